"""Near-duplicates by ProbMinHash.

A text's elements are its distinct runs of five words (A-Z lower-cased), weighted 1 + ln(count). Each element is a Poisson
process whose rate is its weight; an arrival goes to a random register, and a register keeps the element that comes first.
An element is dropped as soon as its next arrival is later than every register's (early termination). Two texts agree in a
register with the probability of their probability Jaccard similarity, which doesn't depend on the texts' lengths.

Registers are cut into bands. Every text is paired with the smallest id of the bucket that it shares most often, and pairs
are verified on the texts themselves; after that only pairs whose texts are in different classes of one bucket are left to
verify. Those aren't all made: the texts of buckets with several classes are joined on their rarest elements, and only
where both texts' rarer elements leave room for the similarity that is asked for; see prefixes(). Where very many texts
share elements, as copies around one text do, common elements say little: these are compared by how they differ from a text
in their midst and joined on their rarest differences; see differences(). So no pair of a bucket is lost, and neither the
members of a class nor the fringe of a large group are paired among each other. Exact copies share one text and are never
paired at all.
"""

from __future__ import annotations

import gc
import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import Tables, batches_of, bitmap, marked, met
from lumenfold.llm.words import Words, chunks, grams, mix, texts_of

#: Words of a shingle, the similarity of near-duplicates, and the bands with their registers each.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 25, 5
#: Bits of the filter that keeps texts without pairs out of the shuffle, at every size of the input (1 MB).
FILTER_BITS = 1 << 23
#: Text bytes for each shard of elements.
SHARD_BYTES = 1 << 20
#: Texts that a task keeps split into elements while it verifies pairs.
KEPT = 2048
#: Texts that share an element from which on they are joined on differences rather than on elements. Either way is exact.
CROWD = 100
#: Rows that go to Python at once.
BATCH_ROWS = 2048
NO_ID = -(1 << 63)
#: Room for rounding in bounds of the similarity.
SLACK = 1e-6

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def elements(texts: list[bytes | None], shingle: int = SHINGLE):
    """Of all texts: text number, hash and weight of each distinct shingle, in order. A shorter text is one shingle."""
    w = Words(texts, _FOLD)
    h, counts = w.hashes(), w.counts()
    text = w.text_of()
    stop = np.repeat(w.first[1:], counts)
    at = np.flatnonzero(np.arange(len(h)) + shingle <= stop)
    own, key = [text[at]], [grams(h, shingle)[at] if len(at) else np.empty(0, np.uint64)]
    for i in np.flatnonzero((counts > 0) & (counts < shingle)):
        own.append(np.array([i]))
        key.append(grams(h[w.first[i] : w.first[i + 1]], int(counts[i])))
    own, key = np.concatenate(own), np.concatenate(key)
    order = np.lexsort((key, own))
    own, key = own[order], key[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(own)))
    return own[lead], key[lead], 1 + np.log(n)


def signatures(own: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """The elements in each text's k registers; a text without elements has zeros."""
    first = np.full(n * k, np.inf)
    element = np.zeros(n * k, np.uint64)
    time, round_ = np.zeros(len(own)), 0
    while len(own):
        for _ in range(1 if round_ < 3 else 8):
            round_ += 1
            draw = mix(key + np.uint64(round_ * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
            at = own * k + (mix(draw) % np.uint64(k)).astype(np.int64)
            np.minimum.at(first, at, time)
            won = first[at] == time
            element[at[won]] = key[won]
        left = np.unique(own)
        limit = np.zeros(n)
        limit[left] = first.reshape(n, k)[left].max(axis=1)
        stay = time < limit[own]
        own, key, weight, time = own[stay], key[stay], weight[stay], time[stay]
    return element.reshape(n, k)


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each text and band."""
    out = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted keys, weights)."""
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    upto = np.searchsorted(ratio, ratio, "right")
    xs, ys = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(y))
    at = np.flatnonzero((x > 0) & (y > 0))
    return float(np.sum(1 / (xs[upto[at]] / x[at] + (ys[-1] - ys[upto[at]]) / y[at])))


def weighted(text: bytes | None, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """One text's shingles, sorted, and their weights."""
    _, key, weight = elements([text], shingle)
    return key, weight


def _signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, shingle: int) -> DataFrame:
    """pos, c1, c2 (of the whole text), size (bytes) and band keys (null without words) of each row."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("pos"), F.col(text_col).alias("text"))
    d = d.select("pos", F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(1), "text").alias("c2"), F.octet_length("text").cast("long").alias("size"), "text")

    def run(batches):
        for b in chunks(batches, "text"):
            texts = texts_of(b, "text")
            number: dict = {}
            place = np.array([number.setdefault(t or b"", len(number)) for t in texts])
            own, key, weight = elements(list(number), shingle)
            keys = bands_of(signatures(own, key, weight, len(number), bands * rows), bands, rows).view(np.int64)
            full = np.zeros(len(number), bool)
            full[own] = True
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("pos", "c1", "c2", "size")), pa.array([k if f else None for k, f in zip(keys[place], full[place], strict=True)], pa.list_(pa.int64()))],
                names=["pos", "c1", "c2", "size", "bands"],
            )

    return d.mapInArrow(run, "pos bigint, c1 bigint, c2 bigint, size bigint, bands array<bigint>")


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``rows`` (pos, text) whose pos is among ``ids``, and some more: by a bitmap of hashed ids.

    The bitmap is made by a partial aggregation and has FILTER_BITS bits, so what is sent to the driver and broadcast
    is bounded. The more ids, the more other rows pass; the joins that follow drop them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("pos")), FILTER_BITS))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(marked(shared.value, b.column("hash").to_numpy(zero_copy_only=False))))
            yield b.select(["pos", "text"])

    return rows.select("pos", "text", F.xxhash64("pos").alias("hash")).mapInArrow(run, "pos bigint, text string")


def _verified(docs: DataFrame, pairs: DataFrame, kept: Tables, id_col: str, text_col: str, similar: float, shingle: int) -> DataFrame:
    """a, b of the pairs of ids (a > b) whose texts are similar.

    Only texts that are in pairs, and few others, are shuffled: see _likely().
    """
    pairs = kept.keep(pairs)
    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("pos"), F.col(text_col).alias("text"))
    text = _likely(text, pairs.select(F.explode(F.array("a", "b")).alias("pos")))
    one = pairs.join(text, F.col("a") == F.col("pos")).select("a", "b", F.col("text").alias("text_a"))
    two = text.select(F.col("pos").alias("pos_b"), F.col("text").alias("text_b"))
    both = one.join(two, F.col("b") == F.col("pos_b")).select("a", "b", "text_a", "text_b")

    def run(batches):
        seen: dict = {}

        def split(i, text):
            at = i, xxhash.xxh3_128_digest(text or b"")  # an id may have several texts
            if at not in seen:
                if len(seen) >= KEPT:
                    del seen[next(iter(seen))]
                seen[at] = weighted(text, shingle)
            return seen[at]

        for b in chunks(batches, "text_a"):
            a_id, b_id = (b.column(c).to_pylist() for c in ("a", "b"))
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(texts_of(b, "text_a"), texts_of(b, "text_b"), strict=True)):
                keep[i] = similarity(split(a_id[i], x), split(b_id[i], y)) >= similar - 1e-9
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a_id[i] for i in at], pa.int64()), pa.array([b_id[i] for i in at], pa.int64())], names=["a", "b"]
            )

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def _pack(**arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def _unpack(b: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.decompress(b))


def prefixes(own: np.ndarray, key: np.ndarray, weight: np.ndarray, often: np.ndarray, n: int, similar: float):
    """Places of the elements by which n texts are joined, and of each its lead: what its text has before it, by what is left.

    An element's place in its text goes by how many texts have it (``often``), then by its hash. Take two texts of total
    weight X and Y, whose first common element in that order has p before it in one text and q in the other. Nothing before
    it is common. The similarity is the sum over the common elements i of 1 / sum_j max(x_j / x_i, y_j / y_i), and that inner
    sum is X / x_i + q / y_i at least. 1 / (X / x + q / y) is concave and homogeneous, so the sum is 1 / (X / (X - p) + q / (Y - q))
    at most, that is 1 / (1 + lead_x + lead_y) with leads p / (X - p) and q / (Y - q). So two similar texts meet in an element
    where their leads add up to 1 / similar - 1 or less; elements of larger lead aren't needed, nor those of one text only.
    """
    order = np.lexsort((key, often, own))
    weight, own = weight[order], own[order]
    upto = np.cumsum(weight)
    start = np.searchsorted(own, own)
    before = upto - weight - np.where(start > 0, upto[start - 1], 0.0)
    lead = np.maximum(0.0, before) / np.maximum(np.bincount(own, weight, n)[own] - before, weight)
    keep = (often[order] > 1) & (lead <= 1 / similar - 1 + SLACK)
    return order[keep], lead[keep]


def differences(own: np.ndarray, key: np.ndarray, weight: np.ndarray, bases: list[np.ndarray], names: list[int]):
    """Text number, key, weight and kind of what tells each text from its base, a sorted array of elements with a name.

    Kind 1: an element that the base doesn't have. Kind 0: one of the base's that the text doesn't have; its weight is 1, the
    least that any text gives it. Kind 2: one key that all texts of a base have. Keys are of one base.
    """
    first = np.searchsorted(own, np.arange(len(bases) + 1))
    out = []
    for i, (base, name) in enumerate(zip(bases, names, strict=True)):
        k, w, salt = key[first[i] : first[i + 1]], weight[first[i] : first[i + 1]], np.uint64(name)
        more, less = ~np.isin(k, base, assume_unique=True), base[~np.isin(base, k, assume_unique=True)]
        keys = mix(np.concatenate([k[more] ^ salt, ~(less ^ salt), [salt]]))
        kinds = np.repeat(np.array([1, 0, 2], np.int8), [more.sum(), len(less), 1])
        out.append((np.full(len(keys), i), keys, np.concatenate([w[more], np.ones(len(less)), [0.0]]), kinds))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def apart(own: np.ndarray, key: np.ndarray, weight: np.ndarray, kind: np.ndarray, often: np.ndarray, total: np.ndarray, similar: float):
    """Places of the differences by which texts are joined, and of each the weight ``more`` and number ``less`` before it.

    A difference's place in its text goes by how many texts have it, kind 2 last. Take two texts x and y of one base whose first
    common difference has ``more``, ``less`` before it in x and ``more'``, ``less'`` in y, and which lack ``lacks`` and ``lacks'`` of
    the base's elements in all. What comes before is not common. They lack at most s = min(lacks - less, lacks' - less')
    elements both, and what only one of them lacks the other has, with a weight of 1 or more. So x has p >= more + lacks' - s
    that y doesn't have, and y q >= more' + lacks - s that x doesn't have, and by prefixes() the similarity is
    1 / (1 + p / (X - p) + q / (Y - q)) at most: see FITS. As every text has the base's kind 2, any two have a first common difference.
    """
    order = np.lexsort((key, np.where(kind == 2, np.iinfo(np.int64).max, often), own))
    own, weight, kind = own[order], weight[order], kind[order]
    start = np.searchsorted(own, own)

    def before(x):
        upto = np.append(0.0, np.cumsum(x))
        return np.maximum(0.0, upto[:-1] - upto[start])

    more, less = before(np.where(kind == 1, weight, 0.0)), before((kind == 0).astype(float))
    keep = ((often[order] > 1) | (kind == 2)) & (more <= (1 / similar - 1 + SLACK) * (total[own] - more + SLACK))
    return order[keep], more[keep], less[keep]


#: Whether two texts that meet in a difference may be similar; see apart(). The first is what a text needs of the element's others.
FITS_ANY = "more + lacks + least <= {room} * most + 1e-6"
FITS = (
    "more + lacks_x - both < total and more_x + lacks - both < total_x and (more + lacks_x - both) * (total_x - more_x - lacks + both)"
    " + (more_x + lacks - both) * (total - more - lacks_x + both) <= {room} * (total - more - lacks_x + both) * (total_x - more_x - lacks + both) + 1e-6"
).replace("both", "least(lacks - less, lacks_x - less_x)")


def _joinable(kept: Tables, text: DataFrame, similar: float, shingle: int) -> DataFrame:
    """element, lead, pos, root: by which elements the texts (pos, root, text) may be similar to others; see prefixes()."""

    def split(b):
        own, key, weight = elements(texts_of(b, "text"), shingle)
        return {"own": own.astype(np.int32), "key": key, "weight": weight}

    def judged(p, often):
        at, lead = prefixes(p["own"], p["key"], p["weight"], often, len(p["pos"]), similar)
        return at, {"lead": lead}

    return _counted(kept, text, split, judged, ["lead"])


def _differing(kept: Tables, text: DataFrame, similar: float, shingle: int) -> DataFrame:
    """element, more, less, lacks, total, pos, root: by which differences from ``base`` the texts (pos, root, text, base) may be similar to others; see apart()."""

    def split(b):
        own, key, weight = elements(texts_of(b, "text"), shingle)
        total = np.bincount(own, weight, b.num_rows)
        number: dict = {}
        at = [number.setdefault(t or b"", len(number)) for t in texts_of(b, "base")]
        bases, names = [weighted(t, shingle)[0] for t in number], [xxhash.xxh64_intdigest(t) for t in number]
        own, key, weight, kind = differences(own, key, weight, [bases[i] for i in at], [names[i] for i in at])
        return {"own": own.astype(np.int32), "key": key, "weight": weight, "kind": kind, "total": total}

    def judged(p, often):
        at, more, less = apart(p["own"], p["key"], p["weight"], p["kind"], often, p["total"], similar)
        own = p["own"][at]
        lacks = np.bincount(p["own"], p["kind"] == 0, len(p["pos"]))
        return at, {"more": more, "less": less, "lacks": lacks[own], "total": p["total"][own]}

    return _counted(kept, text, split, judged, ["more", "less", "lacks", "total"])


def _counted(kept: Tables, text: DataFrame, split, judged, names: list[str]) -> DataFrame:
    """element, ``names``, pos, root: those keys that ``judged`` keeps of what ``split`` makes of the texts (pos, root, text).

    Batches of texts ask the keys' shards in how many texts of all batches each of theirs is; so a key that very many texts
    have makes a row for each batch, not for each text. Batches' texts travel as their keys.
    """
    size = text.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    shards = size // SHARD_BYTES + 1

    def ask(batches):
        for b in (b for b in chunks(batches, "text") if b.num_rows):
            pos, root = (np.array(b.column(c).to_pylist(), np.int64) for c in ("pos", "root"))
            own = split(b)
            keys, n = np.unique(own["key"], return_counts=True)
            name = int(xxhash.xxh64_intdigest(pos.tobytes())) >> 1
            rows = [(-1, name, _pack(pos=pos, root=root, **own))]
            shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
            for s in np.unique(shard):
                rows.append((int(s), name, _pack(keys=keys[shard == s], n=n[shard == s])))
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "batch", "data"), r, strict=True)) for r in rows], _ASK)

    def answer(t: pa.Table) -> pa.Table:
        parts = [_unpack(d) for d in t.column("data").to_pylist()]
        keys, at = np.unique(np.concatenate([p["keys"] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p["n"] for p in parts]), len(keys)).astype(np.int64)
        out = []
        for p in parts:
            k = np.searchsorted(keys, p["keys"])
            k = k[n[k] > 1]
            out.append(_pack(keys=keys[k], n=n[k]))
        return pa.table({"batch": t.column("batch"), "data": pa.array(out, pa.binary())})

    def judge(t: pa.Table) -> pa.Table:
        parts = [_unpack(d) for d in t.column("data").to_pylist()]
        found = [p for p in parts if "keys" in p]
        keys, n = (np.concatenate([p[c] for p in found] or [np.empty(0, kind)]) for c, kind in (("keys", np.uint64), ("n", np.int64)))
        order = np.argsort(keys)
        keys, n = np.append(keys[order], np.uint64(0)), np.append(n[order], 1)
        columns = [("element", pa.int64()), *((c, pa.float64()) for c in names), ("pos", pa.int64()), ("root", pa.int64())]
        out = [pa.table({c: pa.array([], kind) for c, kind in columns})]
        for p in (p for p in parts if "pos" in p):
            at = np.searchsorted(keys[:-1], p["key"])
            often = np.where((keys[at] == p["key"]) & (at < len(keys) - 1), n[at], 1)
            at, values = judged(p, often)
            own = p["own"][at]
            out.append(pa.table({"element": p["key"][at].view(np.int64), **values, "pos": p["pos"][own], "root": p["root"][own]}))
        return pa.concat_tables(out)

    asked = kept.keep(text.mapInArrow(ask, "shard bigint, batch bigint, data binary"))
    answers = asked.filter("shard >= 0").groupBy("shard").applyInArrow(answer, "batch bigint, data binary")
    both = answers.union(asked.filter("shard < 0").select("batch", "data"))
    return both.groupBy("batch").applyInArrow(judge, f"element bigint, {', '.join(f'{c} double' for c in names)}, pos bigint, root bigint")


_ASK = pa.schema([("shard", pa.int64()), ("batch", pa.int64()), ("data", pa.binary())])


def components(links: DataFrame, kept: Tables | None = None) -> DataFrame:
    """node, root (the smallest node that links lead to) of the nodes in ``links`` (a, b), by alternating stars.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest it knows, until no link is
    new: about log of the longest chain's length. A round is one query, whose result is written as a table, that counts its
    links and those of them that the round before didn't have; nothing is collected.
    """
    kept = kept or Tables(links.sparkSession)
    seen = Observation()
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = kept.keep(edges.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    while n:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = met(both, low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        small = met(large, large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        small = small.filter("a != b").distinct()
        had = edges.select(F.col("a").alias("had_a"), F.col("b").alias("had_b"), F.lit(1).alias("had"))
        seen = Observation()
        small = small.join(had, (F.col("a") == F.col("had_a")) & (F.col("b") == F.col("had_b")), "left")
        edges = kept.keep(small.observe(seen, F.count(F.lit(1)).alias("n"), F.count("had").alias("had")).select("a", "b"))
        before, n = n, seen.get["n"]
        if n == before == seen.get["had"]:
            break
    _release(links)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files and checkpoints of finished rounds: it does when the driver's garbage is collected."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, ra, rb of the pairs whose ends are in different classes."""
    for c in "ab":
        r = roots.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}"))
        pairs = pairs.join(r, F.col(c) == F.col(f"n{c}"), "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c)).drop(f"n{c}")
    return pairs.filter("ra != rb")


def _merged(kept: Tables, roots: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after more links between nodes; only classes that are linked take part."""
    links = kept.keep(_across(links, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    if links.isEmpty():
        return roots
    more = components(links, kept)
    old = roots.select("node", F.col("root").alias("old"))
    new = more.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = met(old, new, "old", "left").select("node", F.coalesce("new", "old").alias("root"))
    return kept.keep(moved.union(more.select("node", "root")))


def _unordered(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that aren't among ``done`` in either order."""
    order = lambda d: d.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    pairs = pairs.withColumns({"hi": F.greatest("a", "b"), "lo": F.least("a", "b")})
    return pairs.join(order(done), ["hi", "lo"], "left_anti").select("a", "b")


def _sided(kept: Tables, by: DataFrame, side: str) -> DataFrame:
    """The rows of elements that several sides have, with ``big``, the side that has most of the element's rows."""
    many = by.groupBy("element", side).count().groupBy("element")
    many = many.agg(F.max_by(side, F.struct("count", side)).alias("big"), F.count(F.lit(1)).alias("sides")).filter("sides > 1")
    return kept.keep(met(by, many.drop("sides"), "element"))


def _paired(by: DataFrame, side: str, fits: str) -> DataFrame:
    """a, b of the rows that share an element, are of different classes and sides, and fit: the element's ``big`` side with all others, and these with each other."""
    two = by.filter(f"{side} != big").drop("big").withColumnsRenamed({c: f"{c}_x" for c in by.columns if c != "element"})
    which = f"root != root_x and pos != pos_x and ({side} = big or pos < pos_x) and {side} != {side}_x"
    return met(by, two, "element").filter(f"{which} and {fits}").select(F.col("pos").alias("a"), F.col("pos_x").alias("b"))


def _crowded(kept: Tables, by: DataFrame) -> DataFrame:
    """pos, root, crowd, base of the texts in elements that CROWD texts have: the class in whose midst each is, and that class's text with least rare elements."""
    many = by.groupBy("element").count().filter(f"count >= {CROWD}").select("element")
    rows = met(by, many, "element", "left_semi").groupBy("pos", "root", F.col("f.root").alias("crowd")).agg(F.count(F.lit(1)).alias("n"), F.min("lead").alias("lead"))
    rows = kept.keep(rows)
    base = rows.filter("root = crowd").groupBy("crowd").agg(F.min(F.struct("lead", "pos")).alias("least"))
    base = base.select(F.col("crowd").alias("of"), F.col("least.pos").alias("base"))
    held = rows.groupBy("pos", "root").agg(F.max_by("crowd", F.struct("n", "crowd")).alias("crowd"))
    return kept.keep(met(held, base.withColumnRenamed("of", "crowd"), "crowd"))


def _among(kept: Tables, plain: DataFrame, crowd: DataFrame, room: float, similar: float, shingle: int) -> DataFrame:
    """a, b of the texts (pos, text) of one crowd and different classes that may be similar by their differences from its base; see apart()."""
    text = _likely(plain, crowd.select("pos")).join(crowd, "pos").select("pos", "root", "text", "base")
    bases = crowd.select(F.col("base").alias("pos")).distinct()
    bases = _likely(plain, bases).join(bases, "pos").select(F.col("pos").alias("base"), F.col("text").alias("base_text")).distinct()
    text = met(text, bases, "base").select("pos", "root", "text", F.col("base_text").alias("base"))
    by = kept.keep(_differing(kept, text, similar, shingle))
    some = by.groupBy("element").agg(F.max("total").alias("most"), F.min(F.col("more") - F.col("lacks")).alias("least"))
    by = met(by, some, "element").filter(FITS_ANY.format(room=room)).drop("most", "least")
    return _paired(_sided(kept, by, "root"), "root", FITS.format(room=room))


def classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similar: float = SIMILAR,
    bands: int = BANDS,
    rows: int = ROWS,
    shingle: int = SHINGLE,
) -> DataFrame:
    """For each row: the id and class_id, the smallest id that near-duplicate links lead to from it (its own, if none).

    Links are pairs of texts of similarity ``similar`` or more that share a band (at 0.8 all but one in 10,000 do), and
    equal texts. Texts without words are in no class but their own; a text of fewer than five words is one shingle. Rows
    that repeat an id are one document with several texts, and in one class. A null id is smaller than all others, and counts as one
    document. The id is an integer. An empty table gives no rows; only id and text are read.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _classes(docs, id_col, text_col, similar, bands, rows, shingle)


def _classes(docs: DataFrame, id_col: str, text_col: str, similar: float, bands: int, rows: int, shingle: int) -> DataFrame:
    """classes(); all that runs Python has run when it returns."""
    kept = Tables(docs.sparkSession)
    signed = kept.keep(_signed(docs, id_col, text_col, bands, rows, shingle))
    copies = signed.filter("bands is not null").groupBy("c1", "c2").agg(F.min("pos").alias("rid"))
    copies = copies.select(F.bitwise_not("c1").alias("r1"), F.col("c2").alias("r2"), "rid")  # see met()
    same = (F.bitwise_not("c1") == F.col("r1")) & (F.col("c2") == F.col("r2"))
    own = kept.keep(signed.join(copies, same, "left").select("pos", F.coalesce("rid", "pos").alias("rid"), F.when(F.col("rid") == F.col("pos"), F.col("bands")).alias("bands")))
    banded = own.filter("bands is not null").select("pos", F.explode("bands").alias("band"))
    low = kept.keep(banded.groupBy("band").agg(F.min("pos").alias("b"), F.max("pos").alias("most")).filter("most > b"))
    low = low.select(F.col("band").alias("in"), "b")
    held = banded.join(low, F.col("band") == F.col("in")).select("band", "pos", "b")
    stars = held.filter("pos != b").groupBy(F.col("pos").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    best = kept.keep(stars.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")))
    several = own.groupBy("pos").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo != hi").select("pos")
    joint = own.filter("rid != pos").join(several, "pos", "left_semi").select(F.col("pos").alias("a"), F.col("rid").alias("b")).distinct()
    verified = lambda pairs: _verified(docs, pairs, kept, id_col, text_col, similar, shingle)
    roots = components(verified(best).union(joint), kept)
    placed = held.join(roots, F.col("pos") == F.col("node"), "left").select("band", "pos", F.coalesce("root", "pos").alias("root"))
    placed = kept.keep(placed)
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    mates = kept.keep(met(placed, split, "band", "left_semi").select("pos", "root").distinct())
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("pos"), F.col(text_col).alias("text"))
    text = _likely(plain, mates.select("pos")).join(mates, "pos").select("pos", "root", "text")
    room = 1 / similar - 1 + 2 * SLACK
    by = kept.keep(_joinable(kept, text, similar, shingle))
    # Each text with the one that has least before the element; then what is left between classes.
    first = by.groupBy("element").agg(F.min(F.struct("lead", "pos", "root")).alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    first = first.filter("lo != hi").select("element", "f")
    near = met(by, first, "element").filter(f"root != f.root and pos != f.pos and lead + f.lead <= {room}")
    near = near.select(F.col("pos").alias("a"), F.col("f.pos").alias("b")).distinct()
    near = kept.keep(_unordered(near, best))
    _release(docs)
    roots = _merged(kept, roots, verified(near))
    by = by.drop("root").join(roots, F.col("pos") == F.col("node"), "left").select("element", "lead", "pos", F.coalesce("root", "pos").alias("root"))
    by = kept.keep(by)
    first = by.groupBy("element").agg(F.min(F.struct("lead", "root")).alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    by = kept.keep(met(by, first.filter("lo != hi").select("element", "f"), "element").filter(f"root = f.root or lead + f.lead <= {room}"))
    crowd, across = _crowded(kept, by), None
    if crowd.isEmpty():
        by = by.withColumn("side", F.struct(F.lit(False).alias("crowded"), F.col("root").alias("id")))
    else:
        across = _among(kept, plain, crowd, room, similar, shingle)
        own_crowd = crowd.select("pos", F.col("crowd").alias("in"))
        side = F.struct(F.col("in").isNotNull().alias("crowded"), F.coalesce("in", "root").alias("id"))
        by = met(by, own_crowd, "pos", "left").withColumn("side", side).drop("in")
    by = _sided(kept, by.drop("f"), "side")
    least = by.filter("side != big").groupBy("element").agg(F.min("lead").alias("least"))
    by = met(by, least, "element").filter(f"side != big or lead + least <= {room}").drop("least")
    pairs = _paired(by, "side", f"lead + lead_x <= {room}")
    across = _unordered((pairs if across is None else pairs.union(across)).distinct(), best.union(near))
    roots = _merged(kept, roots, verified(across))
    roots = kept.keep(roots)
    kept.drop(own, roots)
    out = own.join(roots, F.col("rid") == F.col("node"), "left").select("pos", F.coalesce("root", "rid").alias("root"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(docs.schema[id_col].dataType)
    return out.select(null("pos").alias(id_col), null("root").alias("class_id"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of the document with the smallest id in each class (null is smallest).

    Null and empty texts stay, as they are in no class but their own. Of rows that repeat an id and its text one stays, the
    first by the other columns as JSON; of an id's different texts all stay or go. An empty table gives no rows.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.filter(~F.col("class_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("__gone")).distinct()
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")
    often = found.groupBy(F.col(id_col).alias("__often")).count().filter("count > 1").select("__often")
    same = F.col(id_col).eqNullSafe(F.col("__often"))
    nth = F.row_number().over(Window.partitionBy(id_col, text_col).orderBy(F.to_json(F.struct("*"))))
    once = left.join(often, same, "left_semi").withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    return left.join(often, same, "left_anti").union(once)


def brute_force(rows: list[tuple], similar: float = SIMILAR) -> dict:
    """class ids of distinct non-null ids by comparing all pairs, for tests."""
    sets = {i: weighted((t or "").encode()) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a][0]) and len(sets[b][0]) and find(a) != find(b) and similarity(sets[a], sets[b]) >= similar - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}
