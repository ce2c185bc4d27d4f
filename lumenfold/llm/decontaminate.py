"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of all characters from U+0080 on, with A-Z lower-cased. Fingerprints are
hashes of ``k`` consecutive words; of every ``window - k + 1`` neighbouring ones the least is kept, on both sides, so each
span of ``window`` words that a document shares with an item has a kept fingerprint in common. A document's fingerprint
that the benchmark has too is extended to the windows around it, and the windows of both sides are joined: words decide,
hashes only bring candidates together. Hits of neighbouring windows make up a span. An item of fewer words than a window
is one window of its own length.

Of the documents only windows that the benchmark's fingerprints and windows let pass are shuffled: by a bitmap of bounded
size, whatever the benchmark's. So neither the driver nor a task holds the benchmark or its index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import bitmap, cut, marked, met
from lumenfold.llm.words import Words, chunks, grams, greatest, least, texts_of

#: Every byte to itself, A-Z to a-z, other ASCII that isn't a letter or digit to a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Bits of the map of the benchmark's fingerprints and windows (4 MB), at every size of the benchmark.
FILTER_BITS = 1 << 25
#: Java character classes of what words are of, and of what is between them: as FOLD has it.
WORD, GAP = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"


def _winnow(h: np.ndarray, first: np.ndarray, counts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the kept fingerprints start, and the fingerprints; ``first`` and ``counts`` are of the texts in ``h``."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    kh = grams(h, k)
    low = least(kh, window - k + 1)  # by the window's first word
    room = np.repeat(first + counts, counts)[: len(low)] - np.arange(len(low))
    low = np.where(room >= window, low, np.uint64(0))
    padded = np.zeros(len(kh) + window - k, np.uint64)
    padded[window - k :][: len(low)] = low
    at = np.flatnonzero((greatest(padded, window - k + 1) == kh) & (kh != 0))
    return at, kh[at]


def _full(w: Words, n: int) -> np.ndarray:
    """Which runs of n words start at each word and stay in their text (as long as grams() of n)."""
    stop = np.repeat(w.first[1:], w.counts())[: max(len(w) - n + 1, 0)]
    return np.arange(len(stop)) + n <= stop


def _around(w: Words, at: np.ndarray, window: int, k: int) -> np.ndarray:
    """Starts of the windows that have one of the fingerprints, which start at ``at``."""
    full = _full(w, window)
    some = np.zeros(len(full) + window, np.int64)
    np.add.at(some, np.maximum(at + k - window, 0), 1)
    np.add.at(some, at + 1, -1)
    return np.flatnonzero((np.cumsum(some)[: len(full)] > 0) & full)


def _windows(batches, window: int, k: int):
    """The windows of items: gram (its words), hash, n (its length), item, and the hashes of the item's fingerprints."""
    for b in chunks(batches, "text"):
        ids, w = b.column("item").to_pylist(), Words(texts_of(b, "text"), FOLD)
        h, counts, text = w.hashes(), w.counts(), w.text_of()
        grams_, hashes, n, item = [], [], [], []
        for size in sorted({min(int(c), window) for c in counts if c}):
            at = np.flatnonzero(_full(w, size) & (np.minimum(counts[text[: max(len(w) - size + 1, 0)]], window) == size))
            hashes.append(grams(h, size)[at])
            grams_ += [w.buf[w.start[i] : w.end[i + size - 1]] for i in at]
            n += [size] * len(at)
            item += [ids[i] for i in text[at]]
        fp = _winnow(h, w.first[:-1], counts, k, window)[1]
        hashes = np.concatenate([np.empty(0, np.uint64), *hashes, fp]).view(np.int64)
        none = [None] * len(fp)
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams_ + none, pa.binary()), pa.array(hashes), pa.array(n + none, pa.int32()), pa.array(item + none, pa.string())],
            names=["gram", "hash", "n", "item"],
        )


def _probe(shared, lengths: list[int], window: int, k: int):
    """Of each document a row with its number of words, and one for each distinct window that the bitmap lets pass."""

    def run(batches):
        for b in chunks(batches, "text"):
            w = Words(texts_of(b, "text"), FOLD)
            h, counts, text = w.hashes(), w.counts(), w.text_of()
            found: dict[tuple[int, bytes], tuple[int, int, list[int]]] = {}
            for n in lengths:
                if len(h) < n:
                    continue
                g = grams(h, n)
                if n == window:
                    at, fp = _winnow(h, w.first[:-1], counts, k, window)
                    at = _around(w, at[marked(shared.value, fp)], window, k)
                else:
                    at = np.flatnonzero(_full(w, n))
                at = at[marked(shared.value, g[at])]
                for i, t in zip(at.tolist(), text[at].tolist(), strict=True):
                    own = t, w.buf[w.start[i] : w.end[i + n - 1]]
                    found.setdefault(own, (n, int(g[i].view(np.int64)), []))[2].append(i - int(w.first[t]))
            rows = np.arange(len(counts))
            own = np.concatenate([rows, np.array([t for t, _ in found], np.int64)])
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(rows)) if not found else pa.concat_arrays([b.column("id"), pa.nulls(len(found), b.column("id").type)]),
                    b.column("k1").take(pa.array(own)),
                    b.column("k2").take(pa.array(own)),
                    pa.array([*counts.tolist(), *[None] * len(found)], pa.int64()),
                    pa.array([*none, *[x for _, x in found]], pa.binary()),
                    pa.array([*none, *[x[1] for x in found.values()]], pa.int64()),
                    pa.array([*none, *[x[0] for x in found.values()]], pa.int32()),
                    pa.array([*none, *[x[2] for x in found.values()]], pa.list_(pa.int32())),
                ],
                names=["id", "k1", "k2", "n_words", "gram", "hash", "n", "at"],
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _spans(batches):
    """hits (lists of windows' lengths and starts) of each row as merged spans."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for b in batches:
        out = [[{"start": lo, "stop": hi} for lo, hi in merged([(i, i + x["n"]) for x in xs for i in x["at"]])] for xs in b.column("hits").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), pa.array(out, kind)], names=["h1", "h2", "spans"])


def _index(benchmark: DataFrame, item_id: str, item_text: str, window: int, k: int) -> tuple[DataFrame, list[int], object]:
    """Items' windows (gram, hash, item), their lengths, and the broadcast bitmap of their fingerprints and windows."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    own = cut(items.mapInArrow(lambda batches: _windows(batches, window, k), "gram binary, hash bigint, n int, item string"))
    lengths = sorted(r["n"] for r in own.filter("n is not null").select("n").distinct().collect())  # window at most
    shared = benchmark.sparkSession.sparkContext.broadcast(bitmap(own.select("hash"), FILTER_BITS))
    return own.filter("gram is not null").select("gram", "hash", "item"), lengths, shared


def _keys(id_col: str, text_col: str) -> list:
    """k1 and k2, hashes of the id and the text: rows that have both in common are alike."""
    key = F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")]


def _hits(docs: DataFrame, index: tuple, id_col: str, text_col: str, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Documents (id, k1, k2, n_words) and their windows that items have (k1, k2, gram, hash, n, at)."""
    own, lengths, shared = index
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_keys(id_col, text_col))
    kind = rows.schema["id"].dataType.simpleString()
    found = cut(rows.mapInArrow(_probe(shared, lengths, window, k), f"id {kind}, k1 bigint, k2 bigint, n_words bigint, gram binary, hash bigint, n int, at array<int>"))
    ours = own.select(F.col("gram").alias("own"), "hash").distinct()
    near = found.filter("gram is not null").select("k1", "k2", "gram", "hash", "n", "at")
    near = met(near, ours, "hash").filter("gram = own").drop("own").dropDuplicates(["k1", "k2", "gram"])
    return found.filter("n_words is not null").select("id", "k1", "k2", "n_words"), near


def _judged(rows: DataFrame, near: DataFrame, share: float) -> DataFrame:
    """h1, h2 (the keys of each document with hits), spans and n_hit; spans are null of those that have ``share`` of their words hit."""
    spans = near.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.collect_list(F.struct("n", "at")).alias("hits"))
    spans = spans.mapInArrow(_spans, "h1 bigint, h2 bigint, spans array<struct<start:int,stop:int>>")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    words = rows.select("k1", "k2", "n_words").distinct()
    found = words.join(spans, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")))
    return found.select("h1", "h2", F.when(n_hit < share * F.col("n_words"), F.col("spans")).alias("spans"), n_hit.alias("n_hit"))


def _without(text, spans):
    """The text without the words of ``spans`` and what separates each from the next word."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD}+{GAP}*)"), F.lit(1))
    left = F.filter(words, lambda _, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["stop"])))
    return F.concat(F.regexp_extract(text, f"^{GAP}*", 0), F.array_join(left, ""))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    k: int = 7,
) -> DataFrame:
    """For each document: the id, n_words, spans (merged half-open ranges of word numbers inside a shared window) and items.

    ``items`` has the ids, as text, of the items of which a window occurs, sorted. Rows stay separate when ids repeat;
    a null text has no words; items without words have no window; a null item id counts as the empty text. An empty
    benchmark gives no hits. Only the id and the text are read, so other columns can't clash. A word repeated very often is
    one window with many places, so runs of one word cost what other texts of that length do.
    """
    index = _index(benchmark, item_id, item_text, window, k)
    rows, near = _hits(docs, index, id_col, text_col, window, k)
    own, near = index[0], cut(near)
    spans = near.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.collect_list(F.struct("n", "at")).alias("hits"))
    spans = spans.mapInArrow(_spans, "h1 bigint, h2 bigint, spans array<struct<start:int,stop:int>>")
    names = met(near.select("k1", "k2", "gram", "hash"), own.select(F.col("gram").alias("own"), "hash", "item").distinct(), "hash").filter("gram = own")
    names = names.select("k1", "k2", "item").distinct().groupBy(F.col("k1").alias("i1"), F.col("k2").alias("i2")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = rows.join(spans, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    out = out.join(names, (F.col("k1") == F.col("i1")) & (F.col("k2") == F.col("i2")), "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def verdicts(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest of leaks(): n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more are hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    share: float = 0.05, window: int = 13, k: int = 7,
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of whose words less than ``share`` (or none) are in shared windows.

    Null and empty texts stay, as do all rows if the benchmark is empty; of rows with one id each is judged by its own text,
    and equal rows go or stay together. The columns travel in one struct, so names can't clash.
    """
    rows, near = _hits(docs, _index(benchmark, item_id, item_text, window, k), id_col, text_col, window, k)
    bad = cut(_judged(rows, near, share).filter("spans is null").select("h1", "h2"))
    packed = docs.select(F.struct("*").alias("row"), *_keys(id_col, text_col))
    clean = packed.join(bad, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left_anti")
    return clean.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def clean(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    share: float = 0.05, window: int = 13, k: int = 7,
) -> DataFrame:
    """drop_contaminated(), and of the rows that stay the words in shared windows are cut out; n_cut, how many, is beside the columns.

    So no window of the benchmark is in the result, however long its document. A row in whose text the words around a cut
    make up a window anew goes too. What separates a word that is cut from the next one is cut with it; all else keeps its
    spelling. An input column named n_cut is replaced.
    """
    index = _index(benchmark, item_id, item_text, window, k)
    judged = cut(_judged(*_hits(docs, index, id_col, text_col, window, k), share))
    same = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    some = docs.select(F.col(text_col).alias("text"), *_keys(id_col, text_col)).join(judged.filter("spans is not null"), same)
    some = cut(some.dropDuplicates(["h1", "h2"]).select("h1", "h2", "n_hit", _without(F.col("text"), F.col("spans")).alias("left")))
    again = _hits(some, index, "h1", "left", window, k)[1].select(F.col("k1").alias("a1"), F.col("k2").alias("a2")).distinct()
    some = some.select("*", *_keys("h1", "left")).join(again, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")), "left_anti")
    some = some.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), "left", "n_hit")
    judged = cut(judged.select("h1", "h2").join(some, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")), "left").select("h1", "h2", "left", "n_hit"))
    packed = docs.select(F.struct("*").alias("row"), *_keys(id_col, text_col)).join(judged, same, "left").filter("h1 is null or left is not null")
    return packed.select(
        *[(F.coalesce("left", f"row.`{c}`") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != "n_cut"],
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_cut"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    """verdicts() by comparing every window, for tests."""
    split = lambda t: (t or "").encode().translate(FOLD).split()
    out = []
    for doc_id, text in docs:
        words, hit, found = split(text), set(), set()
        for item_id, item in items:
            own = split(item)
            n = min(window, len(own))
            have = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(words) - n + 1) if n else ():
                if tuple(words[i : i + n]) in have:
                    hit.update(range(i, i + n))
                    found.add("" if item_id is None else str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out
