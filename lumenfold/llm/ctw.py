"""Language-model scores by context-tree weighting over bytes, beside a unigram baseline.

Each byte is eight binary decisions, and each decision has a tree of contexts: the 0 to ``depth`` bytes before. A context's
own estimate is Krichevsky-Trofimov's; with P_e of that and P_w = (P_e + product of its children's P_w) / 2, a prediction
mixes the estimates of all depths with weights P_e / (2 P_w). Counts come from the training texts, all of them. A decision
that was never made in a context takes the estimate of the next shorter one. A text ends with a byte of its own, and what
comes before a text is that byte too; so probabilities of all texts sum to one.

With fixed counts, a byte's probability depends on it and its context alone. So a batch of texts asks once for each
distinct run of depth + 1 bytes (and for each distinct word's count), shard by shard; shards merge the counts of all
batches, answer, and the answers meet the batch's texts again, which travel compressed. A shard has whole subtrees: all
runs whose two last context bytes are the same; only the two upper levels, at most 257 contexts, are summed up for all.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut
from lumenfold.llm.toxicity import bucket_of
from lumenfold.llm.words import chunks, mix, texts_of

#: Bytes of context, text bytes of a batch, of a shard (on average) and of a task that scores texts, and the most shards.
DEPTH, BATCH_BYTES, SHARD_BYTES, TASK_BYTES, MAX_SHARDS = 5, 8 << 20, 64 << 20, 256 << 20, 4096
#: The byte that ends texts; UTF-8 never has it.
END = 255
_LN2, _LN10 = float(np.log(2)), float(np.log(10))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _dump(x) -> bytes:
    return zstandard.compress(pickle.dumps(x, 5), 3)


def _load(b: bytes):
    return pickle.loads(zstandard.decompress(b))


def runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of each byte: nearest context byte first (most significant), then farther ones, then the byte; and the
    number of bytes of each text with its end."""
    pad = bytes([END])
    buf = np.frombuffer(pad * depth + b"".join(t + pad * depth for t in texts), np.uint8)
    n = np.array([len(t) + 1 for t in texts], np.int64)
    v = np.zeros(len(buf) - depth, np.uint64)
    for k in range(depth + 1):  # k bytes back
        shift = 8 * (depth - k + 1) if k else 0
        v |= buf[depth - k : len(buf) - k].astype(np.uint64) << np.uint64(shift)
    own = np.ones(len(v), bool)  # but for the padding after each end
    if depth > 1:
        stop = np.cumsum(n + depth - 1)
        own[(stop[:, None] - np.arange(1, depth)[None, :]).ravel()] = False
    return v[own], n


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma_half(zeros) + _log_gamma_half(ones) - _log_factorial(zeros + ones)


_SMALL = 4096
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL + 1)))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log(gamma(n + 1/2) / gamma(1/2))"""
    out = _HALF[np.minimum(n, _SMALL)]
    big = n > _SMALL
    out[big] = _stirling(n[big] + 0.5) - 0.5 * np.log(np.pi)
    return out


def _log_factorial(n: np.ndarray) -> np.ndarray:
    out = _WHOLE[np.minimum(n, _SMALL)]
    big = n > _SMALL
    out[big] = _stirling(n[big] + 1.0)
    return out


class Level:
    """The contexts of one depth, for one of the eight decisions: sorted keys (context, upper bits), counts, log P_w."""

    def __init__(self, run: np.ndarray, count: np.ndarray, k: int):
        key = run >> np.uint64(8 - k)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        lead = np.flatnonzero(new)
        bit = ((run >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        self.k, self.keys = k, key[lead]
        self.ones = np.add.reduceat(count * bit, lead) if len(lead) else np.empty(0, np.int64)
        self.zeros = (np.add.reduceat(count, lead) if len(lead) else np.empty(0, np.int64)) - self.ones
        self.own = log_kt(self.zeros, self.ones)
        self.all = self.own

    def weigh(self, below: np.ndarray) -> None:
        """below: log of the product of the children's P_w."""
        self.all = np.logaddexp(self.own, below) - _LN2

    def children(self, child: Level) -> np.ndarray:
        low = np.uint64((1 << self.k) - 1)
        parent = (child.keys >> np.uint64(8 + self.k)) << np.uint64(self.k) | (child.keys & low)
        return np.bincount(np.searchsorted(self.keys, parent), child.all, len(self.keys))

    def estimate(self, run: np.ndarray, depth_left: int):
        """Of each run: whether its decision was seen here, the estimate of its bit, and that estimate's weight."""
        symbol = (run & np.uint64(255)) >> np.uint64(8 - self.k)
        key = (run >> np.uint64(8 * (depth_left + 1))) << np.uint64(self.k) | symbol
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.zeros(len(run), bool), np.zeros(len(run)), np.zeros(len(run))
        bit = (run >> np.uint64(7 - self.k)) & np.uint64(1)
        n = self.zeros[at] + self.ones[at]
        p = (np.where(bit == 1, self.ones[at], self.zeros[at]) + 0.5) / (n + 1)
        return self.keys[at] == key, p, np.exp(self.own[at] - _LN2 - self.all[at])


def levels(run: np.ndarray, count: np.ndarray, depth: int, top: int) -> list[list[Level]]:
    """For depths ``top`` to ``depth`` the eight levels, weighed. run: sorted; those without a count are left out."""
    run, count = run[count > 0], count[count > 0]
    out: list[list[Level]] = []
    for d in range(depth, top - 1, -1):
        if d < depth:
            key = (run >> np.uint64(16)) << np.uint64(8) | (run & np.uint64(255))
            run, back = np.unique(key, return_inverse=True)
            count = np.bincount(back, count, len(run)).astype(np.int64)
        here = [Level(run, count, k) for k in range(8)]
        if out:
            for a, b in zip(here, out[0], strict=True):
                a.weigh(a.children(b))
        out.insert(0, here)
    return out


def log10_p(run: np.ndarray, tree: list[list[Level]]) -> np.ndarray:
    """log10 of each run's byte after its context. tree: the levels of depths 0, 1, ... in order."""
    depth, total = len(tree) - 1, np.zeros(len(run))
    for k in range(8):
        p = None
        for d in range(depth, -1, -1):
            seen, own, weight = tree[d][k].estimate(run, depth - d)
            if p is None:
                p, known = own, seen
            else:
                p = np.where(known, weight * own + (1 - weight) * p, own)
                known = seen
        total += np.log(np.where(known, p, 0.5))
    return total / _LN10


class Top:
    """Depths 0 and 1, from the counts and log P_w of depth 2 summed by nearest context byte."""

    def __init__(self, rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        run, zeros, ones = (np.array(c, np.int64) for c in columns[:3])
        below = np.array(columns[3], np.float64)
        self.tree: list[list[Level]] = [[], []]
        for k in range(8):
            here = np.flatnonzero((run >> 8 & 255) == k)
            key = (run[here] & 255) << k | run[here] >> 16
            order = np.argsort(key)
            one = self._level(k, key[order], zeros[here][order], ones[here][order])
            one.weigh(below[here][order])
            keys, back = np.unique(one.keys & np.uint64((1 << k) - 1), return_inverse=True)
            sums = [np.bincount(back, x, len(keys)).astype(np.int64) for x in (one.zeros, one.ones)]
            root = self._level(k, keys, *sums)
            root.weigh(root.children(one))
            self.tree[0].append(root)
            self.tree[1].append(one)

    @staticmethod
    def _level(k, keys, zeros, ones) -> Level:
        out = Level(np.empty(0, np.uint64), np.empty(0, np.int64), k)
        out.keys, out.zeros, out.ones = keys.astype(np.uint64), zeros.astype(np.int64), ones.astype(np.int64)
        out.own = log_kt(out.zeros, out.ones)
        return out


def _summary(tree: list[list[Level]]) -> list[tuple[int, int, int, float]]:
    """Depth 2 summed by nearest byte: (upper bits << 16 | decision << 8 | byte, zeros, ones, log P_w)."""
    out = []
    for level in tree[0]:
        k = level.k
        key = (level.keys & np.uint64((1 << k) - 1)) << np.uint64(16) | np.uint64(k << 8) | level.keys >> np.uint64(8 + k)
        keys, back = np.unique(key, return_inverse=True)
        sums = [np.bincount(back, x, len(keys)) for x in (level.zeros, level.ones, level.all)]
        out += zip(keys.tolist(), sums[0].astype(int).tolist(), sums[1].astype(int).tolist(), sums[2].tolist(), strict=True)
    return out


class Batch:
    """What a batch of texts asks for: distinct words and runs, by shard, and how its texts use them."""

    def __init__(self, texts: list[bytes | None], depth: int, shards: int):
        texts = [t or b"" for t in texts]
        words = [t.translate(_FOLD).split() for t in texts]
        self.n_words = np.array([len(w) for w in words], np.int64)
        number: dict[bytes, int] = {}
        self.word = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(self.n_words.sum()))
        self.words = np.array(list(number), object)
        run, self.n_bytes = runs(texts, depth)
        self.run, self.runs = pd.factorize(run)
        shard = (mix(self.runs >> np.uint64(8 * depth - 8)) % np.uint64(shards)).astype(np.int64)
        self.by_run = self._deal(shard, np.argsort(self.runs, kind="stable"))
        shard = pd.util.hash_array(self.words, categorize=False) % np.uint64(shards) if len(self.words) else self.word
        self.by_word = self._deal(shard.astype(np.int64), np.arange(len(self.words)))

    @staticmethod
    def _deal(shard, order):
        order = order[np.argsort(shard[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        return [(int(shard[p[0]]), p) for p in np.split(order, cuts) if len(p)]

    def per_text(self, values: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(n)), n), values, len(n))


_ROWS = "batch bigint, shard bigint, kind string, blob binary"


def _rows(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["batch", "shard", "kind", "blob"])


def _asked(rows: DataFrame, depth: int, shards: int) -> DataFrame:
    """Of batches of (id, held, text) rows: the texts (kind t), and what they ask for by shard (kinds w and r)."""

    def run(batches):
        place = TaskContext.get().partitionId() << 32
        for b in chunks(batches, "text", BATCH_BYTES):
            held = b.column("held").to_numpy(zero_copy_only=False)
            texts = texts_of(b, "text")
            x = Batch(texts, depth, shards)
            train = np.bincount(x.run[np.repeat(~held, x.n_bytes)], minlength=len(x.runs))
            out = [(place, -1, "t", _dump((pa.concat_arrays([b.column("id")]), held, texts)))]
            out += [(place, s, "r", _dump((x.runs[p], train[p].astype(np.int32)))) for s, p in x.by_run]
            train = np.bincount(x.word[np.repeat(~held, x.n_words)], minlength=len(x.words))
            out += [(place, s, "w", _dump((b" ".join(x.words[p]), train[p].astype(np.int32)))) for s, p in x.by_word]
            yield _rows(out)
            place += 1

    return rows.mapInArrow(run, _ROWS)


def _by_shard(batches):
    """(kind, shard, [(batch, blob)]) of rows that come sorted by kind and shard."""
    have, held = None, []
    for b in batches:
        for batch, shard, kind, blob in zip(*(b.column(c).to_pylist() for c in ("batch", "shard", "kind", "blob")), strict=True):
            if (kind, shard) != have and held:
                yield *have, held
                held = []
            have = kind, shard
            held.append((batch, blob))
    if held:
        yield *have, held


def _merge_runs(held):
    parts = [_load(b) for _, b in held]
    run, back = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
    count = np.bincount(back, np.concatenate([c for _, c in parts]), len(run)).astype(np.int64)
    return run, count, np.split(back, np.cumsum([len(r) for r, _ in parts])[:-1])


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=lambda id_col: bucket_of(id_col, 10) == 0, depth: int = DEPTH
) -> DataFrame:
    """For each row: the id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes.

    Everything is learned from the rows that aren't held out. score: log10 of the model's probability of the text, its end
    included; -score * log2(10) / (n_bytes + 1) is the code length in bits per byte. Tokens of the baseline are words (A-Z
    lower-cased, cut at ASCII white space) and one end; its probabilities are (c + 0.1) / (N + 0.1 (V + 1)). A null text
    counts as empty: its end is all it has. Rows that repeat an id are scored and learned from one by one; a null id is
    held out or not as the empty text is. Ids are of any type. An empty table gives no rows; only id and text are read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text_col).alias("text"))
    size, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held"))).collect()[0]
    shards = min(max(2 * slots, -(-size // SHARD_BYTES)), MAX_SHARDS)
    asked = cut(_asked(rows, depth, shards))
    dealt = asked.filter("kind != 't'").repartition(max(slots, shards // 2), "kind", "shard").sortWithinPartitions("kind", "shard")

    def sums(batches):
        for kind, _, held in _by_shard(batches):
            if kind == "r":
                run, count, _ = _merge_runs(held)
                found = _summary(levels(run, count, depth, 2))
            else:
                count = _word_counts(held)[0]
                found = [(-1, int((count > 0).sum()), int(count.sum()), 0.0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ((),) * 4, (pa.int64(),) * 3 + (pa.float64(),), strict=True)],
                names=["key", "zeros", "ones", "below"],
            )

    small = dealt.mapInArrow(sums, "key bigint, zeros bigint, ones bigint, below double")
    small = small.groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("below"))
    found = sorted(tuple(r) for r in small.collect())  # at most 256 * 255 keys, and the words' total
    distinct, words = next((r[1:3] for r in found if r[0] == -1), (0, 0))
    total, kinds = words + ends, distinct + (ends > 0)
    top = spark.sparkContext.broadcast(Top([r for r in found if r[0] >= 0]))
    floor = float(np.log10(total + 0.1 * (kinds + 1)))
    end = float(np.log10(ends + 0.1) - floor)

    def answer(batches):
        for kind, shard, held in _by_shard(batches):
            if kind == "r":
                run, count, backs = _merge_runs(held)
                p = log10_p(run, top.value.tree + levels(run, count, depth, 2)).astype(np.float32)
                out = [(b, shard, "r", _dump(p[back])) for (b, _), back in zip(held, backs, strict=True)]
            else:
                count, backs = _word_counts(held)
                out = [(b, shard, "w", _dump(count[back])) for (b, _), back in zip(held, backs, strict=True)]
            yield _rows(out)

    answers = dealt.mapInArrow(answer, _ROWS)
    met = asked.filter("kind = 't'").unionByName(answers).repartition(max(slots, -(-size // TASK_BYTES)), "batch").sortWithinPartitions("batch", "kind", "shard")
    out_kind = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"

    def finish(batches):
        for held in _by_batch(batches):
            ids, is_held, texts = held["t"][0][1]
            x = Batch(texts, depth, shards)
            count, p = np.zeros(len(x.words), np.int64), np.zeros(len(x.runs))
            for (_, at), (_, values) in zip(x.by_word, held.get("w", ()), strict=True):
                count[at] = values
            for (_, at), (_, values) in zip(x.by_run, held.get("r", ()), strict=True):
                p[at] = values
            base = x.per_text((np.log10(count + 0.1) - floor)[x.word], x.n_words) + end
            known = x.per_text((count > 0)[x.word].astype(float), x.n_words).astype(np.int64) + (ends > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(is_held), pa.array(x.n_words + 1), pa.array(known),
                    pa.array(np.full(len(ids), total)), pa.array(base), pa.array(x.per_text(p[x.run], x.n_bytes)), pa.array(x.n_bytes - 1),
                ],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
            )

    out = met.mapInArrow(finish, out_kind)
    return out.withColumnRenamed("id", id_col)


def _word_counts(held):
    parts = [_load(b) for _, b in held]
    lists = [pa.array(words.split(b" ") if len(n) else [], pa.binary()) for words, n in parts]
    codes = pa.chunked_array(lists, pa.binary()).combine_chunks().dictionary_encode()
    back = codes.indices.to_numpy()
    count = np.bincount(back, np.concatenate([n for _, n in parts]), len(codes.dictionary)).astype(np.int64)
    return count, np.split(back, np.cumsum([len(n) for _, n in parts])[:-1])


def _by_batch(batches):
    """The rows of each batch by kind, in the order of shards."""
    have, held = None, {}
    for b in batches:
        for batch, shard, kind, blob in zip(*(b.column(c).to_pylist() for c in ("batch", "shard", "kind", "blob")), strict=True):
            if batch != have and held:
                yield held
                held = {}
            have = batch
            held.setdefault(kind, []).append((shard, _load(blob)))
    if held:
        yield held
