"""Exact deduplication of repeated windows of words, by super-k-mers.

A document's windows of ``window`` words are dealt to buckets by their minimiser: the least hash of any ``m`` words in
the window. Consecutive windows with one minimiser travel as one packed string (a super-k-mer) to its bucket. There the
windows are sorted and those of equal words are found, exactly: hashes only bring candidates together, and the words
decide. The first window of each group (smallest id, then earliest start) stays; the others' words are removed.

Where copies would crowd a bucket: a super-k-mer that a batch has already sent is not sent again, as all its windows have
an earlier copy; and the most frequent m-word runs of the corpus (each at least one in 8,192, so there are at most 8,192
of them) are chosen as minimisers only where a window has nothing else, so that windows which merely touch a common
passage are dealt by their own words.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut
from lumenfold.llm.words import Words, chunks, grams, least, mix, texts_of

#: Words of a minimiser's run.
M = 3
#: A run is frequent if it makes up one of so many runs.
FREQUENT = 4096
#: Words of the corpus for each bucket, and text bytes of a batch from which super-k-mers are sent.
BUCKET_WORDS, BATCH_BYTES = 1 << 19, 8 << 20
#: Buckets of a task at most: tasks stay of one size however large the corpus, and whatever spark.sql.shuffle.partitions is.
TASK_BUCKETS = 64
#: A null id counts as this one: it comes first.
NO_ID = -(1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id as it is, pos (for the order) and key (to tell rows with one id apart by their texts)."""
    pos = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(F.col(id_col).alias("id"), pos.alias("pos"), F.col(text_col).alias("text")).withColumn(
        "key", F.xxhash64("pos", "text")
    )


def frequent(rows: DataFrame, m: int = M, rate: int = FREQUENT) -> tuple[int, np.ndarray]:
    """All words, and the sorted hashes of the frequent m-word runs. Counted over all rows, with a bounded result.

    A batch reports the runs that are at least 1 / (2 rate) of its own. A run of at least 1 / rate of the corpus has at
    least half its occurrences in batches that report it, so its reported sum is at least half the share that it has.
    """

    def run(batches):
        for b in chunks(batches, "text", BATCH_BYTES):
            w = Words(texts_of(b, "text"))
            found, n = np.empty(0, np.uint64), np.empty(0, np.int64)
            if len(w) >= m:
                found, n = np.unique(grams(w.hashes(), m), return_counts=True)
                keep = n >= max(2, len(w) / (2 * rate))
                found, n = found[keep], n[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(found.view(np.int64), 0)), pa.array(np.append(n, 0)), pa.array(np.append(n * 0, len(w)))],
                names=["h", "n", "words"],
            )

    counted = rows.select("text").mapInArrow(run, "h bigint, n bigint, words bigint")
    total = cut(counted.groupBy("h").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    words = total.agg(F.sum("words")).collect()[0][0] or 0
    # All n add up to words at most, so that at most 2 * rate runs pass.
    often = sorted(np.int64(r["h"]).view(np.uint64) for r in total.filter(F.col("n") >= max(2, words / (2 * rate))).select("h").collect())
    return words, np.array(often, np.uint64)


def _blob(pos, key, start, packed: list[bytes]) -> bytes:
    head = struct.pack("<q", len(packed)) + pos.tobytes() + key.tobytes() + start.tobytes()
    return zstandard.compress(head + b"\n".join(packed) + b"\n", 3)


def _unblob(blob: bytes):
    raw = zstandard.decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    pos, key, start = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * i) for i in range(3))
    return pos, key, start, raw[8 + 24 * n :]


def send(pos: np.ndarray, key: np.ndarray, texts: list, window: int, m: int, often: np.ndarray, buckets: int):
    """Of one batch: (bucket, blob) for its super-k-mers; and pos, key, start, windows of those it had before."""
    order = np.lexsort((key, pos))
    pos, key = pos[order], key[order]
    w = Words([texts[i] for i in order])
    if len(w) < window:
        return [], None
    low = grams(w.hashes(), m)
    if len(often):
        at = np.minimum(np.searchsorted(often, low), len(often) - 1)
        low = (low >> np.uint64(1)) | ((often[at] == low).astype(np.uint64) << np.uint64(63))
    low = least(low, window - m + 1)
    stop = np.repeat(w.first[1:], w.counts())[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + window <= stop)
    if not len(at):
        return [], None
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]])
    lo = at[new]
    hi = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    text = w.text_of()[lo]
    bucket = (mix(low[lo]) % np.uint64(buckets)).astype(np.int64)
    pos, key, start = pos[text], key[text], lo - w.first[text]
    seen: dict[bytes, int] = {}
    buf, packed, again = w.buf, [], np.zeros(len(lo), bool)
    place = list(zip(pos.tolist(), start.tolist(), strict=True))
    for i, (a, b) in enumerate(zip(w.start[lo].tolist(), w.end[hi + window - 1].tolist(), strict=True)):
        s = buf[a:b]
        packed.append(s)
        again[i] = place[seen.setdefault(s, i)] < place[i]
    had = np.flatnonzero(again)
    rest = np.flatnonzero(~again)
    rest = rest[np.argsort(bucket[rest], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[rest])) + 1
    out = []
    for part in np.split(rest, cuts):
        out.append((int(bucket[part[0]]), _blob(pos[part], key[part], start[part], [packed[i] for i in part])))
    return out, (pos[had], key[had], start[had], hi[had] - lo[had] + 1) if len(had) else None


def later_copies(blobs: list[bytes], window: int):
    """pos, key, start of the windows in a bucket whose words also start earlier."""
    parts = [_unblob(b) for b in blobs]
    pos, key, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
    w = Words.packed(b"".join(p[3] for p in parts))
    stop = np.repeat(w.first[1:], w.counts())
    at = np.flatnonzero(np.arange(len(w)) + window <= stop)
    h = grams(w.hashes(), window)[at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = at[order][twice]
    group = h[order][twice]
    text = w.text_of()[at]
    pos, key, start = pos[text], key[text], start[text] + at - w.first[text]
    order = np.lexsort((start, pos, group))
    at, group, pos, key, start = (x[order] for x in (at, group, pos, key, start))
    lead = _leads(group)
    buf, a, b = w.buf, w.start[at].tolist(), w.end[at + window - 1].tolist()
    if any(buf[a[i] : b[i]] != buf[a[j] : b[j]] for i, j in enumerate(lead.tolist())):  # words that share a hash
        number: dict[bytes, int] = {}
        group = np.array([number.setdefault(buf[x:y], len(number)) for x, y in zip(a, b, strict=True)], np.uint64)
        order = np.lexsort((start, pos, group))
        group, pos, key, start = (x[order] for x in (group, pos, key, start))
        lead = _leads(group)
    late = (pos > pos[lead]) | (start > start[lead])
    return pos[late], key[late], start[late], np.ones(int(late.sum()), np.int64)


def _leads(group: np.ndarray) -> np.ndarray:
    """For each row of sorted groups the place of its group's first row."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else np.empty(0, np.int64)


def _spans(pos, key, start, count) -> pa.RecordBatch:
    """A row for each document: pos, key, and the starts and counts of its runs of windows, as packed 32-bit pairs."""
    order = np.lexsort((start, key, pos))
    pos, key, start, count = pos[order], key[order], start[order], count[order]
    new = np.ones(len(pos), bool)
    doc = np.ones(len(pos), bool)
    doc[1:] = (pos[1:] != pos[:-1]) | (key[1:] != key[:-1])
    new[1:] = doc[1:] | (start[1:] > start[:-1] + count[:-1])
    lo = np.flatnonzero(new)
    until = np.maximum.reduceat(start + count, lo)
    pairs = np.stack([start[lo], until - start[lo]], 1).astype("<i4")
    docs = np.flatnonzero(doc)
    offsets = (np.append(np.searchsorted(lo, docs), len(lo)) * 8).astype(np.int32)
    spans = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(pos[docs]), pa.array(key[docs]), spans], names=["pos", "key", "spans"])


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, m: int = M) -> DataFrame:
    """pos, key, spans: packed (start, count) runs of the windows that also start earlier, several rows a document."""
    rows = _keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    m = min(m, window)
    words, often = frequent(rows, m)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8 * slots, math.ceil(words / BUCKET_WORDS))

    def pack(batches):
        for b in chunks(batches, "text", BATCH_BYTES):
            pos, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "key"))
            out, had = send(pos, key, texts_of(b, "text"), window, m, often, buckets)
            kind = ["n"] * len(out)
            if had is not None:
                spans = _spans(*had)
                out.append((int(key[0]) % buckets, spans.serialize().to_pybytes()))
                kind.append("y")
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int64()), pa.array(kind, pa.string()), pa.array([x for _, x in out], pa.binary())],
                names=["bucket", "done", "blob"],
            )

    schema = pa.schema([("pos", pa.int64()), ("key", pa.int64()), ("spans", pa.binary())])

    def settle(batches):
        have, blobs = None, []
        for b in batches:
            for bucket, done, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "done", "blob")), strict=True):
                if done == "y":
                    yield pa.ipc.read_record_batch(pa.py_buffer(blob), schema)
                    continue
                if bucket != have and blobs:
                    yield _spans(*later_copies(blobs, window))
                    blobs = []
                have = bucket
                blobs.append(blob)
        if blobs:
            yield _spans(*later_copies(blobs, window))

    packed = rows.select("pos", "key", "text").mapInArrow(pack, "bucket bigint, done string, blob binary")
    dealt = packed.repartition(max(slots, math.ceil(buckets / TASK_BUCKETS)), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(settle, "pos bigint, key bigint, spans binary")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, m: int = M) -> DataFrame:
    """For each row: the id, n_words, n_removed and kept (the words that stay, joined by one space).

    Words are what ASCII white space separates, unchanged. A word goes if a window of ``window`` words that covers it also
    starts earlier: in a row of smaller id (null is smallest), or earlier in a row with that id; windows are judged on the
    input, not on what is left. Null and empty texts, and those shorter than a window, lose nothing; null is kept as an
    empty text. Rows that repeat an id take no precedence over each other at the same start, so equal rows get equal
    results. The id is an integer. An empty table gives no rows; only id and text are read.
    """
    rows = _keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    gone = repeats(docs, id_col=id_col, text_col=text_col, window=window, m=m)
    gone = gone.groupBy("pos", "key").agg(F.collect_list("spans").alias("spans"))
    gone = gone.select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), "spans")
    joined = rows.join(gone, (F.col("pos") == F.col("__pos")) & (F.col("key") == F.col("__key")), "left")

    def keep(batches):
        for b in chunks(batches, "text"):
            n, removed, kept = [], [], []
            for text, spans in zip(texts_of(b, "text"), b.column("spans").to_pylist(), strict=True):
                words = text.split() if text else []
                n.append(len(words))
                cover = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    pairs = np.frombuffer(s, "<i4").reshape(-1, 2)
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 0] + pairs[:, 1] + window - 1, -1)
                out = np.cumsum(cover)[:-1] > 0 if spans else cover[:-1] > 0
                removed.append(int(out.sum()))
                if removed[-1]:
                    words = [words[i] for i in np.flatnonzero(~out)]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    out = joined.select("id", "text", "spans").mapInArrow(keep, f"id {kind}, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", id_col)


def brute_force(rows: list[tuple], window: int = 20) -> list[tuple]:
    """dedup() through a dictionary of all windows, for tests."""
    first: dict[tuple, tuple] = {}
    cut = [((NO_ID if i is None else i), (t or "").encode().split()) for i, t in rows]
    for i, words in cut:
        for s in range(len(words) - window + 1):
            g = tuple(words[s : s + window])
            first[g] = min(first.get(g, (i, s)), (i, s))
    out = []
    for (i, words), (doc_id, _) in zip(cut, rows, strict=True):
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = b" ".join(x for n, x in enumerate(words) if n not in gone).decode()
        out.append((doc_id, len(words), len(gone), kept))
    return out
