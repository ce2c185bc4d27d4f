"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is a logistic regression on its hashed words; a document's is the noisy-or of its sentences' scores,
1 - prod(1 - p). Only documents have labels, and the gradient reaches each sentence through the noisy-or, so the model
learns which sentences make a document toxic, and points at them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.words import Words, chunks, mix, texts_of

#: Hashed features, labelled rows that a model learns from at most, steps of its training, and the toxic threshold.
BITS, MAX_LABELLED, STEPS, TOXIC = 20, 20_000, 150, 0.7
#: Bytes of an inner run, and by how many standard deviations a feature is to stand out.
GRAM, SIGNIFICANT = 5, 4.9
#: Text bytes that are split into features at once, in training and in scoring.
BLOCK_BYTES = 1 << 18

#: A-Z to a-z; sentence ends to \x01, line ends too; other ASCII that isn't a letter or digit to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90
    else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122
    else 1 if c in b".!?\n" else 32
    for c in range(256)
)


class Bags:
    """The sentences with words of some texts, and their hashed features.

    feature, part: each feature and the number of its sentence; own, lo, hi: each sentence's text and span of bytes.
    Features are words, their first 4, 5 and 6 bytes, and all runs of 5 bytes in a word: insults are inflected.
    """

    def __init__(self, texts: list[bytes | None], bits: int = BITS):
        folded = [t.translate(_FOLD) if t else b"" for t in texts]
        buf = b"\n".join([*folded, b""])
        a = np.frombuffer(buf, np.uint8)
        letter = a > 32
        stops = np.flatnonzero(~letter)
        starts = np.zeros_like(stops)
        starts[1:] = stops[:-1] + 1
        kinds = a[stops]
        text = np.cumsum(kinds == 10) - (kinds == 10)
        part = np.cumsum(kinds != 32) - (kinds != 32)
        full = stops > starts
        starts, stops, text, part = starts[full], stops[full], text[full], part[full]
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(part))[: len(lead)] - 1
        base = np.cumsum([0] + [len(t) + 1 for t in folded])
        self.own = text[lead]
        self.lo, self.hi = starts[lead] - base[self.own], stops[last] - base[self.own]
        part = np.cumsum(new) - 1
        w = Words.__new__(Words)
        w.buf, w.start, w.end, w.first = buf, starts, stops, None
        eight = np.ndarray((len(buf) + 1,), "<u8", np.frombuffer(buf + bytes(9), np.uint8), strides=(1,))
        features, parts = [w.hashes()], [part]
        size = stops - starts
        for k in (4, 5, 6):
            long = size >= k
            features.append(mix((eight[starts[long]] & np.uint64((1 << (8 * k)) - 1)) + np.uint64(k << 59)))
            parts.append(part[long])
        inside = letter.copy()
        for k in range(1, GRAM):
            inside[: len(a) - k] &= letter[k:]
            inside[len(a) - k :] = False
        at = np.flatnonzero(inside)
        features.append(mix(eight[at] & np.uint64((1 << (8 * GRAM)) - 1)))
        word = np.zeros(len(a), np.int32)
        word[starts] = 1
        parts.append(part[np.cumsum(word)[at] - 1] if len(part) else at)
        self.feature = (np.concatenate(features) >> np.uint64(64 - bits)).astype(np.int64)
        self.part = np.concatenate(parts)


@dataclass
class Model:
    """Weights of the hashed features, and the bias of a sentence."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, texts: list[bytes | None]):
        """Of each text its score; and of each sentence with words: score, text, byte span."""
        bags = Bags(texts, self.bits)
        weight = self.weights[bags.feature]
        known = np.flatnonzero(weight)
        z = self.bias + np.bincount(bags.part[known], weight[known], len(bags.own))
        stay = -np.logaddexp(0, z)  # log of 1 - p
        return -np.expm1(np.bincount(bags.own, stay, len(texts))), -np.expm1(stay), bags.own, bags.lo, bags.hi


def train(texts: list[bytes | None], labels: np.ndarray, bits: int = BITS, steps: int = STEPS) -> Model:
    """Fit to labelled texts: full-batch Adam on the documents' log loss, with a small quadratic penalty on the weights.

    Only features take part that are in toxic texts more often than chance has it (``SIGNIFICANT`` standard deviations);
    equal texts count once. Without any text, or with labels of one kind only, scores are about the share of toxic texts.
    """
    once = dict(zip(texts, labels.tolist(), strict=True))
    texts, labels = list(once), np.array(list(once.values()), np.int64)
    n = len(texts)
    with_it, toxic = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    n_parts = 0

    def blocks():
        size, lo = 0, 0
        for i, t in enumerate(texts):
            size += len(t or b"")
            if size > BLOCK_BYTES or i == n - 1:
                yield lo, i + 1
                size, lo = 0, i + 1

    for lo, hi in blocks():
        bags = Bags(texts[lo:hi], bits)
        n_parts += len(bags.own)
        pair = np.unique(bags.feature * (hi - lo) + bags.own[bags.part])
        with_it += np.bincount(pair // (hi - lo), minlength=1 << bits)
        pair = pair[labels[lo + pair % (hi - lo)] > 0]
        toxic += np.bincount(pair // (hi - lo), minlength=1 << bits)
    rate = (labels.sum() + 0.05) / (n + 1)
    model = Model(np.zeros(1 << bits, np.float32), float(np.log(rate / max(n_parts / max(n, 1), 1))), bits)
    if not n_parts or labels.min() == labels.max():
        return model
    excess = (toxic - rate * with_it) / np.sqrt(rate * (1 - rate) * with_it + 1e-9)
    chosen = np.flatnonzero((excess >= SIGNIFICANT) & (toxic >= 3))
    number = np.full(1 << bits, -1)
    number[chosen] = np.arange(len(chosen))
    owns, parts, features, base = [], [], [], 0
    for lo, hi in blocks():
        bags = Bags(texts[lo:hi], bits)
        f = number[bags.feature]
        at = np.flatnonzero(f >= 0)
        features.append(f[at])
        parts.append(bags.part[at] + base)
        owns.append(bags.own + lo)
        base += len(bags.own)
    f, part, own = np.concatenate(features), np.concatenate(parts), np.concatenate(owns)
    w = np.zeros(len(chosen) + 1)
    w[-1] = model.bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(part, w[f], len(own))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        log_stay = np.bincount(own, -np.logaddexp(0, z), n)
        odds = np.where(labels > 0, np.exp(log_stay) / np.maximum(-np.expm1(log_stay), 1e-12), -1.0)
        g = -p * odds[own]  # of the loss by each sentence's z
        grad = np.append(np.bincount(f, g[part], len(chosen)), g.sum()) / n
        grad[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    model.weights[chosen] = w[:-1]
    model.bias = float(w[-1])
    return model


def bucket_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text (null: the empty text), modulo n."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    bits: int = BITS,
    held_out=lambda id_col: bucket_of(id_col, 3) == 1,
) -> Model:
    """A model of the labelled rows that aren't held out: all, or the ``max_labelled`` ids that come first by a hash.

    An id is toxic if one of its label rows says so; null labels and ids say nothing. Of an id's texts the one that comes
    first by its bytes is taken. The ids and labels are broadcast, and their texts meet in one task, which trains:
    max_labelled bounds both. Only the weights that aren't zero come to the driver.
    """
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_labelled)
    )
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id")
    rows = rows.select("__id", F.col("__label").alias("label"), F.encode("__text", "UTF-8").alias("text"))

    def run(batches):
        bags: dict = {}
        for b in batches:
            for i, label, text in zip(*(b.column(c).to_pylist() for c in ("__id", "label", "text")), strict=True):
                if i not in bags or (text or b"") < (bags[i][1] or b""):
                    bags[i] = label, text
        ordered = [bags[i] for i in sorted(bags)]
        model = train([t for _, t in ordered], np.array([y for y, _ in ordered], np.int64), bits)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_pydict({"feature": [at], "weight": [model.weights[at].astype(np.float64)], "bias": [model.bias]})

    found = rows.repartition(1).mapInArrow(run, "feature array<bigint>, weight array<double>, bias double").collect()
    if not found:  # no labelled text, and so no batch
        return train([], np.empty(0, np.int64), bits)
    model = Model(np.zeros(1 << bits, np.float32), found[0]["bias"], bits)
    model.weights[found[0]["feature"]] = found[0]["weight"]
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", at: float = 0.5) -> DataFrame:
    """For each row: the id, score (0 to 1) and offending: the sentences that score ``at`` or more, with their scores.

    Sentences end at ``.``, ``!``, ``?`` or a line's end. A null or empty text, and one without words, has score 0. Each
    row is scored by itself, so repeated rows and ids don't matter; an empty table gives no rows; only the id and the text
    are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks(batches, "text", BLOCK_BYTES):
            texts = texts_of(b, "text")
            scores, parts, own, lo, hi = shared.value.score(texts)
            found: list[list] = [[] for _ in texts]
            for i in np.flatnonzero(parts >= at):
                t = texts[own[i]][lo[i] : hi[i]].decode(errors="replace")
                found[own[i]].append({"sentence": t, "score": float(parts[i])})
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array(scores, pa.float64()),
                    pa.array(found, pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))),
                ],
                names=["id", "score", "offending"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, score double, offending array<struct<sentence:string,score:double>>")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = TOXIC) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``threshold``.

    Null and empty texts score 0 and stay; rows are judged one by one, so equal ones go or stay together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks(batches, text_col, BLOCK_BYTES):
            yield b.filter(pa.array(shared.value.score(texts_of(b, text_col))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
