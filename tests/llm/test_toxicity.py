import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm import toxicity

SCHEMA = "doc_id long, text string, score int, toxic string"


def corpus(n=900, seed=1):
    r = random.Random(seed)
    common, bad = [f"word{i}" for i in range(200)], ["awful", "nasty", "VILE"]
    docs, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.2)
        parts = [" ".join(r.choice(common) for _ in range(8)) for _ in range(r.randrange(1, 12))]
        if toxic:
            parts[r.randrange(len(parts))] += f" {r.choice(bad)} {r.choice(common)}"
        docs.append((i, r.choice([". ", "! ", "\n"]).join(parts), 1, ""))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_sentences(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(df, model).withColumn("held_out", toxicity.bucket_of("doc_id", 3) == 1)
    truth = dict(labels)
    held = [r for r in out.collect() if r.held_out]
    assert len(held) > 200
    assert np.mean([(r.score >= toxicity.TOXIC) == truth[r.doc_id] for r in held]) > 0.97
    hits = [r for r in held if truth[r.doc_id] and r.score >= toxicity.TOXIC]
    assert all(any(w in s.sentence.lower() for w in ("awful", "nasty", "vile")) for r in hits for s in r.offending)
    assert sum(bool(r.offending) for r in hits) > 0.9 * len(hits)


def test_no_held_out_label_is_learned(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = lab.withColumn("toxic", F.when(toxicity.bucket_of("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(df, lab), toxicity.fit(df, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_odd_rows(spark):
    docs, labels = corpus(200)
    odd = [(None, "nasty", 1, ""), (3, None, 1, ""), (3, "", 1, ""), (3, "...", 1, ""), (4, "x" * 200_000, 1, ""), (4, "awful. " * 50_000, 1, "")]
    df = spark.createDataFrame(docs + odd + docs[:3], SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 0), (5, 1)], "doc_id long, toxic int")
    rows = toxicity.score(df, toxicity.fit(df, lab)).collect()
    assert len(rows) == 209 and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows if r.doc_id == 3][1:] == [0, 0, 0]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame(corpus(20)[0], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.7 for r in toxicity.score(df, toxicity.fit(df, none)).collect())
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), none)).collect() == []


def test_bounded_sample(spark):
    docs, labels = corpus(600)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.fit(spark.createDataFrame(docs, SCHEMA), lab, max_labelled=150)
    first = lab.filter(toxicity.bucket_of("doc_id", 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(150).collect()
    text = {i: t.encode() for i, t, *_ in docs}
    first = sorted((r.doc_id, r.toxic) for r in first)
    want = toxicity.train([text[i] for i, _ in first], np.array([y for _, y in first]))
    assert got.bias == want.bias and (got.weights == want.weights).all() and got.weights.any()


BASE, M64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def word_hash(w):
    h = mixed((len(w) + BASE) & M64)
    for k in range(0, len(w), 8):
        h = mixed(((h ^ int.from_bytes(w[k : k + 8], "little")) * BASE + k // 8 * 8 + 1) & M64)
    return h


def brute_force(model, text):
    """The noisy-or of the sentences' scores, one feature at a time."""
    stay = 1.0
    for sentence in re.split(rb"[.!?\n]", text.lower()):
        words = re.findall(rb"[a-z0-9\x80-\xff]+", sentence)
        if not words:
            continue
        z = model.bias
        for w in words:
            found = [word_hash(w)]
            found += [mixed((int.from_bytes(w[:k], "little") + (k << 59)) & M64) for k in (4, 5, 6) if len(w) >= k]
            found += [mixed(int.from_bytes(w[i : i + 5], "little")) for i in range(len(w) - 4)]
            z += sum(float(model.weights[f >> (64 - model.bits)]) for f in found)
        stay *= 1 / (1 + math.exp(z))
    return 1 - stay


def test_scores_as_brute_force(spark):
    docs, labels = corpus(400)
    odd = ["", " ", "...", "Nasty!", "awful" * 30 + " é nasty? VILE.\nok", "a.b.c nasty\x00vile 77"]
    df = spark.createDataFrame([*docs, *[(1000 + i, t, 1, "") for i, t in enumerate(odd)]], SCHEMA)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = {r.doc_id: r.text.encode() for r in df.collect()}
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for i, t in texts.items():
        assert abs(got[i] - brute_force(model, t)) < 1e-6, t
    left = {r.doc_id for r in toxicity.drop_toxic(df, model).collect()}
    assert left == {i for i in texts if got[i] < toxicity.TOXIC}
