import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenfold.llm import ctw

SCHEMA = "doc_id long, text string, held boolean, score string"


class Slow:
    """The model as it is defined, with dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for t in texts:
            for ctx, node, bit in self.decisions(t):
                for d in range(depth + 1):
                    self.counts[ctx[:d], node][bit] += 1
                    if d:
                        self.kids[ctx[: d - 1], node].add(ctx[:d])

    def decisions(self, text):
        b = bytes([ctw.END]) * self.depth + text + bytes([ctw.END])
        for i in range(self.depth, len(b)):
            ctx = tuple(b[i - k] for k in range(1, self.depth + 1))
            node = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                yield ctx, node, bit
                node = 2 * node + bit

    def own(self, ctx, node):
        a, b = self.counts[ctx, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def all(self, ctx, node):
        if len(ctx) == self.depth:
            return self.own(ctx, node)
        below = sum(self.all(c, node) for c in sorted(self.kids[ctx, node]))
        return np.logaddexp(self.own(ctx, node), below) - math.log(2)

    def p(self, ctx, node, bit, d=0):
        c = self.counts.get((ctx[:d], node))
        if not c or not sum(c):
            return None
        kt = (c[bit] + 0.5) / (sum(c) + 1)
        deeper = self.p(ctx, node, bit, d + 1) if d < self.depth else None
        if deeper is None:
            return kt
        w = math.exp(self.own(ctx[:d], node) - math.log(2) - self.all(ctx[:d], node))
        return w * kt + (1 - w) * deeper

    def score(self, text):
        return sum(math.log10(self.p(*x) or 0.5) for x in self.decisions(text))


def data():
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "The", "é", "ab", "q\tz"]) for _ in range(r.randrange(12)))) for i in range(40)]
    return rows + [(None, "the"), (3, None), (3, ""), (7, "zzz"), (7, "zzz"), (8, "ÿ\x00~")]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_as_defined(spark, depth, monkeypatch):
    monkeypatch.setattr(ctw, "BATCH_BYTES", 150)
    rows = data()
    got = ctw.score(spark.createDataFrame([(*r, True, "") for r in rows], SCHEMA), depth=depth).collect()
    train = [(t or "").encode() for i, t in rows if not held(i)]
    slow = Slow(train, depth)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(w for t in train for w in tokens(t.decode()))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((i, held(i), len(w), sum(count[x] > 0 for x in w), n, base, slow.score((t or "").encode())))
    key = lambda r: (str(r[0]), r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_bytes_sum_to_one():
    texts = [b"abracadabra", b"abba", "héé".encode()]
    run, n = ctw.runs(texts, 3)
    keys, count = np.unique(run, return_counts=True)
    tree = ctw.levels(keys, count, 3, 0)
    for ctx in (0x616261, 0x7A7A7A, 0xFFFFFF):
        p = 10 ** ctw.log10_p(np.uint64(ctx << 8) + np.arange(256, dtype=np.uint64), tree)
        assert p.sum() == pytest.approx(1)


def test_empty_table_and_long_text(spark):
    assert ctw.score(spark.createDataFrame([], SCHEMA)).collect() == []
    got = ctw.score(spark.createDataFrame([(1, "ab " * 300_000, True, ""), (10, "ab", True, "")], SCHEMA)).collect()
    assert {r.n_bytes for r in got} == {900_000, 2}


def test_held_out_texts_are_better_than_the_baseline(spark):
    out = ctw.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
