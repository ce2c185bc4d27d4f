import random

import numpy as np
import pytest

from lumenfold.llm import substrings, words

SCHEMA = "doc_id long, text string, pos int, spans string"


def rows(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "é", "The", "x#", "zz", f"w{r.randrange(50)}"])
    common = [" ".join(word() for _ in range(r.randrange(20, 70))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [r.choice(["", " ".join(word() for _ in range(r.randrange(60)))]), r.choice(common) if r.random() < 0.6 else ""]
        parts += [" ".join(word() for _ in range(r.randrange(30))), "ha " * r.choice([0, 0, 0, 70])]
        out.append((r.randrange(-5, n), r.choice([" ", "\n", " \t\x0b"]).join(parts), 1, "q"))
    out += r.sample(out, 10) + [(None, common[0], 1, ""), (None, common[0], 1, ""), (5, None, 1, ""), (5, "", 1, ""), (7, common[1] + " z", 1, "")]
    return out


def check(spark, data, **kw):
    got = [tuple(r) for r in substrings.dedup(spark.createDataFrame(data, SCHEMA), **kw).collect()]
    want = substrings.brute_force([r[:2] for r in data], kw.get("window", 20))
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    assert sum(r[2] for r in check(spark, rows(seed))) > 300


def test_small_windows_and_batches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 500)
    check(spark, rows(7), window=5)
    check(spark, rows(8), window=2)


def test_hash_collisions_decide_nothing():
    data = [(i, t) for i, t, *_ in rows(4) if i is not None]
    pos, key = np.array([i for i, _ in data]), np.arange(len(data))
    real = words.grams
    for bits in (64, 4, 1):
        substrings.grams = lambda h, n, b=bits: real(h, n) & np.uint64((1 << b) - 1)
        try:
            out, had = substrings.send(pos, key, [(t or "").encode() for _, t in data], 20, 3, np.empty(0, np.uint64), 3)
            by = {}
            for bucket, blob in out:
                by.setdefault(bucket, []).append(blob)
            found = {(p, k, s + j) for p, k, s, n in zip(*had, strict=True) for j in range(n)}
            for blobs in by.values():
                p, k, s, _ = substrings.later_copies(blobs, 20)
                found |= set(zip(p.tolist(), k.tolist(), s.tolist(), strict=True))
        finally:
            substrings.grams = real
        first, want = {}, set()
        cut = [(i, (t or "").split()) for i, t in data]
        for i, w in cut:
            for s in range(len(w) - 19):
                first[tuple(w[s : s + 20])] = min(first.get(tuple(w[s : s + 20]), (i, s)), (i, s))
        for n, (i, w) in enumerate(cut):
            want |= {(i, n, s) for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (i, s)}
        assert found == want


def test_frequent_runs(spark):
    data = [(i, f"a b c d{i} e{i}", 1, "") for i in range(300)]
    df = substrings._keyed(spark.createDataFrame(data, SCHEMA), "doc_id", "text")
    n, often = substrings.frequent(df, rate=10)
    h = words.grams(words.Words([b"a b c"]).hashes(), 3)
    assert n == 1500 and often.tolist() == h.tolist()


def test_empty_and_long(spark):
    assert check(spark, []) == []
    assert check(spark, [(1, None, 1, "")]) == [(1, 0, 0, "")]
    long = " ".join(f"w{i}" for i in range(200_000))
    got = check(spark, [(2, long, 1, ""), (1, long + " more", 1, "")])
    assert sorted(r[2] for r in got) == [0, 200_000]
