import random

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import neardup
from lumenfold.llm.common import batches_of

SCHEMA = "doc_id long, text string, pos int, class_id string"


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(300)}"
    out = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([1, 3, 6, 30, 120, 400]))] + ["ha"] * r.choice([0, 0, 40])
        for _ in range(r.choice([1, 1, 2, 3, 9])):
            own = list(base)
            for _ in range(r.randrange(1 + len(own) // 40)):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own))
    r.shuffle(out)
    return [(i * 3 - 50, t, 1, "") for i, t in enumerate(out)]


def slow(a, b):
    """The similarity as it is defined."""
    x, y = dict(zip(*a, strict=True)), dict(zip(*b, strict=True))
    keys = x.keys() | y.keys()
    return sum(
        1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in x.keys() & y.keys()
    )


def test_similarity():
    r = random.Random(1)
    for _ in range(50):
        a, b = ({i: r.choice([1, 2, 5.5]) for i in r.sample(range(30), r.randrange(1, 20))} for _ in range(2))
        pair = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float)) for d in (a, b)]
        assert neardup.similarity(*pair) == pytest.approx(slow(*pair), abs=1e-12)


def test_registers_estimate_the_similarity():
    r = np.random.default_rng(5)
    for n, shared in ((300, 200), (40, 30), (3, 2)):
        keys = r.integers(1, 1 << 62, n + n - shared).astype(np.uint64)
        a, b = np.sort(keys[:n]), np.sort(keys[-n:])
        wa, wb = 1 + np.log(1 + a % 4), 1 + np.log(1 + b % 4)
        own = np.repeat([0, 1], n)
        sig = neardup.signatures(own, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4000)
        assert np.mean(sig[0] == sig[1]) == pytest.approx(neardup.similarity((a, wa), (b, wb)), abs=0.035)


def test_as_brute_force(spark):
    data = corpus(2)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == neardup.brute_force([r[:2] for r in data])
    assert len(set(got.values())) < len(got) - 30


@pytest.mark.parametrize("similar", [0.8, 0.5])
def test_similar_texts_meet_in_an_element(similar):
    r, met = random.Random(3), 0
    for _ in range(300):
        base = {i: r.choice([1, 1, 1, 1.7, 3]) for i in range(12)}
        sets = [{i: w for i, w in base.items() if r.random() < 0.9} | {r.randrange(12, 30): 1.7} for _ in range(6)]
        own = np.concatenate([np.full(len(d), i) for i, d in enumerate(sets)])
        key = np.concatenate([sorted(d) for d in sets]).astype(np.uint64)
        weight = np.array([sets[i][k] for i, k in zip(own, key.tolist(), strict=True)], float)
        often = np.array([sum(k in d for d in sets) for k in key.tolist()])
        at, lead = neardup.prefixes(own, key, weight, often, 6, similar)
        rows = [dict(zip(key[at[own[at] == i]].tolist(), lead[own[at] == i], strict=True)) for i in range(6)]
        pair = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float)) for d in sets]
        for i in range(6):
            for j in range(i):
                if neardup.similarity(pair[i], pair[j]) >= similar:
                    met += 1
                    assert any(rows[i][k] + rows[j][k] <= 1 / similar - 1 + 2 * neardup.SLACK for k in rows[i].keys() & rows[j].keys())
    assert met > 50


@pytest.mark.parametrize("shard", [1 << 20, 3000])
def test_a_large_group_with_a_fringe(spark, monkeypatch, shard):
    monkeypatch.setattr(neardup, "SHARD_BYTES", shard)
    r = random.Random(6)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(220):
        own = list(base)
        for _ in range(r.randrange(7)):
            own[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(own), 1, ""))
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = neardup.brute_force([x[:2] for x in rows])
    assert got == want and 5 < len(set(want.values())) < 200


def around(r, n, words, base, edits):
    """Texts around one of ``words`` words that isn't there unless ``base``: words replaced, dropped, put in and doubled, some in common."""
    own = [f"w{r.randrange(900)}" for _ in range(words)]
    extra, out = [f"c{i}" for i in range(4)], [" ".join(own)] * base
    while len(out) < n:
        text = list(own)
        for _ in range(r.randrange(edits)):
            at, new = r.randrange(len(text)), r.choice([*extra, f"x{r.randrange(10**6)}"])
            text[at : at + 1] = r.choice([[new], [new], [], [text[at], new], [text[at]] * 2])
        out.append(" ".join(text + text[: r.choice([0, 0, 0, 30])]))
    r.shuffle(out)
    return out


def test_a_crowd_around_a_text_is_not_paired(spark, monkeypatch):
    """Of a class and the texts around it that are below the threshold to all of it, few pairs are left to verify."""
    r, tried, own = random.Random(8), [], neardup._verified
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 250):
        text = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 3, 4, 5, 6])):
            text[at] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(text)))

    def counted(docs, pairs, *rest):
        tried.append(pairs.count())
        return own(docs, pairs, *rest)

    monkeypatch.setattr(neardup, "_verified", counted)
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame([(*x, 1, "") for x in rows], SCHEMA)).collect()}
    want = neardup.brute_force(rows)
    assert got == want and 60 < len(set(want.values())) < 200
    print("pairs verified:", tried)
    assert tried[2] < 250, tried


@pytest.mark.parametrize("seed", range(2))
def test_crowds_lose_no_link(spark, monkeypatch, seed):
    """Every element's texts are a crowd: those of several bases, of which some are no text themselves."""
    monkeypatch.setattr(neardup, "CROWD", 2)
    r = random.Random(seed)
    texts = [t for k in range(3) for t in around(r, 40, r.choice([30, 60, 120]), k % 2, r.choice([5, 9]))]
    rows = list(enumerate(texts))
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame([(*x, 1, "") for x in rows], SCHEMA)).collect()}
    assert got == neardup.brute_force(rows)


@pytest.mark.parametrize("similar", [0.8, 0.5])
def test_similar_texts_meet_in_a_difference(similar):
    """Any two similar texts of one base have a common difference at which the joins' conditions hold."""
    r, met = random.Random(5), 0
    fits = neardup.FITS.replace("least(", "min(")
    room = 1 / similar - 1 + 2 * neardup.SLACK
    for _ in range(120):
        texts = [t.encode() for t in around(r, 8, r.choice([8, 20, 40]), 0, 5)]
        n = len(texts)
        own, key, weight = neardup.elements(texts)
        base = neardup.weighted(texts[0])[0]
        total = np.bincount(own, weight, n)
        own, key, weight, kind = neardup.differences(own, key, weight, [base] * n, [7] * n)
        keys, at, count = np.unique(key, return_inverse=True, return_counts=True)
        lacks = np.bincount(own, kind == 0, n)
        at, more, less = neardup.apart(own, key, weight, kind, count[at], total, similar)
        rows = [{} for _ in texts]
        for i, m, s in zip(at, more, less, strict=True):
            rows[own[i]][key[i]] = {"more": m, "less": s, "lacks": lacks[own[i]], "total": total[own[i]]}
        sets = [neardup.weighted(t) for t in texts]
        for i in range(n):
            for j in range(i):
                if neardup.similarity(sets[i], sets[j]) >= similar:
                    met += 1
                    good = False
                    for k in rows[i].keys() & rows[j].keys():
                        x, y = rows[i][k], rows[j][k]
                        held = [d[k] for d in rows if k in d]
                        some = {"most": max(d["total"] for d in held), "least": min(d["more"] - d["lacks"] for d in held)}
                        each = all(eval(neardup.FITS_ANY.format(room=room), {}, d | some) for d in (x, y))
                        good |= each and eval(fits.format(room=room), {}, x | {f"{c}_x": v for c, v in y.items()} | {"min": min})
                    assert good
    assert met > 100


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FILTER_BITS", 32)
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a b c d e f g"), (4, "A b c d e f  g"), (5, None), (6, ""), (7, " \n"), (8, "a b"), (9, "a b"), (9, "a b"), (2, "x y z q r s"), (2, "a b"), (11, long), (12, long + " end")]
    got = neardup.classes(spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    want = {None: {None}, 4: {None}, 5: {5}, 6: {6}, 7: {7}, 8: {2}, 9: {2}, 2: {2}, 11: {11}, 12: {11}}
    for r in got:
        assert r.class_id in want[r.doc_id], r
    assert neardup.classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    got = {x.node: x.root for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {i: i for e in edges for i in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: x for i, x in root.items() if i != x}


def test_planted_copies_are_caught(spark):
    """Of copies with 0 to 8 words in 200 replaced, all are caught whose similarity is 0.8 or more, and no others.

    Four words replaced leave 0.82, six leave 0.74: that copies with more edits are other documents is what the threshold says.
    """
    r = random.Random(11)
    rows, base = [], []
    for i in range(60):
        base.append([f"w{r.randrange(10**6)}" for _ in range(200)])
        rows.append((i, " ".join(base[i])))
    edits = {}
    for k in range(9):
        for i in range(60):
            own = list(base[i])
            for j in r.sample(range(200), k):
                own[j] = f"x{r.randrange(10**6)}"
            edits[1000 * (k + 1) + i] = k, i, " ".join(own)
    rows += [(i, t) for i, (_, _, t) in edits.items()]
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame([(*x, 1, "") for x in rows], SCHEMA)).collect()}
    assert got == neardup.brute_force(rows)
    caught = [sum(got[d] == i for d, (k, i, _) in edits.items() if k == n) / 60 for n in range(9)]
    print("share caught by words replaced in 200:", caught)
    assert min(caught[:4]) == 1.0 and all(got[i] == i for i in range(60))


def test_texts_around_a_common_passage_are_not_paired(spark, monkeypatch):
    """Four fifths of each text is one passage: pairs are below the threshold, and no text but the passage's own is verified much."""
    r = random.Random(12)
    passage = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join(passage + [f"x{r.randrange(10**9)}" for _ in range(r.randrange(16, 24))]), 1, "") for i in range(300)]
    tried = []
    own = neardup._verified

    def counted(docs, pairs, *rest):
        tried.append(pairs.count())
        return own(docs, pairs, *rest)

    monkeypatch.setattr(neardup, "_verified", counted)
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == neardup.brute_force([x[:2] for x in rows])
    assert tried[1] + tried[2] < 300, tried


def test_batches_for_python_are_bounded(spark, monkeypatch):
    """Whatever runs Python in classes() gets few rows at once; the session's setting is as before afterwards."""
    key, sizes, own = "spark.sql.execution.arrow.maxRecordsPerBatch", [], neardup._verified
    before = spark.conf.get(key)

    def counted(docs, *rest):
        n = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        sizes.extend(r.n for r in n.collect())
        return own(docs, *rest)

    monkeypatch.setattr(neardup, "_verified", counted)
    neardup.classes(spark.createDataFrame([(1, "a b c d e f", 1, ""), (2, "a b c d e f g", 1, "")], SCHEMA)).collect()
    assert sum(sizes) == 9000 and max(sizes) <= neardup.BATCH_ROWS < 3000
    assert spark.conf.get(key) == before
    with pytest.raises(ValueError), batches_of(spark, 7):
        assert spark.conf.get(key) == "7"
        raise ValueError
    assert spark.conf.get(key) == before
