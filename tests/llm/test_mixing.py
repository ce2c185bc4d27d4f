import math
from collections import defaultdict
from fractions import Fraction

import pytest

from lumenfold.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, taken string"


def targets(sizes):
    """Caps applied round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = Fraction(3, 2) * sum(sizes.values()), {}, set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def docs(n=900):
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), ["a", "B", "é", None, "zz"][0 if i % 3 else i % 5], 1, "") for i in range(n)]
    return rows + [(5, None, "a", 1, ""), (5, "x y", "a", 1, ""), (5, "x y", "a", 1, ""), (None, "q", "void", 1, ""), (8, "", "none", 1, "")]


def test_contract(spark):
    rows = docs()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), defaultdict(int)
    by = {(sizes[s], float(want[s])): s for s in sizes}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        s = next(v for k, v in by.items() if k[0] == r.source_size and math.isclose(k[1], r.target, rel_tol=1e-9))
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS, s
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_seats_are_the_highest_quotients(spark):
    claims = [(1, i, float(c)) for i, c in enumerate([0, 1, 1, 2, 3.5, 900, 40, 40, 7])] + [(2, 0, 5.0), (3, 0, 0.0), (3, 1, 0.0)]
    for total in (0, 1, 7, 100, 1001):
        df = spark.createDataFrame(claims, "g int, k int, c double").selectExpr("*", f"cast({total} as long) as n")
        got = {(r.g, r.k): r.s for r in mixing.seats(df, ["g"], "k", "c", "n", "s").collect()}
        for g in (1, 2):
            won = defaultdict(int)
            for _ in range(total):
                k = max((c / (2 * won[k] + 1), -k) for q, k, c in claims if q == g)[1]
                won[-k] += 1
            assert {k: v for (q, k), v in got.items() if q == g and v} == {k: v for k, v in won.items() if v}


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as k", "id % 5 as v")
    got = {r.k: r.s for r in mixing.running(df, [df.k.desc()], {"s": "v"}).collect()}
    by, total = {(i * 7919) % 1000: i % 5 for i in range(1000)}, 0
    for k in sorted(by, reverse=True):
        assert got[k] == total
        total += by[k]


@pytest.mark.parametrize("rows", [[], [(1, None, None, 1, "")], [(1, "", "a", 1, ""), (2, " ", "b", 1, "")]])
def test_nothing_to_take(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.taken == 0 and r.target == 0 for r in got)
