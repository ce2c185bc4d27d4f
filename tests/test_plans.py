"""Plans that must keep their shape, and answers that depend on how rows are dealt."""

import datetime as dt
import random
import time

from lumenfold.functions.expr import col, length
from lumenfold.operators.frame import Frame

DAY = dt.datetime(2024, 1, 1)


def events(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, DAY + dt.timedelta(minutes=r.randrange(3000)), r.choice("ab"), float(i)) for i in range(n)]
    return Frame(spark.createDataFrame(rows, "id long, ts timestamp_ntz, k string, v double"))


def test_dynamic_windows_aggregate_before_they_meet_the_grid(spark):
    plan = events(spark).group_by_dynamic("ts", "6h", period="12h", by=["k"]).agg(length().alias("n")).optimized()
    below = plan[plan.index("Aggregate") :]
    assert plan.index("Join") < plan.index("Aggregate") and "Join" not in below.split("Aggregate")[-1]


def test_long_periods_plan_quickly(spark):
    f = events(spark)
    began = time.perf_counter()
    out = f.group_by_dynamic("ts", "1m", period="3000m").agg(length().alias("n"), col("v").max().alias("high"))
    out.explain()
    assert time.perf_counter() - began < 10
    rows = {r.ts: (r.n, r.high) for r in out.collect()}
    mine = [(r.ts, r.v) for r in f.collect()]
    for at in random.Random(2).sample(sorted(rows), 20):
        held = [v for t, v in mine if at <= t < at + dt.timedelta(minutes=3000)]
        assert rows[at] == (len(held), max(held, default=None))


def test_empty_windows_are_aggregates_of_nothing(spark):
    rows = [(1, DAY, "a", 1.0), (2, DAY + dt.timedelta(hours=5), "a", 2.0)]
    f = Frame(spark.createDataFrame(rows, "id long, ts timestamp_ntz, k string, v double"))
    got = f.group_by_dynamic("ts", "1h", by=["k"]).agg(length().alias("n"), col("v").sum().alias("s"), col("v").implode().alias("l")).sort("ts").rows()
    assert [r[2] for r in got] == [1, 0, 0, 0, 0, 1] and got[1][3] is None and list(got[1][4]) == []
    held = f.group_by_dynamic("ts", "1h", by=["k"]).having(col("v").count() == 0).agg(length().alias("n")).rows()
    assert len(held) == 4


def test_asof_without_keys_as_brute_force(spark):
    r = random.Random(5)
    left = [(i, r.choice([None, *range(60)])) for i in range(120)]
    right = [(i, r.choice([None, *range(0, 60, 7)])) for i in range(25)]
    a = Frame(spark.createDataFrame(left, "id long, t long")).sort("id")
    b = Frame(spark.createDataFrame(right, "r long, t long")).sort("r")
    full = [(t, i) for i, t in right if t is not None]
    for exact in (True, False):
        low = lambda t: max(((u, i) for u, i in full if u < t or (exact and u == t)), default=(None, None))
        high = lambda t: min(((u, i) for u, i in full if u > t or (exact and u == t)), default=(None, None))
        for way, pick in (("backward", low), ("forward", high)):
            got = {x[0]: x[-1] for x in a.join_asof(b, on="t", strategy=way, allow_exact_matches=exact).select("id", "r").rows()}
            assert got == {i: None if t is None else pick(t)[1] for i, t in left}, (way, exact)
    none = b.filter(col("r") < 0)
    assert {x[1] for x in a.join_asof(none, on="t").select("id", "r").rows()} == {None}


def test_engine(spark):
    from lumenfold.session import Engine

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")}
    e = Engine(threads=4, batch_rows=500)
    seen = []
    e.on_query(lambda name, rows, seconds: seen.append((name, rows)))
    assert len(e.collect(events(e.spark, 30), "events")) == 30
    assert seen == [("events", 30)] and e.stats()["rows"] == 30 and e.stats()["queries"] == 1
    for k, v in held.items():
        spark.conf.set(k, v)
