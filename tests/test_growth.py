"""What failed only on larger tables: values that don't vary, zeros, ties, long groups."""

import math

import pytest

from lumenfold import Frame, col
from lumenfold.functions.expr import corr, rolling_corr


def frame(spark, rows, schema):
    """Rows in one partition, in the order given."""
    return Frame(spark.createDataFrame(rows, schema).coalesce(1))


def same(got, want):
    return got == want or (got is not None and want is not None and math.isnan(got) and math.isnan(want))


def test_correlation_of_what_does_not_vary(spark):
    f = frame(spark, [(i, 7.0, float(i)) for i in range(5)] + [(5, 8.0, 5.0), (6, 9.0, 7.0)], "i long, a double, b double")
    rolled = [r.r for r in f.select("i", rolling_corr(col("a"), col("b"), 3).over(order_by="i").alias("r")).spark().orderBy("i").collect()]
    assert rolled[:2] == [None, None] and all(map(math.isnan, rolled[2:5])) and rolled[5:] == pytest.approx([math.sqrt(0.75), 0.981980506], abs=1e-6)
    flat = f.filter(col("i") < 5)
    assert math.isnan(flat.select(corr(col("a"), col("b")).alias("r")).collect()[0].r)
    assert math.isnan(flat.select("a", "b").corr().spark().collect()[0].b)


def test_entropy_with_a_zero_is_nan(spark):
    f = frame(spark, [(1, 1.0), (1, 1.0), (1, None), (2, 1.0), (2, 0.0), (3, -1.0), (3, 1.0), (4, None)], "g long, v double")
    for normalize, one in ((True, 1.0), (False, 0.0)):
        got = {r.g: r.e for r in f.group_by("g").agg(col("v").entropy(2.0, normalize).alias("e")).collect()}
        assert got[1] == pytest.approx(one) and math.isnan(got[2]) and math.isnan(got[3]) and got[4] is None


def test_nothing_by_zero_is_null(spark):
    f = frame(spark, [(0, 0.0, 0.0), (1, None, 0.0), (2, 1.0, None), (3, -1.0, 0.0)], "i long, a double, b double")
    got = [r.q for r in f.select("i", (col("a") / col("b")).alias("q")).spark().orderBy("i").collect()]
    assert math.isnan(got[0]) and got[1:] == [None, None, -math.inf]


def test_rounding_scales_first(spark):
    tie = 0.285  # 0.284999... scaled by 100 is 28.499999999999996
    values = [tie, -tie, 2.5, 1e305, math.inf, math.nan, None, 1.005]
    f = frame(spark, [(i, v) for i, v in enumerate(values)], "i long, v double")
    got = [r.r for r in f.select("i", col("v").round(2).alias("r")).spark().orderBy("i").collect()]
    want = [0.28, -0.28, 2.5, 1e305, math.inf, math.nan, None, 1.0]
    assert all(same(a, b) for a, b in zip(got, want, strict=True))
    over = f.select("i", col("v").sum().over("i").round(2).alias("r")).spark().orderBy("i").collect()
    assert all(same(r.r, b) for r, b in zip(over, want, strict=True))
    whole = frame(spark, [(7, 1.25)], "n int, x float").select(col("n").round(2), col("x").round(1)).spark()
    assert [k for _, k in whole.dtypes] == ["int", "float"] and tuple(whole.collect()[0]) == (7, pytest.approx(1.3))


@pytest.mark.parametrize("over", [{}, {"order_by": "i"}])
def test_windows_to_the_end_take_no_square(spark, over):
    n = 60_000  # squared, this took minutes
    f = Frame(spark.range(n).coalesce(1).selectExpr("id AS i", "IF(id % 1000 = 7, CAST(id AS double), NULL) AS v"))
    v = col("v")
    exprs = {"back": v.backward_fill(), "line": v.interpolate(), "near": v.interpolate("nearest"), "total": v.cum_sum(reverse=True), "left": v.cum_count(reverse=True)}
    got = f.select("i", *[(e.over(**over) if over else e).alias(k) for k, e in exprs.items()])
    plan = got.spark()._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan
    rows = sorted(got.spark().collect())
    assert [rows[i].back for i in (0, 7, 8, n - 1)] == [7.0, 7.0, 1007.0, None] and [rows[i].line for i in (0, 7, 8, 500, n - 1)] == [None, 7.0, 8.0, 500.0, None]
    assert [rows[i].near for i in (8, 507, 506)] == [7.0, 1007.0, 7.0] and rows[n - 1].left == 1 and rows[0].left == n
    assert rows[59_007].total == 59_007.0 and rows[58_007].total == 117_014.0


def test_fills_by_group_keep_their_group(spark):
    f = Frame(spark.range(120_000).coalesce(1).selectExpr("id AS i", "id % 2 AS g", "IF(id % 50000 = 1, CAST(id AS double), NULL) AS v"))
    by = {"order_by": "i"}
    got = f.select("i", "g", col("v").fill_null("backward").over("g", **by).alias("b"), col("v").fill_null("forward").over("g", **by).alias("f"))
    rows = sorted(got.spark().collect())
    assert all(r.b is None and r.f is None for r in rows if r.g == 0)
    assert [rows[i].b for i in (1, 3, 50_003, 100_003)] == [1.0, 50_001.0, 100_001.0, None] and [rows[i].f for i in (1, 3, 119_999)] == [1.0, 1.0, 100_001.0]


@pytest.mark.parametrize(("alpha", "adjust", "ignore_nulls"), [(1e-3, True, False), (0.3, False, True), (0.99, False, False), (1.0, True, True)])
def test_decay_against_its_recursion(spark, alpha, adjust, ignore_nulls):
    n = 2500
    rows = [(i, None if i % 11 in (0, 4, 5) else 1e3 + (i * 7919 % 1000) / 7) for i in range(n)]
    o = {"adjust": adjust, "ignore_nulls": ignore_nulls}
    v = col("v")
    exprs = {"m": v.ewm_mean(alpha, **o), "b": v.ewm_var(alpha, bias=True, **o), "u": v.ewm_var(alpha, **o), "s": v.ewm_sum(alpha, ignore_nulls=ignore_nulls)}
    f = frame(spark, rows, "i long, v double").select("i", *[e.over(order_by="i").alias(k) for k, e in exprs.items()])
    assert "aggregate(" not in f.explain()  # no row folds the rows before it
    got = sorted(f.spark().collect())
    w = w2 = q = m = s = 0.0
    first = True
    for (_, x), r in zip(rows, got, strict=True):
        k = 1.0 if ignore_nulls and x is None else 1 - alpha
        w, w2, q, s = w * k, w2 * k * k, q * k, s * k
        if x is None:
            assert (r.m, r.b, r.u, r.s) == (None,) * 4
            continue
        g = 1.0 if adjust or first else alpha
        w, w2, s = w + g, w2 + g * g, s + x
        old, m = m, x if first else m + g / (w) * (x - m)
        q += 0.0 if first else g * (x - old) * (x - m)
        first = False
        assert r.m == pytest.approx(m, rel=1e-12) and r.s == pytest.approx(s, rel=1e-12) and r.b == pytest.approx(q / w, rel=1e-6, abs=1e-9)
        u = q / w * w * w / (w * w - w2) if w * w > w2 * (1 + 1e-12) else None
        assert r.u is None if u is None else r.u == pytest.approx(u, rel=1e-6, abs=1e-9)


def test_texts_reach_their_normal_forms(spark):
    import unicodedata

    texts = ["plain", "", None, "café", "café", "Å", " x", "½", "ﬁ", "̈́", "ẛ̣", "\U0001d15e", "à̕", "각", "˿", "¿", "\u009f"] * 30
    f = frame(spark, list(enumerate(texts)), "i long, t string")
    forms = ["NFC", "NFD", "NFKC", "NFKD"]
    for r, t in zip(f.select("i", *[col("t").str.normalize(k).alias(k) for k in forms]).spark().orderBy("i").collect(), texts, strict=True):
        assert [r[k] for k in forms] == [None if t is None else unicodedata.normalize(k, t) for k in forms]


def test_large_samples_sort_no_whole_frame(spark):
    n = 300_000
    f = Frame(spark.range(0, n, 1, 4))
    a, b = f.sample_n(200_001, seed=3), f.sample_n(200_001, seed=3)
    assert a.height() == 200_001 and a.equals(b) and a.spark().distinct().count() == 200_001
    assert f.sample_n(n + 5, seed=3).height() == n and f.sample_fraction(0.25, seed=3).height() == n // 4
    few, many = f.sample_n(60_000, seed=5).spark(), f.sample_n(70_000, seed=5).spark()
    assert few.exceptAll(many).isEmpty()  # both ways take the lowest hashes
    assert "GlobalLimit 200001" not in a.explain()


def test_functions_of_groups_in_batches(spark):
    import pandas as pd

    n = 45_000  # the null key's rows span batches of 10,000
    f = Frame(spark.range(0, n, 1, 3).selectExpr("IF(id % 2 = 0, NULL, id % 1000) AS k", "id AS v"))
    def one(key, g):  # noqa: E306
        assert g["v"].is_monotonic_increasing
        return pd.DataFrame({"k": [None if pd.isna(key[0]) else int(key[0])], "n": [len(g)], "first": [int(g["v"].iat[0])]})

    got = f.group_by("k").map_groups(one, "k long, n long, first long")
    assert "FlatMapGroups" not in got.explain()
    rows = {r.k: (r.n, r.first) for r in got.spark().collect()}
    assert rows == {None: (n // 2, 0)} | {k: (45, k) for k in range(1, 1000, 2)}
    assert {r.n for r in f.group_by("k").map_groups(lambda g: g[["v"]].head(0).rename(columns={"v": "n"}), "n long").spark().collect()} == set()


def test_runs_of_long_groups(spark):
    from lumenfold.plans import aggregates

    n = 6000  # places of runs, found anew for each run, took the cube of a group
    rows = [(i, 1, "ab"[i // 3 % 2], float(i)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").createOrReplaceTempView("runs")
    held = aggregates.scan
    aggregates.scan = lambda s, d, name: Frame(s.table("runs"))
    try:
        got = sorted(tuple(r) for r in aggregates.agg_rle(spark, "").select("start", "len", "value").spark().collect())
    finally:
        aggregates.scan = held
    assert got == [(i, 3, "ab"[i // 3 % 2]) for i in range(0, n, 3)]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_drained_streams_stay_with_the_executors(spark, tmp_path, mode):
    from pyspark.sql import functions as F

    from lumenfold.streaming import streams

    place = str(tmp_path / "in")
    spark.range(0, 1000, 1, 4).withColumn("k", F.col("id") % 7).write.parquet(place)
    df = streams.read_stream(spark, place, "id long, k long", max_files=1, pattern="*.parquet")
    df = df.groupBy("k").count() if mode == "complete" else df.select("k")
    got = streams.drain(df, f"drained_{mode}", mode, str(tmp_path / "state"))
    assert got.inputFiles()  # from files, and not from the driver's memory
    assert sorted(map(tuple, (got if mode == "complete" else got.groupBy("k").count()).collect())) == [(k, len(range(k, 1000, 7))) for k in range(7)]
    assert streams.drain(streams.read_stream(spark, place, "id long", pattern="none"), f"nothing_{mode}", checkpoint=str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_pairs_of_a_null_key_are_made_in_many_tasks(spark, how):
    from pyspark.sql import functions as F

    f = frame(spark, [(None if i % 2 else i, i) for i in range(1200)], "k long, v long")
    got = f.join(f, on="k", nulls_equal=True, how=how).spark()
    assert got.count() == 600 * 600 + 600 and got.distinct().count() == got.count()
    assert got.filter("k is null").groupBy(F.spark_partition_id()).count().count() > 1


def test_databases_in_the_driver_are_not_opened_by_executors(spark):
    import uuid

    from lumenfold.sources import io

    url, driver = f"jdbc:derby:memory:db{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    n = 2 * io._JDBC_ROWS + 7
    f = Frame(spark.range(0, n, 1, 3).selectExpr("id AS k", "IF(id % 5 = 0, NULL, CAST(id AS string)) AS s", "id / 2 AS x"))
    f.write_database(url, "t", driver=driver)
    f.filter(col("k") < 10).write_database(url, "t", if_exists="append", driver=driver)
    out = io.read_database(spark, url, "SELECT * FROM t", driver=driver, overrides="k bigint").spark()
    assert out.inputFiles()  # written by the driver, where a scan through JDBC has none
    want = f.spark().union(f.spark().filter("k < 10"))
    assert out.count() == n + 10 and out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    assert io.read_database(spark, url, 'SELECT "k" FROM t WHERE "k" < 0', driver=driver).height() == 0
    f.filter(col("k") < 3).write_database(url, "t", if_exists="replace", driver=driver)
    assert io.read_database(spark, url, "SELECT * FROM t", driver=driver).height() == 3
