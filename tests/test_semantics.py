"""Rules that the answers obey whatever the data: nulls, NaN, order, division, windows, names, errors."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import lumenfold as lf
from lumenfold import Frame, asc, col, desc, lit, selectors as sel, when
from lumenfold.operators.temporal import parse
from lumenfold.sources import io

NAN = math.nan


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("eu", 10.0, 1), ("us", 20.0, 2), ("eu", 30.0, 3), ("apac", None, 4), ("us", 40.0, 5), ("eu", 50.0, 6), ("apac", None, 7)]
    return Frame(spark.createDataFrame(rows, "region string, amount double, qty int").coalesce(1))


def frame(spark, values, kind="double"):
    """One column in one partition, so that the rows' order is that of the list."""
    return Frame(spark.createDataFrame([(v,) for v in values], f"v {kind}").coalesce(1))


def values(f, name="v"):
    return [r[name] for r in f.collect()]


def test_sum_of_nothing_is_null(sales):
    got = {r.region: (r.s, r.m, r.n, r.p) for r in sales.group_by("region").agg(col("amount").sum().alias("s"), col("amount").mean().alias("m"), col("amount").count().alias("n"), col("amount").product().alias("p")).collect()}
    assert got["apac"] == (None, None, 0, None) and got["eu"] == (90.0, 30.0, 3, 15000.0)


def test_integer_sum_is_exact(spark):
    big = (1 << 63) - 1
    assert int(frame(spark, [big, big, 1], "long").select(col("v").sum()).collect()[0][0]) == 2 * big + 1


def test_any_of_nothing_is_null(spark):
    f = frame(spark, [None, None], "boolean").select(col("v").any().alias("a"), col("v").all_true().alias("b"))
    assert tuple(f.collect()[0]) == (None, None)


def test_n_unique_skips_null(spark):
    f = frame(spark, [1, 1, None, 2], "int").select(col("v").n_unique().alias("n"), col("v").approx_n_unique().alias("m"))
    assert tuple(f.collect()[0]) == (2, 3)


def test_nulls_first_in_both_directions(spark):
    f = frame(spark, [2.0, None, NAN, 1.0])
    assert values(f.sort("v"))[:3] == [None, 1.0, 2.0]
    down = values(f.sort(desc("v")))
    assert down[0] is None and math.isnan(down[1]) and down[2:] == [2.0, 1.0]
    assert values(f.sort(asc("v").nulls_last()))[-1] is None


def test_sort_is_stable(spark):
    f = Frame(spark.createDataFrame([(i % 3, i) for i in range(50)], "k int, i int").coalesce(1))
    got = f.sort("k").collect()
    assert [r.i for r in got] == sorted(range(50), key=lambda i: i % 3)


def test_division(spark):
    f = Frame(spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (-7, -2), (7, 0)], "a long, b long").coalesce(1))
    got = f.select((col("a") // col("b")).alias("f"), (col("a") % col("b")).alias("m"), col("a").trunc_div(col("b")).alias("t"), (col("a") / col("b")).alias("d")).collect()
    assert [r.f for r in got] == [3, -4, -4, 3, None]
    assert [r.m for r in got] == [1, 1, -1, -1, None]
    assert [r.t for r in got] == [3, -3, -3, 3, None]
    assert [r.d for r in got] == [3.5, -3.5, -3.5, 3.5, math.inf]


def test_nan_is_never_equal(spark):
    f = frame(spark, [NAN, 1.0, None])
    got = f.select((col("v") == col("v")).alias("e"), (col("v") != col("v")).alias("n"), (col("v") > 0.5).alias("g"), (col("v") < lit(NAN)).alias("l")).collect()
    assert [r.e for r in got] == [False, True, None] and [r.n for r in got] == [True, False, None]
    assert [r.g for r in got] == [False, True, None] and [r.l for r in got] == [False, False, None]


def test_nan_is_one_key(spark):
    f = frame(spark, [NAN, NAN, 0.0, -0.0, None]).group_by("v").len()
    assert sorted(r.len for r in f.collect()) == [1, 2, 2]


def test_comparisons_reach_the_scan(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(10).select(F.col("id").cast("double").alias("x"), "id").write.parquet(p)
    f = io.scan_parquet(spark, p).filter(col("x") > 3.0, col("id") <= 8).select("id")
    plan = f.explain()
    assert "GreaterThan(x,3.0)" in plan and "LessThanOrEqual(id,8)" in plan
    assert sorted(values(f, "id")) == [4, 5, 6, 7, 8]


def test_only_used_columns_are_read(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(10).select("id", F.lit(1).alias("a"), F.lit(2).alias("b")).write.parquet(p)
    plan = io.scan_parquet(spark, p).group_by("a").agg(col("id").sum()).explain()
    assert "ReadSchema: struct<id:bigint,a:int>" in plan


def test_remove_drops_null(sales):
    assert [r.qty for r in sales.remove(col("amount") > 25.0).collect()] == [1, 2]


def test_round_goes_away_from_zero(spark):
    f = frame(spark, [0.5, 1.5, -2.5])
    assert values(f.select(col("v").round())) == [1.0, 2.0, -3.0]
    assert values(f.select(col("v").round(0, "half_to_even"))) == [0.0, 2.0, -2.0]


def test_quantile_ranks(spark):
    f = frame(spark, [1.0, 2.0, 3.0, 4.0, None])
    q = lambda how: f.select(col("v").quantile(0.5, how)).collect()[0][0]
    assert [q(h) for h in ("linear", "lower", "higher", "midpoint")] == [2.5, 2.0, 3.0, 2.5]


def test_variance_needs_more_than_ddof(spark):
    f = frame(spark, [3.0])
    assert tuple(f.select(col("v").var(0).alias("a"), col("v").var(1).alias("b"), col("v").std(2).alias("c")).collect()[0]) == (0.0, None, None)


def test_corr_of_one_row_is_nan(spark):
    f = Frame(spark.createDataFrame([(1.0, 2.0)], "a double, b double"))
    row = f.select(lf.corr(col("a"), col("b")).alias("r"), lf.cov(col("a"), col("b")).alias("c")).collect()[0]
    assert math.isnan(row.r) and row.c is None


def test_rank_of_null_is_null(spark):
    f = frame(spark, [2.0, None, 1.0, 2.0])
    assert values(f.select(col("v").rank("average"))) == [2.5, None, 1.0, 2.5]
    assert values(f.select(col("v").rank("ordinal"))) == [2, None, 1, 3]


def test_cumulative_keeps_nulls(spark):
    f = frame(spark, [1.0, None, 2.0])
    assert values(f.select(col("v").cum_sum())) == [1.0, None, 3.0]
    assert values(f.select(col("v").cum_sum(reverse=True))) == [3.0, None, 2.0]
    assert values(f.select(col("v").cum_count())) == [1, 2, 3]


def test_fill_limits(spark):
    f = frame(spark, [5.0, None, None, None, 7.0, None])
    assert values(f.select(col("v").forward_fill(2))) == [5.0, 5.0, 5.0, None, 7.0, 7.0]
    assert values(f.select(col("v").interpolate())) == [5.0, 5.5, 6.0, 6.5, 7.0, None]


def test_rolling_needs_all_values(spark):
    f = frame(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert values(f.select(col("v").rolling_sum(2))) == [None, 3.0, None, None, 9.0, 11.0]
    assert values(f.select(col("v").rolling_sum(2, min_samples=1))) == [1.0, 3.0, 2.0, 4.0, 9.0, 11.0]


def test_ewm(spark):
    f = frame(spark, [1.0, 2.0, 3.0])
    assert values(f.select(col("v").ewm_mean(0.5).round(3))) == [1.0, 1.667, 2.429]


def test_time_window_leaves_its_start_out(spark):
    f = Frame(spark.createDataFrame([(0, 1.0), (10, 1.0), (20, 1.0)], "t long, v double"))
    right = f.select("t", col("v").rolling_sum_by("t", "10i").alias("s")).sort("t")
    both = f.select("t", col("v").rolling_sum_by("t", "10i", closed="both").alias("s")).sort("t")
    assert values(right, "s") == [1.0, 1.0, 1.0] and values(both, "s") == [1.0, 2.0, 2.0]


def test_dynamic_keeps_empty_windows(spark):
    f = Frame(spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 10), 1.0), (dt.datetime(2024, 1, 1, 3, 5), 2.0)], "t timestamp_ntz, v double"))
    got = f.group_by_dynamic("t", "1h").agg(lf.length().alias("n"), col("v").sum().alias("s")).sort("t").collect()
    assert [(r.t.hour, r.n, r.s) for r in got] == [(0, 1, 1.0), (1, 0, None), (2, 0, None), (3, 1, 2.0)]


def test_asof_ties(spark):
    left = Frame(spark.createDataFrame([(5, "a"), (1, "b"), (9, None)], "t long, g string"))
    right = Frame(spark.createDataFrame([(3, "a", "x"), (7, "a", "y"), (5, "z", "z"), (9, None, "n")], "t long, g string, v string"))
    near = {r.t: r.v for r in left.join_asof(right, on="t", by=["g"], strategy="nearest").collect()}
    assert near == {5: "x", 1: None, 9: None}
    assert {r.t: r.v for r in left.join_asof(right, on="t", strategy="backward").select("t", "v").collect()} == {5: "z", 1: None, 9: "n"}


def test_join_rules(spark):
    a = Frame(spark.createDataFrame([(1, "a"), (None, "n"), (3, "c")], "k int, v string"))
    b = Frame(spark.createDataFrame([(1, "x"), (None, "m"), (4, "d")], "k int, v string"))
    assert {tuple(r) for r in a.join(b, on="k").collect()} == {(1, "a", "x")}
    assert len(a.join(b, on="k", nulls_equal=True).collect()) == 2
    full = a.join(b, on="k", how="full")
    assert full.columns == ["k", "v", "k_right", "v_right"] and full.height() == 5
    assert {r.k for r in a.join(b, on="k", how="full", coalesce=True).collect()} == {1, 3, 4, None}
    twice = b.concat(b)
    with pytest.raises(Exception, match="isn't m:1"):
        a.join(twice, on="k", validate="m:1").collect()
    assert a.join(b, on="k", validate="1:1").height() == 1


def test_explode_of_nothing_is_null(spark):
    f = Frame(spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, l array<int>"))
    assert sorted((r.k, r.l or 0) for r in f.explode("l").collect()) == [(1, 1), (1, 2), (2, 0), (3, 0)]


def test_pivot_of_nothing(spark):
    f = Frame(spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, on string, v int"))
    total = {r.k: (r.x, r.y) for r in f.pivot("on", "k", "v", "sum").collect()}
    assert total == {"a": (1, None), "b": (None, 2)}
    assert {r.k: (r.x, r.y) for r in f.pivot("on", "k", "v", "len").collect()} == {"a": (1, 0), "b": (0, 1)}
    with pytest.raises(Exception, match="more than one value"):
        f.concat(f).pivot("on", "k", "v").collect()


def test_month_ends_and_weeks(spark):
    f = Frame(spark.createDataFrame([(dt.datetime(2024, 1, 31, 5),)], "t timestamp_ntz"))
    row = f.select(col("t").dt.offset_by("1mo").alias("a"), col("t").dt.truncate("1w").alias("b"), col("t").dt.offset_by("-1y").alias("c")).collect()[0]
    assert row.a == dt.datetime(2024, 2, 29, 5) and row.b == dt.datetime(2024, 1, 29) and row.c == dt.datetime(2023, 1, 31, 5)
    assert parse("1y2mo").months == 14 and parse("-1d12h").micros == -129_600_000_000 and parse("2w").weekly
    with pytest.raises(ValueError):
        parse("7 days")


def test_casts(spark):
    assert values(frame(spark, [1.0, None, -3.0]).select(col("v").cast("int"))) == [1, None, -3]
    assert values(frame(spark, [1.5, 2.0, 1e300, NAN]).select(col("v").cast_lossy("bigint"))) == [None, 2, None, None]
    with pytest.raises(Exception, match="inexact cast"):
        frame(spark, [1.5]).select(col("v").cast("int")).collect()


def test_names_and_errors(sales):
    with pytest.raises(KeyError):
        sales.drop("nothing")
    with pytest.raises(ValueError, match="duplicate"):
        sales.select("qty", col("amount").alias("qty"))
    f = sales.select(sel.numeric().expr().name.suffix("_x"), col("region").name.to_upper())
    assert f.columns == ["amount_x", "qty_x", "REGION"]
    assert (sel.all_() - sel.string()).expand(sales.schema) == ["amount", "qty"]
    assert (~sel.starts_with("q") & sel.numeric()).expand(sales.schema) == ["amount"]
    e = (col("a") + col("b")).alias("c")
    assert e.meta.root_names() == ["a", "b"] and e.meta.output_name() == "c" and not e.meta.is_column()


def test_conditions_without_a_default(spark):
    assert values(frame(spark, [1.0, None, 3.0]).select(when(col("v") > 2.0).then(lit("big")).alias("v"))) == [None, None, "big"]


def test_row_order_of_frames(spark):
    f = Frame(spark.range(1000).repartition(7)).sort(desc("id"))
    assert values(f.with_row_index("i").filter(col("i") < 3).sort("i"), "id") == [999, 998, 997]
    assert values(f.tail(2), "id") == [1, 0] and values(f.slice(10, 2), "id") == [989, 988]
    assert values(f.gather_every(400), "id") == [999, 599, 199]
    assert values(f.unique("id", keep="last").sort("id").head(2), "id") == [0, 1]


def test_samples_are_seeded(spark):
    f = Frame(spark.range(100).coalesce(1))
    a, b, c = (values(f.sample_n(10, seed=s), "id") for s in (1, 1, 2))
    assert a == b != c and len(set(a)) == 10


def test_fill_and_match(spark):
    f = Frame(spark.createDataFrame([(1, None), (None, 2.0)], "a int, b double"))
    assert sorted(tuple(r) for r in f.fill_null(0).collect()) == [(0, 2.0), (1, 0.0)]
    with pytest.raises(ValueError, match="missing"):
        f.match_to_schema(T.StructType([T.StructField("z", T.IntegerType())]), extra="ignore")
    with pytest.raises(ValueError, match="extra"):
        f.match_to_schema(T.StructType([T.StructField("a", T.IntegerType())]))


def test_driver_side_values(sales):
    assert sales.row(1) == ("us", 20.0, 2) and sales.row_named(0)["qty"] == 1
    assert sales.select(col("qty").max()).item() == 7 and sales.item(2, "amount") == 30.0
    assert sales.row_where(col("qty") == 5)[0] == "us"
    assert sales.equals(sales.sort(desc("qty"))) and not sales.equals(sales.head(2))
    assert set(sales.rows_by_key("region")) == {"eu", "us", "apac"} and sales.shape() == (7, 3)
    assert "region <string>" in sales.glimpse(2) and sales.estimated_size() > 0


def test_groups_of_frames(sales):
    got = {k: f.height() for k, f in sales.group_by("region").groups()}
    assert got == {("eu",): 3, ("us",): 2, ("apac",): 2} == {k: f.height() for k, f in sales.partition_by("region").items()}


def test_arrow_files(spark, sales, tmp_path):
    for stream in (False, True):
        p = str(tmp_path / f"t{stream}.arrow")
        io.write_ipc(sales, p, stream=stream)
        assert sales.equals(io.scan_ipc(spark, p, stream=stream))
    assert io.to_json(sales.head(1)) == '[{"region":"eu","amount":10.0,"qty":1}]'


def test_database(spark, sales):
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.execute("create table t(a integer, b text)")
    con.executemany("insert into t values (?, ?)", [(1, "x"), (2, None)])
    f = io.read_cursor(spark, con.execute("select a, b from t order by a"), "a long, b string")
    assert f.rows() == [(1, "x"), (2, None)]


def test_bytes_in_memory(spark):
    assert io.scan_csv_bytes(spark, b"a,b\n1,x\n2,\n").rows() == [(1, "x"), (2, None)]
    assert io.scan_ndjson_bytes(spark, b'{"a":1}\n{"a":null}\n').rows() == [(1,), (None,)]
    assert io.scan_json_bytes(spark, b'[{"a":1},{"a":2}]').rows() == [(1,), (2,)]
    assert io.scan_lines_bytes(spark, b"x\ny").rows() == [("x",), ("y",)]


def test_argument_orders(spark):
    f = Frame(spark.createDataFrame([(2, "b"), (1, "z"), (2, "a"), (None, "q")], "k int, s string").coalesce(1))
    row = f.select(lf.arg_sort_by("k", desc("s")).alias("a"), lf.arg_where(col("k") == 2).alias("w")).collect()[0]
    assert row.a == [3, 1, 0, 2] and row.w == [0, 2]


def test_rolling_expression(spark):
    f = Frame(spark.createDataFrame([(0, 1.0), (5, 2.0), (10, 4.0)], "t long, v double").coalesce(1))
    got = f.select("t", (col("v").max() - col("v").min()).rolling("t", "10i").alias("d")).sort("t")
    assert values(got, "d") == [0.0, 1.0, 2.0]
