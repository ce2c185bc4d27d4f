"""Frame-level operators: projection, nulls, order, slices, sets and reshaping. Queries name their order."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import selectors as sel
from lumenfold.functions.expr import all_, col, col_dtype, col_regex, desc, exclude, lit, nth, when
from lumenfold.operators.reshape import concat
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan

#: Customers with holes: some balances are null, some NaN.
_HOLES = """(SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS bal,
  CASE WHEN c_custkey % 7 = 0 THEN 'nan'::DOUBLE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS f FROM customer)"""


def holes(spark, d):
    key = col("c_custkey")
    return scan(spark, d, "customer").select(
        "c_custkey",
        "c_nationkey",
        when(key % 5 != 0).then(col("c_acctbal")).otherwise(lit(None)).alias("bal"),
        when(key % 7 == 0).then(lit(float("nan"))).when(key % 11 != 0).then(col("c_acctbal")).otherwise(lit(None)).alias("f"),
    )


@query("select_exprs", "SELECT c_custkey AS k, upper(c_mktsegment) AS seg, c_acctbal * 2 AS twice FROM customer")
def select_exprs(spark, d):
    return scan(spark, d, "customer").select(col("c_custkey").alias("k"), col("c_mktsegment").str.to_upper().alias("seg"), (col("c_acctbal") * 2.0).alias("twice"))


@query("select_aggregates", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, max(c_name) AS last_name FROM customer")
def select_aggregates(spark, d):
    return scan(spark, d, "customer").select(col("c_custkey").len().alias("n"), col("c_acctbal").sum().round(2).alias("total"), col("c_name").max().alias("last_name"))


@query("select_broadcast_aggregate", "SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above FROM customer")
def select_broadcast_aggregate(spark, d):
    return scan(spark, d, "customer").select("c_custkey", (col("c_acctbal") > col("c_acctbal").mean()).alias("above"))


@query("with_columns_sequential", "SELECT *, c_acctbal + 1 AS a, (c_acctbal + 1) * 2 AS b FROM customer")
def with_columns_sequential(spark, d):
    return scan(spark, d, "customer").with_columns((col("c_acctbal") + 1.0).alias("a"), (col("a") * 2.0).alias("b"))


@query("filter_kleene", f"SELECT c_custkey FROM {_HOLES} WHERE bal > 1000 OR c_nationkey < 5")
def filter_kleene(spark, d):
    return holes(spark, d).filter((col("bal") > 1000.0) | (col("c_nationkey") < 5)).select("c_custkey")


@query("remove_rows", f"SELECT c_custkey FROM {_HOLES} WHERE NOT (bal > 1000)")
def remove_rows(spark, d):
    return holes(spark, d).remove(col("bal") > 1000.0).select("c_custkey")


@query("drop_rename_insert", "SELECT c_custkey AS id, c_custkey % 10 AS digit, c_name, c_mktsegment FROM customer")
def drop_rename_insert(spark, d):
    return scan(spark, d, "customer").drop("c_acctbal", "c_nationkey").rename({"c_custkey": "id"}).insert_column(1, (col("id") % 10).alias("digit"))


@query("row_index", "SELECT row_number() OVER (ORDER BY o_orderkey) + 4 AS i, o_orderkey FROM orders")
def row_index(spark, d):
    return scan(spark, d, "orders").select("o_orderkey").sort("o_orderkey").with_row_index("i", 5)


@query("cast_columns", "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::BIGINT AS c_nationkey, floor(c_acctbal)::BIGINT AS whole FROM customer")
def cast_columns(spark, d):
    return scan(spark, d, "customer").select("c_custkey", "c_nationkey", col("c_acctbal").floor().alias("whole")).cast({"c_custkey": "string", "c_nationkey": "bigint"})


@query("cast_lossy", "SELECT p_partkey, try_cast(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand, try_cast(p_type AS BIGINT) AS no FROM part")
def cast_lossy(spark, d):
    return scan(spark, d, "part").select("p_partkey", col("p_brand").str.replace("Brand#", "", literal=True).cast_lossy("bigint").alias("brand"), col("p_type").cast_lossy("bigint").alias("no"))


@query("match_to_schema", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, NULL::DOUBLE AS area FROM nation")
def match_to_schema(spark, d):
    want = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("area", T.DoubleType())])
    return scan(spark, d, "nation").match_to_schema(want, missing="insert", extra="ignore", upcast=True)


@query("drop_nulls", f"SELECT c_custkey, bal FROM {_HOLES} WHERE bal IS NOT NULL")
def drop_nulls(spark, d):
    return holes(spark, d).drop_nulls("bal").select("c_custkey", "bal")


@query("drop_nans", f"SELECT c_custkey, f FROM {_HOLES} WHERE f IS NULL OR NOT isnan(f)")
def drop_nans(spark, d):
    return holes(spark, d).drop_nans().select("c_custkey", "f")


@query("fill_null_value", f"SELECT c_custkey, coalesce(bal, -1) AS bal FROM {_HOLES}")
def fill_null_value(spark, d):
    return holes(spark, d).select("c_custkey", "bal").fill_null(-1.0)


@query("fill_nan", f"SELECT c_custkey, CASE WHEN isnan(f) THEN 0 ELSE f END AS f FROM {_HOLES}")
def fill_nan(spark, d):
    return holes(spark, d).select("c_custkey", "f").fill_nan(0.0)


@query(
    "fill_strategies",
    f"""SELECT c_custkey, coalesce(bal, 0) AS zero, coalesce(bal, 1) AS one, coalesce(bal, min(bal) OVER ()) AS low, coalesce(bal, max(bal) OVER ()) AS high,
    round(coalesce(bal, avg(bal) OVER ()), 4) AS mean, last_value(bal IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS fwd,
    first_value(bal IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bwd FROM {_HOLES}""",
)
def fill_strategies(spark, d):
    b = col("bal")
    by = {"order_by": "c_custkey"}
    return holes(spark, d).select(
        "c_custkey", b.fill_null("zero").alias("zero"), b.fill_null("one").alias("one"), b.fill_null("min").alias("low"), b.fill_null("max").alias("high"),
        b.fill_null("mean").round(4).alias("mean"), b.fill_null("forward").over("c_nationkey", **by).alias("fwd"), b.fill_null("backward").over("c_nationkey", **by).alias("bwd"),
    )


@query(
    "explode_lists",
    """SELECT p_partkey, unnest(CASE WHEN p_partkey % 10 = 0 THEN [NULL] ELSE string_split(p_name, ' ') END) AS word FROM part""",
)
def explode_lists(spark, d):
    words = when(col("p_partkey") % 10 != 0).then(col("p_name").str.split(" ")).otherwise(lit(None))
    return scan(spark, d, "part").select("p_partkey", words.alias("word")).explode("word")


@query("explode_zipped", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(list_transform(string_split(p_name, ' '), lambda x: length(x))) AS n FROM part")
def explode_zipped(spark, d):
    from lumenfold.functions.expr import element

    words = col("p_name").str.split(" ")
    return scan(spark, d, "part").select("p_partkey", words.alias("word"), words.list.eval(element().str.len_chars().cast("bigint")).alias("n")).explode("word", "n")


@query("unnest_struct", "SELECT c_custkey, c_name AS name, c_acctbal AS bal FROM customer")
def unnest_struct(spark, d):
    from lumenfold.functions.expr import struct

    return scan(spark, d, "customer").select("c_custkey", struct(col("c_name").alias("name"), col("c_acctbal").alias("bal")).alias("s")).unnest("s")


@query("hstack_frames", "SELECT n_nationkey, n_name, n_regionkey + 1 AS up FROM nation")
def hstack_frames(spark, d):
    n = scan(spark, d, "nation").sort("n_nationkey")
    return n.select("n_nationkey", "n_name").hstack(n.select((col("n_regionkey") + 1).cast("int").alias("up")))


@query("clear_rows", "SELECT NULL::INTEGER AS n_nationkey, NULL::VARCHAR AS n_name, NULL::INTEGER AS n_regionkey FROM range(3)")
def clear_rows(spark, d):
    return scan(spark, d, "nation").clear(3)


@query("shift_frame", "SELECT lag(n_nationkey, 2, -1) OVER (ORDER BY n_nationkey) AS n_nationkey FROM nation")
def shift_frame(spark, d):
    return scan(spark, d, "nation").select("n_nationkey").sort("n_nationkey").shift(2, -1)


@query("null_counts", f"SELECT count(*) - count(bal) AS bal, count(*) - count(f) AS f FROM {_HOLES}")
def null_counts(spark, d):
    return holes(spark, d).select("bal", "f").null_count()


@query(
    "describe_frame",
    """SELECT unnest(['count', 'null_count', 'min', 'max']) AS statistic, unnest([count(c_acctbal)::VARCHAR, '0', min(c_acctbal)::VARCHAR, max(c_acctbal)::VARCHAR]) AS c_acctbal FROM customer""",
)
def describe_frame(spark, d):
    return scan(spark, d, "customer").select("c_acctbal").describe().filter(col("statistic").is_in(["count", "null_count", "min", "max"]))


@query("columns_by_selector", "SELECT c_custkey, c_nationkey, c_acctbal, c_name FROM customer")
def columns_by_selector(spark, d):
    f = scan(spark, d, "customer")
    return f.select(sel.numeric(), (sel.string() - sel.matches("segment")))


@query("columns_by_pattern", "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice_twice, o_orderstatus FROM orders")
def columns_by_pattern(spark, d):
    f = scan(spark, d, "orders")
    return f.select(col_regex("key$"), (col_dtype(T.DoubleType) * 2.0).suffix("_twice"), nth(2))


@query("columns_excluded", "SELECT r_regionkey::BIGINT + 1 AS r_regionkey FROM region")
def columns_excluded(spark, d):
    return scan(spark, d, "region").select(exclude("r_name") + 1)


# -- order, slices, samples ----------------------------------------------------------------------------------------
@query("sort_nulls_first", f"SELECT row_number() OVER (ORDER BY bal DESC NULLS FIRST, c_custkey) - 1 AS i, c_custkey FROM {_HOLES}")
def sort_nulls_first(spark, d):
    return holes(spark, d).sort(desc("bal"), "c_custkey").with_row_index("i").select("i", "c_custkey")


@query("head_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def head_rows(spark, d):
    return scan(spark, d, "orders").sort(desc("o_totalprice"), "o_orderkey").head(7)


@query("tail_rows", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail_rows(spark, d):
    return scan(spark, d, "orders").sort("o_orderkey").tail(7)


@query("slice_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
def slice_rows(spark, d):
    return scan(spark, d, "orders").sort("o_orderkey").slice(100, 25).select("o_orderkey")


@query("slice_from_end", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10) ORDER BY 1 LIMIT 4")
def slice_from_end(spark, d):
    return scan(spark, d, "orders").sort("o_orderkey").slice(-10, 4).select("o_orderkey")


@query("reverse_rows", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS i, n_nationkey FROM nation")
def reverse_rows(spark, d):
    return scan(spark, d, "nation").sort("n_nationkey").reverse().with_row_index("i").select("i", "n_nationkey")


@query("top_k_rows", f"SELECT c_custkey, bal FROM {_HOLES} ORDER BY bal DESC NULLS LAST, c_custkey LIMIT 12")
def top_k_rows(spark, d):
    return holes(spark, d).sort("c_custkey").top_k(12, "bal").select("c_custkey", "bal")


@query("bottom_k_rows", f"SELECT c_custkey, bal FROM {_HOLES} ORDER BY bal NULLS LAST, c_custkey LIMIT 12")
def bottom_k_rows(spark, d):
    return holes(spark, d).sort("c_custkey").bottom_k(12, "bal").select("c_custkey", "bal")


@query("gather_every_rows", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 3 AND (i - 3) % 10 = 0")
def gather_every_rows(spark, d):
    return scan(spark, d, "orders").sort("o_orderkey").gather_every(10, 3).select("o_orderkey")


@query("gather_rows", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (3, 11, 24) UNION ALL SELECT 3")
def gather_rows(spark, d):
    return scan(spark, d, "nation").sort("n_nationkey").gather([24, 3, 11, 3]).select("n_nationkey")


@query("sample_rows", "SELECT 100::BIGINT AS n, 100::BIGINT AS distinct_rows")
def sample_rows(spark, d):
    got = scan(spark, d, "orders").sample_n(100, seed=7)
    return got.select(col("o_orderkey").len().alias("n"), col("o_orderkey").n_unique().alias("distinct_rows"))


@query("shuffle_rows", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders")
def shuffle_rows(spark, d):
    return scan(spark, d, "orders").shuffle(seed=3).select(col("o_orderkey").len().alias("n"), col("o_orderkey").sum().cast("bigint").alias("total"))


# -- distinct and sets -----------------------------------------------------------------------------------------------
@query("unique_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def unique_rows(spark, d):
    return scan(spark, d, "orders").select("o_orderstatus", "o_orderpriority").unique()


@query("unique_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def unique_keep_first(spark, d):
    return scan(spark, d, "orders").select("o_custkey", "o_orderkey").sort("o_orderkey").unique("o_custkey", keep="first")


@query("unique_keep_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def unique_keep_last(spark, d):
    return scan(spark, d, "orders").select("o_custkey", "o_orderkey").sort("o_orderkey").unique("o_custkey", keep="last")


@query("unique_keep_none", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def unique_keep_none(spark, d):
    return scan(spark, d, "orders").select("o_custkey", "o_orderkey").unique("o_custkey", keep="none")


@query("concat_vertical", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def concat_vertical(spark, d):
    a = scan(spark, d, "region").select(col("r_regionkey").alias("k"), col("r_name").alias("name"))
    return concat([a, scan(spark, d, "nation").select(col("n_nationkey").alias("k"), col("n_name").alias("name"))])


@query("concat_relaxed", "SELECT r_regionkey::BIGINT AS k FROM region UNION ALL SELECT o_orderkey FROM orders")
def concat_relaxed(spark, d):
    return concat([scan(spark, d, "region").select(col("r_regionkey").alias("k")), scan(spark, d, "orders").select(col("o_orderkey").alias("k"))], "vertical_relaxed")


@query("concat_diagonal", "SELECT r_regionkey, r_name, NULL::VARCHAR AS n_name FROM region UNION ALL SELECT NULL, NULL, n_name FROM nation")
def concat_diagonal(spark, d):
    return concat([scan(spark, d, "region"), scan(spark, d, "nation").select("n_name")], "diagonal")


@query(
    "concat_horizontal",
    """SELECT r_name, n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region)
    FULL JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) USING (i)""",
)
def concat_horizontal(spark, d):
    return concat([scan(spark, d, "region").sort("r_regionkey").select("r_name"), scan(spark, d, "nation").sort("n_nationkey").select("n_name")], "horizontal")


@query("concat_align", "SELECT k, a, b FROM (SELECT c_custkey AS k, c_acctbal AS a FROM customer) FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS b FROM supplier) USING (k)")
def concat_align(spark, d):
    a = scan(spark, d, "customer").select(col("c_custkey").alias("k"), col("c_acctbal").alias("a"))
    return concat([a, scan(spark, d, "supplier").select(col("s_suppkey").alias("k"), col("s_acctbal").alias("b"))], "align")


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return scan(spark, d, "customer").select(col("c_nationkey").alias("k")).intersect(scan(spark, d, "supplier").select(col("s_nationkey").alias("k")))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return scan(spark, d, "customer").select(col("c_custkey").alias("k")).subtract(scan(spark, d, "orders").select(col("o_custkey").alias("k")))


@query("set_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except_all(spark, d):
    return scan(spark, d, "orders").select(col("o_custkey").alias("k")).except_all(scan(spark, d, "customer").select(col("c_custkey").alias("k")))


@query(
    "unpivot_columns",
    """SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem)
    UNPIVOT INCLUDE NULLS (value FOR variable IN (l_quantity, l_discount))""",
)
def unpivot_columns(spark, d):
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").unpivot(["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"])


@query(
    "pivot_sum",
    """SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O,
    round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1""",
)
def pivot_sum(spark, d):
    out = scan(spark, d, "orders").pivot("o_orderstatus", "o_orderpriority", "o_totalprice", "sum", ["F", "O", "P"])
    return out.select("o_orderpriority", *[col(c).round(2) for c in "FOP"])


@query("pivot_counts_found", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_counts_found(spark, d):
    return scan(spark, d, "orders").pivot("o_orderstatus", "o_orderpriority", "o_totalprice", "len")


@query("transpose_frame", "SELECT 'r_regionkey' AS key, 0 AS AFRICA, 1 AS AMERICA")
def transpose_frame(spark, d):
    return scan(spark, d, "region").filter(col("r_regionkey") < 2).select("r_name", "r_regionkey").transpose("r_name")


@query("unstack_columns", "SELECT n_nationkey AS n_nationkey_0, n_nationkey + 10 AS n_nationkey_1, CASE WHEN n_nationkey < 5 THEN n_nationkey + 20 END AS n_nationkey_2 FROM nation WHERE n_nationkey < 10")
def unstack_columns(spark, d):
    return scan(spark, d, "nation").select("n_nationkey").sort("n_nationkey").unstack(10)


@query("to_dummies", "SELECT o_orderkey, (o_orderstatus = 'F')::TINYINT AS o_orderstatus_F, (o_orderstatus = 'O')::TINYINT AS o_orderstatus_O, (o_orderstatus = 'P')::TINYINT AS o_orderstatus_P FROM orders")
def to_dummies(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", "o_orderstatus").to_dummies("o_orderstatus")


@query("value_counts_rows", "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def value_counts_rows(spark, d):
    return scan(spark, d, "orders").value_counts("o_orderstatus")


@query(
    "upsample_days",
    """WITH e AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS ts FROM events), g AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM e GROUP BY 1)
    SELECT g.user_id, epoch_us(g.ts) // 86400000000 AS day, e.ts IS NOT NULL AS there FROM g LEFT JOIN e USING (user_id, ts)""",
)
def upsample_days(spark, d):
    days = scan(spark, d, "events").select("user_id", col("ts").dt.truncate("1d")).unique().with_columns(lit(True).alias("there"))
    return days.upsample("ts", "1d", by=["user_id"]).select("user_id", col("ts").dt.epoch_days().cast("bigint").alias("day"), col("there").fill_null_with(False).alias("there"))


@query(
    "interpolate_frame",
    """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS v, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), n AS (SELECT *,
    last_value(v IGNORE NULLS) OVER a AS lv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS li, first_value(v IGNORE NULLS) OVER b AS rv,
    first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ri FROM r
    WINDOW a AS (ORDER BY i), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT c_custkey::DOUBLE AS c_custkey, round(coalesce(v, lv + (rv - lv) * (i - li) / (ri - li)), 6) AS bal FROM n""",
)
def interpolate_frame(spark, d):
    f = holes(spark, d).sort("c_custkey").select("c_custkey", "bal").interpolate()
    return f.select(col("c_custkey").cast("double"), col("bal").round(6))


@query("hash_rows", None)
def hash_rows(spark, d):
    return scan(spark, d, "customer").hash_rows(seed=1)


@query("whole_frame_aggregates", "SELECT round(sum(s_acctbal), 2) AS total, round(avg(s_acctbal), 4) AS mean, round(stddev_samp(s_acctbal), 4) AS sd, min(s_acctbal) AS low, max(s_acctbal) AS high, round(median(s_acctbal), 4) AS mid FROM supplier")
def whole_frame_aggregates(spark, d):
    f = scan(spark, d, "supplier").select("s_acctbal")
    parts = [f.sum().select(col("s_acctbal").round(2).alias("total")), f.mean().select(col("s_acctbal").round(4).alias("mean")), f.std().select(col("s_acctbal").round(4).alias("sd")), f.min().rename({"s_acctbal": "low"}), f.max().rename({"s_acctbal": "high"}), f.median().select(col("s_acctbal").round(4).alias("mid"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, how="cross")
    return out


@query("horizontal_columns", "SELECT l_quantity + l_discount + l_tax AS sum, greatest(l_quantity, l_discount, l_tax) AS max FROM lineitem")
def horizontal_columns(spark, d):
    from lumenfold.functions.expr import max_horizontal, sum_horizontal

    names = ("l_quantity", "l_discount", "l_tax")
    return scan(spark, d, "lineitem").select(sum_horizontal(*names).alias("sum"), max_horizontal(*names).alias("max"))


@query(
    "corr_matrix",
    """WITH c AS (SELECT round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_extendedprice, l_discount), 6) AS pd FROM lineitem)
    SELECT 'l_quantity' AS "column", 1.0::DOUBLE AS l_quantity, qp AS l_extendedprice, qd AS l_discount FROM c UNION ALL SELECT 'l_extendedprice', qp, 1.0, pd FROM c UNION ALL SELECT 'l_discount', qd, pd, 1.0 FROM c""",
)
def corr_matrix(spark, d):
    f = scan(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount").corr()
    return f.select(f.columns[0], *[col(c).round(6) for c in f.columns[1:]])


@query("map_columns", "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def map_columns(spark, d):
    return scan(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").map_columns(["c_name", "c_mktsegment"], lambda e: e.str.to_lower())


@query("rollup_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(spark, d):
    return scan(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("cube_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(spark, d):
    return scan(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select_all", "SELECT r_regionkey, r_name FROM region")
def select_all(spark, d):
    return scan(spark, d, "region").select(all_())


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def grouping_sets(spark, d):
    keys = ("o_orderstatus", "o_orderpriority")
    return scan(spark, d, "orders").grouping_sets([[*keys], [keys[0]], []], *keys).agg(F.count(F.lit(1)).alias("n"))
