"""Grouping and join benchmarks: ten group-bys and five joins, from few groups to many and from small sides to large."""

from __future__ import annotations

from lumenfold.functions.expr import col, concat_str, corr, length, lit
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan


def _items(spark, d, *names):
    return scan(spark, d, "lineitem").select(*names)


@query("h2o_gb1", "SELECT l_returnflag, sum(l_quantity) AS v1 FROM lineitem GROUP BY 1")
def gb1(spark, d):
    return _items(spark, d, "l_returnflag", "l_quantity").group_by("l_returnflag").agg(col("l_quantity").sum().alias("v1"))


@query("h2o_gb2", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS v1 FROM lineitem GROUP BY 1, 2")
def gb2(spark, d):
    return _items(spark, d, "l_returnflag", "l_linestatus", "l_quantity").group_by("l_returnflag", "l_linestatus").agg(col("l_quantity").sum().alias("v1"))


@query("h2o_gb3", "SELECT l_orderkey, sum(l_quantity) AS v1, round(avg(l_extendedprice), 6) AS v3 FROM lineitem GROUP BY 1")
def gb3(spark, d):
    return _items(spark, d, "l_orderkey", "l_quantity", "l_extendedprice").group_by("l_orderkey").agg(col("l_quantity").sum().alias("v1"), col("l_extendedprice").mean().round(6).alias("v3"))


@query("h2o_gb4", "SELECT l_suppkey, round(avg(l_quantity), 6) AS v1, round(avg(l_discount), 6) AS v2, round(avg(l_extendedprice), 6) AS v3 FROM lineitem GROUP BY 1")
def gb4(spark, d):
    f = _items(spark, d, "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    return f.group_by("l_suppkey").agg(col("l_quantity").mean().round(6).alias("v1"), col("l_discount").mean().round(6).alias("v2"), col("l_extendedprice").mean().round(6).alias("v3"))


@query("h2o_gb5", "SELECT l_partkey, sum(l_quantity) AS v1, round(sum(l_discount), 2) AS v2, round(sum(l_extendedprice), 2) AS v3 FROM lineitem GROUP BY 1")
def gb5(spark, d):
    f = _items(spark, d, "l_partkey", "l_quantity", "l_discount", "l_extendedprice")
    return f.group_by("l_partkey").agg(col("l_quantity").sum().alias("v1"), col("l_discount").sum().round(2).alias("v2"), col("l_extendedprice").sum().round(2).alias("v3"))


@query(
    "h2o_gb6",
    "SELECT l_suppkey, l_linenumber, round(median(l_extendedprice), 4) AS median_v3, round(stddev_samp(l_extendedprice), 4) AS sd_v3 FROM lineitem GROUP BY 1, 2",
)
def gb6(spark, d):
    f = _items(spark, d, "l_suppkey", "l_linenumber", "l_extendedprice")
    return f.group_by("l_suppkey", "l_linenumber").agg(col("l_extendedprice").median().round(4).alias("median_v3"), col("l_extendedprice").std().round(4).alias("sd_v3"))


@query("h2o_gb7", "SELECT l_orderkey, max(l_quantity) - min(l_linenumber) AS range_v1_v2 FROM lineitem GROUP BY 1")
def gb7(spark, d):
    f = _items(spark, d, "l_orderkey", "l_quantity", "l_linenumber")
    return f.group_by("l_orderkey").agg((col("l_quantity").max() - col("l_linenumber").min()).alias("range_v1_v2"))


@query(
    "h2o_gb8",
    """SELECT l_partkey, l_extendedprice AS largest2_v3 FROM (SELECT l_partkey, l_extendedprice,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC) AS n FROM lineitem) WHERE n <= 2""",
)
def gb8(spark, d):
    top = _items(spark, d, "l_partkey", "l_extendedprice").filter(col("l_extendedprice").rank("ordinal", descending=True).over("l_partkey") <= 2)
    return top.rename({"l_extendedprice": "largest2_v3"})


@query("h2o_gb9", "SELECT l_suppkey, l_returnflag, round(corr(l_quantity, l_extendedprice) ** 2, 6) AS r2 FROM lineitem GROUP BY 1, 2")
def gb9(spark, d):
    f = _items(spark, d, "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    return f.group_by("l_suppkey", "l_returnflag").agg((corr(col("l_quantity"), col("l_extendedprice")) ** 2.0).round(6).alias("r2"))


@query(
    "h2o_gb10",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS v3, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def gb10(spark, d):
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return _items(spark, d, *keys, "l_extendedprice").group_by(*keys).agg(col("l_extendedprice").sum().round(2).alias("v3"), length().alias("n"))


@query("h2o_j1", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS v1, round(sum(s_acctbal), 2) AS v2 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def j1(spark, d):
    side = scan(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    out = _items(spark, d, "l_suppkey", "l_extendedprice").join(side, left_on="l_suppkey", right_on="s_suppkey")
    return out.select(length().alias("n"), col("l_extendedprice").sum().round(2).alias("v1"), col("s_acctbal").sum().round(2).alias("v2"))


@query("h2o_j2", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS v1, round(sum(p_retailprice), 2) AS v2 FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size < 25")
def j2(spark, d):
    side = scan(spark, d, "part").filter(col("p_size") < 25).select("p_partkey", "p_retailprice")
    out = _items(spark, d, "l_partkey", "l_extendedprice").join(side, left_on="l_partkey", right_on="p_partkey")
    return out.select(length().alias("n"), col("l_extendedprice").sum().round(2).alias("v1"), col("p_retailprice").sum().round(2).alias("v2"))


@query(
    "h2o_j3",
    """SELECT count(*) AS n, count(p_retailprice) AS matched, round(sum(p_retailprice), 2) AS v2
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25""",
)
def j3(spark, d):
    side = scan(spark, d, "part").filter(col("p_size") < 25).select("p_partkey", "p_retailprice")
    out = _items(spark, d, "l_partkey").join(side, left_on="l_partkey", right_on="p_partkey", how="left")
    return out.select(length().alias("n"), col("p_retailprice").count().alias("matched"), col("p_retailprice").sum().round(2).alias("v2"))


@query(
    "h2o_j4",
    """SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS v1, round(sum(p_retailprice), 2) AS v2 FROM lineitem JOIN part
    ON 'id' || l_partkey = 'id' || p_partkey""",
)
def j4(spark, d):
    text = lambda c: concat_str("", lit("id"), col(c))
    side = scan(spark, d, "part").select(text("p_partkey").alias("pid"), "p_retailprice")
    out = _items(spark, d, "l_partkey", "l_extendedprice").with_columns(text("l_partkey").alias("pid")).join(side, on="pid")
    return out.select(length().alias("n"), col("l_extendedprice").sum().round(2).alias("v1"), col("p_retailprice").sum().round(2).alias("v2"))


@query("h2o_j5", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS v1, round(sum(o_totalprice), 2) AS v2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j5(spark, d):
    side = scan(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = _items(spark, d, "l_orderkey", "l_extendedprice").join(side, left_on="l_orderkey", right_on="o_orderkey")
    return out.select(length().alias("n"), col("l_extendedprice").sum().round(2).alias("v1"), col("o_totalprice").sum().round(2).alias("v2"))

