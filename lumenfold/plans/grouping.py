"""Groups: plain, ordered, filtered, by calendar windows and by rolling windows."""

from __future__ import annotations

from lumenfold.functions.expr import col, length
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan

_HOUR = 3_600_000_000


@query("group_expression_keys", "SELECT c_custkey % 7 AS k, upper(c_mktsegment) AS seg, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1, 2")
def group_expression_keys(spark, d):
    return scan(spark, d, "customer").group_by((col("c_custkey") % 7).alias("k"), col("c_mktsegment").str.to_upper().alias("seg")).agg(length().alias("n"), col("c_acctbal").sum().round(2).alias("total"))


@query("group_no_keys_empty", "SELECT count(*) AS n, sum(c_acctbal) AS total FROM customer WHERE c_custkey < 0")
def group_no_keys_empty(spark, d):
    return scan(spark, d, "customer").filter(col("c_custkey") < 0).group_by().agg(length().alias("n"), col("c_acctbal").sum().alias("total"))


@query("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 400000")
def group_having(spark, d):
    return scan(spark, d, "orders").group_by("o_custkey").having(length() > 12, col("o_totalprice").max() > 400000.0).agg(length().alias("n"))


@query("group_maintain_order", "SELECT row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS i, o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def group_maintain_order(spark, d):
    return scan(spark, d, "orders").sort("o_orderkey").group_by("o_custkey").maintain_order().len("n").with_row_index("i").select("i", "o_custkey", "n")


@query("group_every_column", "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY 1")
def group_every_column(spark, d):
    f = scan(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_tax").group_by("l_returnflag").sum()
    return f.select("l_returnflag", col("l_quantity").round(2), col("l_tax").round(2))


@query("group_extremes", "SELECT l_returnflag, min(l_shipdate)::VARCHAR AS first_day, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1")
def group_extremes(spark, d):
    f = scan(spark, d, "lineitem").select("l_returnflag", "l_shipdate", "l_linestatus")
    low, high = f.group_by("l_returnflag").min(), f.group_by("l_returnflag").max()
    return low.select("l_returnflag", col("l_shipdate").cast("string").alias("first_day")).join(high.select("l_returnflag", "l_linestatus"), on="l_returnflag")


@query("group_n_unique", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def group_n_unique(spark, d):
    return scan(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_orderpriority").group_by("o_orderstatus").n_unique()


@query("group_first_last", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS opened, arg_max(o_totalprice, o_orderkey) AS closed FROM orders GROUP BY 1")
def group_first_last(spark, d):
    f = scan(spark, d, "orders").sort("o_orderkey")
    return f.group_by("o_custkey").agg(col("o_totalprice").first().alias("opened"), col("o_totalprice").last().alias("closed"))


@query("group_head", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3")
def group_head(spark, d):
    return scan(spark, d, "orders").select("o_custkey", "o_orderkey").sort("o_orderkey").group_by("o_custkey").head(3)


@query("group_tail", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 2")
def group_tail(spark, d):
    return scan(spark, d, "orders").select("o_custkey", "o_orderkey").sort("o_orderkey").group_by("o_custkey").tail(2)


@query("group_quantiles", "SELECT l_suppkey, round(quantile_cont(l_quantity, 0.3), 6) AS l_quantity, round(quantile_cont(l_tax, 0.3), 6) AS l_tax FROM lineitem GROUP BY 1")
def group_quantiles(spark, d):
    f = scan(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_tax").group_by("l_suppkey").quantile(0.3)
    return f.select("l_suppkey", col("l_quantity").round(6), col("l_tax").round(6))


@query("group_all", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY 1")
def group_all(spark, d):
    f = scan(spark, d, "orders").select("o_custkey", "o_orderkey").sort("o_orderkey").group_by("o_custkey").all()
    return f.select("o_custkey", col("o_orderkey").cast("array<string>").list.join(",").alias("keys"))


@query(
    "map_groups",
    "SELECT o_custkey, count(*) AS n, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1",
)
def map_groups(spark, d):
    import pandas as pd

    def one(pdf):
        p = pdf["o_totalprice"].to_numpy()
        return pd.DataFrame({"o_custkey": [pdf["o_custkey"].iat[0]], "n": [len(p)], "spread": [round(p.max() - p.min(), 2)]})

    return scan(spark, d, "orders").select("o_custkey", "o_totalprice").group_by("o_custkey").map_groups(one, "o_custkey bigint, n bigint, spread double")


def _grid(step: int, span: int, by: str, aggs: str, low: str = "<=", high: str = "<") -> str:
    """SQL of windows of ``span`` every ``step`` microseconds with the empty ones between full ones."""
    back = range(-1, -(-span // step) + 1)
    starts = ", ".join(f"t // {step} * {step} - {k * step}" for k in back)
    return f"""WITH e AS (SELECT {by} AS g, epoch_us(ts) AS t, value FROM events),
    w AS (SELECT g, s, t, value FROM (SELECT g, t, value, unnest([{starts}]) AS s FROM e) WHERE s {low} t AND t {high} s + {span}),
    r AS (SELECT g, unnest(generate_series(min(s), max(s), {step})) AS s FROM w GROUP BY g)
    SELECT r.g, r.s AS start_us, {aggs} FROM r LEFT JOIN w ON w.g = r.g AND w.s = r.s GROUP BY ALL"""


def _start(name: str = "ts"):
    return col(name).dt.epoch("us").alias("start_us")


@query("dynamic_tumbling", _grid(20 * 60_000_000, 20 * 60_000_000, "0", "count(w.t) AS n, round(sum(value), 2) AS total"))
def dynamic_tumbling(spark, d):
    from lumenfold.functions.expr import lit

    f = scan(spark, d, "events").group_by_dynamic("ts", "20m").agg(length().alias("n"), col("value").sum().round(2).alias("total"))
    return f.select(lit(0).cast("int").alias("g"), _start(), "n", "total")


@query("dynamic_sliding_by_key", _grid(6 * _HOUR, 12 * _HOUR, "event_type", "count(w.t) AS n, round(sum(value), 2) AS total"))
def dynamic_sliding_by_key(spark, d):
    f = scan(spark, d, "events").group_by_dynamic("ts", "6h", period="12h", by=["event_type"]).agg(length().alias("n"), col("value").sum().round(2).alias("total"))
    return f.select(col("event_type").alias("g"), _start(), "n", "total")


@query("dynamic_closed_right", _grid(_HOUR, _HOUR, "event_type", "count(w.t) AS n", "<", "<="))
def dynamic_closed_right(spark, d):
    f = scan(spark, d, "events").group_by_dynamic("ts", "1h", closed="right", by=["event_type"]).agg(length().alias("n"))
    return f.select(col("event_type").alias("g"), _start(), "n")


@query("dynamic_closed_both", _grid(_HOUR, _HOUR, "event_type", "count(w.t) AS n", "<=", "<="))
def dynamic_closed_both(spark, d):
    f = scan(spark, d, "events").group_by_dynamic("ts", "1h", closed="both", by=["event_type"]).agg(length().alias("n"))
    return f.select(col("event_type").alias("g"), _start(), "n")


@query(
    "dynamic_months",
    """WITH e AS (SELECT date_trunc('month', o_orderdate) AS s, o_totalprice FROM orders), r AS (SELECT unnest(generate_series(min(s), max(s), INTERVAL 1 MONTH)) AS s FROM e)
    SELECT epoch_us(r.s) AS start_us, epoch_us(r.s + INTERVAL 1 MONTH) AS end_us, count(o_totalprice) AS n, round(sum(o_totalprice), 2) AS total FROM r LEFT JOIN e USING (s) GROUP BY ALL""",
)
def dynamic_months(spark, d):
    f = scan(spark, d, "orders").group_by_dynamic("o_orderdate", "1mo", include_boundaries=True).agg(length().alias("n"), col("o_totalprice").sum().round(2).alias("total"))
    return f.select(col("_lower_boundary").dt.epoch("us").alias("start_us"), col("_upper_boundary").dt.epoch("us").alias("end_us"), "n", "total")


@query(
    "dynamic_weeks_label_right",
    """WITH e AS (SELECT date_trunc('week', ts) AS s, value FROM events), r AS (SELECT unnest(generate_series(min(s), max(s), INTERVAL 7 DAY)) AS s FROM e)
    SELECT epoch_us(r.s + INTERVAL 7 DAY) AS start_us, count(value) AS n FROM r LEFT JOIN e USING (s) GROUP BY ALL""",
)
def dynamic_weeks_label_right(spark, d):
    return scan(spark, d, "events").group_by_dynamic("ts", "1w", label="right").agg(length().alias("n")).select(_start(), "n")


@query("dynamic_offset", "SELECT (epoch_us(ts) - 7200000000) // 86400000000 * 86400000000 + 7200000000 AS start_us, count(*) AS n FROM events GROUP BY 1")
def dynamic_offset(spark, d):
    return scan(spark, d, "events").group_by_dynamic("ts", "1d", offset="2h").agg(length().alias("n")).select(_start(), "n")


@query("dynamic_integers", "SELECT event_id // 500 * 500 AS event_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def dynamic_integers(spark, d):
    return scan(spark, d, "events").group_by_dynamic("event_id", "500i").agg(length().alias("n"), col("value").sum().round(2).alias("total"))


_ROLL = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {} MICROSECOND PRECEDING AND CURRENT ROW)"


@query(
    "rolling_groups",
    f"""SELECT user_id, epoch_us(ts) AS at, round(sum(value) {_ROLL.format(86399999999)}, 2) AS total, max(value) {_ROLL.format(86399999999)} AS high,
    count(*) {_ROLL.format(86399999999)} AS n FROM events""",
)
def rolling_groups(spark, d):
    f = scan(spark, d, "events").rolling("ts", "1d", by=["user_id"]).agg(col("value").sum().round(2).alias("total"), col("value").max().alias("high"), length().alias("n"))
    return f.select("user_id", col("ts").dt.epoch("us").alias("at"), "total", "high", "n")


@query("rolling_closed_both", f"SELECT user_id, epoch_us(ts) AS at, count(*) {_ROLL.format(86400000000)} AS n FROM events")
def rolling_closed_both(spark, d):
    f = scan(spark, d, "events").rolling("ts", "1d", closed="both", by=["user_id"]).agg(length().alias("n"))
    return f.select("user_id", col("ts").dt.epoch("us").alias("at"), "n")
