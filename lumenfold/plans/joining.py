"""Joins of every kind."""

from __future__ import annotations

from lumenfold.functions.expr import col, lit, when
from lumenfold.operators.joins import interval_join
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan

def _nation(spark, d):
    return scan(spark, d, "nation").select(col("n_nationkey").alias("s_nationkey"), "n_name")


_N = "(SELECT n_nationkey AS s_nationkey, n_name FROM nation)"
_ALL = "(SELECT CASE WHEN s_suppkey % 4 = 1 THEN s_nationkey + 10 ELSE greatest(s_nationkey, 5) END AS s_nationkey, s_suppkey, s_acctbal FROM supplier)"


def _all(spark, d):
    """Every supplier; nations below 5 have none, and the keys of a quarter are shifted, some beyond all nations."""
    low = when(col("s_nationkey") < 5).then(lit(5)).otherwise(col("s_nationkey"))
    k = when(col("s_suppkey") % 4 == 1).then(col("s_nationkey") + 10).otherwise(low)
    return scan(spark, d, "supplier").select(k.cast("int").alias("s_nationkey"), "s_suppkey", "s_acctbal")


def _kind(how: str, sql: str, name: str = "", **options):
    @query(f"join_{name or how}", sql)
    def run(spark, d):
        return _nation(spark, d).join(_all(spark, d), on="s_nationkey", how=how, **options)

    return run


_kind("inner", f"SELECT s_nationkey, n_name, s_suppkey, s_acctbal FROM {_N} JOIN {_ALL} USING (s_nationkey)")
_kind("left", f"SELECT s_nationkey, n_name, s_suppkey, s_acctbal FROM {_N} LEFT JOIN {_ALL} USING (s_nationkey)")
_kind("right", f"SELECT s_nationkey, n_name, s_suppkey, s_acctbal FROM {_N} RIGHT JOIN {_ALL} USING (s_nationkey)")
_kind("semi", f"SELECT s_nationkey, n_name FROM {_N} SEMI JOIN {_ALL} USING (s_nationkey)")
_kind("anti", f"SELECT s_nationkey, n_name FROM {_N} ANTI JOIN {_ALL} USING (s_nationkey)")
_kind("full", f"SELECT a.s_nationkey, n_name, b.s_nationkey AS s_nationkey_right, s_suppkey, s_acctbal FROM {_N} a FULL JOIN {_ALL} b USING (s_nationkey)")
_kind("full", f"SELECT s_nationkey, n_name, s_suppkey, s_acctbal FROM {_N} FULL JOIN {_ALL} USING (s_nationkey)", "full_coalesced", coalesce=True)


@query("join_cross", "SELECT a.r_regionkey, a.r_name, b.r_regionkey AS r_regionkey_right, b.r_name AS r_name_right FROM region a, region b")
def join_cross(spark, d):
    return scan(spark, d, "region").join(scan(spark, d, "region"), how="cross")


@query("join_suffix", "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_b, b.n_name AS n_name_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_suffix(spark, d):
    n = scan(spark, d, "nation")
    return n.join(n, on="n_regionkey", suffix="_b")


@query("join_on_expressions", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey % 100 = s_suppkey")
def join_on_expressions(spark, d):
    s = scan(spark, d, "supplier").select("s_suppkey")
    return scan(spark, d, "customer").select("c_custkey").join(s, left_on=(col("c_custkey") % 100).alias("digit"), right_on="s_suppkey", coalesce=False)


_EVERY = "(SELECT CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END AS k, s_suppkey FROM supplier)"


def _quarter_null(spark, d):
    """Every supplier, the keys of a quarter null: that group grows with the table."""
    return scan(spark, d, "supplier").select(when(col("s_suppkey") % 4 != 0).then(col("s_nationkey")).otherwise(lit(None)).alias("k"), "s_suppkey")


@query("join_nulls_equal", f"SELECT a.k, a.s_suppkey, b.s_suppkey AS s_suppkey_right FROM {_EVERY} a JOIN {_EVERY} b ON a.k IS NOT DISTINCT FROM b.k")
def join_nulls_equal(spark, d):
    f = _quarter_null(spark, d)
    return f.join(f, on="k", nulls_equal=True)


@query("join_nulls_apart", f"SELECT a.k, a.s_suppkey, b.s_suppkey AS s_suppkey_right FROM {_EVERY} a JOIN {_EVERY} b ON a.k = b.k")
def join_nulls_apart(spark, d):
    f = _quarter_null(spark, d)
    return f.join(f, on="k")


@query("join_validated", "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_validated(spark, d):
    c = scan(spark, d, "customer").select("c_custkey", "c_name")
    return scan(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, left_on="o_custkey", right_on="c_custkey", validate="m:1")


@query("join_keeps_order", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_keeps_order(spark, d):
    c = scan(spark, d, "customer").select("c_custkey", "c_name")
    out = scan(spark, d, "orders").select("o_orderkey", "o_custkey").sort("o_orderkey").join(c, left_on="o_custkey", right_on="c_custkey", maintain_order="left")
    return out.with_row_index("i").select("i", "o_orderkey", "c_name")


@query("join_where_theta", "SELECT a.s_suppkey, b.s_suppkey AS s_suppkey_right FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_where_theta(spark, d):
    s = scan(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return s.join_where(s, col("s_nationkey") == col("s_nationkey_right"), col("s_acctbal") < col("s_acctbal_right")).select("s_suppkey", "s_suppkey_right")


@query("where_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100 * c_acctbal AND c_acctbal > 0)")
def where_exists(spark, d):
    o = scan(spark, d, "orders").select("o_custkey", "o_totalprice")
    return scan(spark, d, "customer").where_exists(o, col("o_custkey") == col("c_custkey"), col("o_totalprice") > col("c_acctbal") * 100.0, col("c_acctbal") > 0.0).select("c_custkey")


@query("where_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def where_not_exists(spark, d):
    o = scan(spark, d, "orders").filter(col("o_totalprice") > 400000.0).select("o_custkey")
    return scan(spark, d, "customer").where_not_exists(o, col("o_custkey") == col("c_custkey")).select("c_custkey")


_CLICKS = "(SELECT user_id, ts, event_id FROM events WHERE event_type = 'click')"
_BUYS = "(SELECT user_id, ts, event_id AS buy, value FROM events WHERE event_type = 'purchase')"


def _sides(spark, d):
    e = scan(spark, d, "events")
    clicks = e.filter(col("event_type") == "click").select("user_id", "ts", "event_id").sort("ts")
    buys = e.filter(col("event_type") == "purchase").select("user_id", "ts", col("event_id").alias("buy"), "value").sort("ts")
    return clicks, buys


@query("asof_backward", f"SELECT c.event_id, b.buy, b.value FROM {_CLICKS} c ASOF LEFT JOIN {_BUYS} b ON c.user_id = b.user_id AND c.ts >= b.ts")
def asof_backward(spark, d):
    a, b = _sides(spark, d)
    return a.join_asof(b, on="ts", by=["user_id"]).select("event_id", "buy", "value")


@query("asof_forward", f"SELECT c.event_id, b.buy FROM {_CLICKS} c ASOF LEFT JOIN {_BUYS} b ON c.user_id = b.user_id AND c.ts <= b.ts")
def asof_forward(spark, d):
    a, b = _sides(spark, d)
    return a.join_asof(b, on="ts", by=["user_id"], strategy="forward").select("event_id", "buy")


@query("asof_strict", f"SELECT c.event_id, b.event_id AS prev FROM {_CLICKS} c ASOF LEFT JOIN {_CLICKS} b ON c.user_id = b.user_id AND c.ts > b.ts")
def asof_strict(spark, d):
    a, _ = _sides(spark, d)
    return a.join_asof(a.rename({"event_id": "prev"}), on="ts", by=["user_id"], allow_exact_matches=False).select("event_id", "prev")


@query(
    "asof_nearest",
    f"""SELECT c.event_id, CASE WHEN a.buy IS NULL OR epoch_us(c.ts) - epoch_us(b.ts) <= epoch_us(a.ts) - epoch_us(c.ts) THEN b.buy ELSE a.buy END AS buy
    FROM {_CLICKS} c ASOF LEFT JOIN {_BUYS} b ON c.user_id = b.user_id AND c.ts >= b.ts ASOF LEFT JOIN {_BUYS} a ON c.user_id = a.user_id AND c.ts <= a.ts""",
)
def asof_nearest(spark, d):
    a, b = _sides(spark, d)
    return a.join_asof(b, on="ts", by=["user_id"], strategy="nearest").select("event_id", "buy")


@query(
    "asof_tolerance",
    f"""SELECT c.event_id, CASE WHEN epoch_us(c.ts) - epoch_us(b.ts) <= 7200000000 THEN b.buy END AS buy
    FROM {_CLICKS} c ASOF LEFT JOIN {_BUYS} b ON c.user_id = b.user_id AND c.ts >= b.ts""",
)
def asof_tolerance(spark, d):
    a, b = _sides(spark, d)
    return a.join_asof(b, on="ts", by=["user_id"], tolerance="2h").select("event_id", "buy")


@query("merge_sorted_frames", "SELECT row_number() OVER (ORDER BY k, side, id) - 1 AS i, k, id FROM (SELECT c_nationkey AS k, c_custkey AS id, 0 AS side FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier)")
def merge_sorted_frames(spark, d):
    a = scan(spark, d, "customer").select(col("c_nationkey").alias("k"), col("c_custkey").alias("id")).sort("k", "id")
    b = scan(spark, d, "supplier").select(col("s_nationkey").alias("k"), col("s_suppkey").alias("id")).sort("k", "id")
    return a.merge_sorted(b, "k").with_row_index("i").select("i", "k", "id")


_SHIFTED = "(SELECT CASE WHEN c_custkey % 2 = 1 THEN -c_custkey ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE -c_acctbal END AS c_acctbal FROM customer)"


def _update(how: str, nulls: bool, sql: str):
    """An update of every customer by as many rows, half of them of keys that no customer has."""

    @query(f"update_{how}{'_nulls' if nulls else ''}", sql)
    def run(spark, d):
        c = scan(spark, d, "customer").select("c_custkey", "c_acctbal")
        k = when(col("c_custkey") % 2 == 1).then(-col("c_custkey")).otherwise(col("c_custkey"))
        new = scan(spark, d, "customer").select(k.alias("c_custkey"), when(col("c_custkey") % 4 != 0).then(-col("c_acctbal")).otherwise(lit(None)).alias("c_acctbal"))
        return c.update(new, "c_custkey", how, nulls)

    return run


_update("left", False, f"SELECT c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM customer o LEFT JOIN {_SHIFTED} n USING (c_custkey)")
_update("left", True, f"SELECT o.c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM customer o LEFT JOIN {_SHIFTED} n USING (c_custkey)")
_update("inner", False, f"SELECT c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM customer o JOIN {_SHIFTED} n USING (c_custkey)")
_update("full", False, f"SELECT c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM customer o FULL JOIN {_SHIFTED} n USING (c_custkey)")


@query(
    "interval_join",
    """SELECT o_orderkey, lo FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS price FROM orders)
    JOIN (SELECT p_partkey * 200 AS lo, p_partkey * 200 + p_size * 10 AS hi FROM part) ON price >= lo AND price < hi""",
)
def interval_join_query(spark, d):
    o = scan(spark, d, "orders").select("o_orderkey", col("o_totalprice").floor().cast("bigint").alias("price"))
    bands = scan(spark, d, "part").select((col("p_partkey") * 200).alias("lo"), (col("p_partkey") * 200 + col("p_size") * 10).alias("hi"))
    return interval_join(o, bands, "price", "lo", "hi", 256).select("o_orderkey", "lo")




_ALL_BUYS = "(SELECT event_id AS buy, ts FROM events WHERE event_type = 'purchase')"


@query(
    "asof_without_keys",
    f"""WITH c AS (SELECT event_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT ts, max(buy) AS last, min(buy) AS first FROM {_ALL_BUYS} GROUP BY 1),
    l AS (SELECT c.event_id, b.last AS before FROM c ASOF LEFT JOIN b ON c.ts >= b.ts), h AS (SELECT c.event_id, b.first AS after FROM c ASOF LEFT JOIN b ON c.ts <= b.ts)
    SELECT event_id, before, after FROM l JOIN h USING (event_id)""",
)
def asof_without_keys(spark, d):
    """The last purchase before each click, and the first after it, of any user."""
    f = scan(spark, d, "events").sort("event_id")
    a = f.filter(col("event_type") == "click").select("event_id", "ts")
    b = f.filter(col("event_type") == "purchase").select(col("event_id").alias("buy"), "ts")
    low = a.join_asof(b, on="ts").select("event_id", col("buy").alias("before"))
    return low.join(a.join_asof(b, on="ts", strategy="forward").select("event_id", col("buy").alias("after")), on="event_id")
