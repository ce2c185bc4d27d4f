"""Queries over whole tables, on tables that are larger than any subset that a query of the same kind reads."""

import pytest

from lumenfold.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.01"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def same(spark, con, name, rows):
    """The query equals its SQL and has as many rows as ``rows``, a count in SQL."""
    df = QUERIES[name](spark, SF)
    assert oracle.differences(df, con, SQL[name]) == []
    assert df.count() == con.execute(f"SELECT {rows}").fetchone()[0]


@pytest.mark.parametrize("name", ["ewm_mean", "ewm_mean_recursive", "ewm_var", "ewm_sum", "ewm_mean_by_time"])
def test_decay_of_all_users(spark, con, name):
    same(spark, con, name, "(SELECT count(*) FROM events)")


@pytest.mark.parametrize("name", ["str_reverse", "str_codecs"])
def test_texts_to_their_ends(spark, con, name):
    same(spark, con, name, "(SELECT count(*) FROM documents)")


def test_escaped_texts_to_their_ends(spark, con):
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: r.escaped for r in QUERIES["str_escape_regex"](spark, SF).collect()}
    special = set(r"\.+*?()|[]{}^$-#&~")
    assert got == {i: None if t is None else "".join("\\" * (c in special) + c for c in t) for i, t in text.items()}
    assert max(map(len, filter(None, got.values()))) > 1000


@pytest.mark.parametrize("name", ["inner", "left", "right", "semi", "anti", "full", "full_coalesced"])
def test_joins_of_all_suppliers(spark, con, name):
    name = f"join_{name}"
    same(spark, con, name, f"count(*) FROM ({SQL[name]})")
    if any(k in name for k in ("right", "full")):
        assert QUERIES[name](spark, SF).filter("s_suppkey is not null").count() == con.execute("SELECT count(*) FROM supplier").fetchone()[0]
    else:
        assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["join_nulls_equal", "join_nulls_apart"])
def test_null_keys_of_all_suppliers(spark, con, name):
    k = "(SELECT count(*) AS n FROM supplier WHERE s_suppkey % 4 != 0 GROUP BY s_nationkey)"
    null = "(SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0)"
    same(spark, con, name, f"(SELECT sum(n * n) FROM {k})" + f" + {null} * {null}" * name.endswith("equal"))


@pytest.mark.parametrize("name", ["left", "left_nulls", "inner", "full"])
def test_updates_of_all_customers(spark, con, name):
    half = "(SELECT count(*) FROM customer WHERE c_custkey % 2 = 0)"
    n = {"inner": half, "full": f"2 * (SELECT count(*) FROM customer) - {half}"}.get(name, "(SELECT count(*) FROM customer)")
    same(spark, con, f"update_{name}", n)


@pytest.mark.parametrize(("name", "rows"), [("concat_relaxed", "(SELECT count(*) FROM region) + (SELECT count(*) FROM orders)"), ("concat_align", "(SELECT count(DISTINCT k) FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier))")])
def test_concats_of_whole_tables(spark, con, name, rows):
    same(spark, con, name, rows)


def test_decay_counts_values_since_the_start(spark):
    from lumenfold import col
    from lumenfold.operators.frame import Frame

    n, gap = 1000, 150
    rows = [(i, 1.0 + i % 7, float(i) if i % gap == 0 else None) for i in range(n)]
    f = Frame(spark.createDataFrame(rows, "i long, v double, far double"))
    dense, far, std, total = (
        e.over(order_by="i") for e in (col("v").ewm_mean(0.9, min_samples=100), col("far").ewm_mean(0.5, min_samples=3), col("v").ewm_std(0.9, min_samples=100), col("v").ewm_sum(0.9, min_samples=100))
    )
    got = sorted(f.select("i", dense.alias("a"), far.alias("b"), std.alias("c"), total.alias("d")).spark().collect())
    mean = weight = total = 0.0
    for i, v, x in rows:
        weight, total = weight * 0.1 + 1, total * 0.1 + v
        mean += (v - mean) / weight
        r = got[i]
        assert (r.a is None) == (i < 99) == (r.c is None) == (r.d is None)
        assert (r.b is None) == (x is None or i < 2 * gap)
        if i >= 99:
            assert r.a == pytest.approx(mean) and r.d == pytest.approx(total)
        if r.b is not None:
            assert r.b == pytest.approx(x, rel=1e-9)
