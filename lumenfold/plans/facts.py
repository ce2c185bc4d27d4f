"""What frames tell and give on the driver, and operations that differ from others by an option: each as rows beside SQL."""

from __future__ import annotations

import math
from dataclasses import make_dataclass

from pyspark.sql import types as T

from lumenfold.functions import expr as x
from lumenfold.functions.expr import asc, col, lit
from lumenfold.plans.aggregates import _E, _events
from lumenfold.plans.files import _place
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan
from lumenfold.sources import io


def _rows(spark, facts: dict):
    return io.from_rows(spark, [(k, str(v)) for k, v in facts.items()], "fact string, value string")


def _values(**facts) -> str:
    """SQL of a row for each fact; a value that is SQL text is computed."""
    return " UNION ALL ".join(f"SELECT '{k}' AS fact, ({v})::VARCHAR AS value" for k, v in facts.items())


_N = "SELECT count(*) FROM supplier"


@query("frame_shape", _values(height=_N, width="4", shape=f"SELECT '(' || count(*) || ', 4)' FROM supplier", is_empty="'False'", cleared="'True'", index="2", columns="'s_suppkey s_name s_nationkey s_acctbal'", dtypes="'bigint string int double'", schema="'bigint'", sized="'True'"))
def frame_shape(spark, d):
    f = scan(spark, d, "supplier")
    return _rows(spark, {
        "height": f.height(), "width": f.width, "shape": f.shape(), "is_empty": f.is_empty(), "cleared": f.clear().is_empty(), "index": f.get_column_index("s_nationkey"),
        "columns": " ".join(f.columns), "dtypes": " ".join(t.simpleString() for t in f.dtypes), "schema": f.collect_schema()["s_suppkey"].dataType.simpleString(), "sized": f.estimated_size() > 0,
    })


_FIRST = "FROM nation ORDER BY n_nationkey LIMIT 1"


@query("frame_cells", _values(row=f"SELECT '(' || n_nationkey || ', ''' || n_name || ''')' {_FIRST}", row_named=f"SELECT n_name {_FIRST}", row_where="SELECT '(7, ''' || n_name || ''')' FROM nation WHERE n_nationkey = 7", item="SELECT n_name FROM nation WHERE n_nationkey = 3", single=_N.replace("supplier", "nation")))
def frame_cells(spark, d):
    f = scan(spark, d, "nation").select("n_nationkey", "n_name").sort("n_nationkey")
    return _rows(spark, {"row": f.row(0), "row_named": f.row_named(0)["n_name"], "row_where": f.row_where(col("n_nationkey") == 7), "item": f.item(3, "n_name"), "single": f.select(col("n_name").len().alias("n")).item()})


@query("frame_columns_apart", "SELECT n_nationkey, n_name, n_regionkey::BIGINT + 1 AS n_regionkey, n_name AS c, n_nationkey AS s FROM nation")
def frame_columns_apart(spark, d):
    """Columns taken out, put back, replaced and packed."""
    f = scan(spark, d, "nation")
    name, rest = f.drop_in_place("n_name")
    names = [r[0] for r in name.rows()]
    f = f.replace_column(2, (col("n_regionkey") + 1).alias("n_regionkey"))
    packed = f.to_struct("p")
    assert rest.columns == ["n_nationkey", "n_regionkey"] and len(names) == f.column("n_name").height() and f.to_series(0).columns == ["n_nationkey"]
    return packed.select(*[col("p").struct.field(c) for c in f.columns], col("p").struct.field("n_name").alias("c"), col("p").struct.field("n_nationkey").alias("s"))


@query("frame_equality", _values(same="'True'", other="'False'", lazy="'True'"))
def frame_equality(spark, d):
    f = scan(spark, d, "nation")
    return _rows(spark, {"same": f.equals(f.reverse()), "other": f.equals(f.head(3)), "lazy": f.lazy().equals(f)})


@query("frame_results", _values(collect=_N, maps=_N, batches=_N, iterated=_N, by_key="SELECT count(DISTINCT s_nationkey) FROM supplier", into="SELECT s_name FROM supplier ORDER BY s_suppkey LIMIT 1", profiled=_N, cached=_N, parts="SELECT count(DISTINCT s_nationkey) FROM supplier", groups="SELECT count(DISTINCT s_nationkey) FROM supplier"))
def frame_results(spark, d):
    f = scan(spark, d, "supplier").sort("s_suppkey")
    kind = make_dataclass("Supplier", f.columns)
    held = f.cache()
    out = {
        "collect": len(f.collect()), "maps": len(f.to_maps()), "batches": sum(1 for _ in f.collect_batches()), "iterated": sum(1 for _ in f.iter_rows()), "by_key": len(f.rows_by_key("s_nationkey")),
        "into": f.collect_into(kind)[0].s_name, "profiled": f.profile()[1]["rows"], "cached": held.select(col("s_suppkey").len().alias("n")).item(), "parts": len(f.partition_by("s_nationkey")),
        "groups": sum(1 for _ in f.group_by("s_nationkey").groups()),
    }
    held.df.unpersist()
    return _rows(spark, out)


@query("frame_plans", _values(explain="'True'", optimized="'True'", with_schemas="'True'", err="'None'", glimpse="'3'"))
def frame_plans(spark, d):
    f = scan(spark, d, "nation").filter(col("n_nationkey") > 3).select("n_name", "n_regionkey", "n_nationkey")
    return _rows(spark, {
        "explain": "PushedFilters: [IsNotNull(n_nationkey)" in f.explain(), "optimized": "Filter" in f.optimized(), "with_schemas": "n_name: string" in f.explain_with(schemas=True), "err": f.err(), "glimpse": f.glimpse(2).count("<"),
    })


@query("frame_sequences", "SELECT n_nationkey::BIGINT + 1 AS a, n_nationkey::BIGINT + 2 AS b, n_name FROM nation")
def frame_sequences(spark, d):
    f = scan(spark, d, "nation").with_columns_seq((col("n_nationkey") + 1).alias("a"), (col("a") + 1).alias("b"))
    return f.select_seq("a", "b", "n_name").cast_types({T.StringType: "string"})


@query("frame_casts", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def frame_casts(spark, d):
    return scan(spark, d, "nation").select("n_nationkey", "n_regionkey").cast_all("string", strict=False)


@query("frame_stacks", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def frame_stacks(spark, d):
    f = scan(spark, d, "nation").select("n_nationkey", "n_name")
    return f.vstack(f).vstack(f)


@query("unique_kept_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def unique_kept_last(spark, d):
    return scan(spark, d, "orders").select("o_custkey", "o_orderkey").sort("o_orderkey").unique("o_custkey", keep="last")


@query("unique_kept_none", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def unique_kept_none(spark, d):
    return scan(spark, d, "orders").select("o_custkey").unique("o_custkey", keep="none")


@query("sampled_fraction", _values(rows="SELECT floor(count(*) / 4)::BIGINT FROM orders", reruns="'True'"))
def sampled_fraction(spark, d):
    f = scan(spark, d, "orders").select("o_orderkey")
    a, b = f.sample_fraction(0.25, seed=3), f.sample_fraction(0.25, seed=3)
    return _rows(spark, {"rows": a.height(), "reruns": a.equals(b)})


@query("limited_rows", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7")
def limited_rows(spark, d):
    return scan(spark, d, "nation").select("n_nationkey").sort(asc("n_nationkey").nulls_last()).limit(7)


@query("asof_named_sides", "SELECT e.event_id, max(b.event_id) AS buy FROM events e LEFT JOIN events b ON b.event_type = 'purchase' AND b.user_id = e.user_id AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.event_type = 'purchase' AND c.user_id = e.user_id AND c.ts <= e.ts) WHERE e.event_type = 'click' GROUP BY 1")
def asof_named_sides(spark, d):
    f = scan(spark, d, "events").sort("event_id")
    a = f.filter(col("event_type") == "click").select("event_id", "user_id", "ts")
    b = f.filter(col("event_type") == "purchase").select(col("event_id").alias("buy"), col("user_id").alias("who"), col("ts").alias("at"))
    return a.join_asof(b, left_on="ts", right_on="at", left_by=["user_id"], right_by=["who"], suffix="_b", coalesce=False).select("event_id", "buy")


# -- options of expressions ----------------------------------------------------------------------------------------------
@query("agg_by_options", f"SELECT user_id, count(DISTINCT k % 7) AS kinds, sum(k) FILTER (k % 2 = 0)::BIGINT AS even, count(*) = 0 AS none FROM {_E} GROUP BY 1")
def agg_by_options(spark, d):
    k = col("k")
    f = _events(spark, d).group_by("user_id").agg((k % 7).unique_counts().list.len().alias("kinds"), k.filter(k % 2 == 0).sum().alias("even"), k.is_empty().alias("none"))
    return f.select("user_id", col("kinds").cast("bigint"), col("even").cast("bigint"), "none")


@query("agg_ordered_options", f"SELECT user_id, array_to_string(list(event_id ORDER BY k DESC NULLS LAST, event_id)[1:2], ',') AS top, array_to_string(list(event_id ORDER BY event_id)[1:3], ',') AS head FROM {_E} WHERE k IS NOT NULL GROUP BY 1")
def agg_ordered_options(spark, d):
    f = _events(spark, d).filter(col("k").is_not_null()).sort("event_id").group_by("user_id")
    e = col("event_id")
    out = f.agg(e.sort_by_desc(col("k")).alias("top"), e.limit(3).alias("head")).with_columns(col("top").list.head(2))
    return out.select("user_id", *[col(c).cast("array<string>").list.join(",").alias(c) for c in ("top", "head")])


@query("agg_places", "SELECT o_custkey, array_to_string(list(i ORDER BY i) FILTER (o_totalprice > 150000), ',') AS dear, array_to_string(list(i ORDER BY o_totalprice, i), ',') AS rising FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY 1")
def agg_places(spark, d):
    f = scan(spark, d, "orders").sort("o_orderkey").group_by("o_custkey")
    out = f.agg(x.arg_where(col("o_totalprice") > 150000.0).alias("dear"), x.arg_sort_by(asc("o_totalprice")).alias("rising"))
    text = lambda c: col(c).cast("array<string>").list.join(",")
    return out.select("o_custkey", x.when(col("dear").list.len() > 0).then(text("dear")).otherwise(lit(None)).alias("dear"), text("rising").alias("rising"))


@query("agg_first_places", "SELECT o_custkey, count(DISTINCT o_orderstatus)::INTEGER AS n FROM orders GROUP BY 1")
def agg_first_places(spark, d):
    return scan(spark, d, "orders").group_by("o_custkey").agg(col("o_orderstatus").arg_unique().list.len().alias("n"))


@query("over_with_options", "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT NULL AS some, coalesce(lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS before FROM orders")
def over_with_options(spark, d):
    f = scan(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return f.select("o_orderkey", col("o_totalprice").cum_sum().over_with(["o_custkey"], "o_orderkey").is_not_null().alias("some"), col("o_orderkey").shift_fill(2, -1).over("o_custkey", order_by="o_orderkey").alias("before"))


@query("ewm_std", "SELECT count(*) AS n, true AS alike FROM events")
def ewm_std(spark, d):
    """The square of the decaying deviation is the decaying variance, whatever way the decay is given."""
    v = col("value")
    ways = {"a": v.ewm_std(alpha=0.5), "s": v.ewm_std(span=3.0), "c": v.ewm_std(com=1.0), "h": v.ewm_std(half_life=1.0, ignore_nulls=False)}
    f = scan(spark, d, "events").select("event_id", "user_id", "value")
    f = f.select(v.ewm_var(alpha=0.5).over("user_id", order_by="event_id").alias("var"), *[e.over("user_id", order_by="event_id").alias(n) for n, e in ways.items()])
    near = lambda c: (col(c) * col(c) - col("var")).abs() <= lit(1e-6) * (col("var").abs() + 1.0)
    same = near("a") & near("s") & near("c") & near("h") | col("var").is_null()
    return f.select(col("a").len().alias("n"), same.all_true().alias("alike"))


@query("inverse_hyperbolic", "SELECT o_orderkey, round(asinh(o_totalprice), 8) AS s, round(acosh(o_totalprice), 8) AS c, round(atanh(1 / o_totalprice), 10) AS t, round(asin(1 / o_totalprice), 10) AS a FROM orders")
def inverse_hyperbolic(spark, d):
    p = col("o_totalprice")
    return scan(spark, d, "orders").select("o_orderkey", p.arcsinh().round(8).alias("s"), p.arccosh().round(8).alias("c"), (lit(1.0) / p).arctanh().round(10).alias("t"), (lit(1.0) / p).arcsin().round(10).alias("a"))


@query("physical_days", "SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS days FROM orders")
def physical_days(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", col("o_orderdate").cast("date").to_physical().cast("bigint").alias("days"))


@query("cut_options", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS level FROM orders")
def cut_options(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", col("o_totalprice").cut([100000.0, 200000.0], labels=["low", "mid", "high"], left_closed=True).alias("level"))


@query("qcut_parts", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN '0' WHEN o_totalprice <= b THEN '1' WHEN o_totalprice <= c THEN '2' ELSE '3' END AS part FROM orders, q")
def qcut_parts(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", col("o_totalprice").qcut(4).alias("part"))


@query("reductions", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_tax, l_discount) AS most, l_quantity + l_tax + l_discount > 10 AS much FROM lineitem")
def reductions(spark, d):
    from lumenfold.functions.expr import max_horizontal

    c = [col(n) for n in ("l_quantity", "l_tax", "l_discount")]
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", max_horizontal(*c).alias("most"), (x.reduce(lambda a, b: a + b, *c) > 10.0).alias("much"))


@query("list_more_sets", "SELECT o_orderkey, 2 AS n, 'c,b,a' AS down, 1 AS one FROM orders")
def list_more_sets(spark, d):
    a, b = lit([1, 2, 3]), lit([2, 3, 4])
    return scan(spark, d, "orders").select(
        "o_orderkey", a.list.set_symmetric_difference(b).list.len().alias("n"), lit(["b", "c", "a"]).list.sort_desc().list.join(",").alias("down"),
        lit([1, 2, 3, 4]).list.sample_fraction(0.25, seed=2).list.len().alias("one"),
    )


@query("list_without_nans", "SELECT o_orderkey, 2 AS n, 3 AS first FROM orders")
def list_without_nans(spark, d):
    from lumenfold.functions.expr import element

    return scan(spark, d, "orders").select("o_orderkey", lit([1.0, math.nan, 2.0]).list.drop_nans().list.len().alias("n"), lit([1, 2, 3]).list.sort_by_desc(element()).list.first().cast("int").alias("first"))


@query("negated", "SELECT o_orderkey, -o_totalprice AS minus, NOT (o_totalprice > 100000) AS cheap, o_totalprice / 2 AS half FROM orders")
def negated(spark, d):
    p = col("o_totalprice")
    return scan(spark, d, "orders").select("o_orderkey", p.neg().alias("minus"), (p > 100000.0).not_().alias("cheap"), (p / 2.0).alias("half"))


# -- options of files -----------------------------------------------------------------------------------------------------
@query("parquet_hive_options", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-01') AS month, o_orderkey % 4 AS part FROM orders")
def parquet_hive_options(spark, d):
    p = _place(spark)
    f = scan(spark, d, "orders").select("o_orderkey", col("o_orderdate").dt.month_start().cast("date").alias("month"), (col("o_orderkey") % 4).alias("part"))
    io.sink_parquet(f, p, partition_by=["month", "part"])
    return io.scan_parquet(spark, p, hive_schema=T.StructType([T.StructField("part", T.LongType())]), hive_dates=False)


@query("parquet_keys_inside", "SELECT o_orderkey, o_orderstatus AS o_orderstatus_ FROM orders")
def parquet_keys_inside(spark, d):
    p = _place(spark)
    io.sink_parquet(scan(spark, d, "orders").select("o_orderkey", "o_orderstatus"), p, partition_by=["o_orderstatus"], include_key=True, compression="gzip", row_group_bytes=1 << 20)
    return io.scan_parquet(spark, p, hive=False, pruning=True)


@query("files_by_scheme", "SELECT count(*) * 4 AS n FROM supplier")
def files_by_scheme(spark, d):
    """Each format from a path with its file system's scheme."""
    p, f = _place(spark), scan(spark, d, "supplier").select("s_suppkey", "s_name")
    at = p if "://" in p or p.startswith("file:") else f"file://{p}"
    io.sink_parquet(f, f"{p}/parquet")
    io.sink_csv(f, f"{p}/csv")
    io.sink_ndjson(f, f"{p}/json")
    f.select(col("s_name").alias("value")).spark().write.text(f"{p}/text")
    parts = [io.scan_parquet(spark, f"{at}/parquet"), io.scan_csv(spark, f"{at}/csv"), io.scan_ndjson(spark, f"{at}/json"), io.scan_lines(spark, f"{at}/text")]
    counts = [g.select(col(g.columns[0]).len().alias("n")) for g in parts]
    return counts[0].concat(*counts[1:]).select(col("n").sum().cast("bigint").alias("n"))


@query("csv_line_ends", "SELECT s_suppkey, s_name FROM supplier")
def csv_line_ends(spark, d):
    p = _place(spark)
    io.sink_csv(scan(spark, d, "supplier").select("s_suppkey", "s_name"), p, line_terminator="\r\n", separator="\t", header=True, check_extension=True)
    return io.scan_csv(spark, p, separator="\t", schema="s_suppkey bigint, s_name string")


@query("csv_times", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def csv_times(spark, d):
    from lumenfold.operators.frame import Frame

    p = _place(spark)
    f = scan(spark, d, "events").select("event_id", col("ts").dt.time().alias("clock")).spark()
    io.sink_csv(Frame(f.withMetadata("clock", {"time": True})), p, time_format="%H:%M:%S")
    return io.scan_csv(spark, p, schema="event_id bigint, clock string")


@query("ipc_streams", "SELECT s_suppkey, s_name FROM supplier")
def ipc_streams(spark, d):
    """A stream in a file of a folder."""
    import io as memory

    p, out = _place(spark), memory.BytesIO()
    scan(spark, d, "supplier").select("s_suppkey", "s_name").write_ipc(out, stream=True)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{p}/one.arrows")
    to = at.getFileSystem(conf).create(at, True)
    to.write(bytearray(out.getvalue()))
    to.close()
    return io.scan_ipc(spark, p, stream=True)


