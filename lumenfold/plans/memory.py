"""Sources in the driver's memory, lists and globs of files, and what their readers and writers can be told."""

from __future__ import annotations

import csv
import io as text_io
import json

import pyarrow as pa
import pyarrow.parquet as pq

from lumenfold.functions.expr import col, lit, when
from lumenfold.plans.files import _place
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan
from lumenfold.sources import io

_COLUMNS = ("s_suppkey", "s_name", "s_acctbal")
_SQL = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"
_SCHEMA = "s_suppkey bigint, s_name string, s_acctbal double"


def _suppliers(spark, d):
    return scan(spark, d, "supplier").select(*_COLUMNS)


def _csv(rows, header: bool = True) -> bytes:
    out = text_io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerows(([_COLUMNS] if header else []) + rows)
    return out.getvalue().encode()


@query("csv_bytes", _SQL)
def csv_bytes(spark, d):
    return io.scan_csv_bytes(spark, _csv(_suppliers(spark, d).rows()), schema=_SCHEMA)


@query("ndjson_bytes", _SQL)
def ndjson_bytes(spark, d):
    data = "\n".join(json.dumps(r) for r in _suppliers(spark, d).to_maps()).encode()
    return io.scan_ndjson_bytes(spark, data, schema=_SCHEMA)


@query("json_bytes", _SQL)
def json_bytes(spark, d):
    return io.scan_json_bytes(spark, io.to_json(_suppliers(spark, d)).encode(), schema=_SCHEMA)


@query("lines_bytes", "SELECT s_name AS line FROM supplier")
def lines_bytes(spark, d):
    data = "\n".join(r[1] for r in _suppliers(spark, d).rows()).encode()
    return io.scan_lines_bytes(spark, data)


@query("parquet_bytes", _SQL)
def parquet_bytes(spark, d):
    out = text_io.BytesIO()
    pq.write_table(_suppliers(spark, d).to_arrow(), out)
    return io.scan_parquet_bytes(spark, out.getvalue())


def _ipc(spark, d, stream: bool) -> bytes:
    out = text_io.BytesIO()
    _suppliers(spark, d).write_ipc(out, stream=stream, compression="lz4")
    return out.getvalue()


@query("ipc_bytes", _SQL)
def ipc_bytes(spark, d):
    return io.scan_ipc_bytes(spark, _ipc(spark, d, False))


@query("ipc_stream_bytes", _SQL)
def ipc_stream_bytes(spark, d):
    return io.scan_ipc_bytes(spark, _ipc(spark, d, True), stream=True)


@query("ipc_schema", "SELECT * FROM (VALUES ('s_suppkey', 'int64'), ('s_name', 'string'), ('s_acctbal', 'double')) t(name, kind)")
def ipc_schema(spark, d):
    s = io.read_ipc_schema(_ipc(spark, d, False))
    return io.from_rows(spark, [(f.name, str(f.type)) for f in s], "name string, kind string")


@query("parquet_schema", "SELECT * FROM (VALUES ('s_suppkey', 'bigint'), ('s_name', 'string'), ('s_nationkey', 'int'), ('s_acctbal', 'double')) t(name, kind)")
def parquet_schema(spark, d):
    s = io.read_parquet_schema(spark, f"{d}/supplier.parquet")
    return io.from_rows(spark, [(f.name, f.dataType.simpleString()) for f in s.fields], "name string, kind string")


@query("arrow_batches", _SQL)
def arrow_batches(spark, d):
    return io.from_arrow(spark, _suppliers(spark, d).to_arrow().to_batches())


@query("arrow_reader", _SQL)
def arrow_reader(spark, d):
    t = _suppliers(spark, d).record()
    return io.from_arrow(spark, pa.RecordBatchReader.from_batches(t.schema, t.to_batches()))


@query("arrow_schema", "SELECT * FROM (VALUES ('s_suppkey', 'int64'), ('s_name', 'string'), ('s_acctbal', 'double')) t(name, kind)")
def arrow_schema(spark, d):
    return io.from_rows(spark, [(f.name, str(f.type)) for f in _suppliers(spark, d).arrow_schema()], "name string, kind string")


# -- several files ---------------------------------------------------------------------------------------------------
def _halves(spark, d, sink) -> str:
    """The table in two folders, a and b."""
    p, f = _place(spark), _suppliers(spark, d)
    sink(f.filter(col("s_suppkey") % 2 == 0), f"{p}/part-a")
    sink(f.filter(col("s_suppkey") % 2 != 0), f"{p}/part-b")
    return p


def _both(name: str, sink, read, sql: str = _SQL):
    """Queries of a list of paths and of a glob."""

    @query(f"{name}_list", sql)
    def listed(spark, d):
        p = _halves(spark, d, sink)
        return read(spark, [f"{p}/part-a", f"{p}/part-b"])

    @query(f"{name}_glob", sql)
    def globbed(spark, d):
        return read(spark, f"{_halves(spark, d, sink)}/part-*")

    @query(f"{name}_paths", "SELECT s_suppkey, s_suppkey % 2 = 0 AS in_a FROM supplier")
    def paths(spark, d):
        f = read(spark, f"{_halves(spark, d, sink)}/part-*", include_file_paths="path")
        return f.select("s_suppkey", col("path").str.contains("part-a", literal=True).alias("in_a"))


_both("parquet", io.sink_parquet, io.scan_parquet)
_both("csv", io.sink_csv, lambda spark, p, **o: io.scan_csv(spark, p, schema=_SCHEMA, **o))
_both("ndjson", io.sink_ndjson, lambda spark, p, **o: io.scan_ndjson(spark, p, schema=_SCHEMA, **o))
_both("ipc", io.sink_ipc, io.scan_ipc)


def _lines(f, p):
    f.select("s_suppkey").spark().selectExpr("cast(s_suppkey as string) AS value").write.text(p)


def _numbers(spark, p, **o):
    f = io.scan_lines(spark, p, name="n", **o)
    return f.select(col("n").cast("bigint").alias("s_suppkey"), *[c for c in f.columns if c != "n"])


_both("lines", _lines, _numbers, "SELECT s_suppkey FROM supplier")


@query("ipc_hive", "SELECT s_suppkey, s_acctbal, (s_suppkey % 2)::INTEGER AS half, s_suppkey % 2 = 1 AS named FROM supplier")
def ipc_hive(spark, d):
    p, f = _place(spark), _suppliers(spark, d).select("s_suppkey", "s_acctbal")
    for half in (0, 1):
        io.sink_ipc(f.filter(col("s_suppkey") % 2 == half), f"{p}/half={half}")
    out = io.scan_ipc(spark, p, hive=True, include_file_paths="at")
    return out.select("s_suppkey", "s_acctbal", "half", col("at").str.contains("half=1", literal=True).alias("named"))


@query("json_documents", _SQL)
def json_documents(spark, d):
    p, f = _place(spark), _suppliers(spark, d)
    io.from_rows(spark, [(io.to_json(f),)], "value string").spark().write.text(p)
    return io.scan_json(spark, p, schema=_SCHEMA)


@query("ndjson_overrides", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_acctbal FROM supplier")
def ndjson_overrides(spark, d):
    p = _place(spark)
    io.sink_ndjson(_suppliers(spark, d), p, compression="gzip")
    return io.scan_ndjson(spark, p, overrides={"s_suppkey": "string"}, sampling=0.5)


@query("ndjson_bad_lines", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0")
def ndjson_bad_lines(spark, d):
    p, f = _place(spark), _suppliers(spark, d)
    rows = [("{" if r["s_suppkey"] % 3 == 0 else json.dumps(r),) for r in f.to_maps()]
    io.from_rows(spark, rows, "value string").spark().write.text(p)
    return io.scan_ndjson(spark, p, schema=_SCHEMA, ignore_errors=True)


# -- CSV ---------------------------------------------------------------------------------------------------------------
@query("csv_several_nulls", "SELECT s_suppkey::INTEGER AS s_suppkey, CASE WHEN s_suppkey % 5 > 1 THEN s_acctbal END AS s_acctbal, CASE WHEN s_suppkey % 5 > 1 THEN s_nationkey END AS s_nationkey FROM supplier")
def csv_several_nulls(spark, d):
    p = _place(spark)
    hole = lambda c: when(col("s_suppkey") % 5 == 0).then(lit("NA")).when(col("s_suppkey") % 5 == 1).then(lit("-")).otherwise(col(c).cast("string")).alias(c)
    io.sink_csv(scan(spark, d, "supplier").select("s_suppkey", hole("s_acctbal"), hole("s_nationkey")), p)
    return io.scan_csv(spark, p, null_values=("NA", "-"))


@query("csv_several_nulls_typed", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def csv_several_nulls_typed(spark, d):
    p = _place(spark)
    hole = when(col("s_suppkey") % 2 == 0).then(col("s_acctbal").cast("string")).otherwise(lit("?"))
    io.sink_csv(_suppliers(spark, d).select("s_suppkey", hole.alias("s_acctbal")), p)
    return io.scan_csv(spark, p, null_values=("NA", "?"), schema="s_suppkey bigint, s_acctbal double")


@query("csv_quoted_texts", """SELECT s_suppkey || ',"' || s_name || '",' || (s_suppkey % 2 = 0) AS line FROM supplier""")
def csv_quoted_texts(spark, d):
    p = _place(spark)
    f = _suppliers(spark, d).select("s_suppkey", "s_name", (col("s_suppkey") % 2 == 0).alias("even"))
    io.sink_csv(f, p, header=False, quote_style="non_numeric")
    return io.scan_lines(spark, p)


@query("csv_quoted_always", """SELECT '"' || s_suppkey || '","' || s_name || '"' AS line FROM supplier""")
def csv_quoted_always(spark, d):
    p = _place(spark)
    io.sink_csv(_suppliers(spark, d).select("s_suppkey", "s_name"), p, header=False, quote_style="always")
    return io.scan_lines(spark, p)


@query("csv_never_quoted", "SELECT s_suppkey || ',a\"' || s_name AS line FROM supplier")
def csv_never_quoted(spark, d):
    p = _place(spark)
    f = _suppliers(spark, d).spark().selectExpr("s_suppkey", "concat('a\"', s_name) AS s_name")
    from lumenfold.operators.frame import Frame

    io.sink_csv(Frame(f), p, header=False, quote_style="never")
    return io.scan_lines(spark, p)


@query("csv_byte_order_mark", _SQL)
def csv_byte_order_mark(spark, d):
    p = _place(spark)
    io.sink_csv(_suppliers(spark, d), p, include_bom=True, check_extension=True)
    return io.scan_csv(spark, p, schema=_SCHEMA)


@query("csv_number_formats", "SELECT s_suppkey, printf('%.3f', s_acctbal) AS fixed FROM supplier")
def csv_number_formats(spark, d):
    p = _place(spark)
    io.sink_csv(_suppliers(spark, d).select("s_suppkey", col("s_acctbal").alias("fixed")), p, float_precision=3, compression="gzip", compression_level=9)
    return io.scan_csv(spark, p, schema="s_suppkey bigint, fixed string")


@query("csv_scientific", "SELECT s_suppkey, printf('%.7e', s_acctbal) AS s_acctbal FROM supplier")
def csv_scientific(spark, d):
    p = _place(spark)
    io.sink_csv(_suppliers(spark, d).select("s_suppkey", "s_acctbal"), p, float_precision=7, float_scientific=True)
    return io.scan_csv(spark, p, schema="s_suppkey bigint, s_acctbal string")


@query("csv_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day, strftime(o_orderdate, '%Y/%m/%d %H') AS at FROM orders")
def csv_dates(spark, d):
    p = _place(spark)
    f = scan(spark, d, "orders").select("o_orderkey", col("o_orderdate").cast("date").alias("day"), col("o_orderdate").cast("timestamp_ntz").alias("at"))
    io.sink_csv(f, p, date_format="dd.MM.yyyy", datetime_format="yyyy/MM/dd HH")
    return io.scan_csv(spark, p, schema="o_orderkey bigint, day string, at string")


@query("csv_dates_parsed", "SELECT o_orderkey::INTEGER AS o_orderkey, o_orderdate::DATE AS day FROM orders")
def csv_dates_parsed(spark, d):
    p = _place(spark)
    io.sink_csv(scan(spark, d, "orders").select("o_orderkey", col("o_orderdate").cast("date").alias("day")), p)
    return io.scan_csv(spark, p, try_parse_dates=True)


@query("csv_headerless", _SQL)
def csv_headerless(spark, d):
    p = _place(spark)
    io.sink_csv(_suppliers(spark, d), p, header=False, quote="'", separator="|")
    f = io.scan_csv(spark, p, has_header=False, quote="'", separator="|", column_names=list(_COLUMNS), overrides={"s_suppkey": "bigint"})
    return f


@query("csv_comments", _SQL)
def csv_comments(spark, d):
    p = _place(spark)
    lines = [(x,) for x in _csv(_suppliers(spark, d).rows(), header=False).decode().splitlines()] + [("# a comment",), ("#1,x,2.0",)]
    io.from_rows(spark, lines, "value string").spark().write.text(p)
    return io.scan_csv(spark, p, has_header=False, comment="#", schema=_SCHEMA, max_record_size=10_000)


@query("csv_texts_only", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def csv_texts_only(spark, d):
    p = _place(spark)
    io.sink_csv(_suppliers(spark, d).select("s_suppkey", "s_name"), p)
    return io.scan_csv(spark, p, infer=False, encoding="UTF-8", raise_if_empty=True)


@query("csv_ragged", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def csv_ragged(spark, d):
    p = _place(spark)
    lines = [(f"{k},{n}" + (f",{b!r},more" if k % 2 == 0 else ""),) for k, n, b in _suppliers(spark, d).rows()]
    io.from_rows(spark, lines, "value string").spark().write.text(p)
    return io.scan_csv(spark, p, has_header=False, schema=_SCHEMA, truncate_ragged=True)


@query("csv_bad_rows", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def csv_bad_rows(spark, d):
    p = _place(spark)
    lines = [(f"{k},{n},{b!r}" if k % 2 == 0 else f"{k},{n},bad",) for k, n, b in _suppliers(spark, d).rows()]
    io.from_rows(spark, lines, "value string").spark().write.text(p)
    return io.scan_csv(spark, p, has_header=False, schema=_SCHEMA, ignore_errors=True)


@query("csv_skipped_lines", "SELECT n_nationkey, n_name FROM nation")
def csv_skipped_lines(spark, d):
    p = _place(spark)
    rows = scan(spark, d, "nation").select("n_nationkey", "n_name").rows()
    io.from_rows(spark, [("\n".join(["made by hand", "n_nationkey,n_name", *[f"{k},{n}" for k, n in rows]]),)], "value string").spark().write.text(p)
    return io.scan_csv(spark, p, skip_lines=1, schema="n_nationkey int, n_name string")


# -- databases ---------------------------------------------------------------------------------------------------------
@query("database_round_trip", _SQL)
def database_round_trip(spark, d):
    """Through the database that comes with Spark, in the memory of the driver's JVM."""
    import uuid

    url, driver = f"jdbc:derby:memory:db{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    f = _suppliers(spark, d)
    io.write_database(f.filter(col("s_suppkey") % 2 == 0), url, "supplier", driver=driver, types="s_name VARCHAR(200)", dialect="derby")
    f.filter(col("s_suppkey") % 2 != 0).write_database(url, "supplier", if_exists="append", driver=driver)
    out = io.read_database(spark, url, "SELECT * FROM supplier", driver=driver, overrides="s_suppkey bigint")
    return out.rename({c: c.lower() for c in out.columns})


@query("database_cursor", _SQL)
def database_cursor(spark, d):
    """The rows of an open cursor of a database on the driver."""
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE supplier (s_suppkey INTEGER, s_name TEXT, s_acctbal REAL)")
    db.executemany("INSERT INTO supplier VALUES (?, ?, ?)", _suppliers(spark, d).rows())
    return io.read_cursor(spark, db.execute("SELECT s_suppkey, s_name, s_acctbal FROM supplier"), _SCHEMA)


@query("frames_of_schemas", "SELECT * FROM (VALUES (1::BIGINT, 'a', 0.5::DOUBLE), (2, NULL, NULL)) t(k, s, x)")
def frames_of_schemas(spark, d):
    schema = io.schema_of_fields([("k", "bigint"), ("s", "string"), ("x", "double")])
    return io.frame_of(spark, {"k": [1, 2], "s": ["a", None], "x": [0.5, None]}, schema)
