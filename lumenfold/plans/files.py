"""Sources and sinks: each query writes a table in the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import types as T

from lumenfold.functions.expr import col, lit
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan
from lumenfold.sources import io


def _place(spark) -> str:
    return f"{io.shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _customers(spark, d):
    return scan(spark, d, "customer")


_ALL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_LONG = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("parquet_round_trip", _ALL)
def parquet_round_trip(spark, d):
    p = _place(spark)
    io.sink_parquet(_customers(spark, d), p)
    return io.scan_parquet(spark, p)


@query("parquet_hive", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def parquet_hive(spark, d):
    p = _place(spark)
    io.sink_parquet(_customers(spark, d).select("c_custkey", "c_acctbal", "c_mktsegment"), p, partition_by=["c_mktsegment"])
    return io.scan_parquet(spark, p).filter(col("c_mktsegment") == "BUILDING")


@query("parquet_evolution", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, NULL::DOUBLE AS extra FROM customer UNION ALL SELECT s_suppkey, s_nationkey::BIGINT, s_acctbal FROM supplier")
def parquet_evolution(spark, d):
    p = _place(spark)
    io.sink_parquet(_customers(spark, d).select("c_custkey", "c_nationkey", "c_name"), f"{p}/a")
    new = scan(spark, d, "supplier").select(col("s_suppkey").alias("c_custkey"), col("s_nationkey").cast("bigint").alias("c_nationkey"), col("s_acctbal").alias("extra"))
    io.sink_parquet(new, f"{p}/b")
    want = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.LongType()), T.StructField("extra", T.DoubleType())])
    return io.scan_parquet(spark, [f"{p}/a", f"{p}/b"], schema=want, insert_missing=True, ignore_extra=True, upcast=True)


@query("parquet_file_paths", "SELECT count(*) AS n, true AS named FROM customer")
def parquet_file_paths(spark, d):
    f = io.scan_parquet(spark, f"{d}/customer.parquet", include_file_paths="path")
    return f.select(col("path").len().alias("n"), col("path").str.contains("customer.parquet", literal=True).all_true().alias("named"))


@query("csv_round_trip", _LONG)
def csv_round_trip(spark, d):
    p = _place(spark)
    io.sink_csv(_customers(spark, d), p)
    return io.scan_csv(spark, p).cast({"c_custkey": "bigint", "c_nationkey": "bigint"})


@query("csv_dialect", "SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def csv_dialect(spark, d):
    from lumenfold.functions.expr import when

    p = _place(spark)
    holes = _customers(spark, d).select("c_custkey", "c_name", when(col("c_nationkey") != 3).then(col("c_nationkey")).otherwise(lit(None)).alias("c_nationkey"))
    io.sink_csv(holes, p, separator=";", quote_all=True, null_value="NA", compression="gzip")
    return io.scan_csv(spark, p, separator=";", null_values=["NA"], schema="c_custkey bigint, c_name string, c_nationkey int")


@query("csv_decimal_comma", "SELECT c_custkey::DOUBLE AS c_custkey, c_acctbal FROM customer")
def csv_decimal_comma(spark, d):
    p = _place(spark)
    io.sink_csv(_customers(spark, d).select("c_custkey", "c_acctbal"), p, separator=";", decimal_comma=True)
    return io.scan_csv(spark, p, separator=";", decimal_comma=True)


@query("csv_skipped_rows", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 2")
def csv_skipped_rows(spark, d):
    p = _place(spark)
    io.sink_csv(scan(spark, d, "nation").select("n_nationkey", "n_name").sort("n_nationkey"), p, one_file=True)
    return io.scan_csv(spark, p, skip_rows_after_header=3, schema="n_nationkey int, n_name string")


@query("ndjson_round_trip", _LONG)
def ndjson_round_trip(spark, d):
    p = _place(spark)
    io.sink_ndjson(_customers(spark, d), p)
    return io.scan_ndjson(spark, p)


@query("ndjson_nested", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer")
def ndjson_nested(spark, d):
    from lumenfold.functions.expr import struct

    p = _place(spark)
    io.sink_ndjson(_customers(spark, d).select(struct(col("c_custkey").alias("id"), col("c_name").alias("name"), col("c_acctbal").alias("bal")).alias("s")), p)
    return io.scan_ndjson(spark, p).unnest("s")


@query("lines_scan", "SELECT n_nationkey || ',' || n_name AS line FROM nation")
def lines_scan(spark, d):
    p = _place(spark)
    io.sink_csv(scan(spark, d, "nation").select("n_nationkey", "n_name"), p, header=False)
    return io.scan_lines(spark, p)


@query("ipc_round_trip", _ALL)
def ipc_round_trip(spark, d):
    p = _place(spark)
    io.sink_ipc(_customers(spark, d), p, compression="zstd")
    return io.scan_ipc(spark, p)


@query("arrow_tables", "SELECT r_regionkey, r_name FROM region")
def arrow_tables(spark, d):
    return io.from_arrow(spark, scan(spark, d, "region").to_arrow())


@query("orc_round_trip", _ALL)
def orc_round_trip(spark, d):
    p = _place(spark)
    _customers(spark, d).spark().write.orc(p)
    return spark.read.orc(p)


@query("frame_literals", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, NULL), (NULL, 'c')) t(k, s)")
def frame_literals(spark, d):
    return io.frame_of(spark, {"k": [1, 2, None], "s": ["a", None, "c"]}, "k bigint, s string")


@query("partitioned_files", "SELECT o_orderkey, o_orderstatus FROM orders")
def partitioned_files(spark, d):
    p = _place(spark)
    io.sink_parquet(scan(spark, d, "orders").select("o_orderkey", "o_orderstatus"), p, partition_by=["o_orderstatus"], max_rows_per_file=1000)
    return io.scan_parquet(spark, p)
