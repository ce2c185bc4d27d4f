"""The input tables as frames."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from lumenfold.operators.frame import Frame

#: Schemas by path, so that a table's footer is read once in a session and not for each query.
_SCHEMAS: WeakKeyDictionary[SparkSession, dict[str, T.StructType]] = WeakKeyDictionary()


def scan(spark: SparkSession, d: str, name: str) -> Frame:
    known = _SCHEMAS.setdefault(spark, {})
    path = f"{d}/{name}.parquet"
    if path not in known:
        known[path] = spark.read.parquet(path).schema
    return Frame(spark.read.schema(known[path]).parquet(path))
