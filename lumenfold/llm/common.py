"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset (local tests) a folder is made."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


class Tables:
    """Tables written in the shared folder: they cut lineage as checkpoints do.

    A checkpoint keeps the size that its plan was estimated to have. In rounds of joins these estimates, products of products,
    grow into numbers of millions of digits, and the driver into gigabytes. A table has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.where, self.paths = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", set()

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, read from a table of their own."""
        path = f"{self.where}/{uuid.uuid4().hex}"
        self.paths.add(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lumenfold_table = path
        return out

    def drop(self, *but: DataFrame) -> None:
        """Delete all tables but these."""
        held = {getattr(d, "_lumenfold_table", None) for d in but}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths - held:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths &= held


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run meanwhile hand at most so many rows at once to Python: both processes hold a batch whole, and the JVM twice as it grows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def met(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` with the rows of ``right`` for its ``keys``, or those that have one (left_semi). A key may have very many rows.

    The first key is an integer, and they meet on its complement. So neither side, if it comes grouped by the keys, is
    dealt already, and adaptive execution is free to split what a task would get of one key.
    """
    first, *rest = [keys] if isinstance(keys, str) else keys
    right = right.withColumn("__key", F.bitwise_not(first)).drop(first).withColumnsRenamed({c: f"__{c}" for c in rest})
    on = F.bitwise_not(left[first]) == F.col("__key")
    for c in rest:
        on &= left[c] == F.col(f"__{c}")
    return left.join(right, on, how).drop("__key", *[f"__{c}" for c in rest])


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits that the table's only column, of 64-bit hashes, sets of ``bits`` (a multiple of 32): see marked().

    It is made by a partial aggregation, so what comes to the driver is bounded: 16 bytes for each 32 bits.
    """
    slot = hashes.select(F.pmod(F.col(hashes.columns[0]), F.lit(bits)).alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 5).cast("int").alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")).toArrow()  # one job
    out = np.zeros(bits // 32, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be among those of bitmap(): all that are, and the more others, the fuller it is."""
    slot = hashes.view(np.int64) % np.int64(len(bits) * 32)
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32) & 1).astype(bool)


def word_array(text):
    """The words of a text column, unchanged: what ASCII white space separates. Null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
