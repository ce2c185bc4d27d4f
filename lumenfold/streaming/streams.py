"""Structured Streaming on the same expressions: watermarks, tumbling, sliding and session windows, keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.expr import Ctx, Expr
from lumenfold.sources.io import shared_dir


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 1000, pattern: str = "*") -> DataFrame:
    """New files of a folder as they come, of those whose names fit the pattern."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", pattern)
    return r.format(fmt).load(path)


def _marked(df: DataFrame, time: str, watermark: str | None) -> DataFrame:
    """With a watermark; a time without a zone is read as one of the session's zone, as watermarks need instants."""
    if not watermark:
        return df
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, watermark)


def windowed(df: DataFrame, time: str, size: str, aggs: list[Expr], slide: str | None = None, by=(), watermark: str | None = None) -> DataFrame:
    """Aggregates over tumbling (or, with ``slide``, sliding) windows; on batches and streams alike."""
    df = _marked(df, time, watermark)
    ctx = Ctx(df, grouped=True)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(w.alias("w"), *by).agg(*[e.compile(ctx).alias(e.name_of()) for e in aggs])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, aggs: list[Expr], by=(), watermark: str | None = None) -> DataFrame:
    """Aggregates over sessions: events of a key less than ``gap`` apart."""
    df = _marked(df, time, watermark)
    ctx = Ctx(df, grouped=True)
    out = df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*[e.compile(ctx).alias(e.name_of()) for e in aggs])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def deduplicated(df: DataFrame, keys: list[str], time: str, watermark: str) -> DataFrame:
    """First event of each key, with state kept as long as the watermark allows."""
    return _marked(df, time, watermark).dropDuplicatesWithinWatermark(keys)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total after each batch of a key's events: state of two numbers a key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run over everything that is there and return it from files in the shared folder, which the executors write: what all
    batches gave, or in complete mode the last. A batch that runs again writes its files again."""
    spark = df.sparkSession
    where, done = f"{checkpoint or f'{shared_dir(spark)}/{name}'}-rows", {}

    def keep(rows, i):
        rows.write.mode("overwrite").parquet(f"{where}/{i}")
        done[i] = f"{where}/{i}"

    w = df.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()
    paths = [done[i] for i in sorted(done)][-1 if mode == "complete" else 0 :]
    return spark.read.schema(df.schema).parquet(*paths) if paths else spark.createDataFrame([], df.schema)


def sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append", trigger: str | None = None):
    """A running query that writes files exactly once."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()
