"""Streams: the same events read as a stream of files, drained, and compared with the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenfold.functions.expr import col, length
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan
from lumenfold.sources.io import shared_dir
from lumenfold.streaming import streams


def _events(spark, d):
    """The events as a stream of the files of their folder."""
    return streams.read_stream(spark, d, spark.read.parquet(f"{d}/events.parquet").schema, pattern="events.parquet")


def _drained(spark, df, mode: str):
    name = f"s{uuid.uuid4().hex}"
    return streams.drain(df, name, mode, f"{shared_dir(spark)}/{name}")


def _instant(df, *names):
    return df.withColumns({n: F.unix_micros(F.col(n).cast("timestamp")) for n in names})


_HOURS = "SELECT epoch_us(date_trunc('hour', ts)) AS window_start, epoch_us(date_trunc('hour', ts) + INTERVAL 1 HOUR) AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"
_AGGS = [length().alias("n"), col("value").sum().round(2).alias("total")]


@query("stream_tumbling", _HOURS)
def stream_tumbling(spark, d):
    return _instant(_drained(spark, streams.windowed(_events(spark, d), "ts", "1 hour", _AGGS, by=["event_type"]), "complete"), "window_start", "window_end")


@query("batch_tumbling", _HOURS)
def batch_tumbling(spark, d):
    return _instant(streams.windowed(scan(spark, d, "events").spark(), "ts", "1 hour", _AGGS, by=["event_type"]), "window_start", "window_end")


@query(
    "stream_sliding",
    """SELECT s AS window_start, s + 7200000000 AS window_end, count(*) AS n FROM (SELECT unnest([epoch_us(date_trunc('hour', ts)), epoch_us(date_trunc('hour', ts)) - 3600000000]) AS s FROM events) GROUP BY 1""",
)
def stream_sliding(spark, d):
    return _instant(_drained(spark, streams.windowed(_events(spark, d), "ts", "2 hours", _AGGS[:1], slide="1 hour", watermark="1 day"), "complete"), "window_start", "window_end")


_GAPS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
  SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 21600000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, session"""


@query("batch_sessions", _GAPS)
def batch_sessions(spark, d):
    return _instant(streams.sessions(scan(spark, d, "events").spark(), "ts", "6 hours", _AGGS[:1], by=["user_id"]), "session_start", "session_end")


@query("stream_sessions", _GAPS)
def stream_sessions(spark, d):
    return _instant(_drained(spark, streams.sessions(_events(spark, d), "ts", "6 hours", _AGGS[:1], by=["user_id"], watermark="1 day"), "complete"), "session_start", "session_end")


@query("stream_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark, d):
    df = streams.deduplicated(_events(spark, d), ["user_id", "event_type"], "ts", "60 days")
    return _drained(spark, df.select("user_id", "event_type"), "append")


@query("stream_keyed_state", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_keyed_state(spark, d):
    df = streams.running_totals(_events(spark, d).select("user_id", "value"), "user_id", "value")
    out = _drained(spark, df, "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"))


@query("stream_to_files", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_to_files(spark, d):
    p = f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"
    streams.sink(_events(spark, d).select("event_id", "event_type"), p, f"{p}-checkpoint").awaitTermination()
    return spark.read.parquet(p).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
