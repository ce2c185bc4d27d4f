"""Sessions: settings that the engine is made for. Everything else is the cluster's own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: On a cluster. Sizes of partitions follow the data, skewed joins are split at run time, and scans take only what they need.
CLUSTER = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}
#: On one machine: as many shuffle partitions as cores, and nothing that only serves a browser.
LOCAL = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.files.openCostInBytes": "1m",
    "spark.locality.wait": "0s",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int = 0, memory: str = "8g", name: str = "lumenfold", **extra: str) -> SparkSession:
    """A session on this machine."""
    cpus = cpus or os.cpu_count() or 1
    conf = CLUSTER | LOCAL | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | extra
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=conf).getOrCreate()


class Engine:
    """A session with limits of its own, and what its queries have done.

    What has no counterpart in Spark isn't here: batch sizes and threads of single operators are the planner's.
    """

    def __init__(self, threads: int = 0, memory_limit: str = "8g", spill_dir: str | None = None, batch_rows: int = 10_000, optimizer_off: tuple[str, ...] = (), name: str = "lumenfold"):
        """memory_limit: of the driver's heap, on this machine; beyond it operators spill to ``spill_dir``. They hold only if no session runs yet.

        optimizer_off: names of optimizer rules that are left out. batch_rows: rows of a batch that goes to Python.
        """
        extra = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}
        if spill_dir:
            extra["spark.local.dir"] = spill_dir
        if optimizer_off:
            extra["spark.sql.optimizer.excludedRules"] = ",".join(optimizer_off)
        self.spark = local_session(threads, memory_limit, name, **extra)
        self.hooks: list = []
        self.queries, self.rows, self.seconds = 0, 0, 0.0

    def on_query(self, hook) -> None:
        """``hook(name, rows, seconds)`` is called after each query that collect() has run."""
        self.hooks.append(hook)

    def collect(self, frame, name: str = "query") -> list:
        """The frame's rows, counted and timed."""
        import time

        began = time.perf_counter()
        rows = frame.collect()
        took = time.perf_counter() - began
        self.queries, self.rows, self.seconds = self.queries + 1, self.rows + len(rows), self.seconds + took
        for hook in self.hooks:
            hook(name, len(rows), took)
        return rows

    def stats(self) -> dict:
        """Queries run, rows returned, seconds taken, and bytes of memory that cached frames hold."""
        stored = self.spark.sparkContext._jsc.sc().getRDDStorageInfo()
        return {"queries": self.queries, "rows": self.rows, "seconds": self.seconds, "cached_bytes": sum(x.memSize() for x in stored)}
