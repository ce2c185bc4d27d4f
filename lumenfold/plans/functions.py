"""User functions: by value, by batch, over windows, by row and by group."""

from __future__ import annotations

from lumenfold.functions.expr import col
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan


@query("map_elements", "SELECT c_custkey, length(c_name) + 1 AS n FROM customer")
def map_elements(spark, d):
    return scan(spark, d, "customer").select("c_custkey", col("c_name").map_elements(lambda s: len(s) + 1, "bigint").alias("n"))


@query("map_batches", "SELECT c_custkey, round(c_acctbal * 3, 2) AS b FROM customer")
def map_batches(spark, d):
    return scan(spark, d, "customer").select("c_custkey", col("c_acctbal").map_batches(lambda s: s * 3, "double").round(2).alias("b"))


@query(
    "rolling_map",
    """SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(max(value) OVER w - min(value) OVER w, 2) END AS spread FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def rolling_map(spark, d):
    e = col("value").rolling_map(lambda s: float(s.max() - s.min()), 3).over("user_id", order_by="event_id")
    return scan(spark, d, "events").sort("event_id").select("event_id", e.round(2).alias("spread"))


@query("map_rows", "SELECT n_nationkey AS k, lower(n_name) AS name FROM nation")
def map_rows(spark, d):
    return scan(spark, d, "nation").map_rows(lambda r: {"k": r["n_nationkey"], "name": r["n_name"].lower()}, "k int, name string")


@query("table_function", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def table_function(spark, d):
    """A table function: rows out of each row, in Arrow batches."""
    import pyarrow as pa

    def words(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"word": [w for t in b.column("p_name").to_pylist() for w in t.split(" ")]})

    df = scan(spark, d, "part").select("p_name").spark().mapInArrow(words, "word string")
    return df.groupBy("word").count().withColumnRenamed("count", "n")
