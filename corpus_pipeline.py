"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read as the next
stage's documents. All stages but the last return the columns of ``documents``.

Null and empty texts pass all stages but the last, which takes only documents that have words. A document of which line
dedup leaves no word goes. Rows that repeat an id are judged by their own texts, but for near-duplicates, where they are
one document; of rows that repeat an id and a text one stays there. An empty table gives no rows. Other columns are kept as
they are, but for ``n_chars`` of texts that lost lines or passages; the last stage adds ``taken``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, lines, mixing, neardup, toxicity
from lumenfold.llm.common import shared_dir, table, word_array


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxic threshold stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go, but for their first document; so does a document of which no word is left."""
    out = lines.drop_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.size(word_array(F.col("text"))) == 0)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.filter(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class stays."""
    return neardup.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth or more of the words is in 13-word windows of the benchmark; from others these words go."""
    out = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    n_chars = F.when(F.col("n_cut") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with ``taken``: how many, repeats counted."""
    return mixing.take(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash_neardup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't train the toxicity model or draw ProbMinHash registers; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's output lies in the shared folder until the next one is written."""
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{where}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
        before = path
    return docs
