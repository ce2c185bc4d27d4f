"""Cross-site boilerplate lines by distinct-site spread; DataFrame operations only.

A line on many sites is boilerplate. Lines are keyed by two 64-bit hashes. Lines with fewer occurrences than the threshold
can't reach it and are left out first, exactly, by a count with partial sums. For the rest a HyperLogLog sketch of each
line's sites is built from its occurrences as they are, merged by aggregation: each task sends one sketch a line, however
often the line occurs. Only where the estimate is near the threshold are a line's distinct sites brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, met

#: Sites from which on a line is boilerplate.
SITES = 10
#: log2 of the sketch's registers, and the estimate's relative error for which lines are counted exactly (over 5 sigma).
LG_K, NEAR = 10, 0.2


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def trimmed(line: Column) -> Column:
    """A line without ASCII white space at either end."""
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """k1, k2, site, id, own1, own2 (of the id and text) of each distinct line with a word in each row. A null site is a site of its own."""
    lines = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), trimmed))
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("-"))
    keys = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(*_key(x)))
    rows = docs.select(F.col(id_col).alias("id"), site.alias("site"), *_own(id_col, text_col), F.explode(keys).alias("k"))
    return rows.select("k.k1", "k.k2", "site", "id", "own1", "own2")


def _own(id_col: str, text_col: str) -> list[Column]:
    key = F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return [F.xxhash64(key).alias("own1"), F.xxhash64(F.lit(1), key).alias("own2")]


def frequent(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Those of occurrences() whose line occurs ``sites`` times or more, with first_id, the smallest id that has it (null comes first)."""
    often = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.count("id").alias("with_id"))
    often = often.filter(F.col("n") >= sites).select("k1", "k2", F.when(F.col("with_id") == F.col("n"), F.col("first_id")).alias("first_id"))
    return cut(met(lines, cut(often), ["k1", "k2"]))


def spread(held: DataFrame, sites: int = SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """k1, k2, n_sites, exact of the lines of frequent() on ``sites`` sites or more.

    exact: n_sites was counted; else it is the sketch's estimate, which is far over the threshold.
    """
    sketched = held.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate"))
    sketched = cut(sketched.filter(F.col("estimate") >= sites * (1 - near)))
    close = sketched.filter(F.col("estimate") <= sites * (1 + near)).select("k1", "k2")
    counted = met(held.select("k1", "k2", "site"), close, ["k1", "k2"], "left_semi").groupBy("k1", "k2")
    counted = counted.agg(F.count_distinct("site").alias("n_sites")).filter(F.col("n_sites") >= sites)
    far = sketched.filter(F.col("estimate") > sites * (1 + near))
    far = far.select("k1", "k2", F.col("estimate").cast("long").alias("n_sites"), F.lit(False).alias("exact"))
    return far.unionByName(counted.withColumn("exact", F.lit(True)))


def drop_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    sites: int = SITES,
    lg_k: int = LG_K,
    near: float = NEAR,
) -> DataFrame:
    """All columns of ``docs`` with the boilerplate lines taken out of the text, and n_lines and n_dropped beside them.

    A line (trimmed of ASCII white space) on ``sites`` distinct sites or more is dropped wherever it is, but for the
    document with the smallest id that has it (null is smallest), which keeps it: no content is lost altogether. Lines
    without a word are never dropped; a null text stays null, with 0 lines; the other lines keep their order and spelling.
    Rows that repeat an id are told apart by their texts, and equal rows are treated alike. An empty table gives no rows.
    The columns travel in one struct, so their names can't clash with the working columns; an input column named n_lines
    or n_dropped is replaced.
    """
    held = frequent(occurrences(docs, id_col, text_col, site_col), sites)
    bad = spread(held, sites, lg_k, near)
    drops = (
        met(held, bad.select("k1", "k2"), ["k1", "k2"], "left_semi")
        .filter(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy(F.col("own1").alias("d1"), F.col("own2").alias("d2"))
        .agg(F.collect_set(F.struct("k1", "k2")).alias("drops"))
    )
    rows = docs.select(F.struct("*").alias("row"), *_own(id_col, text_col))
    joined = rows.join(drops, (F.col("own1") == F.col("d1")) & (F.col("own2") == F.col("d2")), "left")
    lines = F.split(F.col(f"row.{text_col}"), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("drops", F.struct(*_key(trimmed(x)))))
    text = F.when(F.col("drops").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size(lines), F.lit(0))
    n = F.when(F.col(f"row.{text_col}").isNull(), F.lit(0)).otherwise(n).cast("long")
    left = F.when(F.col("drops").isNull(), n).otherwise(F.size(kept)).cast("long")
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in own],
        n.alias("n_lines"),
        (n - left).alias("n_dropped"),
    )
