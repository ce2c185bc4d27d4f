"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame operations only.

Sources share a number of words by weight, each up to a multiple of its own size. Equal blocks of words are the seats:
they go to sources by highest quotients target / (2 k + 1), and each source's seats go to its shards in the same way. A
shard's documents, in a seeded order, are one line of words, cut into blocks; the shard's quota of blocks is taken from
the line's start, and from the start again once the whole line is taken.

There may be as many sources as web domains, and a third of all shards may be one source's. So nothing is ranked or summed
up in a single window: sorted runs of rows are summed by partition, and only the partitions' sums are added up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, word_array

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: All words of the mix, as a share of all words there are.
SHARE = 1.5
#: A source's target stops at so many times its size.
MOST = 2
BLOCK_WORDS = 16
#: Documents of a shard, on average.
SHARD_ROWS = 500


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """id, source, size (words; 0 for null), a seeded order key and a second key for each row, kept by a reliable checkpoint."""
    text = F.col(text_col)
    return cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.size(word_array(text)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), text).alias("order"),
            F.xxhash64(F.lit(-1 - seed), F.col(id_col), text).alias("also"),
        )
    )


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """``df`` with running sums, each row's own left out: ``sums`` names a column to be summed for each new one.

    Rows are dealt by ranges of the order and summed within each; what comes before a range is the sum of a row for each
    range, of which there are spark.sql.shuffle.partitions at most. Ties in the order must not matter.
    """
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = cut(df.repartitionByRange(slots, *order).withColumn("__range", F.spark_partition_id()))
    of = df.groupBy("__range").agg(*[F.sum(c).alias(f"__{o}") for o, c in sums.items()])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    of = of.select(F.col("__range").alias("__at"), *[F.coalesce(F.sum(f"__{o}").over(earlier), F.lit(0)).alias(f"__{o}") for o in sums])
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(F.broadcast(of), F.col("__range") == F.col("__at"))  # a row for each range
    df = df.withColumns({o: F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"__{o}") for o, c in sums.items()})
    return df.drop("__range", "__at", *[f"__{o}" for o in sums])


def _with(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of the one row of ``other`` for its keys, null or not, if there is one."""
    other = other.withColumnsRenamed({c: f"__of_{c}" for c in keys})
    on = F.lit(True)
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return df.join(other, on, "left").drop(*[f"__of_{c}" for c in keys])


def targets(rows: DataFrame, weights, share: float, most: float) -> DataFrame:
    """source, source_size, n_rows, target: one row for each source.

    Sources fill like vessels: with r = most * size / weight, all sources up to some rank by r are full and the rest get
    words by weight; the rank is the first whose rest-by-weight level isn't above its own r.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"), F.lit(1).alias("one"))
    by = running(by, [F.col("source").asc_nulls_last()], {"place": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    by = by.withColumn("ratio", F.col("cap") / F.col("weight"))
    by = cut(running(by, [F.col("ratio"), F.col("source").asc_nulls_last()], {"full": "cap", "gone": "weight"}))
    total = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"), F.max("ratio").alias("ratio")).collect()[0]
    level = (F.lit(share * (total["size"] or 0)) - F.col("full")) / (F.lit(total["weight"]) - F.col("gone"))
    found = by.withColumn("level", level).filter("level <= ratio").agg(F.min(F.struct("ratio", "full", "level")).alias("f")).collect()[0]["f"]
    final = found["level"] if found else total["ratio"]
    return by.select("source", "source_size", "n_rows", F.least("cap", F.lit(final).cast("double") * F.col("weight")).alias("target"))


def seats(parties: DataFrame, group: list[str], key: str, claim: str, total: str, out: str) -> DataFrame:
    """Highest-quotient (Sainte-Lague) seats within each group of parties: adds ``out`` to ``parties``.

    claim: a party's share, not negative; total: the group's seats. With n parties and a sum T of claims the final divisor
    lies between T / (total + n/2) and T / (total - n/2), so only seats between these bounds are ranked: about three a
    party, however many seats there are. Ties go to the party that comes first by ``key``.
    """
    by = [*group] or [F.lit(1).alias("__one")]
    keys = group or ["__one"]
    p = parties if group else parties.withColumn("__one", F.lit(1))
    p = _with(p, parties.groupBy(*by).agg((F.count(F.lit(1)) / 2).alias("__n"), F.sum(claim).alias("__all")), keys)
    share = F.when(F.col("__all") > 0, F.col(claim) / F.col("__all")).otherwise(F.lit(0.0))
    p = p.withColumn("__low", F.greatest(F.lit(0), F.ceil(share * (F.col(total) - F.col("__n")) - 0.5 - 1e-6)))
    p = cut(p.withColumn("__high", F.greatest(F.col("__low"), F.floor(share * (F.col(total) + F.col("__n")) + 0.5 + 1e-6))))
    ranked = p.filter("__high > __low").select(*keys, key, claim, F.lit(1).alias("__seat"), F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)).alias("__k"))
    ranked = ranked.withColumn("__by", F.col(claim) / (2 * F.col("__k") + 1))
    nulls = lambda cs: [F.col(c).asc_nulls_last() for c in cs]
    ranked = cut(running(ranked, [*nulls(keys), F.col("__by").desc(), *nulls([key, "__k"])], {"__rank": "__seat"}))
    bounds = ranked.groupBy(*keys).agg(F.min("__rank").alias("__first"))
    given = p.groupBy(*keys).agg(F.first(total).alias("__total"), F.sum("__low").alias("__sure"))
    won = _with(_with(ranked, bounds, keys), given, keys).filter("__rank - __first < __total - __sure")
    won = won.groupBy(*keys, key).agg(F.count(F.lit(1)).alias("__won"))
    return _with(p, won, [*keys, key]).select(*parties.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).cast("long").alias(out))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    seed: int = 7,
) -> DataFrame:
    """For each row: id, size, source_size, target (its source's) and taken (words the mix takes, repeats counted).

    Null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own, after all others;
    a source of size 0 has target 0. Rows with the same id and text are alike and may change places; others with the same
    id are told apart by their texts. Nothing depends on partitioning, so reruns agree. An empty table gives no rows. Only
    id, text and source are read.

    A source's rows are dealt to shards by the seeded key, so that no window holds a whole large source.
    """
    return _taken(docs, id_col, text_col, source_col, weights, share, most, block_words, seed).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken"
    )


def _taken(docs, id_col, text_col, source_col, weights, share, most, block_words, seed) -> DataFrame:
    rows = sizes(docs, id_col, text_col, source_col, seed)
    by = targets(rows, weights, share, most)
    blocks = round((by.agg(F.sum("target")).collect()[0][0] or 0) / block_words)
    by = seats(by.withColumn("__blocks", F.lit(blocks).cast("long")), [], "source", "target", "__blocks", "quota").drop("__blocks")
    by = cut(by.withColumn("shards", F.ceil(F.col("n_rows") / SHARD_ROWS)))
    rows = _with(rows, by.drop("n_rows"), ["source"]).withColumn("shard", F.pmod("order", "shards")).drop("shards")
    shards = rows.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_size").alias("of"), F.first("target").alias("to"), F.first("quota").alias("quota")
    )
    claim = F.when(F.col("of") > 0, F.col("to") * F.col("shard_size") / F.col("of")).otherwise(F.lit(0.0))
    shards = seats(cut(shards.withColumn("claim", claim)), ["source"], "shard", "claim", "quota", "blocks")
    shards = shards.select(
        F.col("source").alias("h_source"), F.col("shard").alias("h_shard"), "shard_size", "blocks"
    )
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("shard") == F.col("h_shard")))
    line = Window.partitionBy("source", "shard").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(line), F.lit(0))
    want = F.least(F.col("blocks") * block_words, F.floor(most * F.col("shard_size")))
    rows = rows.withColumn("__start", start).withColumn("__want", want)
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("__want") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("__want") - rounds * F.col("shard_size") - F.col("__start")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.withColumn("taken", taken.cast("long"))


def take(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, seed=7) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, all columns as they are and ``taken`` beside them.

    Rows with the same id and text share their order key and are numbered. Null and empty texts are never taken; an empty
    table gives no rows. The columns travel in one struct, so names can't clash; an input column named taken is replaced.
    """
    rows = _taken(docs, id_col, text_col, source_col, weights, share, most, block_words, seed)
    by = rows.groupBy("order", "also").agg(F.sort_array(F.collect_list("taken"), asc=False).alias("takes")).filter("takes[0] > 0")
    keys = [F.xxhash64(F.lit(x), F.col(id_col), F.col(text_col)) for x in (seed, -1 - seed)]
    packed = docs.select(F.struct("*").alias("row"), keys[0].alias("key"), keys[1].alias("key2"))
    nth = F.row_number().over(Window.partitionBy("key", "key2").orderBy("key"))
    joined = packed.join(by, (F.col("key") == F.col("order")) & (F.col("key2") == F.col("also"))).withColumn("taken", F.element_at("takes", nth))
    own = [c for c in docs.columns if c != "taken"]
    return joined.filter("taken > 0").select(*[F.col(f"row.`{c}`").alias(c) for c in own], "taken")
