"""Quality rules as a short-circuit cascade; DataFrame operations only.

A rule rejects a document. How much work each rule is and how much it rejects is estimated on a sample; rules then run in
order of rejection per cost, each only on what the earlier ones left (a nested CASE). The order changes the time that the
cascade takes and never a verdict. Work is counted, not timed: the characters that a rule's expressions go over, or 1 for
a comparison of measures. And the sample is drawn by a hash. So reruns order the rules alike, on any cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import word_array

SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated, and the least words of a document.
REPEAT, LEAST_WORDS = 8, 20
#: Rows sampled to estimate costs and rejections.
SAMPLE_ROWS = 400


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, n: int = REPEAT) -> Column:
    """Words inside an n-word window that is found twice or more in the array (the first one included).

    Windows are compared by 64-bit hashes of their words' 64-bit hashes. Sorted with their places, equal ones are
    neighbours; the union of their spans is then summed from place to place.
    """

    def spans(places: Column) -> Column:
        gap = lambda p, i: F.coalesce(F.get(places, i + 1) - p, F.lit(n))
        steps = F.transform(places, lambda p, i: F.least(gap(p, i), F.lit(n)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def again(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        last = F.size(pairs) - 1
        twice = F.filter(
            pairs,
            lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(F.lit(False))
            | F.when(i < last, same(x, i + 1)).otherwise(F.lit(False)),
        )
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), spans)

    def windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, again))

    def hashes(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - n)
        return let(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])), windows)

    some = let(F.transform(words, lambda w: F.xxhash64(w)), hashes)
    return F.when(F.size(words) >= n, some).otherwise(F.lit(0).cast("long"))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def chars_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


@dataclass(frozen=True)
class Rule:
    """A named rule: ``rejects`` makes a condition from the text and the measures, ``work`` the cost of it for a text."""

    name: str
    rejects: object
    work: object = lambda t: F.lit(1)


def _letters(text, chars):
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _passes(n: int):
    return lambda t: n * F.char_length(t) + 1


#: The cascade's rules. m: the measures by name. Three go over the text themselves.
RULES = (
    Rule("symbols", lambda t, m: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("dup_lines", lambda t, m: F.col("n_dup_lines") * 10 > 3 * F.size(F.split(t, "\n")), _passes(1)),
    Rule("word_length", lambda t, m: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("shouting", lambda t, m: _letters(t, UPPER) > _letters(t, LOWER), _passes(4)),
    Rule("exclaiming", lambda t, m: 2 * (F.char_length(t) - F.char_length(F.replace(t, F.lit("!!"), F.lit("!")))) > F.col("n_words"), _passes(3)),
)


def measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null as empty) and the base measures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), word_array(text).alias("words"))
    return d.select(
        "id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - chars_of(F.col("text"), " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        chars_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Too short, or too much of it in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def plan(docs: DataFrame, rules=RULES, *, id_col="doc_id", text_col="text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on the ``rows`` rows that come first by a hash of id and text; ties keep their order.

    The sample decides on nothing but the order. Rejections and work of all rules are one aggregate over it, of the rows
    that the base keeps: those are what the cascade sees. An empty table leaves the rules as they are.
    """
    order = F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col))
    sample = docs.select(F.col(id_col), F.col(text_col)).orderBy(order, F.col(id_col)).limit(rows)
    m = measures(sample, id_col, text_col).filter(~base_failed())
    sums = [F.count_if(r.rejects(F.col("text"), m)).alias(f"n{i}") for i, r in enumerate(rules)]
    sums += [F.sum(r.work(F.col("text"))).alias(f"w{i}") for i, r in enumerate(rules)]
    found = m.agg(*sums).collect()[0]
    rate = [(found[f"n{i}"] or 0) / max(found[f"w{i}"] or 0, 1) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -rate[i])]


def judge(docs: DataFrame, rules=None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, n_words, the base measures, base_failed, kept and rejected_by (the first rule that rejects).

    Null and empty texts have no words and fail the base. Rows are judged one by one, so repeated rows and ids don't
    matter; an empty table gives no rows; only id and text are read. ``rules``: in the order to run; planned if None.
    rejected_by depends on that order, kept doesn't.
    """
    rules = plan(docs, id_col=id_col, text_col=text_col) if rules is None else rules
    m = measures(docs, id_col, text_col)
    chain = F.when(base_failed(), F.lit("base"))
    for r in rules:
        chain = chain.when(r.rejects(F.col("text"), m), F.lit(r.name))
    names = [c for c in m.columns if c not in ("id", "text")]
    out = m.select(F.col("id").alias(id_col), *names, base_failed().alias("base_failed"), chain.alias("rejected_by"))
    return out.withColumn("kept", F.col("rejected_by").isNull())
