"""Names and choices of columns: output names, selectors, and what an expression tells about itself."""

from __future__ import annotations

from pyspark.sql import types as T

from lumenfold.functions import expr as x
from lumenfold.functions import selectors as cs
from lumenfold.functions.expr import col, lit, struct
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan
from lumenfold.sources import io


def _f(spark, d):
    return scan(spark, d, "customer")


@query("names_affixes", "SELECT c_custkey AS p_c_custkey, c_name AS c_name_s, c_acctbal AS acctbal, c_mktsegment AS c_mkt FROM customer")
def names_affixes(spark, d):
    return _f(spark, d).select(
        col("c_custkey").name.prefix("p_"), col("c_name").name.suffix("_s"), col("c_acctbal").name.strip_prefix("c_"), col("c_mktsegment").name.strip_suffix("segment")
    )


@query("names_cases", "SELECT c_custkey AS C_CUSTKEY, c_name AS k_name, c_acctbal AS c_acctbal_2, c_mktsegment AS c_mktsegment FROM customer")
def names_cases(spark, d):
    return _f(spark, d).select(
        col("c_custkey").name.to_upper(), col("c_name").name.replace("^c_", "k_"), col("c_acctbal").name.map(lambda n: n + "_2"), col("c_mktsegment").name.to_upper().name.to_lower()
    )


@query("names_kept", "SELECT c_custkey * 2 AS c_custkey, c_acctbal AS a_c_acctbal, c_nationkey AS c_nationkey_z, c_name AS C_NAME FROM customer")
def names_kept(spark, d):
    return _f(spark, d).select(
        (col("c_custkey") * 2).alias("twice").name.keep(), col("c_acctbal").prefix("a_"), col("c_nationkey").suffix("_z"), col("c_name").map_name(str.upper)
    )


@query("names_of_fields", "SELECT c_custkey, c_name AS x_name, c_acctbal AS BAL, c_custkey AS id_y FROM customer")
def names_of_fields(spark, d):
    s = struct(col("c_custkey").alias("id"), col("c_name").alias("name"), col("c_acctbal").alias("bal"))
    f = _f(spark, d).select("c_custkey", s.alias("s"))
    return f.select(
        "c_custkey",
        col("s").name.prefix_fields("x_").struct.field("x_name"),
        col("s").name.map_fields(str.upper).struct.field("BAL"),
        col("s").name.suffix_fields("_y").struct.field("id_y"),
    )


@query("select_numeric", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_numeric(spark, d):
    return _f(spark, d).select(cs.numeric().expr())


@query("select_algebra", "SELECT c_name, c_acctbal FROM customer")
def select_algebra(spark, d):
    return _f(spark, d).select(((cs.floating() | cs.string()) - cs.by_name("c_mktsegment")).expr())


@query("select_complement", "SELECT c_name, c_mktsegment FROM customer")
def select_complement(spark, d):
    return _f(spark, d).select((~cs.numeric()).expr())


@query("select_nth", "SELECT c_custkey, c_nationkey FROM customer")
def select_nth(spark, d):
    return _f(spark, d).select(x.nth(0), x.nth(2))


@query("select_dtype", "SELECT c_name, c_mktsegment FROM customer")
def select_dtype(spark, d):
    return _f(spark, d).select(x.col_dtype(T.StringType))


@query("select_without_pattern", "SELECT c_name, c_mktsegment FROM customer")
def select_without_pattern(spark, d):
    return _f(spark, d).select(x.exclude_regex("key$|bal$"))


#: A column of each type that Spark has.
_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("small", T.ShortType()), T.StructField("real", T.DoubleType()), T.StructField("exact", T.DecimalType(10, 2)),
    T.StructField("day", T.DateType()), T.StructField("at", T.TimestampNTZType()), T.StructField("span", T.DayTimeIntervalType()), T.StructField("clock", T.LongType(), metadata={"time": True}),
    T.StructField("word", T.StringType()), T.StructField("raw", T.BinaryType()), T.StructField("flag", T.BooleanType()), T.StructField("kind", T.StringType(), metadata={"categories": ["a"]}),
    T.StructField("code", T.StringType(), metadata={"categorical": True}), T.StructField("list", T.ArrayType(T.LongType())), T.StructField("vec", T.ArrayType(T.FloatType()), metadata={"width": 3}),
    T.StructField("rec", T.StructType([T.StructField("x", T.LongType())])), T.StructField("a1", T.LongType()), T.StructField("abc", T.LongType()), T.StructField("42", T.LongType()),
])

_SELECTORS = {
    "all": (cs.all_(), "id small real exact day at span clock word raw flag kind code list vec rec a1 abc 42"),
    "empty": (cs.empty(), ""),
    "by_name": (cs.by_name("word", "id"), "word id"),
    "by_index": (cs.by_index(1, -1), "small 42"),
    "first": (cs.first(), "id"),
    "last": (cs.last(), "42"),
    "by_dtype": (cs.by_dtype(T.ShortType, T.BooleanType), "small flag"),
    "numeric": (cs.numeric(), "id small real exact clock a1 abc 42"),
    "integer": (cs.integer(), "id small clock a1 abc 42"),
    "signed_integer": (cs.signed_integer(), "id small clock a1 abc 42"),
    "unsigned_integer": (cs.unsigned_integer(), ""),
    "float": (cs.floating(), "real"),
    "decimal": (cs.decimal(), "exact"),
    "temporal": (cs.temporal(), "day at span"),
    "date": (cs.date(), "day"),
    "datetime": (cs.datetime(), "at"),
    "duration": (cs.duration(), "span"),
    "time": (cs.time(), "clock"),
    "string": (cs.string(), "word kind code"),
    "binary": (cs.binary(), "raw"),
    "boolean": (cs.boolean(), "flag"),
    "enum": (cs.enum(), "kind"),
    "categorical": (cs.categorical(), "code"),
    "list": (cs.list_(), "list vec"),
    "array": (cs.array(), "vec"),
    "struct": (cs.struct(), "rec"),
    "nested": (cs.nested(), "list vec rec"),
    "starts_with": (cs.starts_with("a", "c"), "at clock code a1 abc"),
    "ends_with": (cs.ends_with("t", "d"), "id exact at word kind list"),
    "contains": (cs.contains("ec", "la"), "flag vec rec"),
    "matches": (cs.matches("^[a-c]{3}$"), "abc"),
    "alpha": (cs.alpha(), "id small real exact day at span clock word raw flag kind code list vec rec abc"),
    "digit": (cs.digit(), "42"),
    "alphanumeric": (cs.alphanumeric(), "id small real exact day at span clock word raw flag kind code list vec rec a1 abc 42"),
    "union": (cs.date() | cs.struct(), "day rec"),
    "intersect": (cs.nested() & cs.starts_with("v"), "vec"),
    "difference": (cs.integer() - cs.starts_with("a"), "id small clock 42"),
    "symmetric_difference": (cs.temporal() ^ cs.ends_with("t"), "exact day span list"),
    "complement": (~cs.numeric(), "day at span word raw flag kind code list vec rec"),
    "exclude": (cs.temporal().exclude("at"), "day span"),
}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query("selectors_expand", f"SELECT * FROM (VALUES {_values([(k, v) for k, (_, v) in _SELECTORS.items()])}) t(selector, names)")
def selectors_expand(spark, d):
    return io.frame_of(spark, {"selector": list(_SELECTORS), "names": [" ".join(s.expand(_SCHEMA)) for s, _ in _SELECTORS.values()]}, "selector string, names string")


def _facts() -> list[tuple[str, object, str]]:
    """Name, value and what it must be of each question that an expression answers about itself."""
    e = (col("a") + col("b") * lit(2)).alias("s")
    return [
        ("root_names", e.meta.root_names(), "['a', 'b']"),
        ("output_name", e.meta.output_name(), "s"),
        ("has_multiple_outputs", (x.all_().meta.has_multiple_outputs(), e.meta.has_multiple_outputs()), "(True, False)"),
        ("is_column", (col("a").meta.is_column(), e.meta.is_column()), "(True, False)"),
        ("is_column_selection", (x.all_().meta.is_column_selection(), e.meta.is_column_selection()), "(True, False)"),
        ("is_literal", (lit(1).meta.is_literal(), col("a").meta.is_literal()), "(True, False)"),
        ("is_regex_projection", (x.col_regex("^a").meta.is_regex_projection(), col("a").meta.is_regex_projection()), "(True, False)"),
        ("undo_aliases", col("a").alias("z").meta.undo_aliases().meta.output_name(), "a"),
        ("eq", (col("a").meta.eq(col("a")), col("a").meta.eq(col("b"))), "(True, False)"),
        ("pop", len(e.meta.pop()), "2"),
        ("tree_format", e.meta.tree_format().count("\n") > 1, "True"),
        ("pipe", col("a").pipe(lambda c: c.alias("p")).meta.output_name(), "p"),
    ]


@query("expressions_about_themselves", "SELECT * FROM (VALUES " + _values([("root_names", "['a', 'b']"), ("output_name", "s"), ("has_multiple_outputs", "(True, False)"), ("is_column", "(True, False)"), ("is_column_selection", "(True, False)"), ("is_literal", "(True, False)"), ("is_regex_projection", "(True, False)"), ("undo_aliases", "a"), ("eq", "(True, False)"), ("pop", "2"), ("tree_format", "True"), ("pipe", "p")]) + ") t(fact, value)")
def expressions_about_themselves(spark, d):
    facts = _facts()
    return io.frame_of(spark, {"fact": [n for n, *_ in facts], "value": [str(v) for _, v, _ in facts]}, "fact string, value string")
