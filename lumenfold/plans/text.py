"""Text functions, over whole texts."""

from __future__ import annotations

from lumenfold.functions.expr import col
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan

_t, _n = col("text"), col("n")


def _docs(name: str, sql: str, **exprs):
    @query(name, f"SELECT doc_id, {sql} FROM documents")
    def run(spark, d):
        return scan(spark, d, "documents").select("doc_id", *[e.alias(n) for n, e in exprs.items()])

    return run


def _names(name: str, sql: str, **exprs):
    """Over part names ``p`` and customer names ``n``."""

    @query(name, f"SELECT id, {sql} FROM (SELECT c_custkey AS id, c_name AS n, c_mktsegment AS p FROM customer)")
    def run(spark, d):
        f = scan(spark, d, "customer").select(col("c_custkey").alias("id"), col("c_name").alias("n"), col("c_mktsegment").alias("p"))
        return f.select("id", *[e.alias(k) for k, e in exprs.items()])

    return run


_p = col("p")
_docs("str_contains", "contains(text, 'the') AS lit, regexp_matches(text, '[0-9]{3}') AS rx, starts_with(text, 'A') AS pre, ends_with(text, '.') AS suf", lit=_t.str.contains("the", literal=True), rx=_t.str.contains("[0-9]{3}"), pre=_t.str.starts_with("A"), suf=_t.str.ends_with("."))
_docs("str_lengths", "octet_length(encode(text))::INTEGER AS bytes, length(text)::INTEGER AS chars", bytes=_t.str.len_bytes(), chars=_t.str.len_chars())
_docs("str_find", "CASE WHEN strpos(text, 'on') > 0 THEN octet_length(encode(substr(text, 1, strpos(text, 'on') - 1)))::INTEGER END AS at, len(regexp_extract_all(text, '[a-z]+ing'))::INTEGER AS n", at=_t.str.find("on", literal=True), n=_t.str.count_matches("[a-z]+ing"))
_docs("str_extract", "CASE WHEN regexp_matches(text, '([0-9]+)-([0-9]+)') THEN regexp_extract(text, '([0-9]+)-([0-9]+)', 2) END AS g, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS every", g=_t.str.extract("([0-9]+)-([0-9]+)", 2), every=_t.str.extract_all("[0-9]+").list.join(","))
_docs("str_case", "replace(upper(text), 'ẞ', 'ß') AS up, lower(text) AS low", up=_t.str.to_upper(), low=_t.str.to_lower())
_docs("str_replace_all", "md5(replace(text, 'e', '3')) AS lit, md5(regexp_replace(text, '[aeiou]+', '_', 'g')) AS rx", lit=_t.str.replace_all("e", "3", literal=True)._map("md5", lambda c: _md5(c)), rx=_t.str.replace_all("[aeiou]+", "_")._map("md5", lambda c: _md5(c)))
_docs("str_slices", "substr(text, 3, 10) AS mid, substr(text, 1, 5) AS head, CASE WHEN length(text) < 4 THEN text ELSE right(text, 4) END AS tail", mid=_t.str.slice(2, 10), head=_t.str.head(5), tail=_t.str.tail(4))
_docs("str_strip", "trim(text, ' .') AS both, ltrim(text, 'ABCDEFG') AS start, rtrim(text, '.!?') AS stop", both=_t.str.strip_chars(" ."), start=_t.str.strip_chars_start("ABCDEFG"), stop=_t.str.strip_chars_end(".!?"))
_docs("str_split", "len(string_split(text, ' '))::INTEGER AS n, string_split(text, ' ')[1] AS first", n=_t.str.split(" ").list.len(), first=_t.str.split(" ").list.first())
_docs("str_contains_any", "contains(text, 'the') OR contains(text, 'que') AS hit, regexp_matches(text, '(?i)lor|ers') AS fold", hit=_t.str.contains_any(["the", "que"]), fold=_t.str.contains_any(["LOR", "ers"], ascii_case_insensitive=True))
_docs("str_reverse", "reverse(text) AS r", r=_t.str.reverse())
_docs("str_codecs", "lower(hex(encode(text))) AS hex, base64(encode(text)) AS b64, text AS back", hex=_t.str.encode("hex"), b64=_t.str.encode("base64"), back=_t.str.encode("hex").str.decode("hex"))
_names("str_replace_first", "regexp_replace(n, '[0-9]', 'x') AS one, regexp_replace(n, 'C', 'K') AS lit", one=_n.str.replace("[0-9]", "x"), lit=_n.str.replace("C", "K", literal=True))
_names("str_replace_n", "regexp_replace(regexp_replace(n, '0', 'o'), '0', 'o') AS two", two=_n.str.replace_n("0", "o", literal=True, n=2))
_names("str_replace_many", "replace(replace(replace(p, 'A', '4'), 'E', '3'), 'O', '0') AS leet", leet=_p.str.replace_many(["A", "E", "O"], ["4", "3", "0"]))
_names("str_extract_many", "array_to_string(regexp_extract_all(p, 'UR|IN|MO'), ',') AS hits", hits=_p.str.extract_many(["UR", "IN", "MO"]).list.join(","))
_names("str_extract_groups", "regexp_extract(n, '(?P<word>[A-Za-z]+)#([0-9]+)', 1) AS word, regexp_extract(n, '([A-Za-z]+)#([0-9]+)', 2) AS num", word=_n.str.extract_groups("(?<word>[A-Za-z]+)#([0-9]+)").struct.field("word"), num=_n.str.extract_groups("(?<word>[A-Za-z]+)#([0-9]+)").struct.field("2"))
_names("str_titlecase", "upper(left(p, 1)) || lower(substr(p, 2)) AS t", t=_p.str.to_titlecase())
_names("str_affixes", "CASE WHEN starts_with(n, 'Customer#') THEN substr(n, 10) ELSE n END AS pre, CASE WHEN ends_with(p, 'ING') THEN left(p, length(p) - 3) ELSE p END AS suf", pre=_n.str.strip_prefix("Customer#"), suf=_p.str.strip_suffix("ING"))
_names("str_split_parts", "string_split(n, '#')[1] AS a, string_split(n, '#')[2] AS b, string_split(n, '#')[1] || '#' AS inc", a=_n.str.split_n("#", 2).struct.field("field_0"), b=_n.str.split_exact("#", 1).struct.field("field_1"), inc=_n.str.split_inclusive("#").list.first())
_names("str_to_integer", "substr(n, 10)::BIGINT AS i, try_cast(p AS BIGINT) AS no, (id % 200)::BIGINT AS hex", i=_n.str.slice(9).str.to_integer(), no=_p.str.to_integer(strict=False), hex=(col("id") % 200)._map("hex", lambda c: _hex(c)).str.to_integer(16))
_names("str_to_decimal", "(id / 100.0)::DOUBLE AS x", x=(col("id") / 100.0).cast("string").str.to_decimal(2).cast("double"))
_names("str_compare_columns", "contains(n, left(n, 4)) AS own, starts_with(n, left(n, 2)) AS pre", own=_n.str.contains(_n.str.head(4), literal=True), pre=_n.str.starts_with(_n.str.head(2)))
_names("cat_functions", "CASE p WHEN 'BUILDING' THEN 0 WHEN 'FURNITURE' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code, length(p)::INTEGER AS n, left(p, 3) AS s", code=_p.cat.physical(["BUILDING", "FURNITURE", "MACHINERY"]).cast("int"), n=_p.cat.len_chars(), s=_p.cat.slice(0, 3))


@query("str_escape_regex")
def str_escape_regex(spark, d):
    return scan(spark, d, "documents").select("doc_id", _t.str.escape_regex().alias("escaped"))


@query(
    "str_padding",
    """SELECT c_custkey AS id, lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INT, '*') AS s, rpad(c_mktsegment, greatest(12, length(c_mktsegment))::INT, '.') AS e,
    CASE WHEN c_custkey > 0 AND c_custkey % 2 = 0 THEN '-' || lpad(c_custkey::VARCHAR, 5, '0') ELSE lpad(c_custkey::VARCHAR, 6, '0') END AS z FROM customer""",
)
def str_padding(spark, d):
    from lumenfold.functions.expr import when

    k = col("c_custkey")
    signed = when((k > 0) & (k % 2 == 0)).then(-k).otherwise(k).cast("string")
    return scan(spark, d, "customer").select(k.alias("id"), k.cast("string").str.pad_start(6, "*").alias("s"), col("c_mktsegment").str.pad_end(12, ".").alias("e"), signed.str.zfill(6).alias("z"))


@query("str_dates", "SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)) AS d, epoch_us(o_orderdate) AS t, NULL::BIGINT AS bad FROM orders")
def str_dates(spark, d):
    day = col("o_orderdate").dt.strftime("%d/%m/%Y")
    full = col("o_orderdate").dt.strftime("%Y-%m-%d %H:%M:%S")
    return scan(spark, d, "orders").select(
        "o_orderkey", day.str.to_date("%d/%m/%Y").cast("timestamp_ntz").dt.epoch("us").alias("d"), full.str.to_datetime("%Y-%m-%d %H:%M:%S").dt.epoch("us").alias("t"),
        col("o_orderstatus").str.to_datetime("%Y-%m-%d %H:%M:%S", strict=False).dt.epoch("us").alias("bad"),
    )


@query("str_times", "SELECT event_id, epoch_us(date_trunc('second', ts)) % 86400000000 AS us FROM events")
def str_times(spark, d):
    return scan(spark, d, "events").select("event_id", col("ts").dt.strftime("%H:%M:%S").str.to_time().alias("us"))


@query("json_paths", "SELECT event_id, props->>'$.k' AS k, (props->>'$.k')::BIGINT AS n FROM events")
def json_paths(spark, d):
    p = col("props")
    return scan(spark, d, "events").select("event_id", p.str.json_path_match("$.k").alias("k"), p.str.json_decode("struct<k:bigint>").struct.field("k").alias("n"))


@query("str_normalize", None)
def str_normalize(spark, d):
    return scan(spark, d, "documents").select("doc_id", _t.str.normalize("NFKD").str.len_chars().alias("n"))


@query("str_normalize_composed", "SELECT doc_id, md5(nfc_normalize(text)) AS m FROM documents")
def str_normalize_composed(spark, d):
    return scan(spark, d, "documents").select("doc_id", _t.str.normalize("NFC")._map("md5", _md5).alias("m"))


@query("str_find_many", "SELECT doc_id, (" + " + ".join(f"(length(text) - length(replace(text, '{p}', ''))) // {len(p)}" for p in ("the", "he", "que")) + ")::INTEGER AS n FROM documents")
def str_find_many(spark, d):
    return scan(spark, d, "documents").select("doc_id", _t.str.find_many(["the", "he", "que"], overlapping=True).list.len().alias("n"))


def _md5(c):
    from pyspark.sql import functions as F

    return F.md5(c)


def _hex(c):
    from pyspark.sql import functions as F

    return F.lower(F.hex(c))

