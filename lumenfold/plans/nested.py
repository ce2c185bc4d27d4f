"""Lists, fixed-width arrays, structs, bytes."""

from __future__ import annotations

from lumenfold.functions.expr import col, element, lit, struct
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan

#: Each customer's order prices in order of their keys, and their codes with a hole in each.
_L = """(SELECT o_custkey AS id, list(o_totalprice ORDER BY o_orderkey) AS p, list(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 END ORDER BY o_orderkey) AS k FROM orders GROUP BY 1)"""
_p, _k = col("p"), col("k")


def _lists(spark, d):
    from lumenfold.functions.expr import when

    code = when(col("o_orderkey") % 5 != 0).then(col("o_orderkey") % 7).otherwise(lit(None))
    f = scan(spark, d, "orders").sort("o_orderkey").group_by(col("o_custkey").alias("id"))
    return f.agg(col("o_totalprice").implode().alias("p"), code.implode().alias("k"))


def _q(name: str, sql: str, **exprs):
    @query(name, f"SELECT id, {sql} FROM {_L}")
    def run(spark, d):
        return _lists(spark, d).select("id", *[e.alias(n) for n, e in exprs.items()])

    return run


def _t(e):
    """A list as text, nulls as dashes."""
    return e.cast("array<string>")._map("text", lambda a: _joined(a))


def _joined(a):
    from pyspark.sql import functions as F

    return F.array_join(a, ",", "-")


def _s(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda x: coalesce(x::VARCHAR, '-')), ',')"


_FULL = "list_filter(k, lambda x: x IS NOT NULL)"
_q("list_access", "len(p)::INTEGER AS n, p[1] AS first, p[-1] AS last, p[2] AS second, p[100] AS none", n=_p.list.len(), first=_p.list.first(), last=_p.list.last(), second=_p.list.get(1), none=_p.list.get(99))
_q("list_membership", f"list_contains({_FULL}, 3) AS has, len(list_filter(k, lambda x: x = 3))::INTEGER AS n, len({_FULL}) < len(k) AS hole", has=_k.list.contains(3), n=_k.list.count_matches(3), hole=_k.list.contains(lit(None)))
_q("list_reductions", f"round(list_sum(p), 2) AS total, list_min(p) AS low, list_max(p) AS high, round(list_avg(p), 6) AS mean, list_sum(k)::BIGINT AS ks", total=_p.list.sum().round(2), low=_p.list.min(), high=_p.list.max(), mean=_p.list.mean().round(6), ks=_k.list.sum().cast("bigint"))
_q("list_spread", "CASE WHEN len(p) > 1 THEN round(list_var_samp(p), 1) END AS var, CASE WHEN len(p) > 1 THEN round(list_stddev_samp(p), 4) END AS sd, round(list_median(p), 4) AS mid, round(list_sort(p)[floor((len(p) - 1) * 0.25)::INT + 1], 4) AS low", var=_p.list.var().round(1), sd=_p.list.std().round(4), mid=_p.list.median().round(4), low=_p.list.quantile(0.25, "lower").round(4))
_q("list_uniques", f"len(list_distinct({_FULL})) + (len({_FULL}) < len(k))::INT AS n, list_position(p, list_min(p)) - 1 AS low_at, list_position(p, list_max(p)) - 1 AS high_at", n=_k.list.n_unique().cast("bigint"), low_at=_p.list.arg_min().cast("int"), high_at=_p.list.arg_max().cast("int"))
_q("list_any_all", f"len(list_filter({_FULL}, lambda x: x > 5)) > 0 AS some, len(list_filter({_FULL}, lambda x: x < 7)) = len({_FULL}) AS every", some=_k.list.eval(element() > 5).list.any(), every=_k.list.eval(element() < 7).list.all())
_q("list_eval", f"{_s('list_transform(p, lambda x: round(x * 2, 2))')} AS twice, {_s('list_transform(k, lambda x: x + 1)')} AS up", twice=_t(_p.list.eval((element() * 2.0).round(2))), up=_t(_k.list.eval(element() + 1)))
_q("list_filter", f"{_s('list_filter(k, lambda x: x > 2)')} AS big", big=_t(_k.list.filter(element() > 2)))
_q("list_sorts", f"{_s('list_sort(k, $$ASC$$, $$NULLS FIRST$$)')} AS up, {_s('list_sort(k, $$DESC$$, $$NULLS FIRST$$)')} AS down, {_s('list_sort(k, $$ASC$$, $$NULLS LAST$$)')} AS tail, {_s('list_reverse(k)')} AS back", up=_t(_k.list.sort()), down=_t(_k.list.sort_desc()), tail=_t(_k.list.sort(nulls_last=True)), back=_t(_k.list.reverse()))
_q("list_slices", f"{_s('k[1:3]')} AS head, {_s('k[-3:]')} AS tail, {_s('k[2:4]')} AS mid, {_s('k[1:-1:2]')} AS every", head=_t(_k.list.head(3)), tail=_t(_k.list.tail(3)), mid=_t(_k.list.slice(1, 3)), every=_t(_k.list.gather_every(2)))
_q("list_gather", f"{_s('[k[1], k[-1], k[100]]')} AS g", g=_t(_k.list.gather([0, -1, 99])))
_q("list_shifts", f"{_s('list_transform(k, lambda x, i: CASE WHEN i > 1 THEN k[i - 1] END)')} AS sh, {_s('list_transform(k, lambda x, i: CASE WHEN i > 1 THEN x - k[i - 1] END)')} AS di", sh=_t(_k.list.shift(1)), di=_t(_k.list.diff()))
_q("list_distinct", f"{_s('list_filter(k, lambda x, i: x IS NOT NULL AND list_position(k, x) = i)')} AS u, {_s(_FULL)} AS full", u=_t(_k.list.unique().list.drop_nulls()), full=_t(_k.list.drop_nulls()))
_q("list_joins", f"{_s('list_concat(k, [9, 9])')} AS more", more=_t(_k.list.concat(lit([9, 9]))))
_q("list_sets", f"{_s('list_sort(list_distinct(list_concat(' + _FULL + ', [1, 2, 30])))')} AS u, {_s('list_sort(list_distinct(list_intersect(' + _FULL + ', [1, 2, 30])))')} AS i, {_s('list_sort(list_distinct(list_filter(' + _FULL + ', lambda x: x NOT IN (1, 2, 30))))')} AS d", u=_t(_k.list.drop_nulls().list.set_union([1, 2, 30]).list.sort()), i=_t(_k.list.drop_nulls().list.set_intersection([1, 2, 30]).list.sort()), d=_t(_k.list.drop_nulls().list.set_difference([1, 2, 30]).list.sort()))
_q("list_sort_by", f"{_s('list_transform(list_sort(list_transform(k, lambda x, i: {$$a$$: -coalesce(x, 100), $$i$$: i, $$v$$: x})), lambda s: s.v)').replace('$$', chr(39))} AS s", s=_t(_k.list.sort_by(-element().fill_null_with(100))))
_q("list_to_struct", "k[1] AS a, k[2] AS b", a=_k.list.to_struct("a", "b").struct.field("a"), b=_k.list.to_struct("a", "b").struct.field("b"))
_q("list_samples", "least(len(k), 2)::INTEGER AS n", n=_k.list.sample_n(2, seed=4).list.len())
_q("list_items", "p[1] AS one", one=_p.list.head(1).list.item())
_q("list_agg", "len(list_filter(p, lambda x: x > 200000))::INTEGER AS n", n=_p.list.agg(lambda a: _big(a)))


def _big(a):
    from pyspark.sql import functions as F

    return F.size(F.filter(a, lambda x: x > 200000))


@query("array_dot", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 5) AS norm, len(embedding)::INTEGER AS n FROM embeddings")
def array_dot(spark, d):
    e = col("embedding")
    return scan(spark, d, "embeddings").select("vec_id", "label", e.arr.dot(e).round(5).alias("norm"), e.arr.len().alias("n"))


@query("array_extremes", "SELECT vec_id, list_max(embedding)::DOUBLE AS high, list_position(embedding, list_max(embedding)) - 1 AS at, embedding[1]::DOUBLE AS first FROM embeddings")
def array_extremes(spark, d):
    e = col("embedding").arr
    return scan(spark, d, "embeddings").select("vec_id", e.max().cast("double").alias("high"), e.arg_max().cast("int").alias("at"), e.first().cast("double").alias("first"))


@query("array_width", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS s FROM embeddings")
def array_width(spark, d):
    f = scan(spark, d, "embeddings")
    wide = col("embedding").list.eval(element().cast("double")).list.to_array(len(f.select("embedding").head(1).rows()[0][0]))
    return f.select("vec_id", wide.arr.to_list().list.sum().round(5).alias("s"))


_S = struct(col("c_custkey").alias("id"), col("c_name").alias("name"), col("c_acctbal").alias("bal"))


@query("struct_fields", "SELECT c_custkey, c_name AS name, c_acctbal AS bal2, upper(c_name) AS up, c_custkey AS id3 FROM customer")
def struct_fields(spark, d):
    s = col("s")
    return scan(spark, d, "customer").select("c_custkey", _S.alias("s")).select(
        "c_custkey", s.struct.field("name"), s.struct.rename_fields("a", "b", "c").struct.field("c").alias("bal2"),
        s.struct.with_fields(col("s").struct.field("name").str.to_upper().alias("up")).struct.field("up"), s.struct.drop("name").name.suffix_fields("3").struct.field("id3"),
    )


@query("struct_json", "SELECT c_custkey, '{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\"}' AS j FROM customer")
def struct_json(spark, d):
    return scan(spark, d, "customer").select("c_custkey", _S.struct.field("id", "name").struct.json_encode().alias("j"))


@query(
    "binary_functions",
    """SELECT c_custkey, octet_length(encode(c_name))::INTEGER AS n, lower(hex(encode(left(c_name, 4)))) AS head, lower(hex(encode(right(c_name, 4)))) AS tail, contains(c_name, '#0') AS has,
    starts_with(c_name, 'Cust') AS pre, ascii(substr(c_name, 2, 1)) AS second, length(c_name) / 1024 AS kb FROM customer""",
)
def binary_functions(spark, d):
    b = col("c_name").cast("binary")
    return scan(spark, d, "customer").select(
        "c_custkey", b.bin.size().alias("n"), b.bin.head(4).bin.encode("hex").alias("head"), b.bin.tail(4).bin.encode("hex").alias("tail"), b.bin.contains(lit("#0")).alias("has"),
        b.bin.starts_with(lit("Cust")).alias("pre"), b.bin.get(1).alias("second"), b.bin.size("kb").alias("kb"),
    )


@query("binary_reinterpret", "SELECT c_custkey, c_custkey AS n FROM customer")
def binary_reinterpret(spark, d):
    return scan(spark, d, "customer").select("c_custkey", _bytes(col("c_custkey")).bin.reinterpret("long", "big").alias("n"))


def _bytes(e):
    """A long as its eight bytes."""
    from pyspark.sql import functions as F

    return e._map("bytes", lambda c: F.unhex(F.lpad(F.hex(c), 16, "0")))


@query("map_entries", "SELECT c_custkey, c_mktsegment AS key, c_acctbal AS value FROM customer")
def map_entries(spark, d):
    """An Arrow map is a list of key-value structs here."""
    from pyspark.sql import functions as F

    m = col("c_mktsegment")._f("map", lambda _, k, v: F.map_entries(F.create_map(k, v)), col("c_acctbal"))
    return scan(spark, d, "customer").select("c_custkey", m.alias("m")).explode("m").unnest("m")
