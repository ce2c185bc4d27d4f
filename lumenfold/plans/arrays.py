"""Fixed-width arrays: every operation of ``.arr`` on the embeddings, in thousandths."""

from __future__ import annotations

from lumenfold.functions.expr import col, element, lit
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan

_Z = "(SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT) AS z FROM embeddings)"
z = col("z").arr


def _arrays(spark, d):
    whole = col("embedding").arr.eval((element().cast("double") * 1000.0).floor().cast("bigint"))
    return scan(spark, d, "embeddings").select(col("vec_id").alias("id"), whole.alias("z"))


def _q(name: str, sql: str, **exprs):
    @query(name, f"SELECT id, {sql} FROM {_Z}")
    def run(spark, d):
        return _arrays(spark, d).select("id", *[e.alias(n) for n, e in exprs.items()])


def _t(e):
    return e.cast("array<string>").list.join(",")


def _s(e: str) -> str:
    return f"array_to_string({e}, ',')"


_q("arr_access", "len(z)::INTEGER AS n, z[1] AS first, z[-1] AS last, z[3] AS third, z[-2] AS next_to_last", n=z.len(), first=z.first(), last=z.last(), third=z.get(2), next_to_last=z.get(-2))
_q("arr_reductions", "list_min(z) AS low, list_max(z) AS high, list_sum(z)::BIGINT AS total, round(list_avg(z), 6) AS mean", low=z.min(), high=z.max(), total=z.sum().cast("bigint"), mean=z.mean().round(6))
_q("arr_spread", "round(list_median(z), 4) AS mid, round(list_stddev_samp(z), 4) AS sd, round(list_var_samp(z), 3) AS var", mid=z.median().round(4), sd=z.std().round(4), var=z.var().round(3))
_q("arr_counts", "len(list_distinct(z))::BIGINT AS n, list_contains(z, 7) AS has, len(list_filter(z, lambda x: x = 7))::BIGINT AS sevens", n=z.n_unique().cast("bigint"), has=z.contains(7), sevens=z.count_matches(7).cast("bigint"))
_q("arr_extreme_places", "(list_position(z, list_min(z)) - 1)::INTEGER AS low_at, (list_position(z, list_max(z)) - 1)::INTEGER AS high_at", low_at=z.arg_min().cast("int"), high_at=z.arg_max().cast("int"))
_q("arr_any_all", "len(list_filter(z, lambda x: x > 900)) > 0 AS some, len(list_filter(z, lambda x: x > -900)) = len(z) AS every", some=z.eval(element() > 900).arr.any(), every=z.eval(element() > -900).arr.all())
_q("arr_slices", f"{_s('z[1:2]')} AS head, {_s('z[-2:]')} AS tail, {_s('z[2:3]')} AS mid", head=_t(z.head(2)), tail=_t(z.tail(2)), mid=_t(z.slice(1, 2)))
_q("arr_orders", f"{_s('list_sort(z)')} AS up, {_s('list_reverse_sort(z)')} AS down, {_s('list_reverse(z)')} AS back", up=_t(z.sort()), down=_t(z.sort_desc()), back=_t(z.reverse()))
_q("arr_sort_with", f"{_s('list_reverse_sort(z)')} AS down, {_s('list_sort(z)')} AS up", down=_t(z.sort(descending=True)), up=_t(z.sort(descending=False, nulls_last=True)))
_q("arr_unique", f"{_s('list_sort(list_distinct(z))')} AS u", u=_t(z.unique().list.sort()))
_q("arr_shift", "z[1] AS second, len(z)::INTEGER AS n", second=z.shift(1).arr.get(1), n=z.shift(1).arr.len())
_q("arr_join", "array_to_string(z, '|') AS line", line=z.eval(element().cast("string")).arr.join("|"))
_q("arr_eval_agg", f"{_s('list_transform(z, lambda x: x + 1)')} AS up, len(list_filter(z, lambda x: x > 0))::INTEGER AS positive", up=_t(z.eval(element() + 1)), positive=z.agg(lambda a: _positive(a)))
_q("arr_to_struct", "z[1] AS a, z[2] AS b", a=z.to_struct("a", "b").struct.field("a"), b=z.to_struct("a", "b").struct.field("b"))
_q("arr_to_list", f"{_s('z')} AS whole, len(z) > 3 AS wide", whole=_t(z.to_list()), wide=z.to_list().list.len() > lit(3))


def _positive(a):
    from pyspark.sql import functions as F

    return F.size(F.filter(a, lambda x: x > 0))


@query("arr_explode", f"SELECT id, unnest(z) AS z FROM {_Z}")
def arr_explode(spark, d):
    return _arrays(spark, d).explode("z")
