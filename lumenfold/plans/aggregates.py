"""Aggregate expressions, and expressions that give a list for each group."""

from __future__ import annotations

from lumenfold.functions.expr import corr, cov, col, length, lit, spearman, when
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan

_E = "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v, (event_id * 7919) % 1000 AS k FROM events)"


def _events(spark, d):
    """Events in order of their ids, with holes in v and an integer k."""
    f = scan(spark, d, "events").sort("event_id")
    return f.select("event_id", "user_id", "event_type", when(col("event_id") % 9 != 0).then(col("value")).otherwise(lit(None)).alias("v"), (col("event_id") * 7919 % 1000).alias("k"))


def _by(name: str, sql: str, *aggs, key: str = "user_id"):
    """Register an aggregate query by ``key`` whose SQL is ``sql``."""

    @query(name, f"SELECT {key}, {sql} FROM {_E} GROUP BY 1")
    def run(spark, d):
        return _events(spark, d).group_by(key).agg(*aggs)

    return run


_v, _k = col("v"), col("k")


def _text(e, name: str):
    """A list as text, for comparison."""
    return e.cast("array<string>").list.join(",").alias(name)


_by("agg_sums", "sum(k)::BIGINT AS total, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high", _k.sum().cast("bigint").alias("total"), _v.mean().round(6).alias("mean"), _v.min().alias("low"), _v.max().alias("high"))
_by(
    "agg_counts", "count(v) AS n, count(*) AS len, count(*) - count(v) AS holes, count(*) > count(v) AS any_hole, count(DISTINCT k) AS uniq, count(DISTINCT v) + 1 AS uniq_null",
    _v.count().alias("n"), _v.len().alias("len"), _v.null_count().alias("holes"), _v.has_nulls().alias("any_hole"), _k.n_unique().alias("uniq"), _v.approx_n_unique().alias("uniq_null"), key="event_type",
)
_by("agg_positional", "first(v ORDER BY event_id) AS first, last(v ORDER BY event_id) AS last, arg_min(v, event_id) AS first_full, arg_max(v, event_id) AS last_full", _v.first().alias("first"), _v.last().alias("last"), _v.first_non_null().alias("first_full"), _v.last_non_null().alias("last_full"))
_by("agg_any_all", "bool_or(v > 300) AS any, bool_and(v > 1) AS every", (_v > 300.0).any().alias("any"), (_v > 1.0).all_true().alias("every"))
_by("agg_product", "round(product(1 + v / 100000), 8) AS p", (_v / 100000.0 + 1.0).product().round(8).alias("p"))
_by("agg_positions", "list_position(list(k ORDER BY event_id), min(k)) - 1 AS low_at, list_position(list(k ORDER BY event_id), max(k)) - 1 AS high_at", _k.arg_min().cast("int").alias("low_at"), _k.arg_max().cast("int").alias("high_at"))
_by("agg_min_max_by", "arg_min(event_id, v) AS cheapest, arg_max(event_id, v) AS dearest", col("event_id").min_by(_v).alias("cheapest"), col("event_id").max_by(_v).alias("dearest"), key="event_type")
_by("agg_variance", "round(var_samp(v), 4) AS var1, round(var_pop(v), 4) AS var0, round(stddev_samp(v), 5) AS sd1, round(var_pop(v) * count(v) / (count(v) - 2), 4) AS var2", _v.var().round(4).alias("var1"), _v.var(0).round(4).alias("var0"), _v.std().round(5).alias("sd1"), _v.var(2).round(4).alias("var2"))
_by("agg_pairs", "round(corr(v, k), 6) AS r, round(covar_samp(v, k), 3) AS c1, round(covar_pop(v, k), 3) AS c0", corr(_v, _k).round(6).alias("r"), cov(_v, _k).round(3).alias("c1"), cov(_v, _k, 0).round(3).alias("c0"))


@query(
    "agg_spearman",
    f"""WITH f AS (SELECT * FROM {_E} WHERE v IS NOT NULL), r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2 AS a,
    rank() OVER (PARTITION BY user_id ORDER BY k) + (count(*) OVER (PARTITION BY user_id, k) - 1) / 2 AS b FROM f) SELECT user_id, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""",
)
def agg_spearman(spark, d):
    return _events(spark, d).group_by("user_id").agg(spearman(_v, _k).round(6).alias("rho"))


_SORTED = "list_sort(list(v) FILTER (v IS NOT NULL))"
_AT = "(count(v) - 1) * 0.3"
_by(
    "agg_quantiles", f"""median(v) AS mid, round(quantile_cont(v, 0.3), 6) AS linear, {_SORTED}[floor({_AT})::INT + 1] AS lower, {_SORTED}[ceil({_AT})::INT + 1] AS higher,
    round(({_SORTED}[floor({_AT})::INT + 1] + {_SORTED}[ceil({_AT})::INT + 1]) / 2, 6) AS midpoint""",
    _v.median().alias("mid"), _v.quantile(0.3).round(6).alias("linear"), _v.quantile(0.3, "lower").alias("lower"), _v.quantile(0.3, "higher").alias("higher"), _v.quantile(0.3, "midpoint").round(6).alias("midpoint"),
)
_by("agg_moments", "round(skewness(v), 5) AS skew, round(kurtosis(v), 5) AS kurt, round(kurtosis_pop(v), 5) AS kurt_pop, round(kurtosis_pop(v) + 3, 5) AS pearson", _v.skew(bias=False).round(5).alias("skew"), _v.kurtosis(bias=False).round(5).alias("kurt"), _v.kurtosis().round(5).alias("kurt_pop"), _v.kurtosis(fisher=False).round(5).alias("pearson"))
_by("agg_bits", "bit_and(k + 1024) AS a, bit_or(k) AS o, bit_xor(k) AS x", (_k + 1024).bitwise_and().alias("a"), _k.bitwise_or().alias("o"), _k.bitwise_xor().alias("x"))
_by("agg_entropy", "round((ln(sum(v)) - sum(v * ln(v)) / sum(v)) / ln(2), 6) AS bits", _v.entropy(base=2.0).round(6).alias("bits"))
_by("agg_filter", "round(sum(v) FILTER (event_type = 'click'), 2) AS clicks, count(v) FILTER (event_type = 'view' AND k > 500) AS views", _v.filter(col("event_type") == "click").sum().round(2).alias("clicks"), _v.filter(col("event_type") == "view", _k > 500).count().alias("views"))
_by("agg_dot", "round(sum(v * k), 2) AS dot", _v.dot(_k).round(2).alias("dot"))
_by("agg_top_k", "array_to_string(list_sort(list(k), 'DESC')[1:3], ',') AS top, array_to_string(list_sort(list(k))[1:3], ',') AS bottom, array_to_string(list(event_id ORDER BY k DESC, event_id)[1:3], ',') AS by_k", _text(_k.top_k(3), "top"), _text(_k.bottom_k(3), "bottom"), _text(col("event_id").top_k_by(_k, 3), "by_k"))
_by("agg_implode", "array_to_string(list(coalesce(v::VARCHAR, '-') ORDER BY event_id), ',') AS vs", _v.implode().cast("array<string>")._map("holes", lambda a: _dashes(a)).list.join(",").alias("vs"))


def _dashes(a):
    from pyspark.sql import functions as F

    return F.transform(a, lambda v: F.coalesce(v, F.lit("-")))


_by("agg_sorted", "list_sort(list(k)) = list(k ORDER BY event_id) AS up, true AS ids", _k.is_sorted().alias("up"), col("event_id").is_sorted().alias("ids"))
_by("agg_head_tail", "array_to_string(list(k ORDER BY event_id)[1:3], ',') AS head, array_to_string(list(k ORDER BY event_id)[-2:], ',') AS tail, array_to_string(list(k ORDER BY event_id)[3:6], ',') AS slice, list(k ORDER BY event_id)[5] AS fifth", _text(_k.head(3), "head"), _text(_k.tail(2), "tail"), _text(_k.slice(2, 4), "slice"), _k.get(4).alias("fifth"))
_by("agg_gather", "array_to_string([list(k ORDER BY event_id)[1], list(k ORDER BY event_id)[-1]], ',') AS ends, array_to_string(list(k ORDER BY event_id)[2:-1:3], ',') AS every", _text(_k.gather([0, -1]), "ends"), _text(_k.gather_every(3, 1), "every"))
_by("agg_sort_lists", "array_to_string(list(k ORDER BY k DESC), ',') AS down, array_to_string(list(event_id ORDER BY k, event_id), ',') AS by_k, array_to_string(list_reverse(list(k ORDER BY event_id)), ',') AS back", _text(_k.sort_desc(), "down"), _text(col("event_id").sort_by(_k), "by_k"), _text(_k.reverse(), "back"))
_by("agg_drop_nulls", "array_to_string(list(v ORDER BY event_id) FILTER (v IS NOT NULL), ',') AS full", _text(_v.drop_nulls(), "full"), key="user_id")
_by("agg_append", "array_to_string(list_concat(list(k ORDER BY event_id), list(event_id ORDER BY event_id)), ',') AS both, array_to_string(list_concat(list(k ORDER BY event_id), [7, 7]), ',') AS more", _text(_k.append(col("event_id")), "both"), _text(_k.extend_constant(7, 2), "more"))
_by("agg_search", "count(*) FILTER (k < 400) AS sorted_at, list_position(list(k ORDER BY event_id), 919) - 1 AS at", _k.search_sorted(400).alias("sorted_at"), _k.index_of(919).cast("int").alias("at"), key="event_type")
_by("agg_arg_sort", "array_to_string(list_transform(list_sort(list_transform(range(len(list(k ORDER BY event_id))), lambda i: {'k': list(k ORDER BY event_id)[i + 1], 'i': i})), lambda s: s.i), ',') AS places", _text(_k.arg_sort(), "places"))
_by("agg_arg_true", "array_to_string(list_filter(range(len(list(k ORDER BY event_id))), lambda i: list(k ORDER BY event_id)[i + 1] > 500), ',') AS places", _text((_k > 500).arg_true(), "places"))
_by("agg_text_join", "string_agg(event_type, '|' ORDER BY event_id) AS kinds", col("event_type").str.join("|").alias("kinds"))
_by("agg_len_expr", "count(*) * 2 AS twice, round(max(v) - min(v), 2) AS spread", (length() * 2).alias("twice"), (_v.max() - _v.min()).round(2).alias("spread"))


@query("agg_mode", f"SELECT event_type, array_to_string(list_sort(list(k)), ',') AS modes FROM (SELECT event_type, k, n, max(n) OVER (PARTITION BY event_type) AS most FROM (SELECT event_type, k % 17 AS k, count(*) AS n FROM {_E} GROUP BY ALL)) WHERE n = most GROUP BY 1")
def agg_mode(spark, d):
    return _events(spark, d).group_by("event_type").agg(_text((_k % 17).mode(), "modes"))


@query("agg_hist", f"SELECT event_type, unnest([100.0::DOUBLE, 500.0::DOUBLE, 999.0::DOUBLE]) AS breakpoint, unnest([count(*) FILTER (k BETWEEN 0 AND 100), count(*) FILTER (k > 100 AND k <= 500), count(*) FILTER (k > 500 AND k <= 999)]) AS count FROM {_E} GROUP BY 1")
def agg_hist(spark, d):
    return _events(spark, d).group_by("event_type").agg(_k.hist([0, 100, 500, 999]).alias("h")).explode("h").unnest("h")


@query("agg_value_counts", f"SELECT event_type, k % 5 AS value, count(*) AS count FROM {_E} GROUP BY 1, 2")
def agg_value_counts(spark, d):
    return _events(spark, d).group_by("event_type").agg((_k % 5).value_counts().alias("c")).explode("c").unnest("c")


@query("agg_unique_list", f"SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM {_E} GROUP BY 1, 2) GROUP BY 1")
def agg_unique_list(spark, d):
    return _events(spark, d).group_by("user_id").agg(col("event_type").unique().list.join(",").alias("kinds"))


@query(
    "agg_rle",
    f"""WITH r AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {_E}))
    SELECT user_id, count(*)::INTEGER AS len, min(event_type) AS value, min(event_id) AS start FROM r GROUP BY user_id, run""",
)
def agg_rle(spark, d):
    kind = col("event_type")
    new = kind.rle_id().ne_missing(kind.rle_id().shift(1))
    f = _events(spark, d).group_by("user_id").agg(kind.rle().alias("r"), when(new).then(col("event_id")).drop_nulls().alias("start"))
    return f.explode("r", "start").unnest("r").select("user_id", col("len").cast("int"), "value", "start")


@query("agg_reshape", "SELECT array_to_string([n_nationkey, n_nationkey + 1, n_nationkey + 2, n_nationkey + 3, n_nationkey + 4], ',') AS row FROM nation WHERE n_nationkey % 5 = 0")
def agg_reshape(spark, d):
    f = scan(spark, d, "nation").sort("n_nationkey").select(col("n_nationkey").reshape(5).alias("row")).explode("row")
    return f.select(_text(col("row"), "row"))


@query("agg_item", "SELECT o_orderkey, o_totalprice AS only FROM orders")
def agg_item(spark, d):
    return scan(spark, d, "orders").group_by("o_orderkey").agg(col("o_totalprice").item().alias("only"))


@query("agg_sample", f"SELECT user_id, least(count(*), 5)::INTEGER AS n FROM {_E} GROUP BY 1")
def agg_sample(spark, d):
    return _events(spark, d).group_by("user_id").agg(_k.sample_n(5, seed=3).list.len().alias("n"))


@query("agg_sketch", None)
def agg_sketch(spark, d):
    return _events(spark, d).group_by("event_type").agg(col("event_id").approx_n_unique(rsd=0.02).alias("about"))


@query("agg_shuffled", f"SELECT user_id, array_to_string(list_sort(list(k)), ',') AS ks FROM {_E} GROUP BY 1")
def agg_shuffled(spark, d):
    return _events(spark, d).group_by("user_id").agg(_text(_k.shuffle(5).list.sort(), "ks"))


@query("agg_nan_extremes", "SELECT event_type, CASE WHEN event_type = 'click' THEN 'nan'::DOUBLE ELSE min(value) END AS low, CASE WHEN event_type = 'click' THEN 'nan'::DOUBLE ELSE max(value) END AS high, min(value) AS skip FROM events WHERE event_id <> 1 GROUP BY 1")
def agg_nan_extremes(spark, d):
    v = when((col("event_type") == "click") & (col("event_id") % 2 == 0)).then(lit(float("nan"))).otherwise(col("value"))
    f = scan(spark, d, "events").filter(col("event_id") != 1).select("event_type", v.alias("x"), "value")
    return f.group_by("event_type").agg(col("x").nan_min().alias("low"), col("x").nan_max().alias("high"), col("value").min().alias("skip"))
