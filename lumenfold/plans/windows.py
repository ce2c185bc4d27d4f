"""Window functions: ranks, running values, shifts, fills, rolling frames by rows and by time, decay and duplicates."""

from __future__ import annotations

from lumenfold.functions.expr import col, is_duplicated, is_unique, lit, rolling_corr, rolling_cov, when
from lumenfold.plans.aggregates import _E, _events
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan

_W = "OVER (PARTITION BY user_id ORDER BY event_id)"
_v, _k = col("v"), col("k")


def _win(name: str, sql: str, **exprs):
    """Register a query of window expressions over each user's events in order of their ids; {w} in the SQL is that window."""

    @query(name, f"SELECT event_id, {sql.replace('{w}', _W)} FROM {_E}")
    def run(spark, d):
        return _events(spark, d).select("event_id", *[e.over("user_id", order_by="event_id").alias(n) for n, e in exprs.items()])

    return run


def _frame(rows: str) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {rows})"


_T5 = _frame("4 PRECEDING AND CURRENT ROW")
_win("over_aggregates", "round(sum(v) OVER (PARTITION BY user_id), 2) AS total, count(v) OVER (PARTITION BY user_id) AS n, max(v) OVER (PARTITION BY user_id) AS high, round(avg(v) OVER (PARTITION BY user_id), 6) AS mean", total=_v.sum().round(2), n=_v.count(), high=_v.max(), mean=_v.mean().round(6))
_win("over_distinct", "len(list_distinct(list(k % 10) OVER (PARTITION BY user_id)))::BIGINT AS uniq", uniq=(_k % 10).n_unique())
_win("over_share", "round(v / sum(v) OVER (PARTITION BY user_id), 8) AS share", share=(_v / _v.sum()).round(8))


@query(
    "rank_methods",
    f"""SELECT event_id, CASE WHEN v IS NOT NULL THEN rank() {{w}} END AS low, CASE WHEN v IS NOT NULL THEN dense_rank() {{w}} END AS dense,
    CASE WHEN v IS NOT NULL THEN rank() {{w}} + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2 END AS mean,
    CASE WHEN v IS NOT NULL THEN rank() {{w}} + count(*) OVER (PARTITION BY user_id, v) - 1 END AS high,
    CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY user_id ORDER BY v NULLS LAST, event_id) END AS place,
    CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST) END AS down FROM (SELECT event_id, user_id, round(v / 20) AS v FROM {_E})""".replace("{w}", "OVER (PARTITION BY user_id ORDER BY v NULLS LAST)"),
)
def rank_methods(spark, d):
    f = _events(spark, d).select("event_id", "user_id", (_v / 20.0).round().alias("v"))
    by = lambda e, t="bigint": e.over("user_id").cast(t)
    return f.select(
        "event_id", by(_v.rank("min")).alias("low"), by(_v.rank("dense")).alias("dense"), by(_v.rank("average"), "double").alias("mean"), by(_v.rank("max")).alias("high"),
        by(_v.rank("ordinal")).alias("place"), by(_v.rank("min", descending=True)).alias("down"),
    )


_BACK = _frame("CURRENT ROW AND UNBOUNDED FOLLOWING")
_win("cumulative", f"CASE WHEN v IS NOT NULL THEN round(sum(v) {{w}}, 2) END AS total, CASE WHEN v IS NOT NULL THEN min(v) {{w}} END AS low, CASE WHEN v IS NOT NULL THEN max(v) {{w}} END AS high, row_number() {{w}} AS n, CASE WHEN v IS NOT NULL THEN round(sum(v) {_BACK}, 2) END AS left, sum(k) {{w}}::BIGINT AS ks".replace("sum(k) {w}::BIGINT", "(sum(k) {w})::BIGINT"), total=_v.cum_sum().round(2), low=_v.cum_min(), high=_v.cum_max(), n=_v.cum_count(), left=_v.cum_sum(reverse=True).round(2), ks=_k.cum_sum().cast("bigint"))
_win("cumulative_product", "round(product(1 + k / 100000) {w}, 11) AS p", p=(_k / 100000.0 + 1.0).cum_prod().round(11))
_win("shifts", "lag(v) {w} AS before, lead(v, 2) {w} AS after, lag(k, 3, -1) {w} AS filled", before=_v.shift(1), after=_v.shift(-2), filled=_k.shift(3, -1))
_win("differences", "k - lag(k, 2) {w} AS diff, round(v / lag(v) {w} - 1, 6) AS pct", diff=_k.diff(2), pct=_v.pct_change().round(6))
_win("fills", f"last_value(v IGNORE NULLS) {{w}} AS fwd, first_value(v IGNORE NULLS) {_BACK} AS bwd, last_value(v IGNORE NULLS) {_frame('1 PRECEDING AND CURRENT ROW')} AS near", fwd=_v.forward_fill(), bwd=_v.backward_fill(), near=_v.forward_fill(1))


def _need(agg: str, n: int = 5, w: str = _T5) -> str:
    return f"CASE WHEN count(v) {w} >= {n} THEN {agg} END"


_win(
    "rolling_rows", f"""{_need(f'round(sum(v) {_T5}, 2)', 3)} AS total, {_need(f'round(avg(v) {_T5}, 6)', 3)} AS mean, {_need(f'min(v) {_T5}', 3)} AS low, {_need(f'max(v) {_T5}', 3)} AS high,
    {_need(f'round(avg(v) {_frame("2 PRECEDING AND 2 FOLLOWING")}, 6)', 1, _frame("2 PRECEDING AND 2 FOLLOWING"))} AS centred, CASE WHEN count(k) {_T5} >= 5 THEN sum(k) {_T5} END::BIGINT AS full""",
    total=_v.rolling_sum(5, min_samples=3).round(2), mean=_v.rolling_mean(5, min_samples=3).round(6), low=_v.rolling_min(5, min_samples=3), high=_v.rolling_max(5, min_samples=3),
    centred=_v.rolling_mean(5, min_samples=1, center=True).round(6), full=_k.rolling_sum(5),
)
_win("rolling_spread", f"{_need(f'round(var_samp(v) {_T5}, 7)', 3)} AS var, {_need(f'round(stddev_samp(v) {_T5}, 5)', 3)} AS sd", var=_v.rolling_var(5, min_samples=3).round(7), sd=_v.rolling_std(5, min_samples=3).round(5))
_win("rolling_quantiles", f"{_need(f'round(median(v) {_T5}, 6)', 3)} AS mid, {_need(f'round(quantile_cont(v, 0.25) {_T5}, 6)', 3)} AS q, {_need(f'list_sort(list(v) FILTER (v IS NOT NULL) {_T5})[1 + floor((count(v) {_T5} - 1) * 0.25)::INT]', 3)} AS low", mid=_v.rolling_median(5, min_samples=3).round(6), q=_v.rolling_quantile(0.25, "linear", 5, min_samples=3).round(6), low=_v.rolling_quantile(0.25, "lower", 5, min_samples=3))
_T6 = _frame("5 PRECEDING AND CURRENT ROW")
_win("rolling_moments", f"CASE WHEN count(k) {_T6} >= 6 THEN round(skewness(k) {_T6}, 5) END AS skew, CASE WHEN count(k) {_T6} >= 6 THEN round(kurtosis(k) {_T6}, 5) END AS kurt", skew=_k.rolling_skew(6, bias=False).round(5), kurt=_k.rolling_kurtosis(6, bias=False).round(5))
_win("rolling_rank", f"CASE WHEN count(k) {_T5} >= 5 THEN len(list_filter(list(k) {_T5}, lambda x: x < k)) + (len(list_filter(list(k) {_T5}, lambda x: x = k)) + 1) / 2 END AS place", place=_k.rolling_rank(5))
_win("rolling_pairs", f"CASE WHEN count(k) {_T5} >= 5 THEN round(corr(k, event_id) {_T5}, 6) END AS r, CASE WHEN count(k) {_T5} >= 5 THEN round(covar_samp(k, event_id) {_T5}, 3) END AS c", r=rolling_corr(_k, col("event_id"), 5).round(6), c=rolling_cov(_k, col("event_id"), 5).round(3))
_win("cumulative_eval", f"round(list_max(list(k) {_frame('UNBOUNDED PRECEDING AND CURRENT ROW')}) - list_min(list(k) {_frame('UNBOUNDED PRECEDING AND CURRENT ROW')}))::BIGINT AS spread", spread=_k.cumulative_eval(lambda a: _spread(a)))


def _spread(a):
    from pyspark.sql import functions as F

    return F.array_max(a) - F.array_min(a)


_D = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW)"


@query(
    "rolling_by_time",
    f"""SELECT event_id, round(sum(value) {_D}, 2) AS total, round(avg(value) {_D}, 6) AS mean, min(value) {_D} AS low, max(value) {_D} AS high, round(median(value) {_D}, 6) AS mid,
    CASE WHEN count(value) {_D} > 1 THEN round(stddev_samp(value) {_D}, 5) END AS sd FROM events""",
)
def rolling_by_time(spark, d):
    v = col("value")
    by = lambda e: e.over("user_id")
    return scan(spark, d, "events").select(
        "event_id", by(v.rolling_sum_by("ts", "1d")).round(2).alias("total"), by(v.rolling_mean_by("ts", "1d")).round(6).alias("mean"), by(v.rolling_min_by("ts", "1d")).alias("low"),
        by(v.rolling_max_by("ts", "1d")).alias("high"), by(v.rolling_median_by("ts", "1d")).round(6).alias("mid"), by(v.rolling_std_by("ts", "1d")).round(5).alias("sd"),
    )


@query("rolling_by_integer", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 99 PRECEDING AND CURRENT ROW), 2) AS total FROM events")
def rolling_by_integer(spark, d):
    return scan(spark, d, "events").select("event_id", col("value").rolling_sum_by("event_id", "100i").over("event_type").round(2).alias("total"))


def _decay(num: str, keep: float = 0.5) -> str:
    """SQL of a fold over each row's prefix."""
    return f"SELECT a.event_id, {num} FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id"


_W1, _W2, _M = "sum(pow(0.7, a.i - b.i))", "sum(pow(0.49, a.i - b.i))", "sum(pow(0.7, a.i - b.i) * b.v) / sum(pow(0.7, a.i - b.i))"


_EVERY = "WITH r AS (SELECT user_id, event_id, value::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, epoch_us(ts) AS t FROM events) "


def _decaying(name: str, sql: str, e):
    @query(name, _EVERY + sql)
    def run(spark, d):
        return scan(spark, d, "events").sort("event_id").select("event_id", e)

    return run


_in_order = {"order_by": "event_id"}
_value = col("value")
_decaying("ewm_mean", _decay("round(sum(pow(0.5, a.i - b.i) * b.v) / sum(pow(0.5, a.i - b.i)), 6) AS m"), _value.ewm_mean(0.5).over("user_id", **_in_order).round(6).alias("m"))
_decaying("ewm_mean_recursive", _decay("round(sum(CASE WHEN b.i = 1 THEN 1 ELSE 1 / 3 END * pow(2 / 3, a.i - b.i) * b.v), 6) AS m"), _value.ewm_mean(1 / 3, adjust=False).over("user_id", **_in_order).round(6).alias("m"))
_decaying("ewm_var", _decay(f"CASE WHEN count(*) > 1 THEN round((sum(pow(0.7, a.i - b.i) * b.v * b.v) / {_W1} - ({_M}) ** 2) * {_W1} ** 2 / ({_W1} ** 2 - {_W2}), 5) END AS s"), _value.ewm_var(0.3).over("user_id", **_in_order).round(5).alias("s"))
_decaying("ewm_sum", _decay("round(sum(pow(2 / 3, a.i - b.i) * b.v), 6) AS s"), _value.ewm_sum(1 / 3).over("user_id", **_in_order).round(6).alias("s"))
_decaying(
    "ewm_mean_by_time",
    """, p AS (SELECT *, 1 - pow(0.5, (t - lag(t) OVER (PARTITION BY user_id ORDER BY i)) / 86400000000.0) AS g FROM r)
    SELECT event_id, round(m, 5) AS m FROM (SELECT a.event_id, sum(CASE WHEN b.i = 1 THEN 1 ELSE b.g END * pow(0.5, (a.t - b.t) / 86400000000.0) * b.v) AS m
    FROM p a JOIN p b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY 1)""",
    _value.ewm_mean_by("ts", "1d").over("user_id").round(5).alias("m"),
)


@query(
    "interpolate_rows",
    f"""WITH r AS (SELECT event_id, user_id, v, row_number() {_W} AS i FROM {_E}), n AS (SELECT *,
    last_value(v IGNORE NULLS) OVER a AS lv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS li, first_value(v IGNORE NULLS) OVER b AS rv,
    first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ri FROM r
    WINDOW a AS (PARTITION BY user_id ORDER BY i), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(v, lv + (rv - lv) * (i - li) / (ri - li)), 6) AS v FROM n""",
)
def interpolate_rows(spark, d):
    return _events(spark, d).select("event_id", _v.interpolate().over("user_id", order_by="event_id").round(6).alias("v"))


@query("duplicate_flags", f"SELECT event_id, count(*) OVER (PARTITION BY k) = 1 AS uniq, count(*) OVER (PARTITION BY user_id, event_type) > 1 AS pair, row_number() OVER (PARTITION BY k ORDER BY event_id) = 1 AS first, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1 AS last FROM {_E}")
def duplicate_flags(spark, d):
    return _events(spark, d).select("event_id", _k.is_unique().alias("uniq"), is_duplicated("user_id", "event_type").alias("pair"), _k.is_first_distinct().alias("first"), _k.is_last_distinct().alias("last"))


@query("unique_pairs", "SELECT event_id, count(*) OVER (PARTITION BY user_id, value) = 1 AS alone FROM events")
def unique_pairs(spark, d):
    return scan(spark, d, "events").select("event_id", is_unique("user_id", "value").alias("alone"))


@query(
    "run_ids",
    f"SELECT event_id, (sum(CASE WHEN before IS NULL OR event_type = before THEN 0 ELSE 1 END) {_W})::BIGINT AS run FROM (SELECT *, lag(event_type) {_W} AS before FROM {_E})",
)
def run_ids(spark, d):
    return _events(spark, d).select("event_id", col("event_type").rle_id().over("user_id", order_by="event_id").cast("bigint").alias("run"))


_win("peaks", "k > coalesce(lag(k) {w}, 0) AND k > coalesce(lead(k) {w}, 0) AS top, k < coalesce(lag(k) {w}, 0) AND k < coalesce(lead(k) {w}, 0) AS dip", top=_k.peak_max(), dip=_k.peak_min())


@query("qcut_bins", f"SELECT event_id, CASE WHEN v IS NULL THEN NULL WHEN v <= quantile_cont(v, 0.25) OVER () THEN 'low' WHEN v <= quantile_cont(v, 0.75) OVER () THEN 'mid' ELSE 'high' END AS bin FROM {_E}")
def qcut_bins(spark, d):
    return _events(spark, d).select("event_id", _v.qcut([0.25, 0.75], ["low", "mid", "high"]).alias("bin"))


@query("nested_windows", f"SELECT event_id, max(d) OVER (PARTITION BY user_id) AS widest FROM (SELECT event_id, user_id, k - lag(k) {_W} AS d FROM {_E})")
def nested_windows(spark, d):
    return _events(spark, d).select("event_id", _k.diff(1).over("user_id", order_by="event_id").max().over("user_id").alias("widest"))


@query("window_filter", f"SELECT user_id, event_id, v FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST) AS r FROM {_E}) WHERE v IS NOT NULL AND r <= 2")
def window_filter(spark, d):
    return _events(spark, d).filter(_v.rank("min", descending=True).over("user_id") <= 2).select("user_id", "event_id", "v")


@query("rolling_closed_left", "SELECT event_id, count(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400000000 MICROSECOND PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS n FROM events")
def rolling_closed_left(spark, d):
    from pyspark.sql import functions as F

    e = col("value").rolling_by("n", col("ts"), "1d", lambda c, w: F.count(c).over(w), closed="left", min_samples=0)
    return scan(spark, d, "events").select("event_id", e.over("user_id").alias("n"))


@query("grouped_window_when", f"SELECT event_id, CASE WHEN k > avg(k) OVER (PARTITION BY user_id) THEN 'above' ELSE 'below' END AS side FROM {_E}")
def grouped_window_when(spark, d):
    return _events(spark, d).select("event_id", when(_k > _k.mean().over("user_id")).then(lit("above")).otherwise("below").alias("side"))


_places = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice)"


@query(
    "window_places",
    f"""SELECT o_orderkey, round(percent_rank() {_places}, 8) AS share, round(cume_dist() {_places}, 8) AS upto,
    ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS third,
    nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders""",
)
def window_places(spark, d):
    f = scan(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").sort("o_orderkey")
    p = col("o_totalprice")
    return f.select(
        "o_orderkey", p.percent_rank().over("o_custkey").round(8).alias("share"), p.cume_dist().over("o_custkey").round(8).alias("upto"),
        p.ntile(3).over("o_custkey").cast("bigint").alias("third"), p.nth_value(2).over("o_custkey", order_by="o_orderkey").alias("second"),
    )


_DAY = "OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {} PRECEDING AND {})"
_RIGHT, _BOTH, _LEFT = _DAY.format(86_399_999_999, "CURRENT ROW"), _DAY.format(86_400_000_000, "CURRENT ROW"), _DAY.format(86_400_000_000, "1 PRECEDING")


@query(
    "rolling_by_closed",
    f"""SELECT event_id, CASE WHEN count(value) {_RIGHT} > 1 THEN round(var_samp(value) {_RIGHT} * 0.97, 3) END AS var, round(quantile_cont(value, 0.25) {_RIGHT}, 6) AS low,
    round(sum(value) {_BOTH}, 2) AS both, round(sum(value) {_LEFT}, 2) AS before FROM events""",
)
def rolling_by_closed(spark, d):
    v = col("value")
    by = lambda e: e.over("user_id")
    return scan(spark, d, "events").select(
        "event_id", (by(v.rolling_var_by("ts", "1d")) * 0.97).round(3).alias("var"), by(v.rolling_quantile_by(0.25, "linear", "ts", "1d")).round(6).alias("low"),
        by(v.rolling_sum_by("ts", "1d", closed="both")).round(2).alias("both"), by(v.rolling_sum_by("ts", "1d", closed="left")).round(2).alias("before"),
    )


@query(
    "interpolate_by_time",
    """WITH e AS (SELECT event_id, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN value END AS v, user_id FROM events), n AS (SELECT *,
    last_value(v IGNORE NULLS) OVER a AS lv, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS lt,
    first_value(v IGNORE NULLS) OVER b AS rv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS rt FROM e
    WINDOW a AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(v, lv + (rv - lv) * (t - lt) / (rt - lt)), 4) AS v FROM n""",
)
def interpolate_by_time(spark, d):
    v = when(col("event_id") % 3 == 0).then(col("value")).otherwise(lit(None))
    return scan(spark, d, "events").select("event_id", v.interpolate_by("ts").over("user_id").round(4).alias("v"))


@query("concat_arrays", "SELECT vec_id, (2 * len(embedding))::INTEGER AS n, embedding[1] = embedding[1] AS again FROM embeddings")
def concat_arrays(spark, d):
    from lumenfold.functions.expr import concat_arr

    e = col("embedding")
    both = concat_arr(e, e)
    return scan(spark, d, "embeddings").select("vec_id", both.arr.len().alias("n"), (both.arr.get(0) == e.arr.first()).alias("again"))
