"""Arithmetic, comparison, logic, maths, conditions, folds over columns and generators."""

from __future__ import annotations

import math

from lumenfold.functions.expr import (
    all_horizontal,
    any_horizontal,
    coalesce,
    col,
    concat_list,
    concat_str,
    concat_str_ignore_nulls,
    cum_reduce,
    cum_sum_horizontal,
    fold,
    format_,
    lit,
    max_horizontal,
    mean_horizontal,
    min_horizontal,
    null,
    struct,
    sum_horizontal,
    when,
)
from lumenfold.functions.lists import int_ranges, linear_spaces, ones, repeat
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan
from lumenfold.sources.io import date_range, int_range, linear_space, time_range

#: Integers from -9 to 9 with zeros and nulls, floats with NaN and infinities.
_P = """(SELECT o_orderkey AS id, (o_orderkey % 19 - 9)::BIGINT AS a, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 7 - 3)::BIGINT END AS b,
  CASE WHEN o_orderkey % 11 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 17 = 0 THEN 'inf'::DOUBLE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice / 1000 - 200 END AS x,
  CASE WHEN o_orderkey % 5 = 0 THEN 'nan'::DOUBLE ELSE (o_orderkey % 9 - 4)::DOUBLE END AS y FROM orders)"""
_a, _b, _x, _y = col("a"), col("b"), col("x"), col("y")


def _pairs(spark, d):
    k = col("o_orderkey")
    nan, inf = lit(math.nan), lit(math.inf)
    return scan(spark, d, "orders").select(
        k.alias("id"), (k % 19 - 9).alias("a"), when(k % 13 != 0).then(k % 7 - 3).otherwise(lit(None)).alias("b"),
        when(k % 11 == 0).then(nan).when(k % 17 == 0).then(inf).when(k % 23 == 0).then(null("double")).otherwise(col("o_totalprice") / 1000.0 - 200.0).alias("x"),
        when(k % 5 == 0).then(nan).otherwise((k % 9 - 4).cast("double")).alias("y"),
    )


def _scalar(name: str, sql: str, **exprs):
    @query(name, f"SELECT id, {sql} FROM {_P}")
    def run(spark, d):
        return _pairs(spark, d).select("id", *[e.alias(n) for n, e in exprs.items()])

    return run


_scalar("integer_arithmetic", "a + b AS s, a - b AS m, a * b AS p, -a AS n, abs(a) AS ab, sign(a)::BIGINT AS sg", s=_a + _b, m=_a - _b, p=_a * _b, n=-_a, ab=_a.abs(), sg=_a.sign())
_scalar(
    "integer_division",
    "CASE WHEN b <> 0 THEN floor(a / b)::BIGINT END AS f, CASE WHEN b <> 0 THEN trunc(a / b)::BIGINT END AS t, CASE WHEN b <> 0 THEN (((a % b) + b) % b)::BIGINT END AS r",
    f=_a // _b, t=_a.trunc_div(_b), r=_a % _b,
)
_scalar(
    "float_division",
    "CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 'inf'::DOUBLE WHEN a < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE a::DOUBLE / b END AS q",
    q=_a / _b,
)
_scalar("power", "round(pow(a, 3)) AS cube, round(pow(abs(a), 0.5), 9) AS root", cube=_a.pow(3.0).round(), root=_a.abs().pow(0.5).round(9))
_IEEE = "CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN isnan(x) OR isnan(y) THEN {} ELSE x {} y END AS {}"
_scalar("compare_floats", ", ".join(_IEEE.format("true" if op == "<>" else "false", op, n) for op, n in (("=", "eq"), ("<>", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge"))), eq=_x == _y, ne=_x != _y, lt=_x < _y, le=_x <= _y, gt=_x > _y, ge=_x >= _y)
_scalar("compare_missing", "a IS NOT DISTINCT FROM b AS same, a IS DISTINCT FROM b AS apart", same=_a.eq_missing(_b), apart=_a.ne_missing(_b))
_scalar("kleene", "(a > 0) AND (b > 0) AS both, (a > 0) OR (b > 0) AS either, (a > 0) <> (b > 0) AS one, NOT (b > 0) AS no", both=(_a > 0) & (_b > 0), either=(_a > 0) | (_b > 0), one=(_a > 0) ^ (_b > 0), no=~(_b > 0))
_scalar("bitwise", "(a + 20) & (b + 20) AS an, (a + 20) | (b + 20) AS o, xor(a + 20, b + 20) AS x, ~a AS n, bit_count(a + 20)::INTEGER AS ones", an=(_a + 20) & (_b + 20), o=(_a + 20) | (_b + 20), x=(_a + 20) ^ (_b + 20), n=~_a, ones=(_a + 20).bitwise_count_ones())
_scalar(
    "bit_runs",
    """64 - bit_count(a + 20)::INTEGER AS zeros, 64 - length(bin(a + 20))::INTEGER AS lead, (length(bin(a + 20)) - length(rtrim(bin(a + 20), '0')))::INTEGER AS trail,
    (length(bin(a + 20)) - length(rtrim(bin(a + 20), '1')))::INTEGER AS trail1, 0 AS lead1""",
    zeros=(_a + 20).bitwise_count_zeros(), lead=(_a + 20).bitwise_leading_zeros(), trail=(_a + 20).bitwise_trailing_zeros(), trail1=(_a + 20).bitwise_trailing_ones(), lead1=(_a + 20).bitwise_leading_ones(),
)
_scalar("ranges", "a BETWEEN -3 AND 3 AS both, a >= -3 AND a < 3 AS l, a > -3 AND a <= 3 AS r, a > -3 AND a < 3 AS n", both=_a.is_between(-3, 3), l=_a.is_between(-3, 3, "left"), r=_a.is_between(-3, 3, "right"), n=_a.is_between(-3, 3, "none"))
_scalar("membership", "b IN (1, 2, -3) AS there, list_contains([a, 0, 5], a) AS own", there=_b.is_in([1, 2, -3]), own=_a.is_in(concat_list(_a._map("one", lambda c: _array(c)))))
_scalar("presence", "b IS NULL AS nil, b IS NOT NULL AS full, isnan(x) AS nan, NOT isnan(x) AS num, isfinite(x) AS fin, isinf(x) AS inf", nil=_b.is_null(), full=_b.is_not_null(), nan=_x.is_nan(), num=_x.is_not_nan(), fin=_x.is_finite(), inf=_x.is_infinite())
_scalar("closeness", "CASE WHEN x IS NULL THEN NULL WHEN isnan(x) THEN false WHEN isinf(x) THEN true ELSE true END AS near", near=_x.is_close(_x * 1.0000000001))
_scalar(
    "roots_and_logs",
    """CASE WHEN a < 0 THEN 'nan'::DOUBLE ELSE round(sqrt(greatest(a, 0)), 9) END AS root, round(cbrt(a), 9) AS cube, round(exp(a), 6) AS ex,
    CASE WHEN a = 0 THEN '-inf'::DOUBLE WHEN a < 0 THEN 'nan'::DOUBLE ELSE round(ln(greatest(a, 1)), 9) END AS ln, CASE WHEN a = 0 THEN '-inf'::DOUBLE WHEN a < 0 THEN 'nan'::DOUBLE ELSE round(log10(greatest(a, 1)), 9) END AS lg,
    CASE WHEN a = -1 THEN '-inf'::DOUBLE WHEN a < -1 THEN 'nan'::DOUBLE ELSE round(ln(1 + greatest(a, 0)), 9) END AS l1, CASE WHEN a = 0 THEN '-inf'::DOUBLE WHEN a < 0 THEN 'nan'::DOUBLE ELSE round(ln(greatest(a, 1)) / ln(2), 9) END AS l2""",
    root=_a.cast("double").sqrt().pipe(lambda e: when(_a < 0).then(lit(math.nan)).otherwise(e.round(9))), cube=_a.cbrt().round(9), ex=_a.exp().round(6),
    ln=_a.ln().pipe(lambda e: when(_a <= 0).then(e).otherwise(e.round(9))), lg=_a.log10().pipe(lambda e: when(_a <= 0).then(e).otherwise(e.round(9))),
    l1=_a.log1p().pipe(lambda e: when(_a <= -1).then(e).otherwise(e.round(9))), l2=_a.log(2.0).pipe(lambda e: when(_a <= 0).then(e).otherwise(e.round(9))),
)
_scalar(
    "trigonometry",
    """round(sin(a), 9) AS s, round(cos(a), 9) AS c, round(tan(a), 6) AS t, round(asin(a / 10.0), 9) AS sa, round(acos(a / 10.0), 9) AS ca, round(atan(a), 9) AS ta, round(atan2(a, 3), 9) AS t2,
    round(sinh(a / 4.0), 9) AS sh, round(cosh(a / 4.0), 9) AS ch, round(tanh(a / 4.0), 9) AS th, round(asinh(a), 9) AS ah, round(acosh(abs(a) + 1), 9) AS ac, round(atanh(a / 10.0), 9) AS ath,
    round(degrees(a), 6) AS deg, round(radians(a), 9) AS rad, round(cot(a + 0.5), 6) AS ct""",
    s=_a.sin().round(9), c=_a.cos().round(9), t=_a.tan().round(6), sa=(_a / 10.0).arcsin().round(9), ca=(_a / 10.0).arccos().round(9), ta=_a.arctan().round(9), t2=_a.arctan2(lit(3)).round(9),
    sh=(_a / 4.0).sinh().round(9), ch=(_a / 4.0).cosh().round(9), th=(_a / 4.0).tanh().round(9), ah=_a.arcsinh().round(9), ac=(_a.abs() + 1).arccosh().round(9), ath=(_a / 10.0).arctanh().round(9),
    deg=_a.degrees().round(6), rad=_a.radians().round(9), ct=(_a + 0.5).cot().round(6),
)
_H = "(a * 10 + 5) / 100.0"
_h = (_a * 10 + 5) / 100.0
_scalar(
    "rounding",
    f"""round({_H} * 10) AS away, floor({_H} * 10)::BIGINT AS down, ceil({_H} * 10)::BIGINT AS up, trunc(a / 4.0 * 10) / 10 AS cut, round_even(a / 2.0, 0) AS even""",
    away=(_h * 10.0).round(), down=(_h * 10.0).floor().cast("bigint"), up=(_h * 10.0).ceil().cast("bigint"), cut=(_a / 4.0).truncate(1), even=(_a / 2.0).round(0, "half_to_even"),
)
_scalar("significant_figures", "CASE WHEN a = 0 THEN 0.0 ELSE round(sign(a) * floor(abs(a) * 123.456 * pow(10, 2 - floor(log10(abs(a) * 123.456))) + 0.5) / pow(10, 2 - floor(log10(abs(a) * 123.456))), 6) END::DOUBLE AS r", r=(_a * 123.456).round_sig_figs(3).round(6))
_scalar("clips", "CASE WHEN a < -2 THEN -2 WHEN a > 2 THEN 2 ELSE a END AS both, CASE WHEN b < 0 THEN 0 ELSE b END AS low, CASE WHEN b > 1 THEN 1 ELSE b END AS high", both=_a.clip(-2, 2), low=_b.clip_lower(0), high=_b.clip_upper(1))
_scalar("fills_scalar", "coalesce(b, 99) AS b, CASE WHEN isnan(x) THEN -1 ELSE x END AS x, coalesce(b, a, 0) AS c", b=_b.fill_null_with(99), x=_x.fill_nan(-1.0), c=coalesce(_b, _a, 0))
_scalar("value_maps", "CASE a WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE a END AS keep, CASE a WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS other, CASE a % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS strict", keep=_a.replace([1, 2], [100, 200]), other=_a.replace_or([1, 2], ["one", "two"], "many"), strict=(_a % 2).replace_strict([0, 1], ["even", "odd"]))
_scalar("casts", "a::INTEGER AS i, a::DOUBLE AS d, a::VARCHAR AS s, (a > 0)::INTEGER AS f, CASE WHEN x = floor(x) AND isfinite(x) THEN x::BIGINT END AS whole", i=_a.cast("int"), d=_a.cast("double"), s=_a.cast("string"), f=(_a > 0).cast("int"), whole=_x.cast_lossy("bigint"))
_scalar("physical_and_unsigned", "CASE WHEN a < 0 THEN a::HUGEINT + 18446744073709551616 ELSE a::HUGEINT END::VARCHAR AS u, a AS back", u=_a.reinterpret(signed=False).cast("string"), back=_a.reinterpret(signed=False).reinterpret())
_scalar("cut_bins", "CASE WHEN b IS NULL THEN NULL WHEN b <= -1 THEN 'low' WHEN b <= 1 THEN 'mid' ELSE 'high' END AS bin, CASE WHEN b < -1 THEN '[-inf, -1)' WHEN b < 1 THEN '[-1, 1)' WHEN b IS NOT NULL THEN '[1, inf)' END AS lab", bin=_b.cut([-1, 1], ["low", "mid", "high"]), lab=_b.cut([-1, 1], left_closed=True))
_scalar("conditions", "CASE WHEN b > 0 THEN 'plus' WHEN b < 0 THEN 'minus' ELSE 'none' END AS s, CASE WHEN b > 1 THEN b END AS only", s=when(_b > 0).then(lit("plus")).when(_b < 0).then(lit("minus")).otherwise("none"), only=when(_b > 1).then(_b))
_scalar(
    "horizontal",
    """greatest(a, b, 2) AS high, least(a, b, 2) AS low, a + coalesce(b, 0) AS total, (a + coalesce(b, 0)) / (1 + (b IS NOT NULL)::INT) AS mean, (a > 0) OR (b > 0) AS some, (a > 0) AND (b > 0) AS every""",
    high=max_horizontal("a", "b", lit(2)), low=min_horizontal("a", "b", lit(2)), total=sum_horizontal("a", "b"), mean=mean_horizontal("a", "b"), some=any_horizontal(_a > 0, _b > 0), every=all_horizontal(_a > 0, _b > 0),
)
_scalar("folds", "10 + a + a * 2 AS total, a + a * 2 AS run2, a AS run1, a * 3 + 4 AS last", total=fold(10, lambda s, e: s + e, _a, (_a * 2).alias("a2")), run1=cum_reduce(lambda s, e: s + e, _a, (_a * 2).alias("a2")).struct.field("a"), run2=cum_reduce(lambda s, e: s + e, _a, (_a * 2).alias("a2")).struct.field("a2"), last=cum_sum_horizontal(_a, (_a * 2).alias("p"), lit(4).alias("q")).struct.field("q"))
_scalar("texts_of_columns", "a::VARCHAR || '-' || b::VARCHAR AS poisoned, concat_ws('-', a, b) AS skipped, 'a=' || a::VARCHAR || ', b=' || b::VARCHAR AS shaped", poisoned=concat_str("-", _a, _b), skipped=concat_str_ignore_nulls("-", _a, _b), shaped=format_("a={}, b={}", _a, _b))
_scalar("structs_and_lists", "a AS sa, array_to_string([a, a + 1], ',') AS l", sa=struct(_a, _b).struct.field("a"), l=concat_list(_a._map("x", lambda c: _array(c)), (_a + 1)._map("x", lambda c: _array(c))).cast("array<string>").list.join(","))
_scalar("repeated", "array_to_string(list_transform(range(abs(a)), lambda i: 7), ',') AS r, len(range(abs(a)))::DOUBLE AS n", r=repeat(7, _a.abs()).cast("array<string>").list.join(","), n=ones(_a.abs()).list.sum().fill_null_with(0.0))
_scalar("int_ranges", "array_to_string(range(a, a + 5, 2), ',') AS up, array_to_string(range(a, a - 3, -1), ',') AS down, array_to_string(range(a, a), ',') AS none", up=int_ranges(_a, _a + 5, 2).cast("array<string>").list.join(","), down=int_ranges(_a, _a - 3, -1).cast("array<string>").list.join(","), none=int_ranges(_a, _a).cast("array<string>").list.join(","))
_scalar("linear_spaces", "round(a + 0.0, 6)::DOUBLE AS first, round(a + 2.5, 6)::DOUBLE AS second, round(a + 10.0, 6)::DOUBLE AS last", first=linear_spaces(_a, _a + 10, lit(5)).list.get(0).round(6), second=linear_spaces(_a, _a + 10, lit(5)).list.get(1).round(6), last=linear_spaces(_a, _a + 10, lit(5)).list.get(-1).round(6))
_scalar("type_bounds", "-9223372036854775808 AS low, 9223372036854775807 AS high", low=_a.lower_bound(), high=_a.upper_bound())


def _array(c):
    from pyspark.sql import functions as F

    return F.array(c)


@query("error_function", None)
def error_function(spark, d):
    return _pairs(spark, d).select("id", (_a / 4.0).erf().alias("e"), (_a / 4.0).erfc().alias("c"))


@query("seeded_hash", "SELECT count(*) AS n, true AS differ FROM orders")
def seeded_hash(spark, d):
    f = _pairs(spark, d).select(_a.hash(1).alias("h"), _a.hash(2).alias("g"))
    return f.select(col("h").len().alias("n"), (col("h") != col("g")).all_true().alias("differ"))


@query("generate_integers", "SELECT i AS literal FROM range(5, 200, 3) t(i)")
def generate_integers(spark, d):
    return int_range(spark, 5, 200, 3)


@query("generate_even_spacing", "SELECT round(i * 0.25, 6)::DOUBLE AS x FROM range(0, 41) t(i)")
def generate_even_spacing(spark, d):
    return linear_space(spark, 0, 10, 41).select(col("literal").round(6).alias("x"))


@query("generate_days", "SELECT strftime(i, '%Y-%m-%d') AS day FROM generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-03-02', INTERVAL 1 DAY) t(i)")
def generate_days(spark, d):
    import datetime as dt

    return date_range(spark, dt.date(2024, 1, 30), dt.date(2024, 3, 2), "1d").select(col("literal").dt.strftime("%Y-%m-%d").alias("day"))


@query("generate_months", "SELECT epoch_us(i) AS at FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-01', INTERVAL 1 MONTH) t(i) WHERE i <> TIMESTAMP '2024-12-01'")
def generate_months(spark, d):
    import datetime as dt

    return date_range(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 1), "1mo", closed="left").select(col("literal").dt.epoch("us").alias("at"))


@query("generate_times", "SELECT i * 900000000 AS literal FROM range(0, 9) t(i)")
def generate_times(spark, d):
    return time_range(spark, 0, 7_200_000_000, "15m")
