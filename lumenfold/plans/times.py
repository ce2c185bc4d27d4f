"""Date and time functions."""

from __future__ import annotations

import datetime as dt

from lumenfold.functions.expr import col, lit
from lumenfold.functions.temporal import business_day_count, from_epoch, make_date, make_datetime, make_duration, make_time
from lumenfold.plans.registry import query
from lumenfold.plans.tables import scan

_ts, _d = col("ts"), col("o_orderdate")


def _events(name: str, sql: str, **exprs):
    @query(name, f"SELECT event_id, {sql} FROM events")
    def run(spark, d):
        return scan(spark, d, "events").select("event_id", *[e.alias(n) for n, e in exprs.items()])

    return run


def _orders(name: str, sql: str, **exprs):
    @query(name, f"SELECT o_orderkey, {sql} FROM orders")
    def run(spark, d):
        return scan(spark, d, "orders").select("o_orderkey", *[e.alias(n) for n, e in exprs.items()])

    return run


def _us(e):
    return e.dt.epoch("us")


_events("dt_components", "year(ts)::INTEGER AS y, month(ts)::INTEGER AS mo, day(ts)::INTEGER AS d, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, second(ts)::INTEGER AS s", y=_ts.dt.year(), mo=_ts.dt.month(), d=_ts.dt.day(), h=_ts.dt.hour(), mi=_ts.dt.minute(), s=_ts.dt.second())
_events("dt_subseconds", "(epoch_us(ts) % 1000000)::INTEGER AS us, (epoch_us(ts) % 1000000 // 1000)::INTEGER AS ms, (epoch_us(ts) % 1000000 * 1000)::INTEGER AS ns, round(epoch_us(ts) % 60000000 / 1e6, 6) AS frac", us=_ts.dt.microsecond(), ms=_ts.dt.millisecond(), ns=_ts.dt.nanosecond(), frac=_ts.dt.second_fractional().round(6))
_orders("dt_calendar", "isodow(o_orderdate)::INTEGER AS wd, dayofyear(o_orderdate)::INTEGER AS doy, quarter(o_orderdate)::INTEGER AS q, weekofyear(o_orderdate)::INTEGER AS wk, isoyear(o_orderdate)::INTEGER AS iy, century(o_orderdate)::INTEGER AS c, millennium(o_orderdate)::INTEGER AS m", wd=_d.dt.weekday(), doy=_d.dt.ordinal_day(), q=_d.dt.quarter(), wk=_d.dt.week(), iy=_d.dt.iso_year().cast("int"), c=_d.dt.century(), m=_d.dt.millennium())
_events("dt_split", "strftime(ts, '%Y-%m-%d') AS d, epoch_us(ts) % 86400000000 AS t, epoch_us(ts) AS both", d=_ts.dt.date().cast("string"), t=_ts.dt.time(), both=_us(_ts.dt.date().dt.combine(_ts.dt.time())))
_events("dt_epochs", "epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, (epoch_us(ts) // 86400000000)::INTEGER AS d", s=_ts.dt.epoch("s").cast("bigint"), ms=_ts.dt.epoch("ms").cast("bigint"), us=_us(_ts), d=_ts.dt.epoch("d"))
_events("dt_truncate", "epoch_us(date_trunc('hour', ts)) AS h, epoch_us(ts) // 900000000 * 900000000 AS q, epoch_us(date_trunc('week', ts)) AS w, epoch_us(date_trunc('month', ts)) AS m, epoch_us(date_trunc('quarter', ts)) AS qu, epoch_us(date_trunc('year', ts)) AS y", h=_us(_ts.dt.truncate("1h")), q=_us(_ts.dt.truncate("15m")), w=_us(_ts.dt.truncate("1w")), m=_us(_ts.dt.truncate("1mo")), qu=_us(_ts.dt.truncate("1q")), y=_us(_ts.dt.truncate("1y")))
_events("dt_round", "(epoch_us(ts) + 1800000000) // 3600000000 * 3600000000 AS h", h=_us(_ts.dt.round("1h")))
_orders("dt_offset", "epoch_us(o_orderdate + INTERVAL 1 MONTH) AS mo, epoch_us(o_orderdate - INTERVAL 2 YEAR) AS y, epoch_us(o_orderdate + INTERVAL 36 HOUR) AS h, epoch_us(o_orderdate + INTERVAL 14 DAY) AS w", mo=_us(_d.dt.offset_by("1mo")), y=_us(_d.dt.offset_by("-2y")), h=_us(_d.dt.offset_by("1d12h")), w=_us(_d.dt.offset_by("2w")))
_orders("dt_month_ends", "epoch_us(date_trunc('month', o_orderdate)) AS s, strftime(last_day(o_orderdate), '%Y-%m-%d') AS e, day(last_day(o_orderdate))::INTEGER AS n, day(last_day(make_date(year(o_orderdate), 2, 1))) = 29 AS leap", s=_us(_d.dt.month_start()), e=_d.dt.month_end().cast("date").cast("string"), n=_d.dt.days_in_month(), leap=_d.dt.is_leap_year())
_events("dt_format", "strftime(ts, '%Y/%m/%d %H:%M') AS a, strftime(ts, '%d %b %Y') AS b, strftime(ts, '%j') AS c", a=_ts.dt.strftime("%Y/%m/%d %H:%M"), b=_ts.dt.strftime("%d %b %Y"), c=_ts.dt.strftime("%j"))
_events("dt_durations", "(epoch_us(ts) - 1704067200000000) // 86400000000 AS d, (epoch_us(ts) - 1704067200000000) // 3600000000 AS h, (epoch_us(ts) - 1704067200000000) // 1000000 AS s, epoch_us(ts) - 1704067200000000 AS us, round((epoch_us(ts) - 1704067200000000) / 3600000000, 6) AS hf", **{n: getattr((_ts - lit(dt.datetime(2024, 1, 1))).dt, f"total_{u}")() for n, u in (("d", "days"), ("h", "hours"), ("s", "seconds"), ("us", "microseconds"))}, hf=(_ts - lit(dt.datetime(2024, 1, 1))).dt.total_hours_fractional().round(6))
_events("dt_zones", "epoch_us(ts + INTERVAL 9 HOUR) AS tokyo, epoch_us(ts - INTERVAL 9 HOUR) AS back, epoch_us(ts - INTERVAL 5 HOUR) AS ny", tokyo=_us(_ts.dt.convert_time_zone("Asia/Tokyo")), back=_us(_ts.dt.replace_time_zone("Asia/Tokyo")), ny=_us(_ts.dt.convert_time_zone("America/New_York")))
_events("dt_zone_offsets", "-18000 AS base, 0 AS dst", base=_ts.dt.base_utc_offset("America/New_York").cast("int"), dst=_ts.dt.dst_offset("America/New_York").cast("int"))
_orders("dt_replace", "epoch_us(make_timestamp(2020, month(o_orderdate), 1, 6, 30, 0)) AS t", t=_us(_d.dt.replace(year=2020, day=1, hour=6, minute=30)))
_orders("dt_make", "strftime(make_date(year(o_orderdate), month(o_orderdate), 1), '%Y-%m-%d') AS d, epoch_us(make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6)) AS t, 11045000000 AS tod", d=make_date(_d.dt.year(), _d.dt.month(), lit(1)).cast("string"), t=_us(make_datetime(_d.dt.year(), 2, 3, 4, 5, 6)), tod=make_time(3, 4, 5, 0))
_orders("dt_from_epoch", "epoch_us(make_timestamp((o_orderkey * 1000000)::BIGINT)) AS s, o_orderkey AS d", s=_us(from_epoch(col("o_orderkey"), "s")), d=from_epoch(col("o_orderkey"), "d").dt.epoch_days().cast("bigint"))
_orders("dt_make_duration", "(o_orderkey % 9) * 86400000000 + 7200000000 AS us", us=make_duration(col("o_orderkey") % 9, 2).dt.total_microseconds())
_orders("business_days", "isodow(o_orderdate) <= 5 AND o_orderdate <> TIMESTAMP '1996-01-01' AS works", works=_d.dt.is_business_day(holidays=["1996-01-01"]))
_orders(
    "business_day_counts",
    "len(list_filter(generate_series(date_trunc('month', o_orderdate), o_orderdate, INTERVAL 1 DAY), lambda x: x < o_orderdate AND isodow(x) <= 5))::INTEGER AS n",
    n=business_day_count(_d.dt.month_start(), _d),
)
_orders(
    "business_day_steps",
    """strftime(list_filter(generate_series(o_orderdate + INTERVAL 1 DAY, o_orderdate + INTERVAL 20 DAY, INTERVAL 1 DAY), lambda x: isodow(x) <= 5)[CASE WHEN isodow(o_orderdate) <= 5 THEN 3 ELSE 4 END], '%Y-%m-%d') AS d""",
    d=_d.dt.add_business_days(3, roll="forward").cast("string"),
)


@query("dt_ranges", "SELECT event_id, len(generate_series(date_trunc('day', ts), ts, INTERVAL 1 HOUR))::INTEGER AS n, 23 AS open FROM events")
def dt_ranges(spark, d):
    from lumenfold.functions.lists import datetime_ranges

    day = _ts.dt.truncate("1d")
    return scan(spark, d, "events").select("event_id", datetime_ranges(day, _ts, "1h").list.len().alias("n"), datetime_ranges(day, day.dt.offset_by("1d"), "1h", closed="none").list.len().alias("open"))


_SINCE, _AGO = _ts - lit(dt.datetime(2024, 1, 1)), "(epoch_us(ts) - 1704067200000000)"
_events(
    "dt_totals",
    f"{_AGO} // 60000000 AS m, {_AGO} // 1000 AS ms, {_AGO} * 1000 AS ns, " + ", ".join(f"round({_AGO} / {u} * 0.97, 5) AS {n}" for n, u in (("df", 86_400_000_000), ("mf", 60_000_000), ("sf", 1_000_000), ("msf", 1000), ("usf", 1))) + f", {_AGO} * 1000.0::DOUBLE AS nsf",
    m=_SINCE.dt.total_minutes(), ms=_SINCE.dt.total_milliseconds(), ns=_SINCE.dt.total_nanoseconds(), df=(_SINCE.dt.total_days_fractional() * 0.97).round(5), mf=(_SINCE.dt.total_minutes_fractional() * 0.97).round(5),
    sf=(_SINCE.dt.total_seconds_fractional() * 0.97).round(5), msf=(_SINCE.dt.total_milliseconds_fractional() * 0.97).round(5), usf=(_SINCE.dt.total_microseconds_fractional() * 0.97).round(5), nsf=_SINCE.dt.total_nanoseconds_fractional(),
)
_events("dt_text_and_units", "strftime(ts, '%Y-%m-%dT%H') AS a, epoch_us(ts) AS same, epoch_us(ts) // 1000 AS ms", a=_ts.dt.to_string("%Y-%m-%dT%H"), same=_us(_ts.dt.with_time_unit("ms").dt.cast_time_unit("us")), ms=_ts.dt.epoch("ms").cast("bigint"))
_events("str_parsed_times", "epoch_us(date_trunc('second', ts)) AS us", us=_us(_ts.dt.strftime("%Y-%m-%d %H:%M:%S").str.strptime("datetime", "%Y-%m-%d %H:%M:%S")))


@query("range_rows", "SELECT 'd' AS kind, 31 AS n UNION ALL SELECT 't', 24 UNION ALL SELECT 'c', 8 UNION ALL SELECT 'l', 5")
def range_rows(spark, d):
    """Rows of a range of days, of hours, of times of day, and of evenly spaced numbers."""
    from lumenfold.sources import io

    n = lambda f, kind: f.select(col(f.columns[0]).len().cast("int").alias("n")).select(lit(kind).alias("kind"), "n")
    days = io.date_range(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 31), "1d")
    hours = io.datetime_range(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "1h", closed="left")
    clock = io.time_range(spark, 0, 86_400_000_000, "3h", closed="left")
    return n(days, "d").concat(n(hours, "t"), n(clock, "c"), n(io.linear_space(spark, 0.0, 1.0, 5), "l"))


@query("range_lists", "SELECT o_orderkey, 2 AS two, 8 AS clocks, 3 AS zeros, 4.5::DOUBLE AS last FROM orders")
def range_lists(spark, d):
    from lumenfold.functions.lists import date_ranges, linear_spaces, time_ranges, zeros

    start = _d.cast("date")
    return scan(spark, d, "orders").select(
        "o_orderkey", date_ranges(start, _d.dt.offset_by("1d").dt.date(), "1d").list.len().alias("two"), time_ranges(lit(0), lit(86_400_000_000), "3h", closed="left").list.len().alias("clocks"),
        zeros(3).list.len().alias("zeros"), linear_spaces(lit(0.0), lit(4.5), 4).list.last().alias("last"),
    )
