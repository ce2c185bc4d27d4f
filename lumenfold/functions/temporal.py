"""``expr.dt``: dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.expr import Expr, to_expr

_FORMATS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM",
    "a": "EEE", "A": "EEEE", "f": "SSSSSS", "z": "xx", "Z": "zzz", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "%": "%", "n": "\n", "t": "\t",
}


def java_format(fmt: str) -> str:
    """A strftime format as Spark's."""
    out, i, text = "", 0, ""
    while i < len(fmt):
        if fmt[i] == "%":
            if text:
                out, text = out + _literal(text), ""
            i += 1
            code = fmt[i]
            if code not in _FORMATS:
                raise ValueError(f"%{code} has no counterpart")
            out += _FORMATS[code]
        else:
            text += fmt[i]
        i += 1
    return out + (_literal(text) if text else "")


def _literal(s: str) -> str:
    return "".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else c for c in s)


def micros_of(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def interval_micros(c: Column) -> Column:
    """A day-time interval as microseconds."""
    part = lambda unit: F.extract(F.lit(unit), c).cast("decimal(20,6)" if unit == "SECOND" else "long")
    whole = ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60
    return (whole * 1_000_000).cast("long") + (part("SECOND") * 1_000_000).cast("long")


class Temporal:
    def __init__(self, e: Expr):
        self.e = e

    def _map(self, label, fn) -> Expr:
        return self.e._map(f"dt.{label}", fn)

    def _like(self, label, fn, *others) -> Expr:
        """A function that keeps a date a date."""

        def build(x, c, *o):
            out = fn(c.cast("timestamp_ntz"), *o)
            return out.cast("date") if isinstance(x.type_of(c), T.DateType) else out

        return self.e._f(f"dt.{label}", build, *others)

    def century(self) -> Expr:
        return self._map("century", lambda c: F.ceil(F.year(c) / 100).cast("int"))

    def millennium(self) -> Expr:
        return self._map("millennium", lambda c: F.ceil(F.year(c) / 1000).cast("int"))

    def weekday(self) -> Expr:
        """1 (Monday) to 7."""
        return self._map("weekday", lambda c: F.weekday(c) + 1)

    def iso_year(self) -> Expr:
        return self._map("iso_year", lambda c: F.extract(F.lit("YEAROFWEEK"), c))

    def microsecond(self) -> Expr:
        return self._map("microsecond", lambda c: F.pmod(micros_of(c), F.lit(1_000_000)).cast("int"))

    def millisecond(self) -> Expr:
        return self._map("millisecond", lambda c: F.floor(F.pmod(micros_of(c), F.lit(1_000_000)) / 1000).cast("int"))

    def nanosecond(self) -> Expr:
        return self._map("nanosecond", lambda c: (F.pmod(micros_of(c), F.lit(1_000_000)) * 1000).cast("int"))

    def second_fractional(self) -> Expr:
        return self._map("second_fractional", lambda c: F.pmod(micros_of(c), F.lit(60_000_000)) / 1e6)

    def date(self) -> Expr:
        return self._map("date", lambda c: c.cast("date"))

    def time(self) -> Expr:
        """Microseconds since midnight."""
        return self._map("time", lambda c: F.pmod(micros_of(c), F.lit(86_400_000_000)))

    def combine(self, time) -> Expr:
        return self.e._f("dt.combine", lambda _, d, t: from_micros(micros_of(d.cast("date").cast("timestamp_ntz")) + t), time)

    def epoch(self, unit: str = "us") -> Expr:
        f = {"s": 1_000_000, "ms": 1000, "us": 1}
        if unit == "d":
            return self.epoch_days()
        if unit == "ns":
            return self._map("epoch", lambda c: micros_of(c) * 1000)
        return self._map("epoch", lambda c: F.floor(micros_of(c) / f[unit]) if unit != "us" else micros_of(c))

    epoch_in = timestamp = epoch

    def epoch_days(self) -> Expr:
        return self._map("epoch_days", lambda c: F.unix_date(c.cast("date")))

    def truncate(self, every) -> Expr:
        from lumenfold.operators.temporal import floor_to

        return self._like("truncate", lambda c: floor_to(c, every))

    def round(self, every) -> Expr:
        """To the nearer end of the grid cell; halfway goes up."""
        from lumenfold.operators.temporal import floor_to, offset

        def fn(c):
            lo = floor_to(c, every)
            hi = offset(lo, every)
            return F.when(micros_of(c) - micros_of(lo) < micros_of(hi) - micros_of(c), lo).otherwise(hi)

        return self._like("round", fn)

    def offset_by(self, by) -> Expr:
        from lumenfold.operators.temporal import offset

        return self._like("offset_by", lambda c: offset(c, by))

    def month_start(self) -> Expr:
        return self._like("month_start", lambda c: from_micros(micros_of(F.trunc(c, "MM").cast("timestamp_ntz")) + F.pmod(micros_of(c), F.lit(86_400_000_000))))

    def month_end(self) -> Expr:
        return self._like("month_end", lambda c: from_micros(micros_of(F.last_day(c).cast("timestamp_ntz")) + F.pmod(micros_of(c), F.lit(86_400_000_000))))

    def is_leap_year(self) -> Expr:
        return self._map("is_leap_year", lambda c: ((F.year(c) % 4 == 0) & (F.year(c) % 100 != 0)) | (F.year(c) % 400 == 0))

    def days_in_month(self) -> Expr:
        return self._map("days_in_month", lambda c: F.day(F.last_day(c)))

    def _total(self, unit: int, fractional: bool) -> Expr:
        def fn(c):
            n = interval_micros(c)
            if unit == 0:
                return n.cast("double") * 1000 if fractional else n * 1000
            return n / unit if fractional else (n.cast("decimal(20,0)") / unit).cast("long")

        return self._map("total", fn)

    def with_time_unit(self, unit: str) -> Expr:
        """Spark has microseconds only; the unit is a note to readers of the schema."""
        return self.e

    cast_time_unit = with_time_unit

    def base_utc_offset(self, zone: str) -> Expr:
        return self._zone("base_utc_offset", zone, lambda t: t.utcoffset() - (t.dst() or t.utcoffset() * 0))

    def dst_offset(self, zone: str) -> Expr:
        return self._zone("dst_offset", zone, lambda t: t.dst())

    def _zone(self, label, zone, pick) -> Expr:
        from zoneinfo import ZoneInfo

        return self.e.map_elements(lambda v: int(pick(v.to_pydatetime().replace(tzinfo=ZoneInfo(zone))).total_seconds()), "long")

    def to_string(self, fmt: str | None = None) -> Expr:
        return self.strftime(fmt) if fmt else self._map("to_string", lambda c: c.cast("string"))

    def strftime(self, fmt: str) -> Expr:
        java = java_format(fmt)
        return self._map("strftime", lambda c: F.date_format(c, java))

    def convert_time_zone(self, zone: str, source: str = "UTC") -> Expr:
        """The same instant on another clock."""
        return self._map("convert_time_zone", lambda c: F.convert_timezone(F.lit(source), F.lit(zone), c.cast("timestamp_ntz")))

    def replace_time_zone(self, zone: str, ambiguous: str = "earliest", non_existent: str = "raise") -> Expr:
        """The same clock in another zone, as an instant on the UTC clock. A time that the zone skips is an error or null."""

        def fn(c):
            utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), c.cast("timestamp_ntz"))
            back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
            bad = F.raise_error(F.lit("the zone skips this time")).cast("timestamp_ntz") if non_existent == "raise" else F.lit(None).cast("timestamp_ntz")
            if ambiguous == "latest":
                later = utc + F.expr("INTERVAL 1 HOUR")
                utc = F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), later) == c, later).otherwise(utc)
            return F.when(c.isNull() | (back == c), utc).otherwise(bad)

        return self._map("replace_time_zone", fn)

    def replace(self, year=None, month=None, day=None, hour=None, minute=None, second=None, microsecond=None) -> Expr:
        parts = (year, month, day, hour, minute, second)
        gets = (F.year, F.month, F.day, F.hour, F.minute, F.second)

        def fn(c):
            v = [F.lit(p) if p is not None else g(c) for p, g in zip(parts, gets, strict=True)]
            us = F.lit(microsecond) if microsecond is not None else F.pmod(micros_of(c), F.lit(1_000_000))
            return from_micros(micros_of(F.make_timestamp_ntz(*v)) + us)

        return self._like("replace", fn)

    def is_business_day(self, weekmask=(1, 1, 1, 1, 1, 0, 0), holidays=()) -> Expr:
        return self._map("is_business_day", lambda c: _business(c, weekmask, holidays))

    def add_business_days(self, n, roll: str = "raise", weekmask=(1, 1, 1, 1, 1, 0, 0), holidays=()) -> Expr:
        """Step over business days; a start that isn't one rolls forward or backward, or is an error."""

        def fn(c, k):
            bad = F.raise_error(F.lit("not a business day")).cast("date")
            near = F.sequence(F.lit(0), F.lit(30 + len(holidays)))
            day = lambda i: F.date_add(c.cast("date"), i)
            ahead = F.array_min(F.filter(F.transform(near, day), lambda d: _business(d, weekmask, holidays)))
            back = F.array_max(F.filter(F.transform(near, lambda i: day(-i)), lambda d: _business(d, weekmask, holidays)))
            start = F.when(_business(c, weekmask, holidays), c.cast("date")).otherwise({"forward": ahead, "backward": back, "raise": bad}[roll])
            reach = (F.abs(k) * 7 / sum(weekmask)).cast("int") + 14 + len(holidays)
            days = F.filter(F.transform(F.sequence(F.lit(1), reach), lambda i: F.date_add(start, (F.signum(k) * i).cast("int"))), lambda d: _business(d, weekmask, holidays))
            return F.when(k == 0, start).otherwise(F.get(days, (F.abs(k) - 1).cast("int")))

        return self.e._f("dt.add_business_days", lambda _, c, k: fn(c, k), n)


for _n, _f in {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second, "ordinal_day": F.dayofyear, "quarter": F.quarter, "week": F.weekofyear}.items():
    setattr(Temporal, _n, (lambda n, f: lambda self: self._map(n, f))(_n, _f))
for _n, _u in {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000, "milliseconds": 1000, "microseconds": 1, "nanoseconds": 0}.items():
    setattr(Temporal, f"total_{_n}", (lambda u: lambda self: self._total(u, False))(_u))
    setattr(Temporal, f"total_{_n}_fractional", (lambda u: lambda self: self._total(u, True))(_u))


def _business(c: Column, weekmask, holidays) -> Column:
    ok = F.get(F.array(*[F.lit(bool(d)) for d in weekmask]), F.weekday(c))
    return ok & ~c.cast("date").isin([F.to_date(F.lit(str(h))) for h in holidays]) if holidays else ok


def business_day_count(start, end, weekmask=(1, 1, 1, 1, 1, 0, 0), holidays=()) -> Expr:
    """Business days from start (included) to end (excluded); negative where end is before start."""

    def fn(_, a, b):
        a, b = a.cast("date"), b.cast("date")
        lo, hi = F.least(a, b), F.greatest(a, b)
        days = F.filter(F.sequence(lo, hi), lambda d: (d < hi) & _business(d, weekmask, holidays))
        return F.when(a <= b, F.size(days)).otherwise(-F.size(days))

    return to_expr(start)._f("business_day_count", fn, end)


def make_date(year, month, day) -> Expr:
    return to_expr(year)._f("make_date", lambda _, *c: F.make_date(*[v.cast("int") for v in c]), month, day)


def make_datetime(year, month, day, hour=0, minute=0, second=0, microsecond=0) -> Expr:
    def fn(_, *c):
        return from_micros(micros_of(F.make_timestamp_ntz(*[v.cast("int") for v in c[:6]])) + c[6])

    return to_expr(year)._f("make_datetime", fn, month, day, hour, minute, second, microsecond)


def make_time(hour=0, minute=0, second=0, microsecond=0) -> Expr:
    """Microseconds since midnight."""
    return to_expr(hour)._f("make_time", lambda _, h, m, s, u: ((h * 60 + m) * 60 + s) * 1_000_000 + u, minute, second, microsecond)


def make_duration(days=0, hours=0, minutes=0, seconds=0) -> Expr:
    return to_expr(days)._f("make_duration", lambda _, d, h, m, s: F.make_dt_interval(*[v.cast("int") for v in (d, h, m)], s.cast("decimal(18,6)")), hours, minutes, seconds)


def from_epoch(e, unit: str = "s") -> Expr:
    if unit == "d":
        return to_expr(e)._map("from_epoch", lambda c: F.date_from_unix_date(c.cast("int")))
    scale = {"s": 1_000_000, "ms": 1000, "us": 1}[unit]
    return to_expr(e)._map("from_epoch", lambda c: from_micros(c.cast("long") * scale))
