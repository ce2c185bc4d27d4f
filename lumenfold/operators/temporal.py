"""Calendar intervals, and groups over windows of time."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.temporal import from_micros, micros_of

_UNITS = {"us": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_MONTHS = {"mo": 1, "q": 3, "y": 12}
#: Weeks begin on Mondays; the epoch was a Thursday.
_MONDAY = 4 * 86_400_000_000


@dataclass(frozen=True)
class Interval:
    """Months and microseconds, or a step of integers. ``weekly``: made of weeks only."""

    months: int = 0
    micros: int = 0
    steps: int = 0
    weekly: bool = False

    def times(self, k: int) -> Interval:
        return Interval(self.months * k, self.micros * k, self.steps * k, self.weekly)

    def sql(self) -> Column:
        if self.months and self.micros:
            raise ValueError("a step has months or a fixed span, not both")
        return F.make_ym_interval(F.lit(0), F.lit(self.months)) if self.months else F.make_dt_interval(secs=F.lit(self.micros / 1e6).cast("decimal(18,6)"))

    def at_least(self) -> int:
        """Microseconds that the interval has at least."""
        return self.months * 28 * _UNITS["d"] + self.micros


def parse(text) -> Interval:
    """``1mo``, ``-2w``, ``1d12h``, ``5i`` (integers); a number is a step of integers."""
    if isinstance(text, Interval):
        return text
    if isinstance(text, int):
        return Interval(steps=text)
    sign = -1 if text.startswith("-") else 1
    found = re.findall(r"(\d+)(us|ms|mo|[smhdwqyi])", text.lstrip("-"))
    if not found or "".join(n + u for n, u in found) != text.lstrip("-"):
        raise ValueError(f"{text!r} is no interval")
    months = sum(int(n) * _MONTHS.get(u, 0) for n, u in found)
    return Interval(months, sum(int(n) * _UNITS.get(u, 0) for n, u in found), sum(int(n) for n, u in found if u == "i"), {u for _, u in found} == {"w"}).times(sign)


def every(text: str) -> Interval:
    return parse(text)


def micros(period) -> int:
    """A fixed interval in microseconds, or a step of integers."""
    i = parse(period)
    if i.months:
        raise ValueError("a calendar interval has no fixed length")
    return i.steps or i.micros


def _floor(n: Column, k: int, shift: int = 0) -> Column:
    return n - F.pmod(n - shift, F.lit(k).cast("long"))


def floor_to(c: Column, span) -> Column:
    """Start of the grid cell: the epoch's grid, Mondays for weeks, the calendar's for months."""
    i = parse(span)
    if i.steps:
        return _floor(c, i.steps)
    if i.months:
        at = (F.year(c) - 1970) * 12 + F.month(c) - 1
        at = at - F.pmod(at, F.lit(i.months))
        return F.make_timestamp_ntz(F.floor(at / 12).cast("int") + 1970, F.pmod(at, F.lit(12)) + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return from_micros(_floor(micros_of(c), i.micros, _MONDAY if i.weekly else 0))


def offset(c: Column, by) -> Column:
    """A calendar move; the day stops at the month's end."""
    i = parse(by)
    if i.steps:
        return c + F.lit(i.steps)
    if i.months:
        c = c + F.make_ym_interval(F.lit(0), F.lit(i.months))
    return from_micros(micros_of(c) + F.lit(i.micros)) if i.micros else c


#: Windows that a row may be in up to which each is an expression of its own; above, they are made by one expression.
_UNROLLED = 6


def windows(df: DataFrame, index: str, step: Interval, period: Interval, shift: Interval, closed: str) -> DataFrame:
    """Each row once for each window that has it, with the window's start in ``__start``.

    A row's windows are found from the grid cell it is in, by stepping back; so there is no join by range. Where windows
    neither overlap nor leave gaps a row is in one, and isn't repeated.
    """
    t = F.col(index)
    last = offset(floor_to(offset(t, shift.times(-1)), step), shift)
    df = df.filter(t.isNotNull())
    if step == period and closed == "left" and (step.months or not shift.months):
        return df.withColumn("__start", last)
    size = lambda i: i.steps or i.at_least()
    n = math.ceil((period.steps or period.months * 31 * _UNITS["d"] + period.micros) / max(size(step), 1)) + 1
    inside = {
        "left": lambda s, e: (s <= t) & (t < e), "right": lambda s, e: (s < t) & (t <= e),
        "both": lambda s, e: (s <= t) & (t <= e), "none": lambda s, e: (s < t) & (t < e),
    }[closed]
    if n <= _UNROLLED:
        starts = [offset(last, step.times(-k)) for k in range(-1, n + 1)]
        held = F.array_compact(F.array(*[F.when(inside(s, offset(s, period)), s) for s in starts]))
    else:
        back = lambda k: _back(last, step, k)
        held = F.filter(F.transform(F.sequence(F.lit(-1), F.lit(n)), back), lambda s: inside(s, offset(s, period)))
    return df.withColumn("__start", F.explode(held))


def _back(c: Column, step: Interval, k: Column) -> Column:
    """``k`` steps back."""
    if step.steps:
        return c - k * F.lit(step.steps)
    if step.months:
        c = c - F.make_ym_interval(F.lit(0), k * F.lit(step.months))
    return from_micros(micros_of(c) - k.cast("long") * F.lit(step.micros)) if step.micros else c


def filled(out: DataFrame, none: DataFrame, by: list[str], step: Interval) -> DataFrame:
    """Aggregates by key and ``__start`` with the empty windows between each key's first and last; ``none``: the one row that aggregates of nothing make."""
    ends = out.groupBy(*by).agg(F.min("__start").alias("lo"), F.max("__start").alias("hi")).filter("lo is not null")
    one = F.lit(step.steps).cast("long") if step.steps else step.sql()
    names = [*by, "__start"]
    grid = ends.select(*[F.col(n).alias(f"__g_{n}") for n in by], F.explode(F.sequence("lo", "hi", one)).alias("__g___start"))
    on = F.lit(True)
    for n in names:
        on &= F.col(n).eqNullSafe(F.col(f"__g_{n}"))
    full = grid.join(out.withColumn("__full", F.lit(True)), on, "left")
    full = full.crossJoin(F.broadcast(none.select(*[F.col(c).alias(f"__n_{c}") for c in none.columns])))  # one row
    values = [F.when(F.col("__full"), F.col(c)).otherwise(F.col(f"__n_{c}")).alias(c) for c in none.columns]
    return full.select(*[F.col(f"__g_{n}").alias(n) for n in names], *values)


def dynamic(frame, index: str, step, period=None, shift="0s", closed="left", label="left", boundaries=False, by=()):
    """(rows by window, fill): what a dynamic group aggregates by ``by`` and ``__start``, and what makes its result of the
    aggregates: with the empty windows between full ones, and the windows' labels."""
    step = parse(step)
    period = parse(period) if period is not None else step
    shift = Interval() if shift in ("0s", None) else parse(shift)
    kind = frame.schema[index].dataType
    df = frame.df
    if isinstance(kind, (T.DateType, T.TimestampType)):
        df = df.withColumn(index, F.col(index).cast("timestamp_ntz"))
    elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        df = df.withColumn(index, F.col(index).cast("long"))

    def fill(out: DataFrame, none: DataFrame) -> DataFrame:
        out = filled(out, none, list(by), step)
        start, end = F.col("__start"), offset(F.col("__start"), period)
        keys = [F.col(n) for n in by]
        if boundaries:
            keys += [start.alias("_lower_boundary"), end.alias("_upper_boundary")]
        keys.append((start if label == "left" else end).alias(index))
        return out.select(*keys, *none.columns)

    return windows(df, index, step, period, shift, closed), fill


def upsample(df: DataFrame, time: str, step, by=()) -> DataFrame:
    """Rows for all missing instants of the grid from each group's first to its last instant."""
    by, i = list(by), parse(step)
    ends = df.groupBy(*by).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    one = F.lit(i.steps).cast("long") if i.steps else i.sql()
    g = ends.select(*by, F.explode(F.sequence("lo", "hi", one)).alias(time))
    return g.join(df, [*by, time], "left").select(*df.columns)


def rolling_window(index: Column, period, closed: str, by: list[Column]):
    """The window of rows within ``period`` before each row."""
    i = parse(period)
    if i.months:
        raise ValueError("use group_by_dynamic or a SQL frame for calendar periods")
    step = i.steps or i.micros
    lo = -step if closed in ("left", "both") else 1 - step
    hi = 0 if closed in ("right", "both") else -1
    return Window.partitionBy(*by).orderBy(index).rangeBetween(lo, hi)
