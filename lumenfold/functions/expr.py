"""Expressions: a thin tree over Spark columns.

An expression knows its inputs, its output name and how to become a Column for a given frame. The tree exists for what
Spark columns can't do: expand to many columns, keep a name through a chain, place aggregates over partitions, and run a
body over list elements. Everything else is Spark's.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hidden column that numbers rows in their order.
ROW = "__row"
INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Ctx:
    """Where an expression is compiled: the frame, the partition and order of windows, a group, a list element."""

    df: DataFrame
    part: tuple[Column, ...] = ()
    order: tuple[Column, ...] | None = None
    windowed: bool = False
    grouped: bool = False
    element: Column | None = None
    stages: list = field(default_factory=list)
    frame: object = None
    place: object = None
    shared: dict = field(default_factory=dict)

    def staged(self) -> DataFrame:
        """The frame with the columns that had to be computed first."""
        return functools.reduce(lambda d, s: d.withColumn(*s), self.stages, self.df)

    def stage(self, c: Column, key=None) -> Column:
        """Compute a column one projection earlier: windows can't be nested in one. Those of one ``key`` are computed once."""
        if key is not None and key in self.shared:
            return F.col(self.shared[key])
        name = f"__w{len(self.stages)}"
        self.stages.append((name, c))
        if key is not None:
            self.shared[key] = name
        return F.col(name)

    def type_of(self, c: Column) -> T.DataType | None:
        """The column's type; plain columns and literals carry theirs, so that most questions need no analysis."""
        if self.element is not None:
            return None
        known = c.__dict__.get("_known")
        if known is not None:
            return known
        return self.staged().select(c).schema[0].dataType

    def agg(self, c: Column) -> Column:
        """An aggregate as it is, over each row's own frame, or over the whole partition."""
        if self.frame is not None:
            return c.over(self.frame)
        return c.over(Window.partitionBy(*self.part)) if self.windowed else c

    def n_rows(self) -> Column:
        return self.agg(F.count(F.lit(1)))

    def keys(self) -> tuple[Column, ...]:
        return self.order if self.order is not None else (F.col(ROW),)

    def ordered(self):
        return Window.partitionBy(*self.part).orderBy(*self.keys())

    def rows(self, lo: int, hi: int):
        return self.ordered().rowsBetween(lo, hi)

    def onward(self, order=None):
        """Each row and those after it, as a frame that runs from the partition's end. One that runs from the row to the end
        is folded anew for each row, which takes the square of the partition."""
        w = self.ordered() if order is None else Window.partitionBy(*self.part).orderBy(*order)
        at = F.col(ROW) if order is None and self.order is None else self.stage(F.row_number().over(w))
        return Window.partitionBy(*self.part).orderBy(at.desc()).rowsBetween(_START, 0)


#: Inside Expr, ``str`` is a namespace.
_STR = str

#: Kinds of expressions that are windows.
_OVER = ("window", "spread", "over")
_START, _END = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True, eq=False)
class Expr:
    """An expression. ``fn`` makes the column out of the context and the inputs' columns."""

    fn: Callable
    kids: tuple = ()
    label: str = ""
    kind: str = "scalar"
    out: str | None = None
    renames: tuple = field(default=())

    # -- building ------------------------------------------------------------------------------------------------
    def compile(self, ctx: Ctx) -> Column:
        cols = []
        for k in self.kids:
            c = k.compile(ctx)
            over = self.kind in _OVER or self.kind in ("agg", "rowagg")
            cols.append(ctx.stage(c) if over and k.has(*_OVER) else c)
        if self.kind == "spread" and not ctx.windowed:
            ctx = replace(ctx, windowed=True)
        return self.fn(ctx, *cols)

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()

    def has(self, *kinds: str) -> bool:
        return any(e.kind in kinds for e in self.walk())

    def name_of(self) -> str:
        """The output name: the alias, or the leftmost column's, then the renames."""
        n = self.out
        if n is None:
            n = next((k.name_of() for k in self.kids), "literal")
        for r in self.renames:
            n = r(n)
        return n

    def expand(self, schema: T.StructType) -> list[Expr]:
        """One expression for each column that multi-column references stand for."""
        found = [e for e in self.walk() if e.kind == "match"]
        if not found:
            return [self]
        names = found[0].fn(schema)
        return [self._put(lambda e, n=n: col(n) if e.kind == "match" else None) for n in names]

    def _put(self, swap) -> Expr:
        new = swap(self)
        if new is not None:
            return replace(new, renames=new.renames + self.renames)
        return replace(self, kids=tuple(k._put(swap) for k in self.kids)) if self.kids else self

    def _f(self, label: str, fn, *others, kind: str = "scalar") -> Expr:
        return Expr(fn, (self, *map(to_expr, others)), label, kind)

    def _by(self, label: str, fn, by, kind: str) -> Expr:
        """A function of another column too, which a text names."""
        return Expr(fn, (self, col(by) if isinstance(by, _STR) else to_expr(by)), label, kind)

    def _map(self, label: str, fn: Callable[[Column], Column]) -> Expr:
        return self._f(label, lambda _, c: fn(c))

    def _agg(self, label: str, fn, *others) -> Expr:
        return self._f(label, lambda x, *c: fn(x, *c), *others, kind="agg")

    def _win(self, label: str, fn, *others) -> Expr:
        return self._f(label, fn, *others, kind="window")

    # -- names ---------------------------------------------------------------------------------------------------
    def alias(self, name: str) -> Expr:
        return replace(self, out=name, renames=())

    def map_name(self, fn: Callable[[str], str]) -> Expr:
        return replace(self, renames=(*self.renames, fn))

    def prefix(self, p: str) -> Expr:
        return self.map_name(lambda n: p + n)

    def suffix(self, s: str) -> Expr:
        return self.map_name(lambda n: n + s)

    def pipe(self, fn: Callable[[Expr], Expr]) -> Expr:
        return fn(self)

    @property
    def name(self):
        from lumenfold.functions.names import Names

        return Names(self)

    @property
    def meta(self):
        from lumenfold.functions.names import Meta

        return Meta(self)

    @property
    def str(self):
        from lumenfold.functions.strings import Strings

        return Strings(self)

    @property
    def dt(self):
        from lumenfold.functions.temporal import Temporal

        return Temporal(self)

    @property
    def list(self):
        from lumenfold.functions.lists import Lists

        return Lists(self)

    @property
    def arr(self):
        from lumenfold.functions.lists import Arrays

        return Arrays(self)

    @property
    def struct(self):
        from lumenfold.functions.nested import Structs

        return Structs(self)

    @property
    def bin(self):
        from lumenfold.functions.nested import Binaries

        return Binaries(self)

    @property
    def cat(self):
        from lumenfold.functions.nested import Categories

        return Categories(self)

    def __str__(self) -> str:
        inner = ", ".join(map(str, self.kids))
        return f"{self.label}({inner})" if self.kids else self.label

    # -- arithmetic ----------------------------------------------------------------------------------------------
    def add(self, v) -> Expr:
        return self._f("add", lambda _, a, b: a + b, v)

    def sub(self, v) -> Expr:
        return self._f("sub", lambda _, a, b: a - b, v)

    def mul(self, v) -> Expr:
        return self._f("mul", lambda _, a, b: a * b, v)

    def div(self, v) -> Expr:
        """Float division; by zero it gives an infinity or NaN, and null where a side is null."""

        def fn(_, a, b):
            a, b = a.cast("double"), b.cast("double")
            inf = F.when(a > 0, math.inf).when(a < 0, -math.inf).when(a == 0, math.nan)
            return F.when(b == 0, F.when(F.isnan(a), math.nan).otherwise(inf)).otherwise(a / F.nullif(b, F.lit(0.0)))

        return self._f("div", fn, v)

    true_div = div

    def trunc_div(self, v) -> Expr:
        """Quotient toward zero; an integer by zero gives null."""
        return self._f("trunc_div", lambda x, a, b: _quotient(x, a, b, F.try_divide, toward_zero=True), v)

    def floor_div(self, v) -> Expr:
        """Quotient toward minus infinity; an integer by zero gives null."""
        return self._f("floor_div", lambda x, a, b: _quotient(x, a, b, F.try_divide, toward_zero=False), v)

    def mod(self, v) -> Expr:
        """Remainder with the divisor's sign; an integer by zero gives null."""

        def fn(_, a, b):
            b = F.nullif(b, F.lit(0))
            return ((a % b) + b) % b

        return self._f("mod", fn, v)

    def pow(self, v) -> Expr:
        return self._f("pow", lambda _, a, b: F.pow(a, b), v)

    def neg(self) -> Expr:
        return self._map("neg", lambda c: -c)

    def abs(self) -> Expr:
        return self._map("abs", F.abs)

    def sign(self) -> Expr:
        return self._f("sign", lambda x, c: F.signum(c).cast(x.type_of(c) or T.DoubleType()))

    def eq(self, v) -> Expr:
        return self._f("eq", _compare("eq"), v)

    def ne(self, v) -> Expr:
        return self._f("ne", _compare("ne"), v)

    def lt(self, v) -> Expr:
        return self._f("lt", _compare("lt"), v)

    def le(self, v) -> Expr:
        return self._f("le", _compare("le"), v)

    def gt(self, v) -> Expr:
        return self._f("gt", _compare("gt"), v)

    def ge(self, v) -> Expr:
        return self._f("ge", _compare("ge"), v)

    def eq_missing(self, v) -> Expr:
        return self._f("eq_missing", lambda _, a, b: a.eqNullSafe(b), v)

    def ne_missing(self, v) -> Expr:
        return self._f("ne_missing", lambda _, a, b: ~a.eqNullSafe(b), v)

    def and_(self, v) -> Expr:
        return self._f("and", lambda x, a, b: _known(a & b, T.BooleanType()) if _boolean(x, a) else a.bitwiseAND(b), v)

    def or_(self, v) -> Expr:
        return self._f("or", lambda x, a, b: _known(a | b, T.BooleanType()) if _boolean(x, a) else a.bitwiseOR(b), v)

    def xor(self, v) -> Expr:
        return self._f("xor", lambda x, a, b: _known(a != b, T.BooleanType()) if _boolean(x, a) else a.bitwiseXOR(b), v)

    def not_(self) -> Expr:
        return self._f("not", lambda x, a: _known(~a, T.BooleanType()) if _boolean(x, a) else F.bitwise_not(a))

    __add__, __sub__, __mul__, __truediv__, __floordiv__, __mod__, __pow__ = add, sub, mul, div, floor_div, mod, pow
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = eq, ne, lt, le, gt, ge
    __and__, __or__, __xor__, __invert__, __neg__ = and_, or_, xor, not_, neg
    __hash__ = object.__hash__

    def __radd__(self, v):
        return to_expr(v) + self

    def __rsub__(self, v):
        return to_expr(v) - self

    def __rmul__(self, v):
        return to_expr(v) * self

    def __rtruediv__(self, v):
        return to_expr(v) / self

    def is_between(self, lo, hi, closed: str = "both") -> Expr:
        a = self >= lo if closed in ("both", "left") else self > lo
        b = self <= hi if closed in ("both", "right") else self < hi
        return a & b

    def is_in(self, values) -> Expr:
        if isinstance(values, Expr):
            return self._f("is_in", lambda _, a, b: F.array_contains(b, a), values)
        return self._map("is_in", lambda c: _known(c.isin(list(values)), T.BooleanType()))

    def is_null(self) -> Expr:
        return self._map("is_null", lambda c: _known(c.isNull(), T.BooleanType()))

    def is_not_null(self) -> Expr:
        return self._map("is_not_null", lambda c: _known(c.isNotNull(), T.BooleanType()))

    def is_nan(self) -> Expr:
        return self._map("is_nan", lambda c: F.when(c.isNotNull(), F.isnan(c)))

    def is_not_nan(self) -> Expr:
        return self._map("is_not_nan", lambda c: F.when(c.isNotNull(), ~F.isnan(c)))

    def is_finite(self) -> Expr:
        return self._map("is_finite", lambda c: F.when(c.isNotNull(), ~F.isnan(c) & (F.abs(c) != math.inf)))

    def is_infinite(self) -> Expr:
        return self._map("is_infinite", lambda c: F.when(c.isNotNull(), F.abs(c) == math.inf))

    def is_close(self, other, rel_tol: float = 1e-9, abs_tol: float = 0.0) -> Expr:
        def fn(_, a, b):
            near = F.abs(a - b) <= F.greatest(rel_tol * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
            odd = F.isnan(a) | F.isnan(b) | (F.abs(a) == math.inf) | (F.abs(b) == math.inf)
            return F.when(a.isNull() | b.isNull(), None).when(odd, (a == b) & ~F.isnan(a)).otherwise(near)

        return self._f("is_close", fn, other)

    # -- maths ---------------------------------------------------------------------------------------------------
    def ln(self) -> Expr:
        return self._map("ln", lambda c: _log(c, F.log))

    def log10(self) -> Expr:
        return self._map("log10", lambda c: _log(c, F.log10))

    def log1p(self) -> Expr:
        return self._map("log1p", lambda c: F.when(c == -1, -math.inf).when(c < -1, math.nan).otherwise(F.log1p(c)))

    def log(self, base: float = math.e) -> Expr:
        return self._map("log", lambda c: _log(c, F.log) / math.log(base))

    def arctan2(self, x) -> Expr:
        return self._f("arctan2", lambda _, a, b: F.atan2(a, b), x)

    def erf(self) -> Expr:
        return self._map("erf", _erf("erf"))

    def erfc(self) -> Expr:
        return self._map("erfc", _erf("erfc"))

    def round(self, decimals: int = 0, mode: str = "half_away_from_zero") -> Expr:
        """Floats are scaled, rounded to a whole number and scaled back, so what the scaling makes a tie is one; a float too
        large to be scaled is its own rounding."""
        nearest = F.bround if mode == "half_to_even" else F.round
        once = let if self.has(*_OVER) else lambda c, fn: fn(c)  # a window that stands twice is computed twice

        def fn(x, c):
            if not 0 < decimals <= 22 or not isinstance(x.type_of(c), FLOATS):
                return nearest(c, decimals)
            scale, kind = 10.0**decimals, x.type_of(c)
            scaled = lambda v: nearest(v.cast("double") * scale, 0) / scale
            return once(c, lambda v: F.when(F.abs(scaled(v)) < math.inf, scaled(v)).otherwise(v)).cast(kind)

        return self._f("round", fn)

    def truncate(self, decimals: int = 0) -> Expr:
        s = 10.0**decimals
        return self._map("truncate", lambda c: F.signum(c) * F.floor(F.abs(c) * s) / s)

    def round_sig_figs(self, digits: int) -> Expr:
        def fn(c):
            scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.nullif(F.abs(c.cast("double")), F.lit(0.0)))))
            return F.when(c == 0, 0.0).otherwise(F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale)

        return self._map("round_sig_figs", fn)

    def _bits(self, label: str, pick) -> Expr:
        def fn(x, c):
            width = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(x.type_of(c)), 64)
            text = F.substring(F.lpad(F.bin(c.cast("long")), 64, "0"), 65 - width, width)
            return pick(text).cast("int")

        return self._f(label, fn)

    def bitwise_count_ones(self) -> Expr:
        return self._bits("bitwise_count_ones", lambda t: F.char_length(F.replace(t, F.lit("0"), F.lit(""))))

    def bitwise_count_zeros(self) -> Expr:
        return self._bits("bitwise_count_zeros", lambda t: F.char_length(F.replace(t, F.lit("1"), F.lit(""))))

    def bitwise_leading_ones(self) -> Expr:
        return self._bits("bitwise_leading_ones", lambda t: F.char_length(F.regexp_extract(t, "^1*", 0)))

    def bitwise_leading_zeros(self) -> Expr:
        return self._bits("bitwise_leading_zeros", lambda t: F.char_length(F.regexp_extract(t, "^0*", 0)))

    def bitwise_trailing_ones(self) -> Expr:
        return self._bits("bitwise_trailing_ones", lambda t: F.char_length(F.regexp_extract(t, "1*$", 0)))

    def bitwise_trailing_zeros(self) -> Expr:
        return self._bits("bitwise_trailing_zeros", lambda t: F.char_length(F.regexp_extract(t, "0*$", 0)))

    def clip(self, lo=None, hi=None) -> Expr:
        def fn(_, c, *b):
            b = list(b)
            low = b.pop(0) if lo is not None else None
            high = b.pop(0) if hi is not None else None
            out = c if low is None else F.when(c < low, low).otherwise(c)
            return out if high is None else F.when(c > high, high).otherwise(out)

        return self._f("clip", fn, *[v for v in (lo, hi) if v is not None])

    def clip_lower(self, lo) -> Expr:
        return self.clip(lo=lo)

    def clip_upper(self, hi) -> Expr:
        return self.clip(hi=hi)

    def fill_null_with(self, v) -> Expr:
        return self._f("fill_null_with", lambda _, a, b: F.coalesce(a, b), v)

    def fill_nan(self, v) -> Expr:
        return self._f("fill_nan", lambda _, a, b: F.when(F.isnan(a), b).otherwise(a), v)

    def replace(self, old: list, new: list) -> Expr:
        return self._replace("replace", old, new, lambda c: c)

    def replace_or(self, old: list, new: list, default) -> Expr:
        return self._replace("replace_or", old, new, lambda c: F.lit(default))

    def replace_strict(self, old: list, new: list) -> Expr:
        miss = lambda c: F.raise_error(F.concat(F.lit("no replacement for "), F.coalesce(c.cast("string"), F.lit("null"))))
        return self._replace("replace_strict", old, new, miss)

    def _replace(self, label, old, new, miss) -> Expr:
        def fn(c):
            out = F
            for a, b in zip(old, new, strict=True):
                out = out.when(c.eqNullSafe(F.lit(a)), F.lit(b))
            return out.otherwise(miss(c))

        return self._map(label, fn)

    def cast(self, to) -> Expr:
        """Strict: fails where the value doesn't fit; a float with a fraction isn't an integer."""

        def fn(x, c):
            kind = x.type_of(c)
            if _is_int(to) and isinstance(kind, FLOATS):
                bad = F.raise_error(F.concat(F.lit("inexact cast of "), c.cast("string")))
                return F.when(c.isNull() | (c == F.floor(c)), c).otherwise(bad.cast("double")).cast(to)
            return c.cast(to)

        return self._f(f"cast[{to}]", fn)

    def cast_lossy(self, to) -> Expr:
        """Null where the value doesn't fit."""

        def fn(x, c):
            if _is_int(to) and isinstance(x.type_of(c), FLOATS):
                c = F.when(c == F.floor(c), c)
            return c.try_cast(to)

        return self._f(f"cast_lossy[{to}]", fn)

    def to_physical(self) -> Expr:
        def fn(x, c):
            kind = x.type_of(c)
            if isinstance(kind, T.DateType):
                return F.unix_date(c)
            return F.unix_micros(c.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c

        return self._f("to_physical", fn)

    def reinterpret(self, signed: bool = True) -> Expr:
        """The same 64 bits as a signed long, or as an unsigned number (a decimal)."""

        def fn(c):
            two = F.lit("18446744073709551616").cast("decimal(38,0)")
            d = c.cast("decimal(38,0)")
            if signed:
                return F.when(d >= two / 2, d - two).otherwise(d).cast("long")
            return F.when(d < 0, d + two).otherwise(d)

        return self._map("reinterpret", fn)

    def hash(self, seed: int = 0) -> Expr:
        return self._map("hash", lambda c: F.xxhash64(F.lit(seed), c))

    def cut(self, breaks: list[float], labels: list[str] | None = None, left_closed: bool = False) -> Expr:
        labels = labels or cut_labels(breaks, left_closed)

        def fn(c):
            out = F.when(c.isNull(), F.lit(None).cast("string"))
            for b, name in zip(breaks, labels, strict=False):
                out = out.when(c < b if left_closed else c <= b, name)
            return out.otherwise(labels[-1])

        return self._map("cut", fn)

    def qcut(self, quantiles: list[float] | int, labels: list[str] | None = None, left_closed: bool = False) -> Expr:
        """Bins by the frame's (or partition's) own quantiles; a number makes so many equal parts."""
        qs = [i / quantiles for i in range(1, quantiles)] if isinstance(quantiles, int) else quantiles

        def fn(x, c):
            edges = x.agg(F.percentile(c, F.array(*[F.lit(float(q)) for q in qs])))
            names = labels or [str(i) for i in range(len(qs) + 1)]
            out = F.when(c.isNull(), F.lit(None).cast("string"))
            for i, name in enumerate(names[:-1]):
                out = out.when(c < edges[i] if left_closed else c <= edges[i], name)
            return out.otherwise(names[-1])

        return self._f("qcut", fn, kind="spread")

    # -- aggregates ----------------------------------------------------------------------------------------------
    def sum(self) -> Expr:
        """Exact for integers (decimal); null where there is nothing to add."""

        def fn(x, c):
            kind = x.type_of(c)
            if isinstance(kind, (*INTS, T.BooleanType)):
                c = c.cast("int").cast("decimal(38,0)") if isinstance(kind, T.BooleanType) else c.cast("decimal(38,0)")
            return x.agg(F.sum(c))

        return self._agg("sum", fn)

    def mean(self) -> Expr:
        return self._agg("mean", lambda x, c: x.agg(F.avg(c)))

    def min(self) -> Expr:
        """NaN is greatest, so it is the minimum only where there is nothing else."""
        return self._agg("min", lambda x, c: x.agg(F.min(c)))

    def max(self) -> Expr:
        return self._agg("max", lambda x, c: x.agg(F.max(c)))

    def nan_min(self) -> Expr:
        return self._agg("nan_min", lambda x, c: F.when(x.agg(F.max(F.isnan(c))), math.nan).otherwise(x.agg(F.min(c))))

    def nan_max(self) -> Expr:
        return self._agg("nan_max", lambda x, c: x.agg(F.max(c)))

    def count(self) -> Expr:
        return self._agg("count", lambda x, c: x.agg(F.count(c)))

    def len(self) -> Expr:
        return self._agg("len", lambda x, c: x.n_rows())

    def null_count(self) -> Expr:
        return self._agg("null_count", lambda x, c: x.n_rows() - x.agg(F.count(c)))

    def has_nulls(self) -> Expr:
        return self._agg("has_nulls", lambda x, c: x.agg(F.count_if(c.isNull())) > 0)

    def is_empty(self) -> Expr:
        return self._agg("is_empty", lambda x, c: x.agg(F.count(F.lit(1))) == 0)

    def n_unique(self) -> Expr:
        """Distinct values, null aside; exact."""

        def fn(x, c):
            return F.size(x.agg(F.collect_set(c))).cast("long") if x.windowed else F.count_distinct(c)

        return self._agg("n_unique", fn)

    def approx_n_unique(self, rsd: float | None = None) -> Expr:
        """Distinct values, null included: exact, or by a sketch where a relative error is given."""

        def fn(x, c):
            some = x.agg(F.max(F.coalesce(c.isNull(), F.lit(False)).cast("long")))
            if rsd:
                n = x.agg(F.approx_count_distinct(c, rsd))
            else:
                n = F.size(x.agg(F.collect_set(c))).cast("long") if x.windowed else F.count_distinct(c)
            return n + F.coalesce(some, F.lit(0))

        return self._agg("approx_n_unique", fn)

    def _at_row(self, label: str, pick, among=lambda c: F.lit(True)) -> Expr:
        return self._f(label, lambda x, c: x.agg(pick(c, F.when(among(c), F.struct(*_sortable(x))))), kind="rowagg")

    def first(self) -> Expr:
        return self._at_row("first", F.min_by)

    def last(self) -> Expr:
        return self._at_row("last", F.max_by)

    def first_non_null(self) -> Expr:
        return self._at_row("first_non_null", F.min_by, lambda c: c.isNotNull())

    def last_non_null(self) -> Expr:
        return self._at_row("last_non_null", F.max_by, lambda c: c.isNotNull())

    def any(self) -> Expr:
        return self._agg("any", lambda x, c: x.agg(F.bool_or(c)))

    def all_true(self) -> Expr:
        return self._agg("all_true", lambda x, c: x.agg(F.bool_and(c)))

    def product(self) -> Expr:
        return self._agg("product", lambda x, c: x.agg(F.product(c.cast("double"))))

    def arg_min(self) -> Expr:
        return self._ordered("arg_min", lambda a: F.array_position(a, F.array_min(a)) - 1)

    def arg_max(self) -> Expr:
        return self._ordered("arg_max", lambda a: F.array_position(a, F.array_max(a)) - 1)

    def min_by(self, by) -> Expr:
        return self._by("min_by", lambda x, c, b: x.agg(F.min_by(c, F.when(b.isNotNull(), F.struct(b, *_sortable(x))))), by, kind="rowagg")

    def max_by(self, by) -> Expr:
        """The value where ``by`` is greatest; the first one on ties."""

        def fn(x, c, b):
            return x.agg(F.max_by(c, F.when(b.isNotNull(), F.struct(b, *[-k for k in _sortable(x)]))))

        return self._by("max_by", fn, by, kind="rowagg")

    def var(self, ddof: int = 1) -> Expr:
        return self._agg("var", lambda x, c: _variance(x, c, ddof))

    def std(self, ddof: int = 1) -> Expr:
        return self._agg("std", lambda x, c: F.sqrt(_variance(x, c, ddof)))

    def median(self) -> Expr:
        return self._agg("median", lambda x, c: x.agg(F.percentile(c, 0.5)))

    def quantile(self, q: float, interpolation: str = "linear") -> Expr:
        """By the rank q (n - 1): linear, lower, higher, nearest or midpoint between its neighbours."""

        def fn(x, c):
            if interpolation == "linear":
                return x.agg(F.percentile(c, q))
            return quantile_of(F.sort_array(x.agg(F.collect_list(c))), q, interpolation)

        return self._agg("quantile", fn)

    def skew(self, bias: bool = True) -> Expr:
        def fn(x, c):
            g, n = x.agg(F.skewness(c)), x.agg(F.count(c))
            return g if bias else F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))

        return self._agg("skew", fn)

    def kurtosis(self, fisher: bool = True, bias: bool = True) -> Expr:
        def fn(x, c):
            g, n = x.agg(F.kurtosis(c)), x.agg(F.count(c))
            if not bias:
                g = F.when(n > 3, ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3)))
            return g if fisher else g + 3

        return self._agg("kurtosis", fn)

    def bitwise_and(self) -> Expr:
        return self._agg("bitwise_and", lambda x, c: x.agg(F.bool_and(c) if _boolean(x, c) else F.bit_and(c)))

    def bitwise_or(self) -> Expr:
        return self._agg("bitwise_or", lambda x, c: x.agg(F.bool_or(c) if _boolean(x, c) else F.bit_or(c)))

    def bitwise_xor(self) -> Expr:
        return self._agg("bitwise_xor", lambda x, c: x.agg(F.bit_xor(c)))

    def entropy(self, base: float = math.e, normalize: bool = True) -> Expr:
        """Of the values that aren't null, as a distribution if ``normalize``; NaN where one is zero or negative."""

        def fn(x, c):
            low, total = x.agg(F.min(c)), x.agg(F.sum(c.cast("double")))
            logs = x.agg(F.sum(c * F.log(c)))
            out = F.log(total) - logs / F.nullif(total, F.lit(0.0)) if normalize else -logs
            return F.when(low <= 0, math.nan).otherwise(out / math.log(base))

        return self._agg("entropy", fn)

    def mode(self, maintain_order: bool = False) -> Expr:
        """All most frequent values, as a list: sorted, or as they first appear."""

        def fn(a):
            most = lambda c: F.array_max(F.transform(c, lambda s: s["n"]))
            best = lambda c: let(most(c), lambda n: F.filter(c, lambda s: s["n"] == n))
            return F.transform(let(_counted(a, maintain_order), best), lambda s: s["v"])

        return self._ordered("mode", fn)

    def _ordered(self, label: str, fn, *others) -> Expr:
        """A function of the group's values as a list in row order, nulls kept."""

        def build(x, *lists):
            def bound(got, rest):
                return let(in_order(x, rest[0]), lambda v: bound([*got, v], rest[1:])) if rest else fn(*got)

            return bound([], lists)

        return self._f(label, build, *others, kind="rowagg")

    def implode(self) -> Expr:
        return self._ordered("implode", lambda a: a)

    def top_k(self, k: int) -> Expr:
        return self._agg("top_k", lambda x, c: F.slice(F.sort_array(x.agg(F.collect_list(c)), asc=False), 1, k))

    def bottom_k(self, k: int) -> Expr:
        return self._agg("bottom_k", lambda x, c: F.slice(F.sort_array(x.agg(F.collect_list(c))), 1, k))

    def top_k_by(self, by, k: int) -> Expr:
        return self._by_k("top_k_by", by, k, False)

    def bottom_k_by(self, by, k: int) -> Expr:
        return self._by_k("bottom_k_by", by, k, True)

    def _by_k(self, label, by, k, asc) -> Expr:
        def fn(x, c, b):
            pairs = x.agg(F.collect_list(F.struct(b.alias("b"), *[(s if asc else -s).alias(f"o{i}") for i, s in enumerate(_sortable(x))], c.alias("v"))))
            full = F.filter(pairs, lambda p: p["b"].isNotNull())
            return F.transform(F.slice(F.sort_array(full, asc=asc), 1, k), lambda p: p["v"])

        return self._by(label, fn, by, kind="rowagg")

    def item(self, allow_empty: bool = False) -> Expr:
        def fn(x, c):
            n = x.agg(F.count(F.lit(1)))
            bad = F.raise_error(F.concat(F.lit("item() of so many values: "), n.cast("string")))
            return F.when((n == 1) | (F.lit(allow_empty) & (n == 0)), x.agg(F.max(c))).otherwise(bad)

        return self._agg("item", fn)

    def lower_bound(self) -> Expr:
        return self._f("lower_bound", lambda x, c: F.lit(_bounds(x.type_of(c))[0]).cast(x.type_of(c)))

    def upper_bound(self) -> Expr:
        return self._f("upper_bound", lambda x, c: F.lit(_bounds(x.type_of(c))[1]).cast(x.type_of(c)))

    def is_sorted(self, descending: bool = False, nulls_last: bool = False) -> Expr:
        def fn(a):
            full = F.array_compact(a)
            want = F.sort_array(full, asc=not descending)
            gap = F.array_repeat(F.lit(True), (F.size(a) - F.size(full)).cast("int"))
            rest = F.transform(full, lambda _: F.lit(False))
            nulls = F.transform(a, lambda v: v.isNull())
            return (full == want) & (nulls == (F.concat(rest, gap) if nulls_last else F.concat(gap, rest)))

        return self._ordered("is_sorted", fn)

    def dot(self, other) -> Expr:
        return self._agg("dot", lambda x, a, b: x.agg(F.sum(a * b)), other)

    def filter(self, *preds) -> Expr:
        """The input of an aggregate where all predicates hold: put it before the aggregate."""
        return self._f("filter", lambda _, c, *p: F.when(functools.reduce(lambda a, b: a & b, p), c), *preds)

    def hist(self, bins: list[float] | None = None, bin_count: int = 10) -> Expr:
        """Counts of (lower, upper] bins, as a list of structs; the first bin has its lower edge too."""

        def fn(x, c):
            v = c.cast("double")
            if bins is not None:  # plain sums, which groups of any size take
                edges = [float(b) for b in bins]
                inside = lambda i: ((v > edges[i]) | (v == edges[i]) if i == 0 else v > edges[i]) & (v <= edges[i + 1])
                return F.array(*[F.struct(F.lit(edges[i + 1]).alias("breakpoint"), x.agg(F.count_if(inside(i))).alias("count")) for i in range(len(edges) - 1)])
            values = x.agg(F.collect_list(v))

            def counted(a, lo, hi):
                place = F.transform(a, lambda u: F.least(F.greatest(F.coalesce(F.ceil((u - lo) * bin_count / F.nullif(hi - lo, F.lit(0.0))), F.lit(1)), F.lit(1)), F.lit(bin_count)))
                found = F.map_from_entries(F.transform(_counted(place, False), lambda s: F.struct(s["v"], s["n"])))
                one = lambda at: lambda i: F.struct((lo + (hi - lo) * i / bin_count).alias("breakpoint"), F.coalesce(at[i.cast("long")], F.lit(0)).cast("long").alias("count"))
                return let(found, lambda at: F.transform(F.sequence(F.lit(1), F.lit(bin_count)), one(at)))

            return let(values, lambda a: let(F.array_min(a), lambda lo: let(F.array_max(a), lambda hi: counted(a, lo, hi))))

        return self._agg("hist", fn)

    def value_counts(self, sort: bool = False, normalize: bool = False, name: str = "count") -> Expr:
        def fn(a):
            total = F.size(a)
            n = lambda s: s["n"].cast("long") / total if normalize else s["n"].cast("long")
            out = F.transform(_counted(a), lambda s: F.struct(s["v"].alias("value"), n(s).alias(name)))
            if sort:
                out = F.array_sort(out, lambda p, q: F.when(p[name] > q[name], -1).when(p[name] < q[name], 1).otherwise(0))
            return out

        return self._ordered("value_counts", fn)

    def unique_counts(self) -> Expr:
        return self._ordered("unique_counts", lambda a: F.transform(_counted(a), lambda s: s["n"]))

    def sample_n(self, n: int, with_replacement: bool = False, shuffle: bool = False, seed: int = 0) -> Expr:
        """A seeded draw of the group's values."""

        def fn(x, c):
            a = in_order(x, c)
            if with_replacement:
                return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.get(a, F.pmod(F.xxhash64(F.lit(seed), i), F.size(a)).cast("int")))
            return F.slice(_shuffled(a, seed), 1, n)

        return self._f("sample_n", fn, kind="rowagg")

    def sample_fraction(self, fraction: float, with_replacement: bool = False, shuffle: bool = False, seed: int = 0) -> Expr:
        return self._ordered("sample_fraction", lambda a: F.slice(_shuffled(a, seed), F.lit(1), F.floor(F.size(a) * fraction).cast("int")))

    def shuffle(self, seed: int = 0) -> Expr:
        return self._ordered("shuffle", lambda a: _shuffled(a, seed))

    def append(self, other) -> Expr:
        return self._ordered("append", lambda a, b: F.concat(a, b), other)

    def extend_constant(self, value, n: int) -> Expr:
        return self._ordered("extend_constant", lambda a: F.concat(a, F.array_repeat(F.lit(value), n)))

    # -- length-changing: a list per group -----------------------------------------------------------------------
    def sort(self, descending: bool = False) -> Expr:
        """Values sorted, nulls first."""
        return self._ordered("sort", lambda a: _sorted(a, descending, nulls_last=False))

    def sort_desc(self) -> Expr:
        return self.sort(descending=True)

    def sort_by(self, by, descending: bool = False) -> Expr:
        def fn(a, b):
            pairs = F.transform(F.arrays_zip(b.alias("b"), F.sequence(F.lit(0), F.size(a) - 1).alias("i"), a.alias("v")), lambda p: p)
            better = lambda p, q: F.when(p["b"].eqNullSafe(q["b"]), p["i"] - q["i"]).when(p["b"].isNull(), -1).when(q["b"].isNull(), 1)
            less = (lambda p, q: p["b"] > q["b"]) if descending else (lambda p, q: p["b"] < q["b"])
            return F.transform(F.array_sort(pairs, lambda p, q: better(p, q).when(less(p, q), -1).otherwise(1)), lambda p: p["v"])

        return self._ordered("sort_by", fn, col(by) if isinstance(by, _STR) else by)

    def sort_by_desc(self, by) -> Expr:
        return self.sort_by(by, descending=True)

    def head(self, n: int = 10) -> Expr:
        return self._ordered("head", lambda a: F.slice(a, 1, n))

    limit = head

    def tail(self, n: int = 10) -> Expr:
        return self._ordered("tail", lambda a: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n)))

    def slice(self, offset: int, length: int) -> Expr:
        def fn(a):
            start = F.lit(offset) if offset >= 0 else F.greatest(F.size(a) + offset, F.lit(0))
            return F.slice(a, start + 1, F.lit(length))

        return self._ordered("slice", fn)

    def get(self, i: int) -> Expr:
        return self._ordered("get", lambda a: F.get(a, F.lit(i) if i >= 0 else F.size(a) + i))

    def gather(self, indices) -> Expr:
        return self._ordered("gather", lambda a: F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i))))

    def gather_every(self, n: int, offset: int = 0) -> Expr:
        return self._ordered("gather_every", lambda a: F.filter(a, lambda _, i: (i >= offset) & ((i - offset) % n == 0)))

    def reverse(self) -> Expr:
        return self._ordered("reverse", F.reverse)

    def unique(self) -> Expr:
        return self._ordered("unique", F.array_distinct)

    def drop_nulls(self) -> Expr:
        return self._ordered("drop_nulls", F.array_compact)

    def drop_nans(self) -> Expr:
        return self._ordered("drop_nans", lambda a: F.filter(a, lambda v: F.coalesce(~F.isnan(v), F.lit(True))))

    def explode(self) -> Expr:
        return self._ordered("explode", F.flatten)

    def arg_sort(self, descending: bool = False, nulls_last: bool = False) -> Expr:
        def fn(a):
            pairs = F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
            null = 1 if nulls_last else -1

            def cmp(p, q):
                a, b = p["v"], q["v"]
                less = (a > b) if descending else (a < b)
                return F.when(a.eqNullSafe(b), p["i"] - q["i"]).when(a.isNull(), null).when(b.isNull(), -null).when(less, -1).otherwise(1)

            return F.transform(F.array_sort(pairs, cmp), lambda p: p["i"])

        return self._ordered("arg_sort", fn)

    def arg_true(self) -> Expr:
        return self._ordered("arg_true", lambda a: F.filter(F.transform(a, lambda v, i: F.when(v, i)), lambda i: i.isNotNull()))

    def arg_unique(self) -> Expr:
        return self._ordered("arg_unique", lambda a: F.filter(F.transform(a, lambda v, i: F.when(F.array_position(F.transform(a, lambda u: F.coalesce(u.eqNullSafe(v), F.lit(False))), True) == i + 1, i)), lambda i: i.isNotNull()))

    def search_sorted(self, value, side: str = "left") -> Expr:
        return self._agg("search_sorted", lambda x, c: x.agg(F.count_if(c < F.lit(value) if side == "left" else c <= F.lit(value))))

    def index_of(self, value) -> Expr:
        return self._ordered("index_of", lambda a: F.nullif(F.array_position(F.transform(a, lambda v: v.eqNullSafe(F.lit(value))), True), F.lit(0)) - 1)

    def reshape(self, width: int) -> Expr:
        def fn(a):
            rows = F.sequence(F.lit(0), (F.size(a) / width).cast("int") - 1)
            bad = F.raise_error(F.lit("the values don't fill whole rows"))
            return F.when(F.size(a) % width != 0, bad).otherwise(F.transform(rows, lambda i: F.slice(a, i * width + 1, F.lit(width))))

        return self._ordered("reshape", fn)

    def rle(self) -> Expr:
        """Runs of equal values: structs of len and value."""

        def fn(a):
            start = F.filter(F.transform(a, lambda v, i: F.when((i == 0) | ~v.eqNullSafe(F.get(a, i - 1)), i)), lambda i: i.isNotNull())
            run = lambda p: F.transform(p, lambda s, k: F.struct((F.coalesce(F.get(p, k + 1), F.size(a)) - s).alias("len"), F.get(a, s).alias("value")))
            return let(start, run)

        return self._ordered("rle", fn)

    # -- windows -------------------------------------------------------------------------------------------------
    def over(self, *partition, order_by=None) -> Expr:
        """The expression within each partition, on all its rows; in the order of ``order_by`` where it depends on one."""
        keys = [to_expr(p) if not isinstance(p, str) else col(p) for p in partition]
        order = [] if order_by is None else list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
        place = tuple(k if isinstance(k, str) else object() for k in partition), tuple(k if isinstance(k, str) else object() for k in order)
        order = [k if isinstance(k, SortKey) else asc(k) for k in order]

        def fn(x, *_):
            inner = replace(x, part=tuple(k.compile(x) for k in keys), windowed=True, order=tuple(k.column(x) for k in order) or None, place=place)
            return self.compile(inner)

        kind = "over" if order or not self.has("window", "rowagg") else "window"
        leaf = replace(self, fn=lambda x, *_: F.lit(0), kind="held" if kind == "over" else "window", kids=())
        return Expr(fn, (replace(leaf, out=self.name_of()), *keys), "over", kind)

    def over_with(self, partition_by=(), order_by=None) -> Expr:
        return self.over(*partition_by, order_by=order_by)

    def rolling(self, index, period, closed: str = "right") -> Expr:
        """The aggregates in this expression over the rows within ``period`` before each row's ``index``."""
        from lumenfold.operators.temporal import rolling_window

        by = col(index) if isinstance(index, _STR) else to_expr(index)

        def fn(x, at):
            at = at if isinstance(x.type_of(at), INTS) else F.unix_micros(at.cast("timestamp"))
            return self.compile(replace(x, windowed=True, frame=rolling_window(at, period, closed, list(x.part))))

        return Expr(fn, (by,), "rolling", "window", self.name_of())

    def rank(self, method: str = "average", descending: bool = False) -> Expr:
        """ordinal, dense, min, max or average; null has no rank and isn't counted."""

        def fn(x, c):
            key = c.desc_nulls_last() if descending else c.asc_nulls_last()
            w = Window.partitionBy(*x.part).orderBy(key)
            peers = F.count(F.lit(1)).over(Window.partitionBy(*x.part, c))
            out = {
                "ordinal": lambda: F.row_number().over(Window.partitionBy(*x.part).orderBy(key, F.col(ROW))),
                "dense": lambda: F.dense_rank().over(w),
                "min": lambda: F.rank().over(w),
                "max": lambda: F.rank().over(w) + peers - 1,
                "average": lambda: F.rank().over(w) + (peers - 1) / 2,
            }[method]()
            return F.when(c.isNotNull(), out)

        return self._f("rank", fn, kind="window" if method == "ordinal" else "spread")

    def _placed(self, label: str, fn, descending: bool) -> Expr:
        def build(x, c):
            w = Window.partitionBy(*x.part).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
            return F.when(c.isNotNull(), fn().over(w))

        return self._f(label, build, kind="spread")

    def percent_rank(self, descending: bool = False) -> Expr:
        """(rank - 1) / (rows - 1), 0 for a single row; nulls come last and have none."""
        return self._placed("percent_rank", F.percent_rank, descending)

    def cume_dist(self, descending: bool = False) -> Expr:
        """The share of rows up to and including the row's peers; nulls come last and have none."""
        return self._placed("cume_dist", F.cume_dist, descending)

    def ntile(self, n: int, descending: bool = False) -> Expr:
        """The number from 1 to n of the row's part, of n as equal as can be; equal values keep the order of rows."""

        def build(x, c):
            w = Window.partitionBy(*x.part).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(ROW))
            return F.ntile(n).over(w)

        return self._f("ntile", build, kind="window")

    def nth_value(self, n: int, ignore_nulls: bool = False) -> Expr:
        """The n-th value from 1 in the order of rows, for every row; null where there are fewer."""
        return self._win("nth_value", lambda x, c: F.nth_value(c, n, ignore_nulls).over(x.rows(_START, _END)))

    def _cum(self, label: str, fn, reverse: bool) -> Expr:
        def build(x, c):
            w = x.onward() if reverse else x.rows(_START, 0)
            return F.when(c.isNotNull(), fn(x, c).over(w))

        return self._win(label, build)

    def cum_count(self, reverse: bool = False) -> Expr:
        return self._win("cum_count", lambda x, c: F.count(F.lit(1)).over(x.onward() if reverse else x.rows(_START, 0)))

    def cum_sum(self, reverse: bool = False) -> Expr:
        return self._cum("cum_sum", lambda x, c: F.sum(c.cast("decimal(38,0)") if isinstance(x.type_of(c), INTS) else c), reverse)

    def cum_prod(self, reverse: bool = False) -> Expr:
        return self._cum("cum_prod", lambda x, c: F.product(c.cast("double")), reverse)

    def cum_min(self, reverse: bool = False) -> Expr:
        return self._cum("cum_min", lambda x, c: F.min(c), reverse)

    def cum_max(self, reverse: bool = False) -> Expr:
        return self._cum("cum_max", lambda x, c: F.max(c), reverse)

    def cumulative_eval(self, body: Callable[[Column], Column], min_samples: int = 1) -> Expr:
        """``body`` of each prefix, as a list in row order."""

        def fn(x, c):
            w = x.rows(_START, 0)
            a = F.transform(F.collect_list(F.struct(c.alias("v"))).over(w), lambda s: s["v"])
            return F.when(F.count(c).over(w) >= min_samples, body(a))

        return self._win("cumulative_eval", fn)

    def shift(self, n: int = 1, fill=None) -> Expr:
        return self._win("shift", lambda x, c: F.lag(c, n, fill).over(x.ordered()))

    def shift_fill(self, n: int, fill) -> Expr:
        return self.shift(n, fill)

    def diff(self, n: int = 1) -> Expr:
        return self._win("diff", lambda x, c: c - F.lag(c, n).over(x.ordered()))

    def pct_change(self, n: int = 1) -> Expr:
        return self / self.shift(n) - 1.0

    def forward_fill(self, limit: int = 0) -> Expr:
        return self._win("forward_fill", lambda x, c: F.last(c, ignorenulls=True).over(x.rows(-limit if limit else _START, 0)))

    def backward_fill(self, limit: int = 0) -> Expr:
        return self._win("backward_fill", lambda x, c: F.first(c, ignorenulls=True).over(x.rows(0, limit)) if limit else F.last(c, ignorenulls=True).over(x.onward()))

    def fill_null(self, strategy: str, limit: int = 0) -> Expr:
        """zero, one, forward, backward, min, max or mean."""
        if strategy in ("forward", "backward"):
            return getattr(self, f"{strategy}_fill")(limit)
        if strategy in ("zero", "one"):
            return self._f(strategy, lambda x, c: F.coalesce(c, F.lit(int(strategy == "one")).cast(x.type_of(c))))
        pick = {"min": F.min, "max": F.max, "mean": F.avg}[strategy]
        return self._f(f"fill_{strategy}", lambda x, c: F.coalesce(c, x.agg(pick(c)).cast(x.type_of(c))), kind="spread")

    def _roll(self, label: str, size: int, fn, *others, min_samples: int | None = None, center: bool = False) -> Expr:
        need = size if min_samples is None else min_samples

        def build(x, c, *more):
            w = x.rows(-(size // 2), size - 1 - size // 2) if center else x.rows(1 - size, 0)
            return F.when(F.count(c).over(w) >= need, fn(c, w, *more))

        return self._win(label, build, *others)

    def rolling_sum(self, size: int, **o) -> Expr:
        return self._roll("rolling_sum", size, lambda c, w: F.sum(c).over(w), **o)

    def rolling_mean(self, size: int, **o) -> Expr:
        return self._roll("rolling_mean", size, lambda c, w: F.avg(c).over(w), **o)

    def rolling_min(self, size: int, **o) -> Expr:
        return self._roll("rolling_min", size, lambda c, w: F.min(c).over(w), **o)

    def rolling_max(self, size: int, **o) -> Expr:
        return self._roll("rolling_max", size, lambda c, w: F.max(c).over(w), **o)

    def rolling_var(self, size: int, ddof: int = 1, **o) -> Expr:
        return self._roll("rolling_var", size, lambda c, w: _var_over(c, w, ddof), **o)

    def rolling_std(self, size: int, ddof: int = 1, **o) -> Expr:
        return self._roll("rolling_std", size, lambda c, w: F.sqrt(_var_over(c, w, ddof)), **o)

    def rolling_median(self, size: int, **o) -> Expr:
        return self._roll("rolling_median", size, lambda c, w: F.percentile(c, 0.5).over(w), **o)

    def rolling_quantile(self, q: float, interpolation: str, size: int, **o) -> Expr:
        def fn(c, w):
            if interpolation == "linear":
                return F.percentile(c, q).over(w)
            return quantile_of(F.sort_array(F.collect_list(c).over(w)), q, interpolation)

        return self._roll("rolling_quantile", size, fn, **o)

    def rolling_skew(self, size: int, bias: bool = True, **o) -> Expr:
        def fn(c, w):
            g, n = F.skewness(c).over(w), F.count(c).over(w)
            return g if bias else F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))

        return self._roll("rolling_skew", size, fn, **o)

    def rolling_kurtosis(self, size: int, fisher: bool = True, bias: bool = True, **o) -> Expr:
        def fn(c, w):
            g, n = F.kurtosis(c).over(w), F.count(c).over(w)
            if not bias:
                g = F.when(n > 3, ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3)))
            return g if fisher else g + 3

        return self._roll("rolling_kurtosis", size, fn, **o)

    def rolling_rank(self, size: int, method: str = "average", **o) -> Expr:
        return self._roll("rolling_rank", size, lambda c, w: _rank_in(c, F.collect_list(c).over(w), method), **o)

    def rolling_by(self, label: str, by, period, fn, closed: str = "right", min_samples: int = 1) -> Expr:
        """An aggregate of the rows whose ``by`` lies within ``period`` before each row's: (t - period, t] unless closed says else."""
        from lumenfold.operators.temporal import micros

        def build(x, c, b):
            step = micros(period)
            at = b if isinstance(x.type_of(b), INTS) else F.unix_micros(b.cast("timestamp"))
            lo = -step if closed in ("left", "both") else 1 - step
            hi = 0 if closed in ("right", "both") else -1
            w = Window.partitionBy(*x.part).orderBy(at).rangeBetween(lo, hi)
            return F.when(F.count(c).over(w) >= min_samples, fn(c, w))

        return self._by(label, build, by, kind="spread")

    def rolling_sum_by(self, by, period, **o) -> Expr:
        return self.rolling_by("rolling_sum_by", by, period, lambda c, w: F.sum(c).over(w), **o)

    def rolling_mean_by(self, by, period, **o) -> Expr:
        return self.rolling_by("rolling_mean_by", by, period, lambda c, w: F.avg(c).over(w), **o)

    def rolling_min_by(self, by, period, **o) -> Expr:
        return self.rolling_by("rolling_min_by", by, period, lambda c, w: F.min(c).over(w), **o)

    def rolling_max_by(self, by, period, **o) -> Expr:
        return self.rolling_by("rolling_max_by", by, period, lambda c, w: F.max(c).over(w), **o)

    def rolling_var_by(self, by, period, ddof: int = 1, **o) -> Expr:
        return self.rolling_by("rolling_var_by", by, period, lambda c, w: _var_over(c, w, ddof), **o)

    def rolling_std_by(self, by, period, ddof: int = 1, **o) -> Expr:
        return self.rolling_by("rolling_std_by", by, period, lambda c, w: F.sqrt(_var_over(c, w, ddof)), **o)

    def rolling_median_by(self, by, period, **o) -> Expr:
        return self.rolling_by("rolling_median_by", by, period, lambda c, w: F.percentile(c, 0.5).over(w), **o)

    def rolling_quantile_by(self, q: float, interpolation: str, by, period, **o) -> Expr:
        return self.rolling_by("rolling_quantile_by", by, period, lambda c, w: quantile_of(F.sort_array(F.collect_list(c).over(w)), q, interpolation), **o)

    def rolling_rank_by(self, by, period, method: str = "average", **o) -> Expr:
        return self.rolling_by("rolling_rank_by", by, period, lambda c, w: _rank_in(c, F.collect_list(c).over(w), method), **o)

    def _ewm(self, label: str, alpha: float, adjust: bool, ignore_nulls: bool, min_samples: int, fn) -> Expr:
        """A function of decaying sums; see _Decay. ``min_samples`` counts values since the group's start."""
        tag = self.fn if self.kind == "col" else object()

        def build(x, c):
            d = _Decay(x, c.cast("double"), tag, alpha, adjust, ignore_nulls)
            return F.when(c.isNotNull() if min_samples <= 1 else c.isNotNull() & (d.count() >= min_samples), fn(d))

        return self._win(label, build)

    def ewm_mean(self, alpha: float | None = None, *, span=None, com=None, half_life=None, adjust: bool = True, ignore_nulls: bool = False, min_samples: int = 1) -> Expr:
        return self._ewm("ewm_mean", ewm_alpha(alpha, span, com, half_life), adjust, ignore_nulls, min_samples, lambda d: d.mean())

    def ewm_var(self, alpha: float | None = None, *, span=None, com=None, half_life=None, adjust: bool = True, ignore_nulls: bool = False, bias: bool = False, min_samples: int = 1) -> Expr:
        return self._ewm("ewm_var", ewm_alpha(alpha, span, com, half_life), adjust, ignore_nulls, min_samples, lambda d: d.var(bias))

    def ewm_std(self, alpha: float | None = None, **o) -> Expr:
        return self.ewm_var(alpha, **o)._map("sqrt", F.sqrt)

    def ewm_sum(self, alpha: float | None = None, *, span=None, com=None, half_life=None, ignore_nulls: bool = False, min_samples: int = 1) -> Expr:
        return self._ewm("ewm_sum", ewm_alpha(alpha, span, com, half_life), True, ignore_nulls, min_samples, lambda d: d.total())

    def _ewm_by(self, label: str, by, half_life, pick, bounded: bool) -> Expr:
        """A fold over the rows before each row. ``bounded``: over those within 200 half-lives, as older ones weigh 2^-200 or
        less, beyond what a double can tell, and rows of the same instant change nothing; then what is held for a row
        depends on the decay and not on the group."""
        from lumenfold.operators.temporal import micros

        def build(x, c, b):
            at = b if isinstance(x.type_of(b), INTS) else F.unix_micros(b.cast("timestamp"))
            w = Window.partitionBy(*x.part).orderBy(at)
            w = w.rangeBetween(-200 * micros(half_life), 0) if bounded else w.rowsBetween(_START, 0)
            arr = F.collect_list(F.when(c.isNotNull(), F.struct(at.alias("t"), c.cast("double").alias("v")))).over(w)
            start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(None).cast("long").alias("t"))

            def step(s, p):
                k = F.pow(F.lit(0.5), (p["t"] - s["t"]) / micros(half_life))
                return F.struct(F.when(s["m"].isNull(), p["v"]).otherwise(pick(s["m"], p["v"], k)).alias("m"), p["t"].cast("long").alias("t"))

            return F.when(c.isNotNull(), F.aggregate(arr, start, step)["m"])

        return self._by(label, build, by, kind="spread")

    def ewm_mean_by(self, by, half_life) -> Expr:
        return self._ewm_by("ewm_mean_by", by, half_life, lambda m, v, k: k * m + (1 - k) * v, True)

    def ewm_sum_by(self, by, half_life) -> Expr:
        return self._ewm_by("ewm_sum_by", by, half_life, lambda m, v, k: k * m + v, False)

    def interpolate(self, method: str = "linear") -> Expr:
        def fn(x, c):
            n = x.stage(F.row_number().over(x.ordered()))
            return _interpolated(c, n, x.rows(_START, 0), x.onward(), method)

        return self._win("interpolate", fn)

    def interpolate_by(self, by) -> Expr:
        def fn(x, c, b):
            at = (b if isinstance(x.type_of(b), (*INTS, *FLOATS)) else F.unix_micros(b.cast("timestamp"))).cast("double")
            return _interpolated(c, at, Window.partitionBy(*x.part).orderBy(at).rowsBetween(_START, 0), x.onward([at]), "linear")

        return self._by("interpolate_by", fn, by, kind="spread")

    def is_unique(self) -> Expr:
        return self._f("is_unique", lambda x, c: F.count(F.lit(1)).over(Window.partitionBy(*x.part, c)) == 1, kind="spread")

    def is_duplicated(self) -> Expr:
        return self._f("is_duplicated", lambda x, c: F.count(F.lit(1)).over(Window.partitionBy(*x.part, c)) > 1, kind="spread")

    def is_first_distinct(self) -> Expr:
        return self._win("is_first_distinct", lambda x, c: F.row_number().over(Window.partitionBy(*x.part, c).orderBy(*x.keys())) == 1)

    def is_last_distinct(self) -> Expr:
        return self._win("is_last_distinct", lambda x, c: F.lead(F.lit(1)).over(Window.partitionBy(*x.part, c).orderBy(*x.keys())).isNull())

    def rle_id(self) -> Expr:
        return self._win("rle_id", lambda x, c: _rle_id(x, c))

    def peak_max(self) -> Expr:
        return self._peak("peak_max", lambda c, o: c > o)

    def peak_min(self) -> Expr:
        return self._peak("peak_min", lambda c, o: c < o)

    def _peak(self, label, better) -> Expr:
        def fn(x, c):
            w = x.ordered()
            return better(c, F.coalesce(F.lag(c).over(w), F.lit(0))) & better(c, F.coalesce(F.lead(c).over(w), F.lit(0)))

        return self._win(label, fn)

    def repeat_by(self, n) -> Expr:
        return self._f("repeat_by", lambda _, c, k: F.array_repeat(c, k.cast("int")), n)

    # -- user functions ------------------------------------------------------------------------------------------
    def map_elements(self, fn: Callable, returns) -> Expr:
        """``fn`` of each value that isn't null, in Arrow batches."""
        return self._map("map_elements", _batched(lambda s: s.map(fn, na_action="ignore"), returns))

    def map_batches(self, fn: Callable, returns) -> Expr:
        """``fn`` of whole batches of values (pandas Series to Series)."""
        return self._map("map_batches", _batched(fn, returns))

    def rolling_map(self, fn: Callable, size: int, returns="double", min_samples: int | None = None) -> Expr:
        """``fn`` of each row's trailing window, as a pandas Series without nulls."""

        def run(s):
            import pandas as pd

            return s.map(lambda v: None if v is None else fn(pd.Series(v)))

        call, need = _batched(run, returns), size if min_samples is None else min_samples

        def build(x, c):
            w = x.rows(1 - size, 0)
            return call(F.when(F.count(c).over(w) >= need, F.collect_list(c).over(w)))

        return self._win("rolling_map", build)


for _n, _g in {
    "sqrt": lambda c: F.when(c < 0, math.nan).otherwise(F.sqrt(c)), "cbrt": F.cbrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "cot": F.cot, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh,
    "arccosh": F.acosh, "arctanh": F.atanh, "degrees": F.degrees, "radians": F.radians, "floor": F.floor, "ceil": F.ceil,
}.items():
    setattr(Expr, _n, (lambda n, g: lambda self: self._map(n, g))(_n, _g))


# -- helpers -----------------------------------------------------------------------------------------------------
def _compare(op: str):
    """A comparison by IEEE rules. Spark has NaN equal to itself and above all else, so a guard is added where that
    matters; it stands beside the plain comparison, which scans can still take as a filter."""

    def fn(x, a, b):
        out = getattr(operator, op)(a, b)
        guarded = {"eq": (a, b), "ne": (a, b), "lt": (b, a), "le": (b, a), "gt": (a, b), "ge": (a, b)}[op]
        both = all(isinstance(x.type_of(c), FLOATS) for c in (a, b)) if op in ("eq", "ne") else True
        c, other = guarded
        if both and isinstance(x.type_of(c), FLOATS) and not any(_is_number(v) for v in ((a, b) if op in ("eq", "ne") else (c,))):
            if op == "ne":
                out = out | (F.isnan(c) & other.isNotNull())
            else:
                out = out & (~F.isnan(c) if _is_number(other) else ~F.isnan(c) | other.isNull())
        return _known(out, T.BooleanType())

    return fn


def _is_number(c: Column) -> bool:
    """Whether it is a literal other than NaN and null."""
    return c.__dict__.get("_number", False)


def _boolean(x: Ctx, c: Column) -> bool:
    kind = x.type_of(c)
    return kind is None or isinstance(kind, T.BooleanType)


def _is_int(to) -> bool:
    return isinstance(to, INTS) or to in ("byte", "short", "int", "integer", "long", "bigint", "tinyint", "smallint")


def _quotient(x, a, b, divide, toward_zero):
    if isinstance(x.type_of(a), FLOATS) or isinstance(x.type_of(b), FLOATS):
        q = divide(a.cast("double"), b.cast("double"))
        return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q) if toward_zero else F.floor(q)).cast("double")
    n = F.nullif(b, F.lit(0))
    r = a % n
    q = ((a - r) / n).cast("long")
    return q if toward_zero else q - F.when((r != 0) & ((r < 0) != (n < 0)), 1).otherwise(0)


def _log(c, fn):
    return F.when(c == 0, -math.inf).when(c < 0, math.nan).otherwise(fn(F.when(c > 0, c)))


def _erf(which: str):
    return _batched(lambda s: s.map(getattr(math, which), na_action="ignore").astype("float64"), "double")


def _batched(fn: Callable, returns) -> Callable[[Column], Column]:
    """A function of pandas Series as a function of a column; made when the column is, as that needs a session."""

    def call(c: Column) -> Column:
        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        def run(s):
            return fn(s)

        run.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return pandas_udf(run, returns)(c)

    return call


def cut_labels(breaks, left_closed: bool) -> list[str]:
    edges = ["-inf", *(f"{b:g}" for b in breaks), "inf"]
    return [f"[{a}, {b})" if left_closed else f"({a}, {b}]" for a, b in zip(edges, edges[1:], strict=False)]


def _variance(x, c, ddof: int):
    n = x.agg(F.count(c))
    if ddof == 0:
        return F.when(n > 0, x.agg(F.var_pop(c)))
    if ddof == 1:
        return F.when(n > 1, x.agg(F.var_samp(c)))
    return F.when(n > ddof, x.agg(F.var_pop(c)) * n / (n - ddof))


def _var_over(c, w, ddof: int):
    n = F.count(c).over(w)
    return F.when(n > ddof, F.var_pop(c).over(w) * n / F.nullif(n - ddof, F.lit(0)))


def quantile_of(a: Column, q: float, interpolation: str) -> Column:
    """Quantile of a sorted array."""
    at = (F.size(a) - 1) * F.lit(float(q))
    lo, hi = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
    picks = {
        "linear": lambda: lo + (hi - lo) * (at - F.floor(at)), "lower": lambda: lo, "higher": lambda: hi,
        "nearest": lambda: F.get(a, F.round(at).cast("int")), "midpoint": lambda: (lo + hi) / 2,
    }
    return F.when(F.size(a) > 0, picks[interpolation]().cast("double"))


def _rank_in(c, a, method):
    less, same = F.size(F.filter(a, lambda v: v < c)), F.size(F.filter(a, lambda v: v == c))
    return {"min": less + 1, "max": less + same, "average": less + (same + 1) / 2, "dense": F.size(F.array_distinct(F.filter(a, lambda v: v < c))) + 1, "ordinal": less + same}[method]


def _sortable(x: Ctx) -> tuple[Column, ...]:
    return x.keys() if x.order is None else (F.col(ROW),)


def in_order(x: Ctx, c: Column) -> Column:
    """The group's values as a list in row order, nulls kept."""
    rows = x.agg(F.collect_list(F.struct(F.col(ROW).alias("o"), c.alias("v"))))
    return F.transform(F.sort_array(rows), lambda s: s["v"])


def _sorted(a: Column, descending: bool, nulls_last: bool) -> Column:
    null = 1 if nulls_last else -1
    less = (lambda p, q: p > q) if descending else (lambda p, q: p < q)
    return F.array_sort(a, lambda p, q: F.when(p.eqNullSafe(q), 0).when(p.isNull(), null).when(q.isNull(), -null).when(less(p, q), -1).otherwise(1))


def _shuffled(a: Column, seed: int) -> Column:
    keyed = F.transform(a, lambda v, i: F.struct(F.xxhash64(F.lit(seed), i).alias("h"), v.alias("v")))
    return F.transform(F.sort_array(keyed), lambda s: s["v"])


def _counted(a: Column, in_order: bool = True) -> Column:
    """Structs of v and n for each distinct value, as they first appear or sorted: one sort, then the runs' lengths."""
    def starts(s):
        new = lambda p, k: (k == 0) | ~p["v"].eqNullSafe(F.get(s, k - 1)["v"])
        return F.filter(F.transform(s, lambda p, k: F.when(new(p, k), k)), lambda k: k.isNotNull())

    def runs(s, start):
        n = lambda k, j: F.coalesce(F.get(start, j + 1), F.size(s)) - k
        return F.transform(start, lambda k, j: F.struct(F.get(s, k)["i"].alias("i"), n(k, j).alias("n"), F.get(s, k)["v"].alias("v")))

    placed = F.sort_array(F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    out = let(placed, lambda s: let(starts(s), lambda start: runs(s, start)))
    return F.sort_array(out) if in_order else out


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c), with c computed once: Spark computes what a lambda captures anew for each element."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def _bounds(kind):
    ints = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
    if type(kind) in ints:
        n = ints[type(kind)]
        return -(1 << n), (1 << n) - 1
    return -math.inf, math.inf


def ewm_alpha(alpha=None, span=None, com=None, half_life=None) -> float:
    if alpha is not None:
        return alpha
    if span is not None:
        return 2 / (span + 1)
    if com is not None:
        return 1 / (1 + com)
    return 1 - math.exp(-math.log(2) / half_life)


class _Decay:
    """Sums of a row and those before it, whose weights fall by 1 - alpha a row (or, without nulls, a value).

    A group is cut into blocks, over whose length weights fall by about 2^200, and sums run within a block as if all its rows
    were weighed from its middle. What the block before adds is its total, decayed. Older rows weigh 2^-200 or less, beyond
    what a double can tell. So a row costs the same whatever the decay and the group.
    """

    def __init__(self, x: Ctx, c: Column, tag, alpha: float, adjust: bool, ignore_nulls: bool):
        self.x, self.c, self.keep = x, c, 1 - alpha
        self.key = (x.place, tag, alpha, adjust, ignore_nulls)
        self.count = lambda: x.stage(F.count(c).over(x.rows(_START, 0)), (x.place, tag, "count"))
        self.size = 1 << 62 if self.keep >= 1 else 1 if self.keep <= 0 else max(1, round(200 * math.log(2) / -math.log(self.keep)))
        self.row = x.stage(F.row_number().over(x.ordered()), (x.place, "row"))
        at = (self.count() if ignore_nulls else self.row) - 1
        self.block = x.stage(F.floor(at / F.lit(float(self.size))), (x.place, self.size, tag if ignore_nulls else None))
        self.at = (at - self.block * self.size).cast("double")
        self.gain = F.lit(1.0) if adjust else F.when(self.count() == 1, 1.0).otherwise(alpha)

    def _sums(self, **terms) -> list[Column]:
        """The decaying sums of (term, weight kept a row) by name."""
        part, half = self.x.part, self.size // 2
        own = Window.partitionBy(*part, self.block).orderBy(self.row).rowsBetween(_START, 0)
        before = Window.partitionBy(*part).orderBy(self.block).rangeBetween(-1, -1)
        made = []
        for n, (term, keep) in terms.items():
            made.append(F.sum(term * F.pow(F.lit(keep), half - self.at)).over(own).alias(n))
            made.append(F.sum(term * F.pow(F.lit(keep), self.size - 1 - self.at)).over(before).alias(f"{n}_before"))
        s = self.x.stage(F.struct(*made), (*self.key, *terms))
        old = lambda n, keep: F.coalesce(s[f"{n}_before"] * F.pow(F.lit(keep), self.at + 1), F.lit(0.0)) if keep > 0 else 0.0
        return [s[n] * F.pow(F.lit(keep), self.at - half) + old(n, keep) for n, (_, keep) in terms.items()]

    def total(self) -> Column:
        return self._sums(s=(self.c, self.keep))[0]

    def mean(self) -> Column:
        weight, total = self._sums(w=(F.when(self.c.isNotNull(), self.gain), self.keep), m=(self.gain * self.c, self.keep))
        return total / weight

    def var(self, bias: bool) -> Column:
        """Each value adds to the decayed squares its distances from the mean before it and with it, as Welford has it."""
        c, g, full = self.c, self.gain, self.c.isNotNull()
        weight, total, squared = self._sums(w=(F.when(full, g), self.keep), m=(g * c, self.keep), w2=(F.when(full, g * g), self.keep * self.keep))
        mean = F.when(full, total / weight)
        w = Window.partitionBy(*self.x.part).orderBy(self.block, self.row).rowsBetween(_START, -1)
        last = self.x.stage(F.last(mean, ignorenulls=True).over(w), (*self.key, "last"))
        (squares,) = self._sums(q=(F.when(full, F.coalesce(g * (c - last) * (c - mean), F.lit(0.0))), self.keep))
        biased, all_ = F.greatest(squares / weight, F.lit(0.0)), weight * weight
        return biased if bias else F.when(all_ > squared * (1 + 1e-12), biased * all_ / (all_ - squared))


def _interpolated(c, at, before, after, method):
    """``before`` runs from the start to the row, ``after`` from the end to it."""
    c = c.cast("double")
    spot = F.when(c.isNotNull(), at)
    lv, lp = F.last(c, ignorenulls=True).over(before), F.last(spot, ignorenulls=True).over(before)
    rv, rp = F.last(c, ignorenulls=True).over(after), F.last(spot, ignorenulls=True).over(after)
    if method == "nearest":
        fill = F.when(lv.isNotNull() & rv.isNotNull(), F.when(at - lp < rp - at, lv).otherwise(rv))
    else:
        fill = lv + (rv - lv) * (at - lp) / F.nullif((rp - lp).cast("double"), F.lit(0.0))
    return F.coalesce(c, fill)


def _rle_id(x, c):
    w = x.ordered()
    flag = F.when(F.row_number().over(w) == 1, 0).when(c.eqNullSafe(F.lag(c).over(w)), 0).otherwise(1)
    return F.sum(x.stage(flag)).over(x.rows(_START, 0))


# -- constructors --------------------------------------------------------------------------------------------------
def to_expr(v) -> Expr:
    return v if isinstance(v, Expr) else lit(v)


def col(*names: str) -> Expr:
    if len(names) == 1:
        n = names[0]
        return Expr(lambda x: _column(x, n), (), f"col({n})", "col", n)
    return _match(f"col({', '.join(names)})", lambda s: list(names))


def _known(c: Column, kind: T.DataType) -> Column:
    c._known = kind
    return c


def _column(x: Ctx, name: str) -> Column:
    c = F.col(f"`{name}`")
    kind = next((f.dataType for f in x.df.schema.fields if f.name == name), None) if x.df is not None else None
    return c if kind is None else _known(c, kind)


def _match(label: str, fn) -> Expr:
    return Expr(lambda s: [n for n in fn(s) if n != ROW], (), label, "match", "*")


def col_regex(pattern: str) -> Expr:
    import re

    return _match(f"col_regex({pattern})", lambda s: [n for n in s.names if re.search(pattern, n)])


def col_dtype(*kinds) -> Expr:
    return _match("col_dtype", lambda s: [f.name for f in s.fields if isinstance(f.dataType, tuple(kinds))])


def all_() -> Expr:
    return _match("all", lambda s: s.names)


def exclude(*names: str) -> Expr:
    return _match("exclude", lambda s: [n for n in s.names if n not in names])


def exclude_regex(pattern: str) -> Expr:
    import re

    return _match("exclude_regex", lambda s: [n for n in s.names if not re.search(pattern, n)])


def nth(*indices: int) -> Expr:
    return _match("nth", lambda s: [[n for n in s.names if n != ROW][i] for i in indices])


def lit(v) -> Expr:
    """A literal; a Python integer is a 64-bit integer, a list is a list."""

    def fn(_):
        if v is None:
            return F.lit(v)
        if isinstance(v, bool):
            return _known(F.lit(v), T.BooleanType())
        if isinstance(v, int):
            c = _known(F.lit(v).cast("long"), T.LongType())
            c._number = True
            return c
        if isinstance(v, (list, tuple)):
            return F.array(*[lit(i).compile(None) for i in v])
        if isinstance(v, dt.datetime) and v.tzinfo is None:
            return _known(F.lit(v.isoformat(" ")).cast("timestamp_ntz"), T.TimestampNTZType())
        kind = {str: T.StringType, float: T.DoubleType}.get(type(v))
        c = _known(F.lit(v), kind()) if kind else F.lit(v)
        c._number = isinstance(v, float) and not math.isnan(v)
        return c

    return Expr(fn, (), f"lit({v!r})", "lit", "literal")


def null(kind) -> Expr:
    return Expr(lambda _: F.lit(None).cast(kind), (), "null", "lit", "literal")


def length() -> Expr:
    """Rows of the group."""
    return Expr(lambda x: x.n_rows(), (), "len", "agg", "len")


class _When:
    def __init__(self, pairs, pred):
        self.pairs, self.pred = pairs, pred

    def then(self, v) -> _Then:
        return _Then.of([*self.pairs, (to_expr(self.pred), to_expr(v))])


class _Then(Expr):
    """Branches so far; as an expression, null where none holds."""

    @classmethod
    def of(cls, pairs) -> _Then:
        def fn(_, *c):
            out = F
            for v, p in zip(c[::2], c[1::2], strict=True):
                out = out.when(p, v)
            return out

        return cls(fn, tuple(e for p, v in pairs for e in (v, p)), "when")

    def when(self, pred) -> _When:
        return _When([(p, v) for v, p in zip(self.kids[::2], self.kids[1::2], strict=True)], pred)

    def otherwise(self, v) -> Expr:
        n = len(self.kids)
        return Expr(lambda x, *c: self.fn(x, *c[:n]).otherwise(c[n]), (*self.kids, to_expr(v)), "when")


def when(pred) -> _When:
    return _When([], pred)


def coalesce(*exprs) -> Expr:
    e = list(map(to_expr, exprs))
    return e[0]._f("coalesce", lambda _, *c: F.coalesce(*c), *e[1:])


def _pair(label: str, fn):
    def make(a, b, *args) -> Expr:
        return to_expr(a)._agg(label, lambda x, p, q: fn(x, F.when(p.isNotNull() & q.isNotNull(), p), F.when(p.isNotNull() & q.isNotNull(), q), *args), b)

    return make


def pearson(a: Column, b: Column, agg=lambda c: c) -> Column:
    """Pearson's correlation of the rows that have both values; NaN where one of them doesn't vary, null without rows.
    Spark's own divides by that zero, which is an error by ANSI's rules."""
    both = a.isNotNull() & b.isNotNull()
    p, q = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.sqrt(agg(F.var_pop(p))) * F.sqrt(agg(F.var_pop(q)))
    return F.when(spread == 0, math.nan).otherwise(agg(F.covar_pop(p, q)) / F.nullif(spread, F.lit(0.0)))


corr = _pair("corr", lambda x, a, b: F.coalesce(pearson(a, b, x.agg), F.lit(math.nan)))


def _cov(x, a, b, ddof=1):
    n = x.agg(F.count(a))
    return F.when(n > ddof, x.agg(F.covar_pop(a, b)) * n / F.nullif(n - ddof, F.lit(0)))


cov = _pair("cov", _cov)


def spearman(a, b) -> Expr:
    """Pearson's correlation of the average ranks, within the group, of the rows that have both values."""

    def fn(x, p, q):
        full = p.isNotNull() & q.isNotNull()

        def ranked(c):
            part = (*x.part, full)
            place = F.rank().over(Window.partitionBy(*part).orderBy(c))
            peers = F.count(F.lit(1)).over(Window.partitionBy(*part, c))
            return x.stage(F.when(full, place + (peers - 1) / 2))

        return F.coalesce(pearson(ranked(p), ranked(q), x.agg), F.lit(math.nan))

    return to_expr(a)._agg("spearman", fn, b)


def rolling_cov(a, b, size: int, **o) -> Expr:
    return to_expr(a)._roll("rolling_cov", size, lambda c, w, d: F.covar_samp(c, d).over(w), b, **o)


def rolling_corr(a, b, size: int, **o) -> Expr:
    return to_expr(a)._roll("rolling_corr", size, lambda c, w, d: pearson(c, d, lambda a: a.over(w)), b, **o)


def _horizontal(label: str, fn):
    def make(*exprs) -> Expr:
        e = [to_expr(v) if not isinstance(v, str) else col(v) for v in exprs]
        return Expr(lambda _, *c: fn(c), tuple(e), label)

    return make


def _sum_h(c):
    total = functools.reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in c])
    return F.when(functools.reduce(lambda a, b: a | b, [v.isNotNull() for v in c]), total)


max_horizontal = _horizontal("max_horizontal", lambda c: F.greatest(*c) if len(c) > 1 else c[0])
min_horizontal = _horizontal("min_horizontal", lambda c: F.least(*c) if len(c) > 1 else c[0])
sum_horizontal = _horizontal("sum_horizontal", _sum_h)
mean_horizontal = _horizontal("mean_horizontal", lambda c: _sum_h(c) / functools.reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in c]))
any_horizontal = _horizontal("any_horizontal", lambda c: functools.reduce(lambda a, b: a | b, c))
all_horizontal = _horizontal("all_horizontal", lambda c: functools.reduce(lambda a, b: a & b, c))
concat_list = _horizontal("concat_list", lambda c: F.concat(*c))
concat_arr = concat_list
hash_rows = _horizontal("hash_rows", lambda c: F.xxhash64(*c))


def is_unique(*exprs) -> Expr:
    return struct(*exprs).is_unique()


def is_duplicated(*exprs) -> Expr:
    return struct(*exprs).is_duplicated()


def concat_str(sep: str, *exprs) -> Expr:
    def fn(c):
        parts = [p for v in c for p in (F.lit(sep), v.cast("string"))][1:]
        return F.concat(*parts)

    return _horizontal("concat_str", fn)(*exprs)


def concat_str_ignore_nulls(sep: str, *exprs) -> Expr:
    return _horizontal("concat_str_ignore_nulls", lambda c: F.concat_ws(sep, *[v.cast("string") for v in c]))(*exprs)


def format_(template: str, *exprs) -> Expr:
    parts = template.split("{}")

    def fn(c):
        out = [F.lit(parts[0])]
        for v, p in zip(c, parts[1:], strict=True):
            out += [v.cast("string"), F.lit(p)]
        return F.concat(*out)

    return _horizontal("format", fn)(*exprs)


def struct(*exprs) -> Expr:
    e = [to_expr(v) if not isinstance(v, str) else col(v) for v in exprs]
    names = [v.name_of() for v in e]
    return Expr(lambda _, *c: F.struct(*[a.alias(n) for a, n in zip(c, names, strict=True)]), tuple(e), "struct")


def fold(acc, fn, *exprs) -> Expr:
    return functools.reduce(fn, [to_expr(e) for e in exprs], to_expr(acc))


def reduce(fn, *exprs) -> Expr:
    return functools.reduce(fn, [to_expr(e) for e in exprs])


def cum_fold(acc, fn, *exprs) -> Expr:
    out, run = [], to_expr(acc)
    for e in map(to_expr, exprs):
        run = fn(run, e)
        out.append(run.alias(e.name_of()))
    return struct(*out)


def cum_reduce(fn, *exprs) -> Expr:
    e = list(map(to_expr, exprs))
    out, run = [e[0]], e[0]
    for v in e[1:]:
        run = fn(run, v)
        out.append(run.alias(v.name_of()))
    return struct(*out)


def cum_sum_horizontal(*exprs) -> Expr:
    return cum_reduce(lambda a, b: a + b, *exprs)


@dataclass(frozen=True)
class SortKey:
    """A sort key; nulls come first in both directions unless told otherwise."""

    expr: Expr
    descending: bool = False
    last: bool = False

    def nulls_first(self) -> SortKey:
        return replace(self, last=False)

    def nulls_last(self) -> SortKey:
        return replace(self, last=True)

    def column(self, ctx: Ctx) -> Column:
        c = self.expr.compile(ctx)
        if self.descending:
            return c.desc_nulls_last() if self.last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.last else c.asc_nulls_first()


def asc(e) -> SortKey:
    return SortKey(col(e) if isinstance(e, str) else to_expr(e))


def desc(e) -> SortKey:
    return SortKey(col(e) if isinstance(e, str) else to_expr(e), descending=True)


def arg_where(pred) -> Expr:
    """Places of the rows where the predicate holds, as a list."""
    return to_expr(pred).arg_true()


def arg_sort_by(*keys) -> Expr:
    """Places of the rows in the order of the keys, nulls first, as a list."""
    e = [k if isinstance(k, SortKey) else asc(k) for k in keys]
    n = range(len(e))

    def fn(*lists):
        rows = F.transform(F.arrays_zip(*[a.alias(f"k{i}") for i, a in enumerate(lists)], F.sequence(F.lit(0), F.size(lists[0]) - 1).alias("at")), lambda p: p)

        def cmp(p, q):
            out = F
            for i in n:
                a, b, down = p[f"k{i}"], q[f"k{i}"], e[i].descending
                null = 1 if e[i].last else -1
                out = out.when(a.isNull() & b.isNotNull(), null).when(a.isNotNull() & b.isNull(), -null)
                out = out.when(a < b, 1 if down else -1).when(a > b, -1 if down else 1)
            return out.otherwise(p["at"] - q["at"])

        return F.transform(F.array_sort(rows, cmp), lambda p: p["at"])

    return e[0].expr._ordered("arg_sort_by", fn, *[k.expr for k in e[1:]])


def element() -> Expr:
    """The element inside list.eval, list.agg and list.filter."""
    return Expr(lambda x: x.element, (), "element", "element", "element")
