"""``expr.list`` and ``expr.arr``: lists and fixed-width arrays."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.expr import Ctx, Expr, _shuffled, _sorted, quantile_of, to_expr


def _numbers(a: Column) -> Column:
    return F.array_compact(a)


def _sum(a: Column) -> Column:
    full = F.transform(_numbers(a), lambda v: v.cast("double"))
    return F.when(F.size(full) > 0, F.aggregate(full, F.lit(0.0), lambda s, v: s + v))


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(_numbers(a))


def _var(a: Column, ddof: int) -> Column:
    n = F.size(_numbers(a))
    with_mean = F.transform(F.array(_mean(a)), lambda m: F.aggregate(_numbers(a), F.lit(0.0), lambda s, v: s + (v - m) * (v - m)))
    return F.when(n > ddof, F.get(with_mean, F.lit(0)) / F.nullif(n - ddof, F.lit(0)))


class Lists:
    def __init__(self, e: Expr):
        self.e = e

    def _map(self, label, fn) -> Expr:
        return self.e._map(f"list.{label}", fn)

    def _two(self, label, fn, other) -> Expr:
        return self.e._f(f"list.{label}", lambda _, a, b: fn(a, b), other)

    def len(self) -> Expr:
        return self._map("len", lambda a: F.when(a.isNotNull(), F.size(a)))

    def get(self, i) -> Expr:
        return self._two("get", lambda a, i: F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i).cast("int")), i)

    def first(self) -> Expr:
        return self.get(0)

    def last(self) -> Expr:
        return self.get(-1)

    def item(self, allow_empty: bool = False) -> Expr:
        def fn(a):
            bad = F.raise_error(F.lit("item() of a list that doesn't have one element"))
            return F.when(a.isNull() | (F.size(a) == 1) | ((F.size(a) == 0) & F.lit(allow_empty)), F.get(a, F.lit(0))).otherwise(bad)

        return self._map("item", fn)

    def contains(self, v) -> Expr:
        return self._two("contains", lambda a, v: F.exists(a, lambda u: u.eqNullSafe(v)), v)

    def count_matches(self, v) -> Expr:
        return self._two("count_matches", lambda a, v: F.size(F.filter(a, lambda u: u.eqNullSafe(v))), v)

    def eval(self, body: Expr) -> Expr:
        """``body`` of each element, where element() stands for it."""
        return self.e._f("list.eval", lambda x, a: F.transform(a, lambda v: body.compile(replace(x, element=v))))

    def agg(self, body) -> Expr:
        """A function of the whole list (a Column function) for each row."""
        return self._map("agg", body)

    def filter(self, pred: Expr) -> Expr:
        return self.e._f("list.filter", lambda x, a: F.filter(a, lambda v: pred.compile(replace(x, element=v))))

    def min(self) -> Expr:
        return self._map("min", F.array_min)

    def max(self) -> Expr:
        return self._map("max", F.array_max)

    def sum(self) -> Expr:
        def fn(x, a):
            kind = x.type_of(a)
            if kind is not None and isinstance(kind.elementType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                full = _numbers(a)
                zero = F.lit(0).cast("decimal(38,0)")
                return F.when(F.size(full) > 0, F.aggregate(full, zero, lambda s, v: (s + v.cast("decimal(37,0)")).cast("decimal(38,0)")))
            return _sum(a)

        return self.e._f("list.sum", fn)

    def mean(self) -> Expr:
        return self._map("mean", _mean)

    def median(self) -> Expr:
        return self.quantile(0.5)

    def std(self, ddof: int = 1) -> Expr:
        return self._map("std", lambda a: F.sqrt(_var(a, ddof)))

    def var(self, ddof: int = 1) -> Expr:
        return self._map("var", lambda a: _var(a, ddof))

    def quantile(self, q: float, interpolation: str = "linear") -> Expr:
        return self._map("quantile", lambda a: quantile_of(F.sort_array(_numbers(a)), q, interpolation))

    def n_unique(self) -> Expr:
        return self._map("n_unique", lambda a: F.size(F.array_distinct(a)))

    def arg_min(self) -> Expr:
        return self._map("arg_min", lambda a: F.array_position(a, F.array_min(a)) - 1)

    def arg_max(self) -> Expr:
        return self._map("arg_max", lambda a: F.array_position(a, F.array_max(a)) - 1)

    def any(self, ignore_nulls: bool = True) -> Expr:
        return self._map("any", lambda a: F.exists(F.array_compact(a) if ignore_nulls else a, lambda v: v))

    def all(self, ignore_nulls: bool = True) -> Expr:
        return self._map("all", lambda a: F.forall(F.array_compact(a) if ignore_nulls else a, lambda v: v))

    def sort(self, descending: bool = False, nulls_last: bool = False) -> Expr:
        if not descending and not nulls_last:
            return self._map("sort", F.sort_array)
        return self._map("sort", lambda a: _sorted(a, descending, nulls_last))

    sort_with = sort

    def sort_desc(self) -> Expr:
        return self.sort(descending=True)

    def sort_by(self, by: Expr, descending: bool = False) -> Expr:
        def fn(x: Ctx, a):
            pairs = F.transform(a, lambda v, i: F.struct(by.compile(replace(x, element=v)).alias("k"), i.alias("i"), v.alias("v")))
            less = (lambda p, q: p["k"] > q["k"]) if descending else (lambda p, q: p["k"] < q["k"])
            cmp = lambda p, q: F.when(p["k"].eqNullSafe(q["k"]), p["i"] - q["i"]).when(p["k"].isNull(), -1).when(q["k"].isNull(), 1).when(less(p, q), -1).otherwise(1)
            return F.transform(F.array_sort(pairs, cmp), lambda p: p["v"])

        return self.e._f("list.sort_by", fn)

    def sort_by_desc(self, by: Expr) -> Expr:
        return self.sort_by(by, descending=True)

    def reverse(self) -> Expr:
        return self._map("reverse", F.reverse)

    def head(self, n: int = 5) -> Expr:
        return self._map("head", lambda a: F.slice(a, 1, n))

    def tail(self, n: int = 5) -> Expr:
        return self._map("tail", lambda a: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n)))

    def slice(self, offset: int, length: int) -> Expr:
        return self._map("slice", lambda a: F.slice(a, (F.lit(offset) if offset >= 0 else F.greatest(F.size(a) + offset, F.lit(0))) + 1, F.lit(length)))

    def gather(self, indices, null_on_oob: bool = True) -> Expr:
        pick = (lambda a, i: F.get(a, i)) if null_on_oob else (lambda a, i: F.element_at(a, i + 1))
        return self._two("gather", lambda a, idx: F.transform(idx, lambda i: pick(a, F.when(i < 0, F.size(a) + i).otherwise(i).cast("int"))), indices)

    def gather_every(self, n: int, offset: int = 0) -> Expr:
        return self._map("gather_every", lambda a: F.filter(a, lambda _, i: (i >= offset) & ((i - offset) % n == 0)))

    def sample_n(self, n: int, with_replacement: bool = False, shuffle: bool = False, seed: int = 0) -> Expr:
        return self._map("sample_n", lambda a: F.slice(_shuffled(a, seed), 1, n))

    def sample_fraction(self, fraction: float, with_replacement: bool = False, shuffle: bool = False, seed: int = 0) -> Expr:
        return self._map("sample_fraction", lambda a: F.slice(_shuffled(a, seed), F.lit(1), F.floor(F.size(a) * fraction).cast("int")))

    def shift(self, n: int = 1) -> Expr:
        return self._map("shift", lambda a: F.transform(a, lambda v, i: F.when(i - n >= 0, F.get(a, i - n))))

    def diff(self, n: int = 1, drop_nulls: bool = False) -> Expr:
        out = lambda a: F.transform(a, lambda v, i: F.when(i >= n, v - F.get(a, i - n)))
        return self._map("diff", (lambda a: F.slice(out(a), F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))) if drop_nulls else out)

    def unique(self) -> Expr:
        return self._map("unique", F.array_distinct)

    def drop_nulls(self) -> Expr:
        return self._map("drop_nulls", F.array_compact)

    def drop_nans(self) -> Expr:
        return self._map("drop_nans", lambda a: F.filter(a, lambda v: F.coalesce(~F.isnan(v), F.lit(True))))

    def join(self, sep: str) -> Expr:
        return self._map("join", lambda a: F.array_join(a, sep))

    def concat(self, *others) -> Expr:
        return self.e._f("list.concat", lambda _, *a: F.concat(*a), *others)

    def set_union(self, other) -> Expr:
        return self._two("set_union", F.array_union, other)

    def set_intersection(self, other) -> Expr:
        return self._two("set_intersection", F.array_intersect, other)

    def set_difference(self, other) -> Expr:
        return self._two("set_difference", F.array_except, other)

    def set_symmetric_difference(self, other) -> Expr:
        return self._two("set_symmetric_difference", lambda a, b: F.concat(F.array_except(a, b), F.array_except(b, a)), other)

    def to_array(self, width: int) -> Expr:
        return self._map("to_array", lambda a: F.when(a.isNull() | (F.size(a) == width), a).otherwise(F.raise_error(F.lit(f"a list isn't {width} wide"))))

    def to_struct(self, *names: str) -> Expr:
        return self._map("to_struct", lambda a: F.when(a.isNotNull(), F.struct(*[F.get(a, F.lit(i)).alias(n) for i, n in enumerate(names)])))

    def explode(self) -> Expr:
        return self.e.explode()


class Arrays(Lists):
    """Lists of one width; the list functions that keep it do so here too."""

    def to_list(self) -> Expr:
        return self.e

    def dot(self, other) -> Expr:
        """Sum of the products of elements."""
        return self._two("dot", lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v), other)


def int_ranges(start, end, step=1) -> Expr:
    """A list of the integers from start to end (excluded) for each row."""

    def fn(_, a, b, s):
        last = b - F.signum(s).cast("long")
        return F.when(((s > 0) & (a < b)) | ((s < 0) & (a > b)), F.sequence(a, last, s)).otherwise(F.array().cast("array<long>"))

    return to_expr(start)._f("int_ranges", fn, end, step)


def linear_spaces(start, end, n, closed: str = "both") -> Expr:
    def fn(_, a, b, k):
        parts = {"both": k - 1, "left": k, "right": k, "none": k + 1}[closed]
        shift = 0 if closed in ("both", "left") else 1
        width = (b - a) / F.nullif(parts.cast("double"), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: a.cast("double") + F.coalesce(width, F.lit(0.0)) * (i + shift))

    return to_expr(start)._f("linear_spaces", fn, end, n)


def temporal_ranges(start, end, every: str, closed: str = "both") -> Expr:
    """A list of instants for each row; dates stay dates."""
    from lumenfold.operators.temporal import parse

    def fn(_, a, b):
        out = F.sequence(a, b, parse(every).sql())
        if closed in ("right", "none"):
            out = F.filter(out, lambda v: v != a)
        return F.filter(out, lambda v: v != b) if closed in ("left", "none") else out

    return to_expr(start)._f("temporal_ranges", fn, end)


date_ranges = datetime_ranges = temporal_ranges


def time_ranges(start, end, every: str, closed: str = "both") -> Expr:
    """Times of day are microseconds since midnight."""
    from lumenfold.operators.temporal import micros

    def fn(_, a, b):
        out = F.sequence(a, b, F.lit(micros(every)))
        if closed in ("right", "none"):
            out = F.filter(out, lambda v: v != a)
        return F.filter(out, lambda v: v != b) if closed in ("left", "none") else out

    return to_expr(start)._f("time_ranges", fn, end)


def repeat(value, n) -> Expr:
    return to_expr(value).repeat_by(n)


def ones(n) -> Expr:
    return repeat(1.0, n)


def zeros(n) -> Expr:
    return repeat(0.0, n)
