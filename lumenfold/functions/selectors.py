"""Selectors: predicates over a schema, with set algebra."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import types as T

from lumenfold.functions.expr import FLOATS, INTS, ROW, Expr, _match

_NUMERIC = (*INTS, *FLOATS, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


class Selector:
    """A choice of columns; ``expand`` gives their names in the schema's order."""

    def __init__(self, pick: Callable[[T.StructType], list[str]], label: str):
        self.pick, self.label = pick, label

    def expand(self, schema: T.StructType) -> list[str]:
        return self.pick(T.StructType([f for f in schema.fields if f.name != ROW]))

    def expr(self) -> Expr:
        return _match(self.label, self.expand)

    def __str__(self) -> str:
        return self.label

    def _with(self, o: Selector, sign: str, keep) -> Selector:
        def pick(s):
            a, b = set(self.pick(s)), set(o.pick(s))
            return [n for n in s.names if keep(n in a, n in b)]

        return Selector(pick, f"({self} {sign} {o})")

    def union(self, o):
        return self._with(o, "|", lambda a, b: a or b)

    def intersect(self, o):
        return self._with(o, "&", lambda a, b: a and b)

    def difference(self, o):
        return self._with(o, "-", lambda a, b: a and not b)

    def symmetric_difference(self, o):
        return self._with(o, "^", lambda a, b: a != b)

    def complement(self) -> Selector:
        return all_().difference(self)

    def exclude(self, *names: str) -> Selector:
        return self.difference(by_name(*names))

    __or__, __and__, __sub__, __xor__, __invert__ = union, intersect, difference, symmetric_difference, complement


def _names(label: str, test: Callable[[str], bool]) -> Selector:
    return Selector(lambda s: [n for n in s.names if test(n)], label)


def _types(label: str, *kinds) -> Callable[[], Selector]:
    return lambda: Selector(lambda s: [f.name for f in s.fields if isinstance(f.dataType, kinds)], label)


def all_() -> Selector:
    return _names("all", lambda n: True)


def empty() -> Selector:
    return _names("empty", lambda n: False)


def by_name(*names: str) -> Selector:
    return Selector(lambda s: [n for n in names if s[n] is not None], f"by_name({', '.join(names)})")


def by_index(*indices: int) -> Selector:
    return Selector(lambda s: [s.names[i] for i in indices], f"by_index{indices}")


def first() -> Selector:
    return by_index(0)


def last() -> Selector:
    return by_index(-1)


def by_dtype(*kinds) -> Selector:
    return _types("by_dtype", *kinds)()


numeric, integer, floating = _types("numeric", *_NUMERIC), _types("integer", *INTS), _types("float", *FLOATS)
signed_integer, decimal = _types("signed_integer", *INTS), _types("decimal", T.DecimalType)
temporal, date = _types("temporal", *_TEMPORAL), _types("date", T.DateType)
datetime, duration = _types("datetime", T.TimestampType, T.TimestampNTZType), _types("duration", T.DayTimeIntervalType)
string, binary, boolean = _types("string", T.StringType), _types("binary", T.BinaryType), _types("boolean", T.BooleanType)
list_, struct, nested = _types("list", T.ArrayType), _types("struct", T.StructType), _types("nested", T.ArrayType, T.StructType, T.MapType)
unsigned_integer = empty  # Spark has none


def _tagged(key: str, label: str) -> Callable[[], Selector]:
    return lambda: Selector(lambda s: [f.name for f in s.fields if key in f.metadata], label)


enum, categorical, array, time = _tagged("categories", "enum"), _tagged("categorical", "categorical"), _tagged("width", "array"), _tagged("time", "time")


def starts_with(*prefixes: str) -> Selector:
    return _names(f"starts_with{prefixes}", lambda n: n.startswith(prefixes))


def ends_with(*suffixes: str) -> Selector:
    return _names(f"ends_with{suffixes}", lambda n: n.endswith(suffixes))


def contains(*subs: str) -> Selector:
    return _names(f"contains{subs}", lambda n: any(s in n for s in subs))


def matches(pattern: str) -> Selector:
    return _names(f"matches({pattern})", lambda n: bool(re.search(pattern, n)))


def alpha() -> Selector:
    return _names("alpha", str.isalpha)


def digit() -> Selector:
    return _names("digit", str.isdigit)


def alphanumeric() -> Selector:
    return _names("alphanumeric", str.isalnum)
