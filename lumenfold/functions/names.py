"""Output names and introspection of expressions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.expr import Expr


class Names:
    """``expr.name``: the output name, and names of struct fields."""

    def __init__(self, e: Expr):
        self.e = e

    def keep(self) -> Expr:
        return self.e.map_name(lambda n: n) if self.e.out is None else self.e.alias(next(iter(self.e.meta.root_names()), self.e.out))

    def map(self, fn) -> Expr:
        return self.e.map_name(fn)

    def prefix(self, p: str) -> Expr:
        return self.e.prefix(p)

    def suffix(self, s: str) -> Expr:
        return self.e.suffix(s)

    def strip_prefix(self, p: str) -> Expr:
        return self.e.map_name(lambda n: n.removeprefix(p))

    def strip_suffix(self, s: str) -> Expr:
        return self.e.map_name(lambda n: n.removesuffix(s))

    def to_lower(self) -> Expr:
        return self.e.map_name(str.lower)

    def to_upper(self) -> Expr:
        return self.e.map_name(str.upper)

    def replace(self, pattern: str, value: str, literal: bool = False) -> Expr:
        return self.e.map_name(lambda n: n.replace(pattern, value) if literal else re.sub(pattern, value, n))

    def map_fields(self, fn) -> Expr:
        def build(x, c):
            kind = x.type_of(c)
            return c.cast(T.StructType([T.StructField(fn(f.name), f.dataType, f.nullable) for f in kind.fields]))

        return self.e._f("map_fields", build)

    def prefix_fields(self, p: str) -> Expr:
        return self.map_fields(lambda n: p + n)

    def suffix_fields(self, s: str) -> Expr:
        return self.map_fields(lambda n: n + s)


class Meta:
    """``expr.meta``: what an expression is made of."""

    def __init__(self, e: Expr):
        self.e = e

    def root_names(self) -> list[str]:
        return list(dict.fromkeys(x.label[4:-1] for x in self.e.walk() if x.kind == "col"))

    def output_name(self) -> str:
        if self.has_multiple_outputs():
            raise ValueError("the expression has many outputs")
        return self.e.name_of()

    def has_multiple_outputs(self) -> bool:
        return self.e.has("match")

    def is_column(self) -> bool:
        return self.e.kind == "col" and self.e.out == self.e.label[4:-1]

    def is_column_selection(self, allow_aliasing: bool = False) -> bool:
        return self.e.kind in ("col", "match") and (allow_aliasing or self.e.kind == "match" or self.is_column())

    def is_literal(self, allow_aliasing: bool = False) -> bool:
        return self.e.kind == "lit" and (allow_aliasing or self.e.out == "literal")

    def is_regex_projection(self) -> bool:
        return any(x.label.startswith(("col_regex", "exclude_regex")) for x in self.e.walk())

    def undo_aliases(self) -> Expr:
        e = self.e
        return e.alias(e.label[4:-1]) if e.kind == "col" else e.alias("literal" if e.kind == "lit" else None)

    def eq(self, other: Expr) -> bool:
        return str(self.e) == str(other) and self.e.out == other.out

    def pop(self) -> list[Expr]:
        return list(self.e.kids)

    def tree_format(self) -> str:
        def lines(e, depth):
            yield "  " * depth + e.label
            for k in e.kids:
                yield from lines(k, depth + 1)

        return "\n".join(lines(self.e, 0))


__all__ = ["Meta", "Names", "F"]
