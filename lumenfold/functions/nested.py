"""``expr.struct``, ``expr.bin`` and ``expr.cat``: structs, bytes and categories."""

from __future__ import annotations

import struct as codec

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.expr import Expr, to_expr


class Structs:
    def __init__(self, e: Expr):
        self.e = e

    def field(self, *names: str) -> Expr:
        if len(names) == 1:
            return self.e._map(f"field[{names[0]}]", lambda c: c.getField(names[0])).alias(names[0])
        return self.e._map("fields", lambda c: F.struct(*[c.getField(n).alias(n) for n in names]))

    def rename_fields(self, *names: str) -> Expr:
        def fn(x, c):
            return c.cast(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, x.type_of(c).fields, strict=True)]))

        return self.e._f("rename_fields", fn)

    def with_fields(self, *exprs) -> Expr:
        names = [to_expr(e).name_of() for e in exprs]

        def fn(_, c, *v):
            for n, a in zip(names, v, strict=True):
                c = c.withField(n, a)
            return c

        return self.e._f("with_fields", fn, *exprs)

    def drop(self, *names: str) -> Expr:
        return self.e._map("drop", lambda c: c.dropFields(*names))

    def json_encode(self) -> Expr:
        return self.e._map("json_encode", lambda c: F.to_json(c, {"ignoreNullFields": "false"}))


class Binaries:
    def __init__(self, e: Expr):
        self.e = e

    def _two(self, label, fn, other) -> Expr:
        return self.e._f(f"bin.{label}", lambda _, a, b: fn(a.cast("binary"), b.cast("binary")), other)

    def contains(self, pattern) -> Expr:
        return self._two("contains", F.contains, pattern)

    def starts_with(self, prefix) -> Expr:
        return self._two("starts_with", F.startswith, prefix)

    def ends_with(self, suffix) -> Expr:
        return self._two("ends_with", F.endswith, suffix)

    def get(self, index: int, null_on_oob: bool = True) -> Expr:
        def fn(c):
            one = F.hex(F.substring(c.cast("binary"), F.lit(index + 1 if index >= 0 else index), F.lit(1)))
            return F.when(one != "", F.conv(one, 16, 10).cast("int"))

        return self.e._map("bin.get", fn)

    def head(self, n: int) -> Expr:
        return self.slice(0, n)

    def tail(self, n: int) -> Expr:
        return self.e._map("bin.tail", lambda c: F.substring(c.cast("binary"), F.greatest(F.octet_length(c) - n, F.lit(0)) + 1, F.lit(n)))

    def slice(self, offset: int, length: int | None = None) -> Expr:
        def fn(c):
            start = F.lit(offset) if offset >= 0 else F.greatest(F.octet_length(c) + offset, F.lit(0))
            return F.substring(c.cast("binary"), start + 1, F.lit(length) if length is not None else F.octet_length(c))

        return self.e._map("bin.slice", fn)

    def size(self, unit: str = "b") -> Expr:
        scale = {"b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}[unit]
        return self.e._map("bin.size", lambda c: F.octet_length(c) if scale == 1 else F.octet_length(c) / scale)

    def encode(self, how: str) -> Expr:
        return self.e._map("bin.encode", lambda c: F.lower(F.hex(c)) if how == "hex" else F.base64(c.cast("binary")))

    def decode(self, how: str, strict: bool = True) -> Expr:
        fn = {"hex": F.unhex, "base64": F.unbase64}[how] if strict else lambda c: F.try_to_binary(c, F.lit(how))
        return self.e._map("bin.decode", lambda c: fn(c.cast("string")))

    def reinterpret(self, kind: str = "long", endianness: str = "little") -> Expr:
        """Bytes as numbers of a fixed width."""
        code = {"byte": "b", "short": "h", "int": "i", "long": "q", "float": "f", "double": "d"}[kind]
        fmt = ("<" if endianness == "little" else ">") + code
        return self.e.map_elements(lambda b: codec.unpack(fmt, b)[0] if len(b) == codec.calcsize(fmt) else None, kind)


class Categories:
    """Text of a fixed list of categories, in the list's order."""

    def __init__(self, e: Expr):
        self.e = e

    def get_categories(self) -> Expr:
        return self.e._agg("get_categories", lambda x, c: F.sort_array(x.agg(F.collect_set(c))))

    def physical(self, categories: list[str]) -> Expr:
        """The place of each value in the list; null where it isn't there."""
        return self.e._map("cat.physical", lambda c: F.nullif(F.array_position(F.array(*map(F.lit, categories)), c), F.lit(0)) - 1)

    def starts_with(self, prefix: str) -> Expr:
        return self.e.str.starts_with(prefix)

    def ends_with(self, suffix: str) -> Expr:
        return self.e.str.ends_with(suffix)

    def len_bytes(self) -> Expr:
        return self.e.str.len_bytes()

    def len_chars(self) -> Expr:
        return self.e.str.len_chars()

    def slice(self, offset: int, length: int | None = None) -> Expr:
        return self.e.str.slice(offset, length)
