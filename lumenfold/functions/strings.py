"""``expr.str``: text functions."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.expr import Expr, to_expr
from lumenfold.functions.temporal import java_format


#: What a text has that a normal form changes: others are the form already.
_CHANGED = {"NFC": r"[^\x{0}-\x{2FF}]", "NFD": r"[^\x{0}-\x{BF}]", "NFKC": r"[^\x{0}-\x{9F}]", "NFKD": r"[^\x{0}-\x{9F}]"}
#: Texts that Python holds at once as objects.
_PIECE = 64


def quote(s: str) -> str:
    """A literal as a Java regular expression."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _replacement(s: str, literal: bool) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$") if literal else s


def _any_of(patterns: list[str], insensitive: bool, longest_first: bool = False) -> str:
    p = sorted(patterns, key=len, reverse=True) if longest_first else patterns
    return ("(?i)" if insensitive else "") + "|".join(map(quote, p))


class Strings:
    def __init__(self, e: Expr):
        self.e = e

    def _map(self, label, fn) -> Expr:
        return self.e._map(f"str.{label}", fn)

    def _two(self, label, fn, other) -> Expr:
        return self.e._f(f"str.{label}", lambda _, a, b: fn(a, b), other)

    def contains(self, pattern, literal: bool = False) -> Expr:
        if isinstance(pattern, Expr):
            return self._two("contains", F.contains if literal else F.rlike, pattern)
        return self._map("contains", lambda c: c.contains(pattern) if literal else c.rlike(pattern))

    def starts_with(self, prefix) -> Expr:
        return self._two("starts_with", F.startswith, prefix)

    def ends_with(self, suffix) -> Expr:
        return self._two("ends_with", F.endswith, suffix)

    def find(self, pattern: str, literal: bool = False) -> Expr:
        """Byte offset of the first match, or null."""

        def fn(c):
            at = F.instr(c, pattern) if literal else F.regexp_instr(c, F.lit(pattern))
            return F.when(at > 0, F.octet_length(F.substring(c, F.lit(1), at - 1)))

        return self._map("find", fn)

    def count_matches(self, pattern: str, literal: bool = False) -> Expr:
        return self._map("count_matches", lambda c: F.regexp_count(c, F.lit(quote(pattern) if literal else pattern)))

    def extract(self, pattern: str, group: int = 1) -> Expr:
        return self._map("extract", lambda c: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)))

    def extract_all(self, pattern: str) -> Expr:
        return self._map("extract_all", lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))

    def extract_groups(self, pattern: str) -> Expr:
        """A struct of the capture groups, by name or number."""
        found = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
        names = {i: n for n, i in found.groupindex.items()}

        def fn(c):
            parts = [F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i)).alias(names.get(i, str(i))) for i in range(1, found.groups + 1)]
            return F.struct(*parts)

        return self._map("extract_groups", fn)

    def replace(self, pattern: str, value, literal: bool = False) -> Expr:
        return self.replace_n(pattern, value, literal, 1)

    def replace_all(self, pattern: str, value, literal: bool = False) -> Expr:
        if literal:
            return self._two("replace_all", lambda c, v: F.replace(c, F.lit(pattern), v), value)
        return self._map("replace_all", lambda c: F.regexp_replace(c, pattern, value))

    def replace_n(self, pattern: str, value, literal: bool = False, n: int = 1) -> Expr:
        """The first n matches: each step replaces the first match behind what is done already."""
        p = quote(pattern) if literal else pattern

        def once(done: Column, rest: Column, v: Column):
            at = F.regexp_instr(rest, F.lit(p))
            hit = F.regexp_extract(rest, p, 0)
            new = v if literal or isinstance(value, Expr) else F.regexp_replace(hit, p, value)
            return (
                F.when(at > 0, F.concat(done, F.substring(rest, F.lit(1), at - 1), new)).otherwise(done),
                F.when(at > 0, F.substring(rest, at + F.char_length(hit), F.char_length(rest))).otherwise(rest),
            )

        def fn(c, v):
            done, rest = F.lit(""), c
            for _ in range(n):
                done, rest = once(done, rest, v)
            return F.concat(done, rest)

        return self._two("replace_n", fn, value)

    def contains_any(self, patterns: list[str], ascii_case_insensitive: bool = False) -> Expr:
        return self._map("contains_any", lambda c: c.rlike(_any_of(patterns, ascii_case_insensitive)))

    def replace_many(self, patterns: list[str], replace_with: list[str], ascii_case_insensitive: bool = False, leftmost: bool = False) -> Expr:
        """All patterns at once: what one replacement writes isn't replaced again."""
        new = replace_with * len(patterns) if len(replace_with) == 1 else replace_with
        p = _any_of(patterns, ascii_case_insensitive, longest_first=leftmost)

        def fn(c):
            gaps, hits = F.split(c, p, -1), F.regexp_extract_all(c, F.lit(p), F.lit(0))
            pick = F
            for a, b in zip(patterns, new, strict=True):
                pick = lambda h, pick=pick, a=a, b=b: (pick.when if pick is F else pick(h).when)(F.lower(h) == a.lower() if ascii_case_insensitive else h == a, b)
            done = F.transform(hits, lambda h: pick(h).otherwise(h))
            return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(done, i), F.lit("")))), "")

        return self._map("replace_many", fn)

    def extract_many(self, patterns: list[str], ascii_case_insensitive: bool = False, overlapping: bool = False, leftmost: bool = False) -> Expr:
        if overlapping:
            return self._many("extract_many", patterns, ascii_case_insensitive, "array<string>", lambda t, at, n: t[at : at + n])
        p = _any_of(patterns, ascii_case_insensitive, longest_first=leftmost)
        return self._map("extract_many", lambda c: F.regexp_extract_all(c, F.lit(p), F.lit(0)))

    def find_many(self, patterns: list[str], ascii_case_insensitive: bool = False, overlapping: bool = False, leftmost: bool = False) -> Expr:
        """Byte offsets of the matches."""
        if not overlapping:
            p = re.compile("|".join(map(re.escape, sorted(patterns, key=len, reverse=True) if leftmost else patterns)), re.I | re.A if ascii_case_insensitive else 0)
            return self.e.map_batches(lambda s: s.map(lambda t: [len(t[: m.start()].encode()) for m in p.finditer(t)], na_action="ignore"), "array<int>")
        return self._many("find_many", patterns, ascii_case_insensitive, "array<int>", lambda t, at, n: len(t[:at].encode()))

    def _many(self, label, patterns, fold, kind, pick) -> Expr:
        def one(t):
            low = t.lower() if fold else t
            found = [(i, len(p)) for p in patterns for i in range(len(t)) if low.startswith(p.lower() if fold else p, i)]
            return [pick(t, i, n) for i, n in sorted(found, key=lambda f: (f[0] + f[1], f[0]))]

        return self.e.map_batches(lambda s: s.map(one, na_action="ignore"), kind)

    def to_lower(self) -> Expr:
        return self._map("to_lower", F.lower)

    def to_upper(self) -> Expr:
        """Letter by letter: a sharp s stays one letter."""
        return self._map("to_upper", lambda c: F.array_join(F.transform(F.split(c, "ß", -1), F.upper), "ß"))

    def to_titlecase(self) -> Expr:
        def fn(c):
            words = F.regexp_extract_all(F.lower(c), F.lit("\\p{L}+|\\P{L}+"), F.lit(0))
            return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))), "")

        return self._map("to_titlecase", fn)

    def len_bytes(self) -> Expr:
        return self._map("len_bytes", F.octet_length)

    def len_chars(self) -> Expr:
        return self._map("len_chars", F.char_length)

    def slice(self, offset: int, length: int | None = None) -> Expr:
        def fn(c):
            n = F.char_length(c)
            start = F.lit(offset) if offset >= 0 else F.greatest(n + offset, F.lit(0))
            size = F.lit(length) if length is not None else n
            if offset < 0 and length is not None:
                size = F.greatest(F.lit(0), F.lit(length) + F.least(n + offset, F.lit(0)))
            return F.substring(c, start + 1, size)

        return self._map("slice", fn)

    def head(self, n: int) -> Expr:
        return self._map("head", lambda c: F.substring(c, F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.char_length(c) + n, F.lit(0))))

    def tail(self, n: int) -> Expr:
        return self._map("tail", lambda c: F.substring(c, F.greatest(F.char_length(c) - n, F.lit(0)) + 1 if n >= 0 else F.lit(1 - n), F.char_length(c)))

    def strip_chars(self, chars: str = " \t\n\r\x0b\f") -> Expr:
        return self._map("strip_chars", lambda c: F.btrim(c, F.lit(chars)))

    def strip_chars_start(self, chars: str = " \t\n\r\x0b\f") -> Expr:
        return self._map("strip_chars_start", lambda c: F.ltrim(c, F.lit(chars)))

    def strip_chars_end(self, chars: str = " \t\n\r\x0b\f") -> Expr:
        return self._map("strip_chars_end", lambda c: F.rtrim(c, F.lit(chars)))

    def strip_prefix(self, prefix) -> Expr:
        return self._two("strip_prefix", lambda c, p: F.when(F.startswith(c, p), F.substring(c, F.char_length(p) + 1, F.char_length(c))).otherwise(c), prefix)

    def strip_suffix(self, suffix) -> Expr:
        return self._two("strip_suffix", lambda c, p: F.when(F.endswith(c, p), F.substring(c, F.lit(1), F.char_length(c) - F.char_length(p))).otherwise(c), suffix)

    def pad_start(self, width: int, fill: str = " ") -> Expr:
        return self._map("pad_start", lambda c: F.when(F.char_length(c) >= width, c).otherwise(F.lpad(c, width, fill)))

    def pad_end(self, width: int, fill: str = " ") -> Expr:
        return self._map("pad_end", lambda c: F.when(F.char_length(c) >= width, c).otherwise(F.rpad(c, width, fill)))

    def zfill(self, width: int) -> Expr:
        def fn(c):
            sign = F.regexp_extract(c, "^[+-]", 0)
            rest = F.substring(c, F.char_length(sign) + 1, F.char_length(c))
            pad = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.char_length(c), F.lit(0)))
            return F.concat(sign, pad, rest)

        return self._map("zfill", fn)

    def reverse(self) -> Expr:
        return self._map("reverse", F.reverse)

    def split(self, by) -> Expr:
        return self._two("split", lambda c, b: F.split(c, F.concat(F.lit("\\Q"), b, F.lit("\\E"))), by)

    def split_inclusive(self, by: str) -> Expr:
        return self._map("split_inclusive", lambda c: F.filter(F.split(c, f"(?<={quote(by)})"), lambda p: p != ""))

    def split_n(self, by: str, n: int) -> Expr:
        """A struct of n parts; the last one has the rest."""
        return self._map("split_n", lambda c: F.struct(*[F.get(F.split(c, quote(by), n), F.lit(i)).alias(f"field_{i}") for i in range(n)]))

    def split_exact(self, by: str, n: int, inclusive: bool = False) -> Expr:
        p = f"(?<={quote(by)})" if inclusive else quote(by)
        return self._map("split_exact", lambda c: F.struct(*[F.get(F.split(c, p), F.lit(i)).alias(f"field_{i}") for i in range(n + 1)]))

    def join(self, sep: str = "") -> Expr:
        """An aggregate: the group's texts in row order, nulls skipped."""
        return self.e._ordered("str.join", lambda a: F.array_join(F.array_compact(a), sep))

    def encode(self, how: str) -> Expr:
        """Base64 without the line breaks that Spark puts after every 76 characters."""
        return self._map("encode", lambda c: F.lower(F.hex(c)) if how == "hex" else F.translate(F.base64(c.cast("binary")), "\r\n", ""))

    def decode(self, how: str, strict: bool = True) -> Expr:
        fn = {"hex": F.unhex, "base64": F.unbase64}[how] if strict else lambda c: F.try_to_binary(c, F.lit(how))
        return self._map("decode", lambda c: fn(c).cast("string"))

    def to_integer(self, base: int = 10, strict: bool = True) -> Expr:
        if base == 10:
            return self._map("to_integer", lambda c: c.cast("long") if strict else c.try_cast("long"))
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
        ok = f"(?i)^[+-]?[{digits}]+$"
        bad = (lambda: F.raise_error(F.lit("not an integer")).cast("long")) if strict else lambda: F.lit(None).cast("long")
        return self._map("to_integer", lambda c: F.when(c.isNull() | c.rlike(ok), F.conv(c, base, -10).cast("long")).otherwise(bad()))

    def to_decimal(self, scale: int = 0) -> Expr:
        return self._map("to_decimal", lambda c: F.round(c.try_cast(f"decimal(38,{min(scale + 6, 37)})"), scale).cast(f"decimal(38,{scale})"))

    def to_date(self, fmt: str | None = None, strict: bool = True) -> Expr:
        java = java_format(fmt) if fmt else None
        if strict:
            return self._map("to_date", lambda c: F.to_date(c, java) if java else F.to_date(c))
        return self._map("to_date", lambda c: F.try_to_timestamp(c, F.lit(java)).cast("date") if java else c.try_cast("date"))

    def to_datetime(self, fmt: str | None = None, strict: bool = True) -> Expr:
        java = java_format(fmt) if fmt else None
        if strict:
            return self._map("to_datetime", lambda c: F.to_timestamp_ntz(c, F.lit(java)) if java else c.cast("timestamp_ntz"))
        return self._map("to_datetime", lambda c: F.try_to_timestamp(c, F.lit(java)).cast("timestamp_ntz") if java else c.try_cast("timestamp_ntz"))

    def to_time(self, fmt: str = "%H:%M:%S", strict: bool = True) -> Expr:
        """Microseconds since midnight."""
        return self.to_datetime(fmt, strict)._map("to_time", lambda c: F.unix_micros(c.cast("timestamp")) - F.unix_micros(F.date_trunc("day", c).cast("timestamp")))

    def strptime(self, kind: str, fmt: str, strict: bool = True) -> Expr:
        return {"date": self.to_date, "datetime": self.to_datetime, "time": self.to_time}[kind](fmt, strict)

    def json_path_match(self, path: str) -> Expr:
        return self._map("json_path_match", lambda c: F.get_json_object(c, path))

    def json_decode(self, kind) -> Expr:
        return self._map("json_decode", lambda c: F.from_json(c, kind))

    def normalize(self, form: str = "NFC") -> Expr:
        """Texts with a character that the form may change go to Python, in Arrow's form and few at a time; others stay as they are."""

        def fn(c):
            from pyspark.sql.functions import arrow_udf

            # annotated by hand: the module's annotations are texts
            def run(texts):
                pieces = [pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.slice(i, _PIECE).to_pylist()], pa.string()) for i in range(0, len(texts), _PIECE)]
                return pa.concat_arrays(pieces) if pieces else texts.cast(pa.string())

            run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
            return F.coalesce(arrow_udf(run, "string")(F.when(c.rlike(_CHANGED[form]), c)), c)

        return self._map("normalize", fn)

    def escape_regex(self) -> Expr:
        return self._map("escape_regex", lambda c: F.regexp_replace(c, r"([\\.+*?()|\[\]{}^$\-#&~])", r"\\$1"))


__all__ = ["Strings", "quote", "to_expr"]
