"""Frame: a lazy table of expressions, and its groups."""

from __future__ import annotations

import functools
import inspect
import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import selectors
from lumenfold.functions.expr import FLOATS, INTS, ROW, Ctx, Expr, SortKey, all_, asc, col, pearson, to_expr

_NUMBERS = (*INTS, *FLOATS, T.DecimalType)
#: Rows of a sample that one task may sort.
_FEW = 1 << 16
#: Results of groups that go back to the JVM at once.
_FRAMES = 2000


def _scalar(e: Expr) -> bool:
    """Whether the expression has one value for a whole frame or group."""
    if e.kind in ("agg", "rowagg", "lit"):
        return True
    if e.kind in ("col", "over", "window", "spread", "match", "element"):
        return False
    return all(_scalar(k) for k in e.kids)


def _as_expr(e) -> Expr:
    if isinstance(e, selectors.Selector):
        return e.expr()
    return col(e) if isinstance(e, str) else to_expr(e)


class Frame:
    """A lazy frame over a Spark DataFrame.

    Row order is that of the source or of the last sort. Where an operator needs it, a hidden column numbers the rows by
    partition and place; it is kept by operators that keep the order, and lost by joins and groups.
    """

    def __init__(self, df: DataFrame):
        self.df = df

    # -- shape -----------------------------------------------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema.fields if f.name != ROW])

    def collect_schema(self) -> T.StructType:
        return self.schema

    @property
    def dtypes(self) -> list[T.DataType]:
        return [f.dataType for f in self.schema.fields]

    @property
    def width(self) -> int:
        return len(self.columns)

    def height(self) -> int:
        return self.df.count()

    count = height

    def shape(self) -> tuple[int, int]:
        return self.height(), self.width

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def get_column_index(self, name: str) -> int:
        return self.columns.index(name)

    def estimated_size(self) -> int:
        """Bytes by the optimizer's statistics."""
        return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def spark(self) -> DataFrame:
        """The Spark DataFrame, without the hidden column."""
        return self.df.drop(ROW)

    def lazy(self) -> Frame:
        return self

    def _need(self, names) -> None:
        missing = [n for n in names if n not in self.columns]
        if missing:
            raise KeyError(f"no such columns: {missing}")

    def _row(self) -> Frame:
        return self if ROW in self.df.columns else Frame(self.df.withColumn(ROW, F.monotonically_increasing_id()))

    def _hidden(self) -> list[Column]:
        return [F.col(ROW)] if ROW in self.df.columns else []

    def _compiled(self, exprs) -> tuple[DataFrame, list[tuple[str, Column]]]:
        """The frame to select from, and named columns. Aggregates among rows are one broadcast row, not a window."""
        exprs = [x for e in exprs for x in _as_expr(e).expand(self.schema)]
        f = self._row() if any(e.has("window", "rowagg", "spread", "over") for e in exprs) else self
        sums: dict[str, Expr] = {}

        def swap(e):
            if e.kind in ("agg", "rowagg"):
                name = f"__s{len(sums)}"
                sums[name] = e
                return col(name).alias(e.name_of())
            return None

        exprs = [e._put(swap).alias(e.name_of()) if e.has("agg", "rowagg") else e for e in exprs]
        df = f.df
        if sums:
            ctx = Ctx(df)
            cols = [e.compile(ctx).alias(n) for n, e in sums.items()]
            df = df.crossJoin(F.broadcast(ctx.staged().agg(*cols)))
        ctx = Ctx(df)
        out = [(e.name_of(), e.compile(ctx)) for e in exprs]
        names = [n for n, _ in out]
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate output names: {sorted(n for n in set(names) if names.count(n) > 1)}")
        return ctx.staged(), out

    # -- projection --------------------------------------------------------------------------------------------------
    def select(self, *exprs) -> Frame:
        flat = [x for e in exprs for x in _as_expr(e).expand(self.schema)]
        if flat and all(_scalar(e) for e in flat) and any(e.has("agg", "rowagg") for e in flat):
            return GroupBy(self, []).agg(*flat)
        df, out = self._compiled(exprs)
        hidden = [F.col(ROW)] if ROW in df.columns else []
        return Frame(df.select(*[c.alias(n) for n, c in out], *hidden))

    select_seq = select

    def with_columns(self, *exprs) -> Frame:
        """Add or replace columns; later expressions see earlier ones."""
        f = self
        for e in exprs:
            df, out = f._compiled([e])
            names = dict(out)
            keep = [c for c in df.columns if c == ROW or c in f.columns]
            own = [names.pop(c).alias(c) if c in names else F.col(f"`{c}`") for c in keep]
            f = Frame(df.select(*own, *[c.alias(n) for n, c in names.items()]))
        return f

    with_columns_seq = with_columns

    def filter(self, *preds) -> Frame:
        preds = [_as_expr(p) for p in preds]
        df, out = self._compiled([p.alias(f"__p{i}") for i, p in enumerate(preds)])
        keep = [F.col(f"`{c}`") for c in df.columns if c == ROW or c in self.df.columns]
        if any(p.has("window", "spread", "over") for p in preds):  # a window can't stand in a filter
            df, out = df.select(*keep, *[c.alias(n) for n, c in out]), [(n, F.col(n)) for n, _ in out]
        df = df.filter(functools.reduce(lambda a, b: a & b, [c for _, c in out]))
        return Frame(df.select(*keep) if len(df.columns) > len(keep) else df)

    def remove(self, *preds) -> Frame:
        return self.filter(*[_as_expr(p).not_() for p in preds])

    def drop(self, *names: str) -> Frame:
        self._need(names)
        return Frame(self.df.drop(*names))

    def rename(self, names: dict[str, str]) -> Frame:
        self._need(names)
        return Frame(self.df.withColumnsRenamed(names))

    def insert_column(self, i: int, e) -> Frame:
        e = _as_expr(e)
        order = self.columns
        order.insert(i, e.name_of())
        return self.with_columns(e).select(*order)

    def replace_column(self, i: int, e) -> Frame:
        old = self.columns[i]
        return self.insert_column(i, e).drop(old) if _as_expr(e).name_of() != old else self.with_columns(e)

    def indexed(self, name: str, start: int = 0) -> DataFrame:
        """The rows with their numbers. Partitions are counted and offset, so no task sees all rows; the rows are kept by
        a reliable checkpoint first, so that both passes see the same partitions."""
        from lumenfold.sources.io import reliable

        held = reliable(self._row().df)
        held = held.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        counts = sorted((r["__pid"], r["count"]) for r in held.groupBy("__pid").count().collect())
        base, total = {}, start
        for pid, n in counts:
            base[pid] = total
            total += n
        offsets = held.sparkSession.createDataFrame(list(base.items()) or [(0, 0)], "__pid int, __base long")
        low = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
        return held.join(F.broadcast(offsets), "__pid").select(*[F.col(f"`{c}`") for c in held.columns if c not in ("__pid", "__at")], (low + F.col("__base")).alias(name))

    def with_row_index(self, name: str = "index", offset: int = 0) -> Frame:
        df = self.indexed(name, offset)
        return Frame(df.select(name, *self.columns, ROW))

    def cast(self, types: dict, strict: bool = True) -> Frame:
        self._need(types)
        return self.with_columns(*[col(n).cast(t) if strict else col(n).cast_lossy(t) for n, t in types.items()])

    def cast_types(self, types: dict, strict: bool = True) -> Frame:
        return self.cast({f.name: types[type(f.dataType)] for f in self.schema.fields if type(f.dataType) in types}, strict)

    def cast_all(self, to, strict: bool = True) -> Frame:
        return self.cast({n: to for n in self.columns}, strict)

    def match_to_schema(self, schema: T.StructType, missing: str = "raise", extra: str = "raise", upcast: bool = False) -> Frame:
        """Coerce: missing columns raise or are inserted as null, extra ones raise or are ignored, numbers may widen."""
        own = {f.name: f.dataType for f in self.schema.fields}
        more = [n for n in own if n not in schema.names]
        if more and extra == "raise":
            raise ValueError(f"extra columns: {more}")
        out = []
        for f in schema.fields:
            if f.name not in own:
                if missing == "raise":
                    raise ValueError(f"missing column: {f.name}")
                out.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif own[f.name] == f.dataType:
                out.append(F.col(f"`{f.name}`"))
            elif upcast and isinstance(own[f.name], _NUMBERS) and isinstance(f.dataType, _NUMBERS):
                out.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
            elif isinstance(f.dataType, T.StructType) and isinstance(own[f.name], T.StructType) and missing == "insert":
                fields = [F.col(f"`{f.name}`.`{g.name}`").alias(g.name) if g.name in own[f.name].names else F.lit(None).cast(g.dataType).alias(g.name) for g in f.dataType.fields]
                out.append(F.struct(*fields).alias(f.name))
            else:
                raise TypeError(f"{f.name}: {own[f.name].simpleString()} isn't {f.dataType.simpleString()}")
        return Frame(self.df.select(*out, *self._hidden()))

    def drop_nulls(self, *subset: str) -> Frame:
        return Frame(self.df.na.drop(subset=list(subset) or self.columns))

    def _floats(self, subset) -> list[str]:
        return [f.name for f in self.schema.fields if isinstance(f.dataType, FLOATS) and (not subset or f.name in subset)]

    def drop_nans(self, *subset: str) -> Frame:
        bad = [F.coalesce(F.isnan(F.col(c)), F.lit(False)) for c in self._floats(subset)]
        return Frame(self.df.filter(~functools.reduce(lambda a, b: a | b, bad))) if bad else self

    def fill_null(self, value=None, *subset: str, strategy: str | None = None) -> Frame:
        names = list(subset) or self.columns
        if strategy:
            fits = names if strategy in ("forward", "backward", "min", "max") else [f.name for f in self.schema.fields if f.name in names and isinstance(f.dataType, _NUMBERS)]
            return self.with_columns(*[col(n).fill_null(strategy) for n in fits])
        return Frame(self.df.na.fill(value, subset=names))

    def fill_nan(self, value, *subset: str) -> Frame:
        return self.with_columns(*[col(n).fill_nan(value) for n in self._floats(subset)])

    def interpolate(self) -> Frame:
        return self.with_columns(*[col(f.name).interpolate() for f in self.schema.fields if isinstance(f.dataType, _NUMBERS)])

    def explode(self, *names: str) -> Frame:
        """Lists to rows, several side by side; an empty or null list gives one null row."""
        self._need(names)
        if len(names) == 1:
            return Frame(self.df.withColumn(names[0], F.explode_outer(names[0])))
        same = functools.reduce(lambda a, b: a & b, [F.size(names[0]).eqNullSafe(F.size(n)) for n in names[1:]])
        bad = F.raise_error(F.lit("exploded lists differ in length"))
        zipped = F.explode_outer(F.when(same, F.arrays_zip(*names)).otherwise(bad))
        df = self.df.withColumn("__z", zipped)
        for n in names:
            df = df.withColumn(n, F.col("__z").getField(n))
        return Frame(df.drop("__z"))

    def unnest(self, *names: str) -> Frame:
        out = []
        for f in self.schema.fields:
            out += [F.col(f"`{f.name}`.`{g}`") for g in f.dataType.names] if f.name in names else [F.col(f"`{f.name}`")]
        return Frame(self.df.select(*out, *self._hidden()))

    def pipe(self, fn: Callable, *args, **kw):
        return fn(self, *args, **kw)

    def clear(self, n: int = 0) -> Frame:
        """The schema, with n rows of nulls."""
        spark = self.df.sparkSession
        return Frame(spark.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]))

    def shift(self, n: int = 1, fill=None) -> Frame:
        return self.select(*[col(c).shift(n, fill) for c in self.columns])

    shift_fill = shift

    def cache(self) -> Frame:
        return Frame(self.df.cache())

    def hash_rows(self, seed: int = 0) -> Frame:
        return Frame(self.df.select(F.xxhash64(F.lit(seed), *self.columns).alias("hash")))

    # -- running -----------------------------------------------------------------------------------------------------
    def collect(self) -> list:
        return self.in_order().collect()

    def in_order(self) -> DataFrame:
        return self.df.orderBy(ROW).drop(ROW) if ROW in self.df.columns else self.df

    def to_arrow(self):
        return self.in_order().toArrow()

    record = to_arrow

    def arrow_schema(self):
        return self.df.limit(0).drop(ROW).toArrow().schema

    def to_pandas(self):
        return self.in_order().toPandas()

    def collect_batches(self, prefetch: bool = True):
        return self.spark().toLocalIterator(prefetchPartitions=prefetch)

    iter_rows = collect_batches

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.collect()]

    def to_maps(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.collect()]

    def rows_by_key(self, key: str) -> dict:
        out: dict = {}
        for r in self.collect():
            out.setdefault(r[key], []).append(r)
        return out

    def collect_into(self, kind) -> list:
        return [kind(**r.asDict()) for r in self.collect()]

    def explain(self, mode: str = "formatted") -> str:
        return self.df._sc._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), mode)

    def optimized(self) -> str:
        """The plan after the optimizer, before a physical strategy is chosen."""
        return self.df._jdf.queryExecution().optimizedPlan().toString()

    def explain_with(self, *, schemas: bool = False, costs: bool = False, codegen: bool = False) -> str:
        """The plan with what is asked for besides: each column's type, statistics, or the generated code."""
        text = self.explain("codegen" if codegen else "cost" if costs else "extended")
        return text + "\n" + self.df._jdf.schema().treeString() if schemas else text

    def err(self) -> Exception | None:
        """What is wrong with the plan, if it can't be analysed; names and types are checked as it is built."""
        from pyspark.errors import AnalysisException

        try:
            self.df.schema
        except AnalysisException as e:
            return e
        return None

    def profile(self):
        """The rows, and how many there were."""
        from pyspark.sql import Observation

        o = Observation()
        rows = self.df.observe(o, F.count(F.lit(1)).alias("rows")).collect()
        return rows, o.get

    def show(self, n: int = 20) -> None:
        self.spark().show(n)

    def glimpse(self, n: int = 5) -> str:
        rows = self.head(n).collect()
        return "\n".join(f"{f.name} <{f.dataType.simpleString()}> {', '.join(str(r[f.name]) for r in rows)}" for f in self.schema.fields)

    def describe(self, percentiles=(0.25, 0.5, 0.75)) -> Frame:
        """count, null_count, mean, std, min, percentiles and max of each column, in one pass."""
        stats: list[tuple[str, Callable]] = [
            ("count", lambda c, num: F.count(c)), ("null_count", lambda c, num: F.count(F.lit(1)) - F.count(c)),
            ("mean", lambda c, num: F.avg(c) if num else F.lit(None)), ("std", lambda c, num: F.stddev_samp(c) if num else F.lit(None)),
            ("min", lambda c, num: F.min(c)),
            *[(f"{q * 100:g}%", lambda c, num, q=q: F.percentile(c, q) if num else F.lit(None)) for q in percentiles],
            ("max", lambda c, num: F.max(c)),
        ]
        cells = [fn(F.col(f"`{f.name}`"), isinstance(f.dataType, _NUMBERS)).cast("string").alias(f"{s}|{f.name}") for s, fn in stats for f in self.schema.fields]
        one = self.df.agg(*cells)
        rows = F.array(*[F.struct(F.lit(s).alias("statistic"), *[F.col(f"`{s}|{c}`").alias(c) for c in self.columns]) for s, _ in stats])
        return Frame(one.select(F.explode(rows).alias("r")).select("r.*"))

    # -- order -------------------------------------------------------------------------------------------------------
    def sort(self, *keys) -> Frame:
        """Stable; nulls first in both directions unless a key says otherwise."""
        f = self._row()
        keys = [k if isinstance(k, SortKey) else asc(k) for k in keys]
        ctx = Ctx(f.df)
        cols = [k.column(ctx) for k in keys]
        df = ctx.staged().orderBy(*cols, F.col(ROW)).select(*[F.col(f"`{c}`") for c in self.columns])
        return Frame(df)

    def head(self, n: int = 5) -> Frame:
        return Frame(self.df.limit(n))

    limit = head

    def first(self) -> Frame:
        return self.head(1)

    def tail(self, n: int = 5) -> Frame:
        f = self._row()
        return Frame(f.df.orderBy(F.desc(ROW)).limit(n).orderBy(ROW))

    def last(self) -> Frame:
        return self.tail(1)

    def slice(self, offset: int, length: int = -1) -> Frame:
        f = self._row()
        if offset < 0:
            f = f.tail(-offset)
            return f if length < 0 else Frame(f.df.orderBy(ROW).limit(length))
        df = f.df.orderBy(ROW).offset(offset)
        return Frame(df if length < 0 else df.limit(length))

    def reverse(self) -> Frame:
        f = self._row()
        return Frame(f.df.orderBy(F.desc(ROW)).drop(ROW))

    def _k(self, k: int, by, largest: bool) -> Frame:
        f, cols = self._row(), []
        for key in by:
            key = key if isinstance(key, SortKey) else asc(key)
            down = key.descending != largest
            cols.append(SortKey(key.expr, down, last=True).column(Ctx(f.df)))
        return Frame(f.df.orderBy(*cols, F.col(ROW)).limit(k).drop(ROW))

    def top_k(self, k: int, *by) -> Frame:
        """The k largest rows, nulls last."""
        return self._k(k, by, True)

    def bottom_k(self, k: int, *by) -> Frame:
        return self._k(k, by, False)

    def gather_every(self, n: int, offset: int = 0) -> Frame:
        df = self.indexed("__i").filter((F.col("__i") >= offset) & ((F.col("__i") - offset) % n == 0))
        return Frame(df.drop("__i"))

    def gather(self, indices: list[int], null_on_oob: bool = False) -> Frame:
        rows = [(k, i) for k, i in enumerate(indices)]
        want = self.df.sparkSession.createDataFrame(rows, "__k long, __j long")
        got = F.broadcast(want).join(self.indexed("__i"), F.col("__j") == F.col("__i"), "left" if null_on_oob else "inner")
        return Frame(got.orderBy("__k").select(*self.columns))

    def _seeded(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col(ROW), *[F.col(f"`{c}`") for c in self.columns])

    def sample_n(self, n: int, with_replacement: bool = False, shuffle: bool = False, seed: int = 0) -> Frame:
        """n rows by a seeded hash."""
        if with_replacement:
            total = self.height()
            return self.gather([hash((seed, k)) % max(total, 1) for k in range(n)])
        f = self._row()
        return Frame(f.df.orderBy(f._seeded(seed), ROW).limit(n)) if n <= _FEW else f._lowest(n, seed)

    def _lowest(self, n: int, seed: int) -> Frame:
        """The n rows of the lowest seeded hashes, for any n: whole ranges of hashes, counted first, and of the range that n
        cuts the lowest ones; so one task sees one of 65,536 ranges. The rows are kept by a reliable checkpoint, so that
        all passes see the same ones."""
        from lumenfold.sources.io import reliable

        held = reliable(self.df.withColumn("__h", self._seeded(seed)))
        part = F.shiftright("__h", 48)
        left = n
        for key, size in sorted((r["__part"], r["count"]) for r in held.groupBy(part.alias("__part")).count().collect()):
            if size > left:
                whole, rest = held.filter(part < key), held.filter(part == key).orderBy("__h", ROW).limit(left)
                return Frame(whole.unionByName(rest).drop("__h"))
            left -= size
        return Frame(held.drop("__h"))

    def sample_fraction(self, fraction: float, with_replacement: bool = False, shuffle: bool = False, seed: int = 0) -> Frame:
        return self.sample_n(int(self.height() * fraction), with_replacement, shuffle, seed)

    def shuffle(self, seed: int = 0) -> Frame:
        f = self._row()
        return Frame(f.df.orderBy(f._seeded(seed), ROW).drop(ROW))

    # -- groups ------------------------------------------------------------------------------------------------------
    def group_by(self, *keys) -> GroupBy:
        return GroupBy(self, [_as_expr(k) for k in keys])

    def group_by_dynamic(self, index: str, every, period=None, offset="0s", closed="left", label="left", include_boundaries=False, by=()) -> GroupBy:
        """Calendar windows over a time or integer column; windows without rows between full ones are kept."""
        from lumenfold.operators.temporal import dynamic

        df, fill = dynamic(self, index, every, period, offset, closed, label, include_boundaries, by)
        g = GroupBy(Frame(df), [])
        g.columns, g.fill, g.hidden = [F.col(c) for c in [*by, "__start"]], fill, {*by, index, "__start"}
        return g

    def rolling(self, index: str, period, closed: str = "right", by=()) -> Rolling:
        """One window for each row: the rows within ``period`` before it."""
        return Rolling(self, index, period, closed, list(by))

    def upsample(self, time: str, every, by=()) -> Frame:
        from lumenfold.operators.temporal import upsample

        return Frame(upsample(self.spark(), time, every, by))

    def rollup(self, *keys: str):
        return self.spark().rollup(*keys)

    def grouping_sets(self, sets: list[list[str]], *keys: str):
        """Groups by each of the sets, which are some of the keys; ``agg`` of PySpark makes the result."""
        return self.spark().groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys])

    def cube(self, *keys: str):
        return self.spark().cube(*keys)

    def _every(self, fn: Callable[[Expr], Expr], numbers: bool = True) -> Frame:
        def one(f):
            if numbers and not isinstance(f.dataType, _NUMBERS):
                return Expr(lambda _: F.max(F.lit(None)), (), "null", "agg", f.name)
            return fn(col(f.name)).alias(f.name)

        return GroupBy(self, []).agg(*[one(f) for f in self.schema.fields])

    def sum(self) -> Frame:
        return self._every(lambda e: e.sum())

    def mean(self) -> Frame:
        return self._every(lambda e: e.mean())

    def median(self) -> Frame:
        return self._every(lambda e: e.median())

    def min(self) -> Frame:
        return self._every(lambda e: e.min(), False)

    def max(self) -> Frame:
        return self._every(lambda e: e.max(), False)

    def std(self, ddof: int = 1) -> Frame:
        return self._every(lambda e: e.std(ddof))

    def var(self, ddof: int = 1) -> Frame:
        return self._every(lambda e: e.var(ddof))

    def quantile(self, q: float, interpolation: str = "linear") -> Frame:
        return self._every(lambda e: e.quantile(q, interpolation))

    def product(self) -> Frame:
        return self._every(lambda e: e.product())

    def null_count(self) -> Frame:
        return self._every(lambda e: e.null_count(), False)

    def value_counts(self, *by) -> Frame:
        return self.group_by(*by).count()

    def n_unique(self, *subset: str) -> int:
        return self.df.select(*(subset or self.columns)).distinct().count()

    def is_unique(self) -> Frame:
        return self.select(Expr(lambda x: F.count(F.lit(1)).over(Window.partitionBy(*self.columns)) == 1, (), "is_unique", "spread", "is_unique"))

    def is_duplicated(self) -> Frame:
        return self.select(Expr(lambda x: F.count(F.lit(1)).over(Window.partitionBy(*self.columns)) > 1, (), "is_duplicated", "spread", "is_duplicated"))

    def corr(self) -> Frame:
        """The matrix of Pearson correlations, in one pass."""
        names = [f.name for f in self.schema.fields if isinstance(f.dataType, _NUMBERS)]
        cells = [F.coalesce(pearson(F.col(f"`{a}`"), F.col(f"`{b}`")), F.lit(math.nan)).alias(f"{a}|{b}") for a in names for b in names]
        rows = F.array(*[F.struct(F.lit(a).alias("column"), *[F.col(f"`{a}|{b}`").alias(b) for b in names]) for a in names])
        return Frame(self.df.agg(*cells).select(F.explode(rows).alias("r")).select("r.*"))

    def sum_horizontal(self) -> Frame:
        from lumenfold.functions.expr import sum_horizontal

        return self.select(sum_horizontal(*self.columns).alias("sum"))

    def mean_horizontal(self) -> Frame:
        from lumenfold.functions.expr import mean_horizontal

        return self.select(mean_horizontal(*self.columns).alias("mean"))

    def min_horizontal(self) -> Frame:
        from lumenfold.functions.expr import min_horizontal

        return self.select(min_horizontal(*self.columns).alias("min"))

    def max_horizontal(self) -> Frame:
        from lumenfold.functions.expr import max_horizontal

        return self.select(max_horizontal(*self.columns).alias("max"))

    def fold(self, fn) -> Frame:
        from lumenfold.functions.expr import reduce

        return self.select(reduce(fn, *[col(c) for c in self.columns]).alias(self.columns[0]))

    # -- distinct and sets -------------------------------------------------------------------------------------------
    def unique(self, *subset: str, keep: str = "first") -> Frame:
        """Distinct rows; with a subset (or keep none) the first, last, any or no row of each key."""
        if not subset and keep in ("first", "last", "any"):
            return Frame(self.spark().distinct())
        names = list(subset) or self.columns
        self._need(names)
        if keep == "any":
            return Frame(self.df.dropDuplicates(names))
        f, part = self._row(), Window.partitionBy(*names)
        if keep == "none":
            return Frame(f.df.withColumn("__n", F.count(F.lit(1)).over(part)).filter("__n = 1").drop("__n"))
        order = F.col(ROW) if keep == "first" else F.desc(ROW)
        return Frame(f.df.withColumn("__n", F.row_number().over(part.orderBy(order))).filter("__n = 1").drop("__n"))

    unique_keep = unique

    def concat(self, *others: Frame, how: str = "vertical") -> Frame:
        from lumenfold.operators.reshape import concat

        return concat([self, *others], how)

    def vstack(self, other: Frame) -> Frame:
        return self.concat(other)

    extend = vstack

    def hstack(self, *others: Frame) -> Frame:
        """Side by side by row number; heights are equal."""
        from lumenfold.operators.reshape import concat

        return concat([self, *others], "horizontal", strict=True)

    def intersect(self, other: Frame) -> Frame:
        return Frame(self.spark().intersect(other.spark()))

    def intersect_all(self, other: Frame) -> Frame:
        return Frame(self.spark().intersectAll(other.spark()))

    def subtract(self, other: Frame) -> Frame:
        return Frame(self.spark().subtract(other.spark()))

    def except_all(self, other: Frame) -> Frame:
        return Frame(self.spark().exceptAll(other.spark()))

    # -- reshape, joins: see the modules -----------------------------------------------------------------------------
    def pivot(self, on: str, index, values: str, agg: str | None = None, on_values=None) -> Frame:
        from lumenfold.operators.reshape import pivot

        return pivot(self, on, index, values, agg, on_values)

    def unpivot(self, on=None, index=(), variable: str = "variable", value: str = "value") -> Frame:
        from lumenfold.operators.reshape import unpivot

        return unpivot(self, on, index, variable, value)

    def transpose(self, header: str) -> Frame:
        return Frame(self.spark().transpose(header))

    def unstack(self, step: int, how: str = "vertical", columns=None) -> Frame:
        from lumenfold.operators.reshape import unstack

        return unstack(self, step, how, columns)

    def to_dummies(self, *names: str, separator: str = "_") -> Frame:
        from lumenfold.operators.reshape import to_dummies

        return to_dummies(self, names, separator)

    def partition_by(self, *keys: str) -> dict:
        from lumenfold.operators.reshape import partition_by

        return partition_by(self, keys)

    def join(self, other: Frame, **options) -> Frame:
        from lumenfold.operators.joins import join

        return join(self, other, **options)

    def join_where(self, other: Frame, *preds, suffix: str = "_right") -> Frame:
        from lumenfold.operators.joins import join_where

        return join_where(self, other, preds, suffix)

    def where_exists(self, other: Frame, *preds) -> Frame:
        from lumenfold.operators.joins import exists

        return exists(self, other, preds, True)

    def where_not_exists(self, other: Frame, *preds) -> Frame:
        from lumenfold.operators.joins import exists

        return exists(self, other, preds, False)

    def join_asof(self, other: Frame, **options) -> Frame:
        from lumenfold.operators.joins import join_asof

        return join_asof(self, other, **options)

    def merge_sorted(self, other: Frame, key: str) -> Frame:
        from lumenfold.operators.joins import merge_sorted

        return merge_sorted(self, other, key)

    def update(self, other: Frame, on, how: str = "left", include_nulls: bool = False) -> Frame:
        from lumenfold.operators.joins import update

        return update(self, other, on, how, include_nulls)

    def map_rows(self, fn: Callable[[dict], dict], schema: str) -> Frame:
        """``fn`` of each row as a dict, in Arrow batches."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(T._parse_datatype_string(schema))

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pylist([fn(r) for r in b.to_pylist()], schema=own)

        return Frame(self.spark().mapInArrow(run, schema))

    def map_columns(self, names: list[str], fn: Callable[[Expr], Expr]) -> Frame:
        return self.with_columns(*[fn(col(n)).alias(n) for n in names])

    # -- sinks: see the sources' module ---------------------------------------------------------------------------------
    def sink_parquet(self, path: str, **o) -> None:
        from lumenfold.sources import io

        io.sink_parquet(self, path, **o)

    def sink_csv(self, path: str, **o) -> None:
        from lumenfold.sources import io

        io.sink_csv(self, path, **o)

    def sink_ndjson(self, path: str, **o) -> None:
        from lumenfold.sources import io

        io.sink_ndjson(self, path, **o)

    def sink_ipc(self, path: str, **o) -> None:
        from lumenfold.sources import io

        io.sink_ipc(self, path, **o)

    def write_ipc(self, sink, **o) -> None:
        from lumenfold.sources import io

        io.write_ipc(self, sink, **o)

    def write_json(self) -> str:
        from lumenfold.sources import io

        return io.to_json(self)

    def write_database(self, url: str, table: str, **o) -> None:
        from lumenfold.sources import io

        io.write_database(self, url, table, **o)

    # -- single values -----------------------------------------------------------------------------------------------
    def row(self, i: int) -> tuple:
        return tuple(self.slice(i, 1).collect()[0])

    def row_named(self, i: int) -> dict:
        return self.slice(i, 1).collect()[0].asDict()

    def row_where(self, pred) -> tuple:
        rows = self.filter(pred).head(2).collect()
        if len(rows) != 1:
            raise ValueError("the predicate doesn't hold for one row alone")
        return tuple(rows[0])

    def item(self, row: int | None = None, column: str | None = None):
        if row is None:
            rows = self.head(2).collect()
            if len(rows) != 1 or len(rows[0]) != 1:
                raise ValueError("item() needs a frame of one row and one column")
            return rows[0][0]
        return self.slice(row, 1).collect()[0][column]

    item_at = at = item

    def to_series(self, i: int = 0) -> Frame:
        return self.select(self.columns[i])

    def column(self, name: str) -> Frame:
        return self.select(name)

    def drop_in_place(self, name: str) -> tuple[Frame, Frame]:
        return self.select(name), self.drop(name)

    def to_struct(self, name: str) -> Frame:
        return Frame(self.df.select(F.struct(*self.columns).alias(name)))

    def equals(self, other: Frame) -> bool:
        """The same rows, however often and in whatever order."""
        a, b = self.spark(), other.spark()
        return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


class GroupBy:
    """Rows by key."""

    def __init__(self, frame: Frame, keys: list[Expr]):
        self.frame, self.order, self.preds = frame, False, []
        self.keys = [x for k in keys for x in k.expand(frame.schema)]
        self.columns: list[Column] | None = None
        self.fill: Callable[[DataFrame, DataFrame], DataFrame] | None = None
        self.hidden: set[str] = set()

    def maintain_order(self) -> GroupBy:
        self.order = True
        return self

    def having(self, *preds) -> GroupBy:
        self.preds += [_as_expr(p) for p in preds]
        return self

    def agg(self, *exprs) -> Frame:
        exprs = [x for e in exprs for x in _as_expr(e).expand(self.frame.schema)]
        f = self.frame._row() if self.order or any(e.has("rowagg", "window") for e in [*exprs, *self.preds]) else self.frame
        ctx = Ctx(f.df, grouped=True)
        if self.columns is None:
            ctx = replace(ctx, part=tuple(k.compile(ctx) for k in self.keys))
        names = [e.name_of() for e in exprs]
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate output names: {names}")
        cols = [e.compile(ctx).alias(n) for e, n in zip(exprs, names, strict=True)]
        tests = [p.compile(ctx).alias(f"__h{i}") for i, p in enumerate(self.preds)]
        order = [F.min(ROW).alias("__first")] if self.order else []
        keys = self.columns if self.columns is not None else [k.compile(ctx).alias(k.name_of()) for k in self.keys]
        df = ctx.staged()
        made = [*(cols or [F.lit(1).alias("__none")]), *tests, *order]
        out = df.groupBy(*keys).agg(*made)
        if self.fill is not None:
            out = self.fill(out, df.filter(F.lit(False)).agg(*made))
        for i in range(len(tests)):
            out = out.filter(F.col(f"__h{i}")).drop(f"__h{i}")
        out = out.drop("__none")
        return Frame(out.orderBy("__first").drop("__first") if self.order else out)

    def _others(self, numbers: bool) -> list[str]:
        names = {k.name_of() for k in self.keys} | self.hidden
        return [f.name for f in self.frame.schema.fields if f.name not in names and (not numbers or isinstance(f.dataType, _NUMBERS))]

    def _each(self, fn: Callable[[Expr], Expr], numbers: bool = False) -> Frame:
        return self.agg(*[fn(col(c)).alias(c) for c in self._others(numbers)])

    def count(self) -> Frame:
        return self.len("count")

    def len(self, name: str = "len") -> Frame:
        from lumenfold.functions.expr import length

        return self.agg(length().alias(name))

    def sum(self) -> Frame:
        return self._each(lambda e: e.sum(), True)

    def mean(self) -> Frame:
        return self._each(lambda e: e.mean(), True)

    def median(self) -> Frame:
        return self._each(lambda e: e.median(), True)

    def quantile(self, q: float, interpolation: str = "linear") -> Frame:
        return self._each(lambda e: e.quantile(q, interpolation), True)

    def min(self) -> Frame:
        return self._each(lambda e: e.min())

    def max(self) -> Frame:
        return self._each(lambda e: e.max())

    def n_unique(self) -> Frame:
        return self._each(lambda e: e.n_unique())

    def first(self) -> Frame:
        return self._each(lambda e: e.first())

    def last(self) -> Frame:
        return self._each(lambda e: e.last())

    def first_non_null(self) -> Frame:
        return self._each(lambda e: e.first_non_null())

    def last_non_null(self) -> Frame:
        return self._each(lambda e: e.last_non_null())

    def all(self) -> Frame:
        return self._each(lambda e: e.implode())

    def _ends(self, n: int, down: bool) -> Frame:
        f = self.frame.with_columns(*self.keys)._row()
        w = Window.partitionBy(*[k.name_of() for k in self.keys]).orderBy(F.desc(ROW) if down else F.col(ROW))
        return Frame(f.df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n"))

    def head(self, n: int = 5) -> Frame:
        """The first rows of each group."""
        return self._ends(n, False)

    def tail(self, n: int = 5) -> Frame:
        return self._ends(n, True)

    def groups(self):
        """(key, frame) for each group, one at a time."""
        names = [k.name_of() for k in self.keys]
        f = self.frame.with_columns(*self.keys)
        for key in f.df.select(*names).distinct().toLocalIterator():
            same = functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.lit(v)) for n, v in zip(names, key, strict=True)])
            yield tuple(key), Frame(f.df.filter(same))

    def map_groups(self, fn: Callable, schema: str) -> Frame:
        """A function of each group's pandas frame, in row order, or of its key and that.

        Groups lie one after the other in batches of rows, and their results go back in batches: a group alone costs Arrow
        and both processes several milliseconds.
        """
        f = self.frame.with_columns(*self.keys)._row()
        names = [k.name_of() for k in self.keys]
        place = F.row_number().over(Window.partitionBy(*names).orderBy(ROW))
        call = fn if len(inspect.signature(fn).parameters) == 1 else lambda g: fn(tuple(g[n].iat[0] for n in names), g)

        def run(batches):
            import pandas as pd

            made, kind = [], None
            for g in _grouped(batches):
                out = call(g)
                now = (tuple(out.columns), tuple(out.dtypes))
                if made and (now != kind or len(made) >= _FRAMES):  # equal types alone, as others would be widened
                    yield pd.concat(made, ignore_index=True)
                    made = []
                made.append(out)
                kind = now
            if made:
                yield pd.concat(made, ignore_index=True)

        return Frame(f.df.withColumn("__n", place).drop(ROW).mapInPandas(run, schema))


def _grouped(batches):
    """The groups of pandas batches whose column __n counts a group's rows from 1; a group may span batches."""
    import numpy as np
    import pandas as pd

    open_ = []
    for b in batches:
        starts = np.flatnonzero(b.pop("__n").to_numpy() == 1)
        edges = [0, *starts, len(b)] if len(starts) else [0, len(b)]
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if i and open_:
                yield open_[0] if len(open_) == 1 else pd.concat(open_, ignore_index=True)
                open_ = []
            if hi > lo:
                open_.append(b.iloc[lo:hi])
                open_[-1].index = pd.RangeIndex(hi - lo)
    if open_:
        yield open_[0] if len(open_) == 1 else pd.concat(open_, ignore_index=True)


class Rolling:
    """A time window for each row."""

    def __init__(self, frame: Frame, index: str, period, closed: str, by: list[str]):
        self.frame, self.index, self.period, self.closed, self.by = frame, index, period, closed, by

    def agg(self, *exprs) -> Frame:
        from lumenfold.operators.temporal import rolling_window

        kind = self.frame.schema[self.index].dataType
        at = F.col(self.index) if isinstance(kind, INTS) else F.unix_micros(F.col(self.index).cast("timestamp"))
        w = rolling_window(at, self.period, self.closed, [F.col(c) for c in self.by])
        ctx = Ctx(self.frame.df, windowed=True, frame=w)
        cols = [e.compile(ctx).alias(e.name_of()) for e in map(_as_expr, exprs)]
        return Frame(ctx.staged().select(*self.by, self.index, *cols))


__all__ = ["Frame", "GroupBy", "Rolling", "all_", "replace"]
