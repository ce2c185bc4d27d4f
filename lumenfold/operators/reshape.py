"""Concatenation and reshaping."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from lumenfold.functions.expr import ROW
from lumenfold.operators.frame import Frame


def concat(frames: list[Frame], how: str = "vertical", strict: bool = False) -> Frame:
    """vertical (same columns and types), vertical_relaxed (types meet), diagonal (missing columns are null), horizontal
    (side by side; shorter frames end in nulls), align (joined on the columns they share), align_inner, align_left, align_right."""
    dfs = [f.spark() for f in frames]
    if how.startswith("vertical"):
        if how == "vertical" and any(d.dtypes != dfs[0].dtypes for d in dfs):
            raise ValueError("the frames' columns or types differ")
        return Frame(functools.reduce(lambda a, b: a.unionByName(b), dfs))
    if how.startswith("diagonal"):
        return Frame(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs))
    if how == "horizontal":
        names = [c for d in dfs for c in d.columns]
        if len(set(names)) != len(names):
            raise ValueError("the frames share column names")
        if strict and len({d.count() for d in dfs}) > 1:
            raise ValueError("the frames differ in height")
        numbered = [f.indexed("__i").drop(ROW) for f in frames]
        out = functools.reduce(lambda a, b: a.join(b, "__i", "full"), numbered)
        return Frame(out.orderBy("__i").select(*names))
    if how.startswith("align"):
        kind = {"align": "full", "align_full": "full", "align_inner": "inner", "align_left": "left", "align_right": "right"}[how]
        keys = [c for c in dfs[0].columns if all(c in d.columns for d in dfs)]
        return Frame(functools.reduce(lambda a, b: a.join(b, keys, kind), dfs).orderBy(*keys))
    raise ValueError(f"no such way to concatenate: {how}")


_AGGS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "first": F.first, "last": F.last, "median": F.median, "count": F.count, "len": lambda c: F.count(F.lit(1))}


def pivot(f: Frame, on: str, index, values: str, agg: str | None = None, on_values=None) -> Frame:
    """One column for each value of ``on``. Without an aggregate a cell has at most one value; counts of no rows are 0."""
    index = [index] if isinstance(index, str) else list(index)
    if agg is None:
        bad = F.raise_error(F.lit("a pivot cell has more than one value"))
        fn = F.when(F.count(F.lit(1)) > 1, bad.cast(f.schema[values].dataType)).otherwise(F.max(values))
    else:
        fn = _AGGS[agg](F.col(values))
    g = f.df.groupBy(*index)
    if on_values is None:
        on_values = [r[0] for r in f.df.select(on).distinct().orderBy(on).limit(10_001).collect()]
        if len(on_values) > 10_000:
            raise ValueError("more than 10,000 columns to make")
    out = g.pivot(on, list(on_values)).agg(fn)
    if agg in ("count", "len"):
        out = out.fillna(0, subset=[c for c in out.columns if c not in index])
    return Frame(out)


def unpivot(f: Frame, on=None, index=(), variable: str = "variable", value: str = "value") -> Frame:
    index = [index] if isinstance(index, str) else list(index)
    on = [c for c in f.columns if c not in index] if on is None else list(on)
    return Frame(f.df.drop(ROW).unpivot(index, on, variable, value))


def unstack(f: Frame, step: int, how: str = "vertical", columns=None) -> Frame:
    """Lay columns out in a grid of ``step`` rows (vertical) or ``step`` columns (horizontal)."""
    names = list(columns or f.columns)
    df = f.indexed("__i")
    n = df.count()
    width = -(-n // step) if how == "vertical" else step
    rows = step if how == "vertical" else -(-n // step)
    at = F.col("__i")
    row, place = (at % rows, F.floor(at / rows)) if how == "vertical" else (F.floor(at / width), at % width)
    digits = len(str(max(width - 1, 0)))
    cells = [F.max(F.when(F.col("__c") == k, F.col(c))).alias(f"{c}_{k:0{digits}d}") for c in names for k in range(width)]
    out = df.withColumn("__r", row).withColumn("__c", place).groupBy("__r").agg(*cells).orderBy("__r").drop("__r")
    return Frame(out)


def to_dummies(f: Frame, names=(), separator: str = "_") -> Frame:
    """A column of 0 and 1 for each value of each column."""
    names = list(names) or f.columns
    out = []
    for c in f.columns:
        if c in names:
            values = [r[0] for r in f.df.select(c).distinct().orderBy(c).limit(10_001).collect()]
            if len(values) > 10_000:
                raise ValueError("more than 10,000 columns to make")
            out += [F.col(c).eqNullSafe(F.lit(v)).cast("byte").alias(f"{c}{separator}{'null' if v is None else v}") for v in values]
        else:
            out.append(F.col(c))
    return Frame(f.df.select(*out))


def partition_by(f: Frame, keys) -> dict:
    """A lazy frame for each key; the keys come to the driver."""
    found = f.df.select(*keys).distinct().toLocalIterator()
    same = lambda k: functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.lit(v)) for n, v in zip(keys, k, strict=True)])
    return {tuple(k): Frame(f.df.filter(same(k))) for k in found}
