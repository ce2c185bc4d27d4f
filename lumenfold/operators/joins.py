"""Joins: by keys, by predicates, as-of, sorted merges and updates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.expr import FLOATS, INTS, ROW, Ctx, col, to_expr
from lumenfold.operators.frame import Frame
from lumenfold.operators.temporal import parse

_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def _exprs(keys) -> list:
    keys = keys if isinstance(keys, (list, tuple)) else [keys]
    return [col(k) if isinstance(k, str) else to_expr(k) for k in keys]


def join(left: Frame, right: Frame, on=None, left_on=None, right_on=None, how="inner", suffix="_right", coalesce=None, nulls_equal=False, validate=None, maintain_order=None) -> Frame:
    """An equi-join. Null keys don't match unless ``nulls_equal``. Keys are merged, but for full joins (or as ``coalesce``
    says); other right columns whose names are taken get ``suffix``. validate: 1:1, 1:m or m:1. The planner picks the
    strategy: nothing is hinted."""
    if how == "cross":
        r = right.df.drop(ROW)
        return Frame(left.df.drop(ROW).crossJoin(r.select(*[F.col(f"`{c}`").alias(c + suffix if c in left.columns else c) for c in r.columns])))
    lk, rk = _exprs(on if on is not None else left_on), _exprs(on if on is not None else right_on)
    keep_order = maintain_order in ("left", "right", "left_right")
    if keep_order:
        left, right = (left._row() if maintain_order != "right" else left), (right._row() if maintain_order == "right" else right)
    names = [e.name_of() for e in lk]
    merged = (how != "full") if coalesce is None else coalesce
    ldf, lcols = left.df, left.columns
    rctx = Ctx(right.df)
    rnames = [e.name_of() if e.kind == "col" else None for e in rk]
    rest = [c for c in right.columns if not (merged and c in rnames)]
    out_names = {c: c + suffix if c in lcols else c for c in rest}
    if len(set(out_names.values())) != len(out_names):
        raise ValueError("the suffix makes duplicate names")
    rkeys = [e.compile(rctx).alias(f"__rk{i}") for i, e in enumerate(rk)]
    hidden_r = [F.col(ROW).alias("__rrow")] if maintain_order == "right" else []
    rdf = rctx.staged().select(*rkeys, *[F.col(f"`{c}`").alias(f"__r_{c}") for c in rest], *hidden_r)
    lctx = Ctx(ldf)
    own = [e.name_of() if e.kind == "col" and e.name_of() in lcols and not e.renames else f"__lk{i}" for i, e in enumerate(lk)]
    added = {n: e.compile(lctx) for n, e in zip(own, lk, strict=True) if n not in lcols}
    if added:
        ldf = lctx.staged().withColumns(added)
    if validate in ("1:1", "1:m"):
        ldf = _checked(ldf, own, validate)
    if validate in ("1:1", "m:1"):
        rdf = _checked(rdf, [f"__rk{i}" for i in range(len(rk))], validate)
    pair = [(F.col(f"`{n}`"), F.col(f"__rk{i}")) for i, n in enumerate(own)]
    cond = functools.reduce(lambda a, b: a & b, [a.eqNullSafe(b) if nulls_equal else a == b for a, b in pair])
    if nulls_equal and how == "inner" and len(pair) == 1:
        df = _null_pairs(ldf, rdf, *pair[0])
    elif nulls_equal:
        # the null key's rows multiply: dealt out, they and their pairs are in all tasks where one side is broadcast
        n = int(ldf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = ldf.repartition(n).join(rdf.repartition(n), cond, _HOW[how])
    else:
        df = ldf.join(rdf, cond, _HOW[how])
    order = F.col("__rrow") if maintain_order == "right" else F.col(ROW)
    if how in ("semi", "anti"):
        df = df.orderBy(order) if keep_order and maintain_order != "right" else df
        return Frame(df.select(*[F.col(f"`{c}`") for c in lcols]))
    cols = []
    for c in lcols:
        if merged and c in names and how in ("right", "full"):
            i = names.index(c)
            cols.append(F.coalesce(F.col(f"`{own[i]}`"), F.col(f"__rk{i}")).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    cols += [F.col(f"`__r_{c}`").alias(n) for c, n in out_names.items()]
    if keep_order:
        df = df.orderBy(order)
    return Frame(df.select(*cols))


def _null_pairs(ldf: DataFrame, rdf: DataFrame, a, b) -> DataFrame:
    """The rows whose keys a and b are equal or both null. The null key's rows, all with all, are dealt out on both sides, so
    that many tasks make them whatever the planner does; the others keep as many tasks as there are, however few their bytes."""
    n = int(ldf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = ldf.filter(a.isNotNull()).repartition(n, a).join(rdf.filter(b.isNotNull()).repartition(n, b), a == b)
    few = min(n, 32)
    return full.union(ldf.filter(a.isNull()).repartition(few).crossJoin(rdf.filter(b.isNull()).repartition(few)))


def _checked(df, keys, what):
    """Fail where a key repeats (null keys aside)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    full = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    bad = F.raise_error(F.lit(f"the join isn't {what}")).cast("boolean")
    return df.withColumn("__n", n).filter(F.when(full & (F.col("__n") > 1), bad).otherwise(F.lit(True))).drop("__n")


def _renamed(left: Frame, right: Frame, suffix: str):
    return right.df.drop(ROW).select(*[F.col(f"`{c}`").alias(c + suffix if c in left.columns else c) for c in right.columns])


def join_where(left: Frame, right: Frame, preds, suffix: str = "_right") -> Frame:
    """Inner join by predicates; right columns whose names are taken are named with the suffix in them. Equalities become
    hash or merge keys in the planner, the rest is checked on what they bring together."""
    r = _renamed(left, right, suffix)
    l_ = left.df.drop(ROW)
    both = Ctx(l_.limit(0).crossJoin(r.limit(0)))
    cond = functools.reduce(lambda a, b: a & b, [to_expr(p).compile(both) for p in preds])
    return Frame(l_.join(r, cond, "inner"))


def interval_join(left: Frame, right: Frame, point: str, start: str, end: str, width: int) -> Frame:
    """Rows whose ``point`` lies in [start, end) of a right row, by bins of ``width``: an equi-join on the bin.

    A right row goes to each bin that it touches, so a match is found once. Long intervals make many bins: choose the
    width near their usual length.
    """
    binned = right.df.drop(ROW).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    own = left.df.drop(ROW).withColumn("__bin", F.floor(F.col(point) / width))
    out = own.join(binned, "__bin").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
    return Frame(out.drop("__bin"))


def exists(left: Frame, right: Frame, preds, positive: bool) -> Frame:
    """Rows with (or without) a right row for which all predicates hold; taken names have the suffix ``_right``."""
    r = _renamed(left, right, "_right")
    both = Ctx(left.df.limit(0).crossJoin(r.limit(0)))
    cond = functools.reduce(lambda a, b: a & b, [to_expr(p).compile(both) for p in preds])
    return Frame(left.df.join(r, cond, "left_semi" if positive else "left_anti"))


def join_asof(left: Frame, right: Frame, on=None, left_on=None, right_on=None, by=(), left_by=None, right_by=None, strategy="backward", tolerance=None, suffix="_right", allow_exact_matches=True, coalesce=True) -> Frame:
    """A left join to the nearest right row by ``on`` within equal ``by`` keys: the last one before (backward), the first
    one after (forward), or the nearer of both (nearest; the one before on ties).

    Both sides are stacked and sorted by key once; a window then carries the last right row along. Each row makes one row,
    so nothing multiplies. A right row counts as before a left row of the same instant if exact matches are allowed.
    Without ``by`` the instants are cut into sections of about as many rows, and what lies before (or after) a section is
    the last (first) right row of others: a row for each section; so no task sees all rows.
    """
    lo, ro = (on, on) if on is not None else (left_on, right_on)
    lb, rb = (list(by), list(by)) if left_by is None else (list(left_by), list(right_by))
    lf, rf = left._row(), right._row()
    rest = [c for c in right.columns if c not in rb and not (c == ro and coalesce and lo == ro)]
    name = {c: c + suffix if c in left.columns else c for c in rest}
    kind = left.schema[lo].dataType
    number = lambda c: c.cast("double") if isinstance(kind, FLOATS) else c.cast("long") if isinstance(kind, INTS) else F.unix_micros(c.cast("timestamp"))
    empty = lambda f, cols: F.lit(None).cast(T.StructType([f.schema[c] for c in cols]) if cols else "struct<x:int>")
    pack = lambda cols: F.struct(*[F.col(f"`{c}`") for c in cols])
    kinds = [f"__b{i}" for i in range(len(lb))]
    l_ = lf.df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(lb, kinds, strict=True)], number(F.col(lo)).alias("__t"), F.lit(False).alias("__is_r"), F.col(ROW).alias("__o"), pack(left.columns).alias("__l"), empty(right, right.columns).alias("__r"))
    r_ = rf.df.filter(F.col(ro).isNotNull()).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(rb, kinds, strict=True)], number(F.col(ro)).alias("__t"), F.lit(True).alias("__is_r"), F.col(ROW).alias("__o"), empty(left, left.columns).alias("__l"), pack(right.columns).alias("__r"))
    both = l_.union(r_).withColumn("__c", F.when(F.col("__is_r"), F.struct("__t", "__r")))
    ok = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in kinds], F.lit(True)) & F.col("__t").isNotNull()
    both, edges = (both, None) if kinds else _sections(both)
    part = Window.partitionBy(*kinds) if kinds else Window.partitionBy("__s")
    before = F.last("__c", ignorenulls=True).over(part.orderBy("__t", F.col("__is_r").desc() if allow_exact_matches else F.col("__is_r").asc(), "__o").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__c", ignorenulls=True).over(part.orderBy(F.col("__t").desc(), F.col("__is_r").desc() if allow_exact_matches else F.col("__is_r").asc(), F.col("__o").desc()).rowsBetween(Window.unboundedPreceding, 0))
    if edges is not None:
        before, after = F.coalesce(before, F.col("__low")), F.coalesce(after, F.col("__high"))
    df = both if edges is None else both.join(F.broadcast(edges), F.col("__s") == F.col("__e"))
    if strategy in ("backward", "nearest"):
        df = df.withColumn("__before", before)
    if strategy in ("forward", "nearest"):
        df = df.withColumn("__after", after)
    df = df.filter(~F.col("__is_r"))
    t = F.col("__t")
    if strategy == "nearest":
        b, a = F.col("__before"), F.col("__after")
        hit = F.when(a.isNull() | ((b.isNotNull()) & (t - b["__t"] <= a["__t"] - t)), b).otherwise(a)
    else:
        hit = F.col("__before") if strategy == "backward" else F.col("__after")
    df = df.withColumn("__hit", F.when(ok, hit))
    if tolerance is not None:
        limit = tolerance if isinstance(tolerance, float) else (lambda i: i.steps or i.micros)(parse(tolerance))
        df = df.withColumn("__hit", F.when(F.abs(t - F.col("__hit.__t")) <= limit, F.col("__hit")))
    return Frame(df.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__hit.__r.`{c}`").alias(n) for c, n in name.items()]))


def _sections(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (__t, __is_r, __o, __c) with their section ``__s``; and of each section ``__e`` the nearest right rows before and after it.

    Sections' bounds are approximate quantiles of all instants, as many as there are shuffle partitions; a row's section is
    found by binary search in them. Equal instants are in one section.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("__t", cuts, 100 * n)).first()[0] if cuts else None
    bounds = sorted(set(bounds or []))
    s = F.lit(0)
    if bounds:
        steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        at = lambda a, k: F.coalesce(F.get(F.lit(bounds), a + k - 1) <= F.col("__t"), F.lit(False))
        s = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, k: F.when(at(a, k), a + k).otherwise(a))
    rows = rows.withColumn("__s", s)
    order = F.struct("__t", "__o")
    of = rows.filter("__is_r").groupBy("__s").agg(F.max_by("__c", order).alias("last"), F.min_by("__c", order).alias("first"))
    every = spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("__e"))
    of = every.join(of, F.col("__e") == F.col("__s"), "left")
    w = Window.orderBy("__e")  # a row for each section
    low = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__low")
    high = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__high")
    return rows, of.select("__e", low, high)


def merge_sorted(left: Frame, right: Frame, key: str) -> Frame:
    """Two frames sorted by a key as one; the left one's rows come first among equals."""
    a, b = (f._row().df.withColumn("__side", F.lit(i)) for i, f in enumerate((left, right)))
    out = a.unionByName(b).orderBy(F.col(key).asc_nulls_first(), "__side", ROW)
    return Frame(out.drop("__side", ROW))


def update(left: Frame, right: Frame, on, how: str = "left", include_nulls: bool = False) -> Frame:
    """The left frame with the right one's values where their keys meet; nulls don't overwrite unless they are to."""
    keys = on if isinstance(on, (list, tuple)) else [on]
    fresh = [c for c in right.columns if c in left.columns and c not in keys]
    r = right.df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(True).alias("__m"), *[F.col(c).alias(f"__u_{c}") for c in fresh])
    cond = functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)])
    df = left.df.drop(ROW).join(r, cond, _HOW[how])
    new = lambda c: F.when(F.col("__m"), F.col(f"__u_{c}")).otherwise(F.col(c)) if include_nulls else F.coalesce(F.col(f"__u_{c}"), F.col(c))
    cols = []
    for c in left.columns:
        cols.append(F.coalesce(F.col(c), F.col(f"__k{keys.index(c)}")).alias(c) if c in keys else new(c).alias(c) if c in fresh else F.col(c))
    return Frame(df.select(*cols))
