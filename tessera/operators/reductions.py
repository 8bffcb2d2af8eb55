"""Reductions that count unstored zeros, norms, extrema with positions, differences and sorting.

A reduction is an aggregate of the stored entries, partial before the shuffle, and a part for the zeros that follows from counts. By
``dims`` 1 there is a value for each column, by 2 for each row, and for both, or None, one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import ArgumentError, SparseMatrix, SparseVector, cells, line, nonzero, rows
from .access import literal
from .order import numbered

Fn = Callable[[Column], Column]
same: Fn = lambda v: v


def grouped(a, dims: int | None, aggregates: dict[str, Column]) -> tuple[DataFrame, Column]:
    """A row for each group, empty ones too, and its number of unstored cells as a column."""
    df = rows(a)
    stored = {"_n": F.count("*")} | aggregates
    if dims is None:
        out = df.agg(*[c.alias(n) for n, c in stored.items()])
        return out, F.lit(cells(a)) - F.col("_n")
    key, other, n = ("j", a.m, a.n) if dims == 1 else ("i", a.n, a.m)
    sums = df.groupBy(key).agg(*[c.alias(n) for n, c in stored.items()])
    out = line(a.spark, n).withColumnRenamed("i", key).join(sums, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return out, F.lit(other) - F.col("_n")


def finished(out: DataFrame, value: Column, dims: int | None, what: str = "v") -> DataFrame:
    return out.select(*([] if dims is None else [F.col({1: "j", 2: "i"}[dims])]), value.alias(what))


def zero_value(f: Fn, a) -> object:
    kind = rows(a).schema["v"].dataType.typeName()
    return literal(f, False if kind == "boolean" else 0)


def unstored(a) -> int:
    return cells(a) - rows(a).count()


def sum_(a, f: Fn = same, dims: int | None = None) -> DataFrame:
    f0 = zero_value(f, a) if f is not same else 0
    gone = F.count_if(f(F.col("v")).isNull())
    out, z = grouped(a, dims, {"s": F.sum(f(F.col("v"))), "gone": gone})
    zeros = F.lit(f0) * z if f0 else F.lit(0)
    return finished(out, F.when(F.coalesce("gone", F.lit(0)) == 0, F.coalesce("s", F.lit(0)) + zeros), dims)


def prod(a, f: Fn = same, dims: int | None = None) -> DataFrame:
    """The zeros' part decides where it is zero, whatever is stored."""
    f0 = float(zero_value(f, a))
    out, z = grouped(a, dims, {"s": F.product(f(F.col("v")).cast("double"))})
    zeros = F.pow(F.lit(f0), z)
    return finished(out, F.when((z > 0) & (zeros == 0), F.lit(0.0)).otherwise(F.coalesce("s", F.lit(1.0)) * zeros), dims)


def extreme(a, largest: bool, f: Fn = same, dims: int | None = None) -> DataFrame:
    """Minimum or maximum; NaN wins, and an empty group is an error."""
    if cells(a) == 0 and (dims is None or (a.m if dims == 1 else a.n) == 0):
        raise ArgumentError("nothing to reduce")
    agg, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    value = f(F.col("v"))
    out, z = grouped(a, dims, {"s": agg(value), "nan": F.bool_or(F.isnan(value.cast("double")))})
    full = unstored(a) == 0
    f0 = F.lit(None) if full else F.lit(zero_value(f, a))  # f(0) is not evaluated where nothing is unstored
    plain = F.when(z == 0, F.col("s")).otherwise(F.coalesce(pick(F.col("s"), f0), f0))
    if rows(a).schema["v"].dataType.typeName() in ("double", "float"):
        return finished(out, F.when(F.coalesce("nan", F.lit(False)), F.lit(float("nan"))).otherwise(plain), dims)
    return finished(out, plain, dims)


def minimum(a, f: Fn = same, dims: int | None = None) -> DataFrame:
    return extreme(a, False, f, dims)


def maximum(a, f: Fn = same, dims: int | None = None) -> DataFrame:
    return extreme(a, True, f, dims)


def extrema(a, dims: int | None = None) -> DataFrame:
    low, high = minimum(a, dims=dims), maximum(a, dims=dims)
    k = [] if dims is None else [{1: "j", 2: "i"}[dims]]
    if not k:
        return low.select(F.col("v").alias("min")).crossJoin(high.select(F.col("v").alias("max")))  # one row each
    return low.withColumnRenamed("v", "min").join(high.withColumnRenamed("v", "max"), k)


def any_(a, pred: Fn, dims: int | None = None) -> DataFrame:
    out, z = grouped(a, dims, {"s": F.bool_or(pred(F.col("v")))})
    p0 = F.lit(bool(zero_value(pred, a))) & (z > 0)
    return finished(out, F.coalesce("s", F.lit(False)) | p0, dims)


def all_(a, pred: Fn, dims: int | None = None) -> DataFrame:
    out, z = grouped(a, dims, {"s": F.bool_and(pred(F.col("v")))})
    p0 = F.lit(bool(zero_value(pred, a))) | (z == 0)
    return finished(out, F.coalesce("s", F.lit(True)) & p0, dims)


def count(a, pred: Fn, dims: int | None = None) -> DataFrame:
    out, z = grouped(a, dims, {"s": F.count_if(pred(F.col("v")))})
    zeros = z if zero_value(pred, a) else F.lit(0)
    return finished(out, F.coalesce("s", F.lit(0)) + zeros, dims)


#: Values that a task folds at once.
FOLD = 4096


#: No value given for what is reduced where nothing is stored.
OF_ZEROS = object()


def mapreduce(a, f: Fn, op: Callable[[Column, Column], Column], empty: object = OF_ZEROS) -> object:
    """Any associative op over f of all cells, the stored ones in column-major order, in a tree: runs of FOLD neighbours in a column, then runs of
    those, then columns likewise, so no task gets more than FOLD values at once. The zeros are folded in until nothing changes.
    Where nothing is stored, the result is ``empty``; if that is not given, the fold of the zeros alone."""
    df = rows(a).withColumn("v", f(F.col("v")))
    if isinstance(a, SparseVector):
        df = df.withColumn("j", F.lit(0).cast("long"))
    fold = lambda l: F.aggregate(F.slice(l, 2, F.size(l)), F.get(l, F.lit(0)).v, lambda x, y: op(x, y.v))

    def level(df: DataFrame, by: str, keep: list[str]) -> DataFrame:
        run = F.floor(F.col(by) / FOLD).cast("long").alias("_run")
        return df.groupBy(*keep, run).agg(F.array_sort(F.collect_list(F.struct(by, "v"))).alias("l")).select(*keep, F.col("_run").alias(by), fold(F.col("l")).alias("v"))

    for by, keep, size in (("i", ["j"], a.n if isinstance(a, SparseVector) else a.m), ("j", [], 0 if isinstance(a, SparseVector) else a.n)):
        while size > 0:
            df, size = level(df, by, keep), size // FOLD
        df = df.select("j", "v")
    found = df.first()
    if found is None and empty is not OF_ZEROS:
        return empty
    r = None if found is None else found.v
    z = unstored(a)
    if z == 0:
        return r
    f0 = zero_value(f, a)
    r, z = (f0, z - 1) if r is None else (r, z)
    while z > 0:
        new = literal(op, r, f0)
        if new == r:
            break
        r, z = new, z - 1
    return r


def find_extreme(a, largest: bool, dims: int | None = None) -> DataFrame:
    """(value, position): of equal values the first in column-major order; NaN wins. The first zero place is found by column: a column's first
    gap is where the running number of its stored nonzeros leaves the index."""
    if cells(a) == 0:
        raise ArgumentError("nothing to reduce")
    df = rows(a)
    vector = isinstance(a, SparseVector)
    if vector:
        df = df.withColumn("j", F.lit(1).cast("long"))
    m, n = (a.n, 1) if vector else (a.m, a.n)
    line_of, place_of, lines, size = ("j", "i", n, m) if dims in (None, 1) else ("i", "j", m, n)
    solid = df.where(nonzero(df=df))
    w = Window.partitionBy(line_of).orderBy(place_of)
    run = solid.withColumn("_r", F.row_number().over(w))
    runs = run.groupBy(line_of).agg(F.min(F.when(F.col("_r") != F.col(place_of), F.col("_r"))).alias("_gap"), F.count("*").alias("_n"))
    every = line(a.spark, lines).withColumnRenamed("i", line_of)
    gaps = every.join(runs, line_of, "left").select(line_of, F.when(F.coalesce("_n", F.lit(0)) < size, F.coalesce("_gap", F.coalesce("_n", F.lit(0)) + 1)).cast("long").alias(place_of))
    zeros = gaps.where(F.col(place_of).isNotNull()).withColumn("v", F.lit(0).cast(df.schema["v"].dataType))
    cand = solid.select(line_of, place_of, "v").union(zeros.select(line_of, place_of, "v"))
    nan = F.isnan(F.col("v").cast("double"))
    rank = F.when(nan, F.lit(0)).otherwise(F.lit(1))
    value = -F.col("v") if largest else F.col("v")
    order = F.struct(rank.alias("r"), F.when(~nan, value).alias("o"), F.col("j").alias("j"), F.col("i").alias("i"), F.col("v").alias("v"))
    best = cand.groupBy(*([] if dims is None else [line_of])).agg(F.min(order).alias("b")) if dims else cand.agg(F.min(order).alias("b"))
    cols = [F.col("b.v").alias("v"), F.col("b.i").alias("i")] + ([] if vector else [F.col("b.j").alias("j")])
    return best.select(*cols)


def findmin(a, dims: int | None = None) -> DataFrame:
    return find_extreme(a, False, dims)


def findmax(a, dims: int | None = None) -> DataFrame:
    return find_extreme(a, True, dims)


def norms(a, *ps: float) -> list[float]:
    """Several norms by one pass over the stored values."""
    v = F.abs(F.col("v").cast("double"))
    known = {0: F.count_if(v != 0).cast("double"), 1: F.sum(v), 2: F.sqrt(F.sum(v * v)), float("inf"): F.max(v), float("-inf"): F.min(v)}
    aggs = [known[p] if p in known else F.pow(F.sum(F.pow(v, F.lit(p))), F.lit(1 / p)) for p in ps]
    return list(rows(a).agg(*[F.coalesce(x, F.lit(0.0)).alias(f"p{k}") for k, x in enumerate(aggs)]).first())


def norm(a, p: float = 2) -> float:
    """Over stored values only."""
    return norms(a, p)[0]


def opnorm(a: SparseMatrix, p: float = 1) -> float:
    """The largest absolute column sum (1) or row sum (Inf)."""
    if p == 2 and 1 in (a.m, a.n):
        return norm(a, 2)
    if p not in (1, float("inf")):
        raise ArgumentError("only the norms 1 and Inf of a matrix are computed")
    sums = a.entries.groupBy("j" if p == 1 else "i").agg(F.sum(F.abs("v")).alias("s"))
    return float(sums.agg(F.coalesce(F.max("s"), F.lit(0))).first()[0])


def nnz_slices(a: SparseMatrix, dims: int) -> DataFrame:
    """Stored entries of each column (1) or row (2)."""
    out, _ = grouped(a, dims, {})
    return finished(out, F.col("_n"), dims)


def diff(a: SparseMatrix, dims: int) -> SparseMatrix:
    """Differences of neighbours: each entry counts for one and against the next, a sum without a window. Only what cancels exactly drops."""
    c, size = ("i", a.m) if dims == 1 else ("j", a.n)
    plus = a.entries.where(F.col(c) > 1).withColumn(c, F.col(c) - 1)
    minus = a.entries.where(F.col(c) < size).withColumn("v", -F.col("v"))
    sums = plus.select("i", "j", "v").union(minus.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("k"))
    out = sums.where("k = 1 OR v <> 0 OR v IS NULL").select("i", "j", "v")
    return SparseMatrix(out, max(0, a.m - 1) if dims == 1 else a.m, a.n if dims == 1 else max(0, a.n - 1))


def sort(x: SparseVector, *, descending: bool = False) -> SparseVector:
    """Sorted values: stored zeros stay stored, unstored zeros lie between the signs and move what comes after."""
    z = x.n - x.df.count()
    v = F.col("v")
    ranked = numbered(x.df, [v.desc() if descending else v.asc(), F.col("i").asc()], "_rank")
    after = (v < 0) if descending else (v > 0)
    return x.of(ranked.select((F.col("_rank") + F.when(after, F.lit(z)).otherwise(F.lit(0))).cast("long").alias("i"), "v"))


def ordinal(a) -> DataFrame:
    """The stored entries with their place in column-major order, numbered within columns and offset by column counts."""
    df = rows(a)
    counts = df.groupBy("j").agg(F.count("*").alias("n"))
    w = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("j", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    own = df.withColumn("k", F.row_number().over(Window.partitionBy("j").orderBy("i")))
    return own.join(before, "j").select((F.col("k") + F.col("before")).alias("pos"), "i", "j", "v")
