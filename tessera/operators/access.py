"""Accessors, reshaping projections, filters and structural deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import ArgumentError, BoundsError, DimensionMismatch, SparseMatrix, SparseVector, all_cells, cells, conj, is_complex, keys, linear, nonzero, rows

Pred = Callable[[Column], Column]


def place(a) -> Column:
    return F.col("i") if isinstance(a, SparseVector) else linear(a.m)


def nnz(a) -> int:
    return rows(a).count()


def literal(f: Callable, *zeros: object) -> object:
    """f at zeros, computed while the plan is built."""
    from pyspark.sql import SparkSession

    return SparkSession.active().range(1).select(f(*[F.lit(z) for z in zeros]).alias("f")).first().f


def count(a, pred: Pred = lambda v: v) -> int:
    """Cells that satisfy pred; unstored ones count as zeros."""
    r = rows(a).agg(F.count("*").alias("stored"), F.count_if(pred(F.col("v"))).alias("true")).first()
    zero = False if rows(a).schema["v"].dataType.typeName() == "boolean" else 0
    unstored = cells(a) - r.stored
    return r.true + (unstored if unstored and literal(pred, zero) else 0)


def findnz(a) -> DataFrame:
    """The stored entries in column-major order."""
    return rows(a).orderBy(*reversed(keys(a)))


def nzrange(a: SparseMatrix) -> DataFrame:
    """First and last place of each column among the stored entries. Columns are counted first, so the ordered window is over columns only."""
    per = a.entries.groupBy("j").agg(F.count("*").alias("n"))
    w = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("j", (F.sum("n").over(w) - F.col("n") + 1).alias("first"), F.sum("n").over(w).alias("last"))


def expandptr(ranges: DataFrame) -> DataFrame:
    """Column ids by place, of ranges (j, first, last)."""
    return ranges.select(F.explode(F.sequence("first", "last")).alias("pos"), "j")


def findall(a, pred: Pred) -> DataFrame:
    """Cells that satisfy pred; the grid is filled in only where zeros satisfy it."""
    df, k = rows(a), keys(a)
    if not literal(pred, 0):
        return df.where(pred(F.col("v"))).select(*k)
    return all_cells(a, "findall").join(df, k, "left").where(pred(F.coalesce("v", F.lit(0)))).select(*k)


def findnext(a, start: int) -> int | None:
    """The place of the first stored nonzero at or after a place."""
    df = rows(a)
    return df.where(nonzero(df=df)).select(place(a).alias("p")).where(F.col("p") >= start).agg(F.min("p")).first()[0]


def findprev(a, start: int) -> int | None:
    df = rows(a)
    return df.where(nonzero(df=df)).select(place(a).alias("p")).where(F.col("p") <= start).agg(F.max("p")).first()[0]


def isstored(a: SparseMatrix, i: int, j: int) -> bool:
    if not (1 <= i <= a.m and 1 <= j <= a.n):
        raise BoundsError((i, j))
    return not a.entries.where((F.col("i") == i) & (F.col("j") == j)).isEmpty()


# ---- projections


def transpose(a: SparseMatrix) -> SparseMatrix:
    flip = {"upper": "lower", "lower": "upper", "unit_upper": "unit_lower", "unit_lower": "unit_upper"}
    if a.structure in ("symmetric", "hermitian"):
        a = a.general()
    return SparseMatrix(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a.n, a.m, flip.get(a.structure, a.structure), a.fixed)


def adjoint(a: SparseMatrix) -> SparseMatrix:
    t = transpose(a)
    return t.of(t.df.withColumn("v", conj(F.col("v")))) if is_complex(t.df) else t


def ftranspose(a: SparseMatrix, f: Callable[[Column], Column]) -> SparseMatrix:
    t = transpose(a.general())
    return t.of(t.df.withColumn("v", f(F.col("v"))))


def permutation(p: DataFrame, n: int) -> DataFrame:
    """A checked permutation (pos, idx)."""
    r = p.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    if (r.n, r.d) != (n, n) or n and (r.low, r.high) != (1, n):
        raise ArgumentError("not a permutation")
    return p


def permute(a: SparseMatrix, p: DataFrame, q: DataFrame) -> SparseMatrix:
    """A[p, q]."""
    out = a.entries.join(permutation(p, a.m).select(F.col("pos").alias("ni"), F.col("idx").alias("i")), "i")
    out = out.join(permutation(q, a.n).select(F.col("pos").alias("nj"), F.col("idx").alias("j")), "j")
    return a.of(out.select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v"), structure="general")


def reshape(a: SparseMatrix, m: int, n: int) -> SparseMatrix:
    if m * n != a.m * a.n:
        raise DimensionMismatch(f"{a.m}x{a.n} has no shape {m}x{n}")
    at = linear(a.m) - 1
    return SparseMatrix(a.entries.select((at % m + 1).alias("i"), (F.floor(at / m) + 1).cast("long").alias("j"), "v"), m, n)


def moved(a: SparseMatrix, i: Column, j: Column, m: int | None = None, n: int | None = None) -> SparseMatrix:
    return SparseMatrix(a.entries.select(i.cast("long").alias("i"), j.cast("long").alias("j"), "v"), m or a.m, n or a.n)


def reverse(a, dims: tuple[int, ...] = (1, 2), start: int = 1, stop: int | None = None):
    i, j = F.col("i"), F.col("j") if isinstance(a, SparseMatrix) else None
    if isinstance(a, SparseVector):
        stop = a.n if stop is None else stop
        return a.of(a.df.withColumn("i", F.when(i.between(start, stop), start + stop - i).otherwise(i)))
    return moved(a, a.m + 1 - i if 1 in dims else i, a.n + 1 - j if 2 in dims else j)


def rot180(a: SparseMatrix) -> SparseMatrix:
    return reverse(a)


def rotr90(a: SparseMatrix) -> SparseMatrix:
    return moved(a, F.col("j"), a.m + 1 - F.col("i"), a.n, a.m)


def rotl90(a: SparseMatrix) -> SparseMatrix:
    return moved(a, a.n + 1 - F.col("j"), F.col("i"), a.n, a.m)


def circshift(a, r: int, c: int = 0):
    i = F.pmod(F.col("i") - 1 + r, F.lit(a.n if isinstance(a, SparseVector) else a.m)) + 1
    if isinstance(a, SparseVector):
        return a.of(a.df.withColumn("i", i.cast("long")))
    return moved(a, i, F.pmod(F.col("j") - 1 + c, F.lit(a.n)) + 1)


def swapped(c: str, x: int, y: int) -> Column:
    return F.when(F.col(c) == x, y).when(F.col(c) == y, x).otherwise(F.col(c))


def swapcols(a: SparseMatrix, x: int, y: int) -> SparseMatrix:
    return moved(a, F.col("i"), swapped("j", x, y))


def swaprows(a: SparseMatrix, x: int, y: int) -> SparseMatrix:
    return moved(a, swapped("i", x, y), F.col("j"))


def diag(a: SparseMatrix, k: int = 0) -> SparseVector:
    size = min(a.m, a.n - k) if k >= 0 else min(a.m + k, a.n)
    if size < 0:
        raise ArgumentError(f"there is no diagonal {k}")
    return SparseVector(a.entries.where(F.col("j") - F.col("i") == k).select(F.least("i", "j").alias("i"), "v"), size)


def trace(a: SparseMatrix):
    if a.m != a.n:
        raise DimensionMismatch("a trace needs a square matrix")
    return a.entries.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]


def shifted(df: DataFrame, by: int) -> DataFrame:
    """Indices between 0-based and 1-based."""
    return df.withColumns({c: F.col(c) + by for c in df.columns if c in ("i", "j")})


# ---- filters


def fkeep(a, keep: Callable[..., Column]):
    """The entries where ``keep`` of the indices and the value holds; with a fixed pattern the others become zeros."""
    df = rows(a)
    test = F.coalesce(keep(*[F.col(c) for c in keys(a)], F.col("v")), F.lit(False))
    if a.fixed:
        return a.of(df.withColumn("v", F.when(test, F.col("v")).otherwise(F.lit(0).cast(df.schema["v"].dataType))))
    return a.of(df.where(test), **({} if isinstance(a, SparseVector) else {"structure": "general"}))


def dropzeros(a):
    """Without stored zeros; missing stays, and a fixed pattern stays whole."""
    if a.fixed:
        return a
    df = rows(a)
    return a.of(df.where(nonzero(df=df)), **({} if isinstance(a, SparseVector) else {"structure": "general"}))


def droptol(a, tol: float):
    """abs(v) > tol, where NaN is not greater."""
    return fkeep(a, lambda *x: (F.abs(x[-1]) > tol) & ~F.isnan(x[-1].cast("double")))


def tril(a: SparseMatrix, k: int = 0) -> SparseMatrix:
    return fkeep(a.general(), lambda i, j, v: i + k >= j)


def triu(a: SparseMatrix, k: int = 0) -> SparseMatrix:
    return fkeep(a.general(), lambda i, j, v: j >= i + k)


def dropstored(a, i: DataFrame | None = None, j: DataFrame | None = None):
    """Without the entries at I x J; a side that is None stands for all. Index lists have a column idx."""
    df = rows(a)
    gone = df
    for c, own in (("i", i), ("j", j)):
        if own is not None:
            gone = gone.join(own.select(F.col("idx").alias(c)).distinct(), c, "left_semi")
    return a.of(df.join(gone.select(*keys(a)), keys(a), "left_anti"))


def fillstored(a, x: object):
    return a.of(a.df.withColumn("v", F.lit(x).cast(a.df.schema["v"].dataType)))


# ---- introspection


def issparse(a: object) -> bool:
    return isinstance(a, SparseMatrix | SparseVector)


def indtype(a) -> str:
    return a.df.schema["i"].dataType.simpleString()


def unwrap(a: SparseMatrix) -> SparseMatrix:
    """The stored rows without the structure that they are read by."""
    return a.of(a.df, structure="general")


def iswrapped(a) -> bool:
    return isinstance(a, SparseMatrix) and a.structure != "general"


def widelength(a) -> int:
    """The number of cells, in integers without bound."""
    return cells(a)
