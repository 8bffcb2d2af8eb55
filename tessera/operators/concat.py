"""Concatenation, block matrices and tiling as unions with shifted indices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ArgumentError, DimensionMismatch, SparseMatrix, SparseVector
from ..sources.build import spzeros


def joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def as_column(a) -> SparseMatrix:
    return SparseMatrix(a.df.select("i", F.lit(1).cast("long").alias("j"), "v"), a.n, 1) if isinstance(a, SparseVector) else a


def offsets(sizes: list[int]) -> list[int]:
    return [sum(sizes[:k]) for k in range(len(sizes))]


def shift(a: SparseMatrix, di: int, dj: int) -> DataFrame:
    return a.entries.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), "v")


def vcat(*args):
    """One over the other; vectors make a vector."""
    if all(isinstance(a, SparseVector) for a in args):
        at = offsets([a.n for a in args])
        return SparseVector(joined([a.df.select((F.col("i") + k).alias("i"), "v") for a, k in zip(args, at)]), sum(a.n for a in args))
    args = tuple(map(as_column, args))
    if len({a.n for a in args}) != 1:
        raise DimensionMismatch(f"numbers of columns {[a.n for a in args]}")
    at = offsets([a.m for a in args])
    return SparseMatrix(joined([shift(a, k, 0) for a, k in zip(args, at)]), sum(a.m for a in args), args[0].n)


def hcat(*args) -> SparseMatrix:
    args = tuple(map(as_column, args))
    if len({a.m for a in args}) != 1:
        raise DimensionMismatch(f"numbers of rows {[a.m for a in args]}")
    at = offsets([a.n for a in args])
    return SparseMatrix(joined([shift(a, 0, k) for a, k in zip(args, at)]), args[0].m, sum(a.n for a in args))


def hvcat(row_sizes: list[int], *args) -> SparseMatrix:
    """Rows of blocks, of the given numbers of blocks."""
    if any(n < 1 for n in row_sizes) or sum(row_sizes) != len(args):
        raise ArgumentError(f"rows of {row_sizes} blocks don't take {len(args)}")
    at = offsets(row_sizes)
    return vcat(*[hcat(*args[k : k + n]) for k, n in zip(at, row_sizes)])


def cat(*args, dims: int | tuple[int, int]):
    """Along a dimension, or along both as blocks of a diagonal."""
    if dims == 1:
        return vcat(*args)
    if dims == 2:
        return hcat(*args)
    return blockdiag(*map(as_column, args))


def blockdiag(*args: SparseMatrix, spark=None) -> SparseMatrix:
    if not args:
        return spzeros(spark, 0, 0)
    rows, columns = offsets([a.m for a in args]), offsets([a.n for a in args])
    return SparseMatrix(joined([shift(a, i, j) for a, i, j in zip(args, rows, columns)]), sum(a.m for a in args), sum(a.n for a in args))


def repeat(a, m: int, n: int = 1):
    """Tiles; the copies are a generator next to each row, no shuffle."""
    copies = lambda k, c: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(c)
    if m * n == 0:
        return a.of(a.df.limit(0), **({"n": a.n * m} if isinstance(a, SparseVector) and n == 1 else {"m": a.m * m, "n": a.n * n}))
    if isinstance(a, SparseVector):
        if n == 1:
            return SparseVector(a.df.select("i", "v", copies(m, "x")).select((F.col("i") + F.col("x") * a.n).alias("i"), "v"), a.n * m)
        a = as_column(a)
    out = a.entries.select("*", copies(m, "x")).select("*", copies(n, "y"))
    return SparseMatrix(out.select((F.col("i") + F.col("x") * a.m).alias("i"), (F.col("j") + F.col("y") * a.n).alias("j"), "v"), a.m * m, a.n * n)


def pattern_union(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    return a.entries.select("i", "j").union(b.entries.select("i", "j")).distinct()


def pattern_intersect(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    return a.entries.select("i", "j").join(b.entries.select("i", "j"), ["i", "j"], "left_semi")


def pattern_except(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    return a.entries.select("i", "j").join(b.entries.select("i", "j"), ["i", "j"], "left_anti")
