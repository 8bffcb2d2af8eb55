"""Predicates about values and structure, each one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import SparseMatrix, conj, is_complex, keys, nonzero, rows, shape, zero_of


def truth(df: DataFrame, condition) -> bool:
    return df.agg(F.coalesce(F.bool_and(condition), F.lit(True))).first()[0]


def equal(a, b) -> bool:
    """Equal shapes and values; stored zeros equal unstored ones, NaN equals nothing."""
    if shape(a) != shape(b):
        return False
    return truth(*differing(rows(a), rows(b), keys(a)))


def differing(x: DataFrame, y: DataFrame, k: list[str]):
    both = x.select(*k, "v", F.lit(True).alias("p")).join(y.select(*k, F.col("v").alias("w"), F.lit(True).alias("q")), k, "full")
    v = F.when(F.col("p").isNull(), zero_of(x)).otherwise(F.col("v"))
    w = F.when(F.col("q").isNull(), zero_of(y)).otherwise(F.col("w"))
    if is_complex(x):
        return both, (v.re == w.re) & (v.im == w.im)
    same = v == w
    return both, same & ~F.isnan(v.cast("double")) if x.schema["v"].dataType.typeName() in ("double", "float") else same


def issymmetric(a: SparseMatrix, hermitian: bool = False) -> bool:
    if a.m != a.n:
        return False
    t = a.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), (conj(F.col("v")) if hermitian and is_complex(a.df) else F.col("v")).alias("v"))
    return truth(*differing(a.entries, t, ["i", "j"]))


def ishermitian(a: SparseMatrix) -> bool:
    return issymmetric(a, True)


def isbanded(a: SparseMatrix, low: int, high: int) -> bool:
    """All nonzeros have low <= j - i <= high."""
    return truth(a.entries.where(nonzero(df=a.df)), (F.col("j") - F.col("i")).between(low, high))


def istriu(a: SparseMatrix, k: int = 0) -> bool:
    return isbanded(a, k, max(a.n, k))


def istril(a: SparseMatrix, k: int = 0) -> bool:
    return isbanded(a, min(-a.m, k), k)


def isdiag(a: SparseMatrix) -> bool:
    return isbanded(a, 0, 0)


def iszero(a) -> bool:
    df = rows(a)
    return df.where(nonzero(df=df)).isEmpty()


def isone(a: SparseMatrix) -> bool:
    if a.m != a.n:
        return False
    r = a.entries.where(nonzero(df=a.df)).agg(F.count("*").alias("n"), F.coalesce(F.bool_and((F.col("i") == F.col("j")) & (F.col("v") == 1)), F.lit(True)).alias("ok")).first()
    return r.ok and r.n == a.m


def isperm(p: DataFrame, n: int) -> bool:
    r = p.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    return (r.n, r.d) == (n, n) and (not n or (r.low, r.high) == (1, n))
