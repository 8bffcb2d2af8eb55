"""Sparse matrices and vectors as coordinate relations.

A matrix is a DataFrame ``(i, j, v)`` with 1-based indices, at most one row per cell, and its shape; a vector is ``(i, v)``
with its length. A row is a stored entry, also when its value is zero or null (missing). ``structure`` says how the
rows are to be read (for instance only the upper triangle of a symmetric matrix); ``fixed`` that operators must keep the pattern.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ArgumentError(ValueError):
    pass


class DimensionMismatch(ValueError):
    pass


class BoundsError(IndexError):
    pass


class SingularException(ArithmeticError):
    pass


class PosDefException(ArithmeticError):
    pass


class ZeroPivotException(ArithmeticError):
    pass


class ScalarIndexingError(RuntimeError):
    pass


#: Cells that an operator may fill in when its result is dense; beyond it, an error names the operator.
MAX_DENSE_CELLS = 200_000_000
STRUCTURES = ("general", "symmetric", "hermitian", "upper", "lower", "unit_upper", "unit_lower", "diagonal")


def is_complex(df: DataFrame, c: str = "v") -> bool:
    return df.schema[c].dataType.typeName() == "struct"


def conj(v: Column) -> Column:
    return F.struct(v.re.alias("re"), (-v.im).alias("im"))


def nonzero(v: str = "v", df: DataFrame | None = None) -> Column:
    """Not known to be zero: a null counts as stored nonzero."""
    if df is not None and is_complex(df, v):
        return F.col(v).isNull() | (F.col(v).re != 0) | (F.col(v).im != 0)
    if df is not None and df.schema[v].dataType.typeName() == "boolean":
        return F.col(v).isNull() | F.col(v)
    return F.col(v).isNull() | (F.col(v) != 0)


def zero_of(df: DataFrame, c: str = "v") -> Column:
    t = df.schema[c].dataType
    if t.typeName() == "struct":
        return F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")).cast(t)
    return F.lit(0).cast(t)


def check_dense(cells: int, what: str) -> None:
    if cells > MAX_DENSE_CELLS:
        raise ArgumentError(f"{what} would fill {cells} cells; the limit is {MAX_DENSE_CELLS}")


@dataclass(frozen=True)
class SparseVector:
    df: DataFrame
    n: int
    fixed: bool = False

    def of(self, df: DataFrame, n: int | None = None) -> SparseVector:
        return replace(self, df=df, n=self.n if n is None else n)

    @property
    def spark(self):
        return self.df.sparkSession


@dataclass(frozen=True)
class SparseMatrix:
    df: DataFrame
    m: int
    n: int
    structure: str = "general"
    fixed: bool = False

    def of(self, df: DataFrame, m: int | None = None, n: int | None = None, structure: str | None = None) -> SparseMatrix:
        return replace(self, df=df, m=self.m if m is None else m, n=self.n if n is None else n, structure=structure or self.structure)

    @property
    def spark(self):
        return self.df.sparkSession

    @property
    def entries(self) -> DataFrame:
        """The rows that the structure stands for."""
        df, kind = self.df, self.structure
        if kind == "general":
            return df
        if kind == "diagonal":
            return df.where("i = j")
        if kind in ("symmetric", "hermitian"):
            upper, mirrored = df.where("i <= j"), F.col("v")
            if kind == "hermitian" and is_complex(df):
                mirrored = conj(F.col("v"))
                upper = upper.withColumn("v", F.when(F.col("i") == F.col("j"), F.struct(F.col("v").re.alias("re"), F.lit(0.0).alias("im"))).otherwise(F.col("v")))
            return upper.union(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), mirrored.alias("v")))
        half = df.where({"upper": "i <= j", "lower": "i >= j", "unit_upper": "i < j", "unit_lower": "i > j"}[kind])
        if not kind.startswith("unit"):
            return half
        ones = self.spark.range(1, min(self.m, self.n) + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1).cast(df.schema["v"].dataType).alias("v"))
        return half.union(ones)

    def general(self) -> SparseMatrix:
        return self.of(self.entries, structure="general")

    def validate(self) -> SparseMatrix:
        """Raises where a cell is out of bounds or stored twice."""
        bad = self.df.groupBy("i", "j").count().where(f"count > 1 OR i < 1 OR j < 1 OR i > {self.m} OR j > {self.n}")
        if not bad.isEmpty():
            raise ArgumentError("cells must be unique and inside the matrix")
        return self


def grid(spark, m: int, n: int, what: str = "this operator") -> DataFrame:
    check_dense(m * n, what)
    return spark.range(m * n).select((F.col("id") % max(m, 1) + 1).alias("i"), (F.floor(F.col("id") / max(m, 1)) + 1).cast("long").alias("j"))


def line(spark, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "i")


def linear(m: int) -> Column:
    """The column-major place of a cell, from 1."""
    return (F.col("j") - 1) * m + F.col("i")


def like(a: SparseMatrix | SparseVector, b: SparseMatrix | SparseVector, what: str) -> None:
    if shape(a) != shape(b):
        raise DimensionMismatch(f"{what}: {shape(a)} and {shape(b)}")


def shape(a: SparseMatrix | SparseVector) -> tuple[int, ...]:
    return (a.n,) if isinstance(a, SparseVector) else (a.m, a.n)


def keys(a: SparseMatrix | SparseVector) -> list[str]:
    return ["i"] if isinstance(a, SparseVector) else ["i", "j"]


def rows(a: SparseMatrix | SparseVector) -> DataFrame:
    return a.df if isinstance(a, SparseVector) else a.entries


def cells(a: SparseMatrix | SparseVector) -> int:
    return a.n if isinstance(a, SparseVector) else a.m * a.n


def all_cells(a: SparseMatrix | SparseVector, what: str) -> DataFrame:
    return line(a.spark, a.n) if isinstance(a, SparseVector) else grid(a.spark, a.m, a.n, what)
