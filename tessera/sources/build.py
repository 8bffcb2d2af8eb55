"""Constructors and sinks: triplets, dense and banded data, identities, random matrices, densifying and conversions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import ArgumentError, DimensionMismatch, SparseMatrix, SparseVector, all_cells, cells, check_dense, is_complex, keys, nonzero, rows, zero_of

#: Combining functions of duplicates that are aggregates of their own.
MONOIDS: dict[str, Callable[[str], Column]] = {"+": F.sum, "*": F.product, "min": F.min, "max": F.max, "|": F.bool_or, "&": F.bool_and}


def combined(df: DataFrame, by: list[str], combine: str | Callable[[Column, Column], Column] | None, order: str | None) -> DataFrame:
    """One row per cell. Monoids aggregate on both sides of the shuffle; any other function folds a cell's values in the order of column ``order``."""
    kind = df.schema["v"].dataType
    if combine is None:
        combine = "|" if kind.typeName() == "boolean" else "+"
    if isinstance(combine, str):
        if combine == "+" and is_complex(df):
            return df.groupBy(*by).agg(F.struct(F.sum("v.re").alias("re"), F.sum("v.im").alias("im")).alias("v"))
        gone = F.count_if(F.col("v").isNull()) > 0  # aggregates skip nulls, sums must not
        return df.groupBy(*by).agg(F.when(gone, F.lit(None)).otherwise(MONOIDS[combine]("v")).cast(kind).alias("v"))
    if order is None:
        raise ArgumentError("a fold needs a column that gives the order of the triplets")
    listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col("v").alias("v")))).alias("l"))
    return listed.select(*by, F.aggregate(F.slice("l", 2, F.size("l")), F.get("l", F.lit(0)).v, lambda a, x: combine(a, x.v).cast(kind)).alias("v"))


def inferred(df: DataFrame, c: str) -> int:
    return int(df.agg(F.max(c)).first()[0] or 0)


def checked(df: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """The rows; running into an index out of bounds is an error of the job, so no pass of its own is needed."""
    for c, n in bounds.items():
        if n < 0:
            raise ArgumentError("dimensions must not be negative")
        df = df.withColumn(c, F.when((F.col(c) < 1) | (F.col(c) > n), F.raise_error(F.concat(F.lit(f"{c} must be in 1..{n}, not "), F.col(c).cast("string")))).otherwise(F.col(c)).cast("long"))
    return df


def sparse(df: DataFrame, m: int | None = None, n: int | None = None, combine=None, *, order: str | None = None, check: bool = False) -> SparseMatrix:
    """A matrix of triplets (i, j, v); duplicates are combined, stored zeros are kept, dimensions inferred where they are not given."""
    if m == 0 or n == 0:
        raise ArgumentError("a matrix of triplets needs positive dimensions")
    m, n = inferred(df, "i") if m is None else m, inferred(df, "j") if n is None else n
    if check:
        df = checked(df, {"i": m, "j": n})
    return SparseMatrix(combined(df, ["i", "j"], combine, order), m, n)


def sparsevec(df: DataFrame, n: int | None = None, combine=None, *, order: str | None = None, check: bool = False) -> SparseVector:
    n = inferred(df, "i") if n is None else n
    return SparseVector(combined(checked(df, {"i": n}) if check else df, ["i"], combine, order), n)


def from_table(df: DataFrame, i: str, j: str, v: Column | str, m: int | None = None, n: int | None = None, combine=None) -> SparseMatrix:
    """Triplets from 0-based key columns of a table."""
    return sparse(df.select((F.col(i) + 1).cast("long").alias("i"), (F.col(j) + 1).cast("long").alias("j"), (F.expr(v) if isinstance(v, str) else v).alias("v")), m, n, combine)


def from_map(df: DataFrame, column: str, n: int | None = None) -> SparseVector:
    """A vector of a map column's entries."""
    return sparsevec(df.select(F.explode(column).alias("i", "v")).select(F.col("i").cast("long").alias("i"), "v"), n, check=n is not None)


def from_dense_rows(df: DataFrame, row: str, values: str, m: int, n: int) -> SparseMatrix:
    """A matrix of a table with an array per row, without zeros."""
    out = df.select(F.col(row).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).select("i", (F.col("j") + 1).cast("long").alias("j"), "v")
    return SparseMatrix(out.where(nonzero(df=out)), m, n)


def from_dense(df: DataFrame, m: int, n: int | None = None) -> SparseMatrix | SparseVector:
    """A complete relation without its zeros; nulls and NaN stay."""
    out = df.where(nonzero(df=df))
    return SparseVector(out, m) if n is None else SparseMatrix(out, m, n)


def identity(spark: SparkSession, m: int, n: int | None = None, value: object = 1.0) -> SparseMatrix:
    n = m if n is None else n
    count = 0 if value == 0 else min(m, n)
    return SparseMatrix(spark.range(1, count + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(value).alias("v")), m, n)


def spzeros(spark: SparkSession, m: int, n: int | None = None, kind: str = "double") -> SparseMatrix | SparseVector:
    return SparseVector(spark.createDataFrame([], f"i long, v {kind}"), m) if n is None else SparseMatrix(spark.createDataFrame([], f"i long, j long, v {kind}"), m, n)


def pattern(df: DataFrame, m: int, n: int, kind: str = "double") -> SparseMatrix:
    """Stored zeros at the given cells."""
    return SparseMatrix(df.select("i", "j").distinct().withColumn("v", F.lit(0).cast(kind)), m, n)


def sprand(spark: SparkSession, m: int, n: int | None, p: float, seed: int, value: Column | None = None) -> SparseMatrix | SparseVector:
    """Each cell is stored with probability p. Cells are ranges of a distributed range, so nothing is drawn on the driver."""
    if m < 0 or (n or 0) < 0 or not 0 <= p <= 1:
        raise ArgumentError("dimensions must not be negative and p must be in 0..1")
    size = m * (1 if n is None else n)
    value = F.rand(seed + 1) if value is None else value
    drawn = spark.range(size).withColumn("u", F.rand(seed)).where(F.col("u") < p).withColumn("v", value)
    if n is None:
        return SparseVector(drawn.select((F.col("id") + 1).alias("i"), "v"), m)
    return SparseMatrix(drawn.select((F.col("id") % m + 1).alias("i"), (F.floor(F.col("id") / m) + 1).cast("long").alias("j"), "v"), m, n)


def sprandn(spark: SparkSession, m: int, n: int | None, p: float, seed: int) -> SparseMatrix | SparseVector:
    return sprand(spark, m, n, p, seed, F.randn(seed + 1))


def diagonals(parts: dict[int, SparseVector], m: int | None = None, n: int | None = None) -> SparseMatrix:
    """Vectors on diagonals by offset; where they meet they add up."""
    out = None
    for k, x in parts.items():
        d = x.df.select((F.col("i") + max(-k, 0)).alias("i"), (F.col("i") + max(k, 0)).alias("j"), "v")
        out = d if out is None else out.union(d)
    size = max(x.n + abs(k) for k, x in parts.items())
    return sparse(out, m or size, n or size)


def banded(parts: dict[int, SparseVector], m: int | None = None, n: int | None = None) -> SparseMatrix:
    """Diagonal, bidiagonal and tridiagonal matrices: their diagonals without zeros."""
    return dropped(diagonals(parts, m, n))


def dropped(a):
    df = rows(a)
    return a.of(df.where(nonzero(df=df)))


def flatten(a: SparseMatrix) -> SparseVector:
    """The columns one after the other."""
    return SparseVector(a.entries.select(((F.col("j") - 1) * a.m + F.col("i")).alias("i"), "v"), a.m * a.n)


def column_vector(a: SparseMatrix) -> SparseVector:
    if a.n != 1:
        raise ArgumentError("only a matrix of one column is a vector")
    return SparseVector(a.entries.select("i", "v"), a.m)


def as_matrix(x: SparseVector) -> SparseMatrix:
    return SparseMatrix(x.df.select("i", F.lit(1).cast("long").alias("j"), "v"), x.n, 1)


def dense(a, what: str = "a dense copy") -> DataFrame:
    """Every cell, zeros where nothing is stored."""
    check_dense(cells(a), what)
    df = rows(a).withColumn("_stored", F.lit(True))
    out = all_cells(a, what).join(df, keys(a), "left")
    return out.select(*keys(a), F.when(F.col("_stored"), F.col("v")).otherwise(zero_of(df)).alias("v"))


def converted(a: SparseMatrix, structure: str) -> SparseMatrix:
    """The matrix under a structure that its values must have."""
    from ..operators.predicates import isbanded

    low, high = {"diagonal": (0, 0), "tridiagonal": (-1, 1), "lower": (-a.m, 0), "upper": (0, a.n)}[structure]
    if not isbanded(a, low, high):
        raise ArgumentError(f"the matrix is not {structure}")
    return a.of(a.entries, structure="general" if structure == "tridiagonal" else structure)


def cast(a, kind: str):
    return a.of(a.df.withColumn("v", F.col("v").cast(kind)))


def as_complex(a):
    return a.of(a.df.withColumn("v", F.when(F.col("v").isNotNull(), F.struct(F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")))))


def similar(a, kind: str | None = None, dims: tuple[int, ...] | None = None):
    """The same pattern with zeros, or nothing stored where the dimensions are others."""
    kind = kind or a.df.schema["v"].dataType.simpleString()
    if dims is not None:
        return spzeros(a.spark, *dims, kind=kind)
    return a.of(a.df.withColumn("v", F.lit(0).cast(kind)))


def copyto(dest: SparseMatrix, source: SparseMatrix) -> SparseMatrix:
    """The source's cells over the first places of the destination, column after column; the tail stays."""
    if source.m * source.n > dest.m * dest.n:
        raise DimensionMismatch("the source is larger")
    last = source.m * source.n
    tail = dest.entries.where((F.col("j") - 1) * dest.m + F.col("i") > last)
    at = (F.col("j") - 1) * source.m + F.col("i") - 1
    return dest.of(source.entries.select((at % dest.m + 1).alias("i"), (F.floor(at / dest.m) + 1).cast("long").alias("j"), "v").union(tail))


def copytrito(dest: DataFrame, a: SparseMatrix, uplo: str) -> DataFrame:
    """A dense relation with a triangle of the matrix, zeros included, copied over it."""
    if uplo not in ("U", "L"):
        raise ArgumentError(f"uplo must be U or L, not {uplo!r}")
    side = (F.col("i") <= F.col("j")) if uplo == "U" else (F.col("i") >= F.col("j"))
    inside = side & (F.col("i") <= a.m) & (F.col("j") <= a.n)
    out = dest.join(a.entries.select("i", "j", F.col("v").alias("w")), ["i", "j"], "left")
    return out.select("i", "j", F.when(inside, F.coalesce("w", F.lit(0).cast(a.df.schema["v"].dataType))).otherwise(F.col("v")).alias("v"))


def one(a: SparseMatrix) -> SparseMatrix:
    if a.m != a.n:
        raise DimensionMismatch("only a square matrix has an identity")
    return cast(identity(a.spark, a.m), a.df.schema["v"].dataType.simpleString())


def zero(a: SparseMatrix) -> SparseMatrix:
    return spzeros(a.spark, a.m, a.n, a.df.schema["v"].dataType.simpleString())


def spy(a: SparseMatrix, height: int, width: int) -> DataFrame:
    """Stored entries by cells of a picture of the matrix, at most height * width rows."""
    return a.entries.groupBy(F.floor((F.col("i") - 1) * height / a.m).cast("long").alias("y"), F.floor((F.col("j") - 1) * width / a.n).cast("long").alias("x")).agg(F.count("*").alias("n"))


def show(a, limit: int = 20) -> str:
    """A summary and the first entries in column-major order."""
    k = keys(a)
    head = rows(a).orderBy(*reversed(k)).limit(limit).collect()
    size = f"{a.n}-element vector" if isinstance(a, SparseVector) else f"{a.m}x{a.n} matrix"
    return "\n".join([f"{size} with {rows(a).count()} stored entries"] + [f"  [{', '.join(str(r[c]) for c in k)}] = {r.v}" for r in head])
