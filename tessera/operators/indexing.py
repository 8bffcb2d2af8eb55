"""Indexing and assignment as joins with index relations.

An index list is a DataFrame ``(pos, idx)``: position in the result and index taken, which may repeat in any order. Assignments
return a new matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import BoundsError, DimensionMismatch, ScalarIndexingError, SparseMatrix, SparseVector, check_dense, linear, zero_of
from .order import numbered

#: Whether single cells may be read and written; each one is a job.
ALLOW_SCALAR = True


def allowscalar(allow: bool) -> None:
    global ALLOW_SCALAR
    ALLOW_SCALAR = allow


def scalar_check() -> None:
    if not ALLOW_SCALAR:
        raise ScalarIndexingError("scalar indexing is switched off")


def index_list(spark: SparkSession, values: range | list[int]) -> DataFrame:
    """(pos, idx) of a range, made where it is used, or of a short list."""
    if isinstance(values, range):
        return spark.range(len(values)).select((F.col("id") + 1).alias("pos"), (F.col("id") * values.step + values.start).alias("idx"))
    return spark.createDataFrame(list(enumerate(values, 1)), "pos long, idx long")


def from_mask(mask: DataFrame) -> DataFrame:
    """(pos, idx) of the true flags of (pos, flag), in their order."""
    true = mask.where("flag").select(F.col("pos").alias("idx"))
    return numbered(true, [F.col("idx").asc()], "pos").select(F.col("pos").cast("long").alias("pos"), "idx")


def length(index: DataFrame) -> int:
    return index.count()


def get(a, i: int, j: int | None = None):
    """A[i, j] or x[i]."""
    scalar_check()
    if isinstance(a, SparseVector):
        if not 1 <= i <= a.n:
            raise BoundsError(i)
        found = a.df.where(F.col("i") == i).select("v").first()
    else:
        if not (1 <= i <= a.m and 1 <= j <= a.n):
            raise BoundsError((i, j))
        found = a.entries.where((F.col("i") == i) & (F.col("j") == j)).select("v").first()
    return found.v if found else 0


def column(a: SparseMatrix, j: int, index: DataFrame | range | None = None) -> SparseVector:
    """A[:, j], or A[I, j]."""
    if not 1 <= j <= a.n:
        raise BoundsError(j)
    x = SparseVector(a.entries.where(F.col("j") == j).select("i", "v"), a.m)
    return x if index is None else take(x, index)


def row(a: SparseMatrix, i: int, index: DataFrame | range | None = None) -> SparseVector:
    if not 1 <= i <= a.m:
        raise BoundsError(i)
    x = SparseVector(a.entries.where(F.col("i") == i).select(F.col("j").alias("i"), "v"), a.n)
    return x if index is None else take(x, index)


def ranged(df: DataFrame, c: str, index: range) -> DataFrame:
    """Index arithmetic instead of a join: a filter that reaches the scan, and a projection."""
    low, high = min(index[0], index[-1]), max(index[0], index[-1])
    at = F.col(c) - index.start
    return df.where(F.col(c).between(low, high) & (at % index.step == 0)).withColumn(c, (at / index.step + 1).cast("long"))


def chosen(df: DataFrame, c: str, index: DataFrame | range | None, n: int) -> tuple[DataFrame, int]:
    if index is None:
        return df, n
    if isinstance(index, range):
        if not len(index):
            return df.limit(0), 0
        if min(index[0], index[-1]) < 1 or max(index[0], index[-1]) > n:
            raise BoundsError(f"{index} of {n}")
        return ranged(df, c, index), len(index)
    if index.agg(F.coalesce(F.bool_or((F.col("idx") < 1) | (F.col("idx") > n)), F.lit(False))).first()[0]:
        raise BoundsError(f"an index outside of 1..{n}")
    others = [x for x in df.columns if x != c]
    return df.join(index.select(F.col("pos").alias("_pos"), F.col("idx").alias(c)), c).select(F.col("_pos").alias(c), *others), length(index)


def submatrix(a: SparseMatrix, rows: DataFrame | range | None = None, columns: DataFrame | range | None = None) -> SparseMatrix:
    """A[I, J]; None stands for a colon."""
    df, m = chosen(a.entries, "i", rows, a.m)
    df, n = chosen(df, "j", columns, a.n)
    return SparseMatrix(df.select("i", "j", "v"), m, n)


def take(x: SparseVector, index: DataFrame | range) -> SparseVector:
    df, n = chosen(x.df, "i", index, x.n)
    return SparseVector(df.select("i", "v"), n)


def at_linear(a: SparseMatrix, index: DataFrame | range) -> SparseVector:
    """A[K] with K over the columns one after the other."""
    return take(SparseVector(a.entries.select(linear(a.m).alias("i"), "v"), a.m * a.n), index)


def masked(a: SparseMatrix, mask: SparseMatrix) -> SparseVector:
    """A[mask] of a logical matrix that stores its true cells."""
    if (a.m, a.n) != (mask.m, mask.n):
        raise DimensionMismatch("a mask has the matrix's shape")
    places = mask.entries.where("v").select(linear(a.m).alias("idx"))
    return at_linear(a, numbered(places, [F.col("idx").asc()], "pos").select(F.col("pos").cast("long").alias("pos"), "idx"))


# ---- assignment


def put(a, value: object, i: int, j: int | None = None):
    """A[i, j] = value: a zero is stored only where an entry is, and -0.0 always."""
    scalar_check()
    here = F.col("i") == i
    if isinstance(a, SparseMatrix):
        here = here & (F.col("j") == j)
    df = a.df if isinstance(a, SparseVector) else a.entries
    negative_zero = isinstance(value, float) and str(value) == "-0.0"
    own = [F.lit(i).cast("long").alias("i")] + ([] if isinstance(a, SparseVector) else [F.lit(j).cast("long").alias("j")]) + [F.lit(value).cast(df.schema["v"].dataType).alias("v")]
    if value == 0 and not negative_zero:
        out = df.withColumn("v", F.when(here, F.lit(value).cast(df.schema["v"].dataType)).otherwise(F.col("v")))
    else:
        out = df.where(~here).union(a.spark.range(1).select(*own))
    return a.of(out)


def inside(a: SparseMatrix, rows: DataFrame, columns: DataFrame) -> DataFrame:
    return a.entries.join(rows.select(F.col("idx").alias("i")).distinct(), "i", "left_semi").join(columns.select(F.col("idx").alias("j")).distinct(), "j", "left_semi").select("i", "j", "v")


def assign(a: SparseMatrix, rows: DataFrame, columns: DataFrame, b: SparseMatrix) -> SparseMatrix:
    """A[I, J] = B: entries of A in I x J that B does not store become stored zeros, zeros of B go only to stored cells."""
    if (length(rows), length(columns)) != (b.m, b.n):
        raise DimensionMismatch("the right side has another shape")
    old = inside(a, rows, columns)
    new = b.entries.join(rows.select(F.col("pos").alias("i"), F.col("idx").alias("ni")), "i").join(columns.select(F.col("pos").alias("j"), F.col("idx").alias("nj")), "j")
    new = new.select(F.col("ni").alias("i"), F.col("nj").alias("j"), F.col("v").alias("w"), F.lit(True).alias("q"))
    both = old.select("i", "j", F.lit(True).alias("p")).join(new, ["i", "j"], "full")
    value = F.when(F.col("q"), F.col("w")).otherwise(zero_of(b.df)).cast(a.df.schema["v"].dataType)
    kept = both.where("p OR w IS NULL OR w <> 0").select("i", "j", value.alias("v"))
    return a.of(a.entries.join(old.select("i", "j"), ["i", "j"], "left_anti").union(kept))


def fill_region(a: SparseMatrix, rows: DataFrame, columns: DataFrame, x: object) -> SparseMatrix:
    """A[I, J] .= x: a zero clears the stored entries, any other value fills the region."""
    old = inside(a, rows, columns).select("i", "j")
    rest = a.entries.join(old, ["i", "j"], "left_anti")
    if x == 0:
        return a.of(rest.union(old.withColumn("v", zero_of(a.df))))
    check_dense(length(rows) * length(columns), "filling a region")
    full = rows.select(F.col("idx").alias("i")).distinct().crossJoin(columns.select(F.col("idx").alias("j")).distinct())
    return a.of(rest.union(full.withColumn("v", F.lit(x).cast(a.df.schema["v"].dataType))))


def fill(a: SparseMatrix, x: object) -> SparseMatrix:
    spark = a.spark
    return fill_region(a, index_list(spark, range(1, a.m + 1)), index_list(spark, range(1, a.n + 1)), x)


def put_linear(a: SparseMatrix, values: DataFrame) -> SparseMatrix:
    """A[K] = X with (pos, idx, w) rows; of repeated places the last survives. Zeros go only to stored cells."""
    last = values.groupBy("idx").agg(F.max_by("w", "pos").alias("w"))
    at = F.col("idx") - 1
    new = last.select((at % a.m + 1).alias("i"), (F.floor(at / a.m) + 1).cast("long").alias("j"), "w", F.lit(True).alias("q"))
    both = a.entries.withColumn("p", F.lit(True)).join(new, ["i", "j"], "full")
    out = both.where("p OR w IS NULL OR w <> 0").select("i", "j", F.when(F.col("q"), F.col("w")).otherwise(F.col("v")).alias("v"))
    return a.of(out)


def fill_mask(a: SparseMatrix, mask: SparseMatrix, x: object) -> SparseMatrix:
    """A[mask] = x."""
    places = mask.entries.where("v").select(linear(a.m).alias("idx"), linear(a.m).alias("pos"), F.lit(x).cast(a.df.schema["v"].dataType).alias("w"))
    return put_linear(a, places)


def mergeinds(c: SparseMatrix, a: SparseMatrix) -> SparseMatrix:
    """C with A's pattern added as zeros."""
    more = a.entries.select("i", "j").join(c.entries.select("i", "j"), ["i", "j"], "left_anti")
    return c.of(c.entries.union(more.withColumn("v", zero_of(c.df))))


