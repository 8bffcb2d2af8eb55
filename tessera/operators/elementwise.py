"""Maps and broadcasts. The plan follows from f at zeros: an outer join of patterns where it is zero, a grid where it is not."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import DimensionMismatch, SingularException, SparseMatrix, SparseVector, all_cells, cells, conj, grid, is_complex, keys, like, nonzero, rows, zero_of
from .access import literal, nnz

Fn = Callable[..., Column]


def general(a, df: DataFrame):
    return a.of(df) if isinstance(a, SparseVector) else a.of(df, structure="general")


def kept(a, df: DataFrame):
    """Results without zeros, but for a fixed pattern."""
    return general(a, df if a.fixed else df.where(nonzero(df=df)))


def fills(f: Fn, *args) -> bool:
    """Whether f makes something of zeros. Entries are counted only where it does, or where it fails, which matters if every argument has an unstored zero."""
    failed = None
    try:
        if literal(f, *[a.value if isinstance(a, Scalar) else 0 for a in args]) == 0:
            return False
    except (PySparkException, Py4JError) as e:
        failed = e
    if any(nnz(a) == cells(a) for a in args if not isinstance(a, Scalar)):
        return False
    if failed is not None:
        raise failed
    return True


class Scalar:
    def __init__(self, value: object):
        self.value = value


def emap(f: Fn, a):
    """f of every cell."""
    df, k = rows(a), keys(a)
    if not fills(f, a):
        return kept(a, df.select(*k, f(F.col("v")).alias("v")))
    full = all_cells(a, "a map with f(0) != 0").join(df.withColumn("_p", F.lit(True)), k, "left")
    value = F.when(F.col("_p"), F.col("v")).otherwise(zero_of(df))
    return general(a, full.select(*k, f(value).alias("v")))


def emap_n(f: Fn, *args):
    """f of the cells of several operands of one shape: one shuffle of a tagged union, whatever their number."""
    a = args[0]
    for b in args[1:]:
        like(a, b, "map")
    k = keys(a)
    tagged = reduce(DataFrame.union, [rows(x).select(*k, F.lit(t).alias("t"), F.col("v").cast(wide(args)).alias("v")) for t, x in enumerate(args)])
    zero = F.lit(0).cast(wide(args))
    wide_rows = tagged.groupBy(*k).agg(*[F.max_by("v", F.when(F.col("t") == t, 1)).alias(f"v{t}") for t in range(len(args))], *[F.count_if(F.col("t") == t).alias(f"n{t}") for t in range(len(args))])
    values = [F.when(F.col(f"n{t}") == 0, zero).otherwise(F.col(f"v{t}")) for t in range(len(args))]
    if not fills(f, *args):
        return kept(a, wide_rows.select(*k, f(*values).alias("v")))
    full = all_cells(a, "a map with f(0, ...) != 0").join(wide_rows, k, "left")
    values = [F.when(F.coalesce(F.col(f"n{t}"), F.lit(0)) == 0, zero).otherwise(F.col(f"v{t}")) for t in range(len(args))]
    return general(a, full.select(*k, f(*values).alias("v")))


def wide(args) -> str:
    kinds = [rows(a).schema["v"].dataType.simpleString() for a in args]
    order = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]
    return max(kinds, key=lambda k: order.index(k) if k in order else len(order))


def outer(a, b) -> DataFrame:
    """Both values by cell, v and w, and p and q for where they are stored."""
    k = keys(a)
    return rows(a).withColumn("p", F.lit(True)).join(rows(b).select(*k, F.col("v").alias("w"), F.lit(True).alias("q")), k, "full")


def emap2(f: Fn, a, b):
    """f of two operands of one shape."""
    like(a, b, "map")
    k = keys(a)
    v = F.when(F.col("p"), F.col("v")).otherwise(zero_of(rows(a)))
    w = F.when(F.col("q"), F.col("w")).otherwise(zero_of(rows(b)))
    if not fills(f, a, b):
        return kept(a, outer(a, b).select(*k, f(v, w).alias("v")))
    full = all_cells(a, "a map with f(0, 0) != 0").join(outer(a, b), k, "left")
    return general(a, full.select(*k, f(v, w).alias("v")))


def add(a, b, sign: int = 1):
    """a + b or a - b without zeros. Sums of a union aggregate before the shuffle; where a null can be, it must win, so they are joined."""
    like(a, b, "addition")
    k = keys(a)
    x, y = rows(a), rows(b)
    if is_complex(x):
        both = x.select(*k, "v.re", "v.im").union(y.select(*k, F.col("v.re") * sign, F.col("v.im") * sign))
        out = both.groupBy(*k).agg(F.struct(F.sum("re").alias("re"), F.sum("im").alias("im")).alias("v"))
        return kept(a, out)
    both = x.select(*k, "v").union(y.select(*k, (F.col("v") * sign).alias("v"))).groupBy(*k)
    total = F.when(F.count_if(F.col("v").isNull()) == 0, F.sum("v"))
    return kept(a, both.agg(total.alias("v")))


def add_scaled_identity(a: SparseMatrix, value: object) -> SparseMatrix:
    if a.m != a.n:
        raise DimensionMismatch("only a square matrix takes a multiple of the identity")
    return add(a, SparseMatrix(a.spark.range(1, a.m + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(value).cast(a.df.schema["v"].dataType).alias("v")), a.m, a.n))


def add_dense(a, other: DataFrame, sign: int = 1) -> DataFrame:
    """A complete relation plus or minus a sparse operand."""
    k = keys(a)
    return other.join(rows(a).select(*k, F.col("v").alias("w")), k, "left").select(*k, (F.col("v") + sign * F.coalesce("w", F.lit(0))).alias("v"))


def axpy(alpha: object, x: SparseVector, y: DataFrame) -> DataFrame:
    return y.join(x.df.select("i", F.col("v").alias("w")), "i", "left").select("i", (F.col("v") + F.lit(alpha) * F.coalesce("w", F.lit(0))).alias("v"))


#: Modes of vector maps: 0 both stored, zeros kept; 1 either stored, a zero of both drops; 2 either stored, zeros drop.
VECTOR_MODES = {"*": 0, "+": 1, "-": 1, "min": 2, "max": 2}
VECTOR_OPS: dict[str, Fn] = {"*": lambda a, b: a * b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "min": F.least, "max": F.greatest}


def vector_map(op: str, x: SparseVector, y: SparseVector, *, missing: bool = False) -> SparseVector:
    like(x, y, "map")
    mode, f = 2 if missing and op == "*" else VECTOR_MODES[op], VECTOR_OPS[op]
    if mode == 0:
        return x.of(x.df.join(y.df.withColumnRenamed("v", "w"), "i").select("i", f(F.col("v"), F.col("w")).alias("v")))
    v, w = (F.when(F.col(p), F.col(c)).otherwise(F.lit(0)) for p, c in (("p", "v"), ("q", "w")))
    out = outer(x, y).select("i", f(v, w).alias("v"), (F.col("p") & F.col("q")).alias("both"))
    zero = ~nonzero()
    return x.of(out.where(~(zero & F.coalesce("both", F.lit(False))) if mode == 1 else ~zero).select("i", "v"))


def negate(a):
    df = a.df
    v = F.struct((-F.col("v.re")).alias("re"), (-F.col("v.im")).alias("im")) if is_complex(df) else -F.col("v")
    if isinstance(a, SparseMatrix) and a.structure.startswith("unit"):
        a, df = a.general(), a.entries
    return a.of(df.withColumn("v", v))


def conjugate(a):
    return a.of(a.df.withColumn("v", conj(F.col("v")))) if is_complex(a.df) else a


def part(a, which: str):
    """Real or imaginary part; those of complex vectors have no zeros."""
    out = a.of(a.df.withColumn("v", F.col(f"v.{which}")))
    return kept(out, rows(out)) if isinstance(a, SparseVector) else out


def scale(a, x: object):
    """Every stored entry times x; the pattern stays also for zero."""
    df = rows(a)
    return general(a, df.withColumn("v", F.col("v") * x))


def divide(a, x: float):
    if x == 0:
        inf = F.lit(float("inf"))
        return general(a, rows(a).withColumn("v", F.when((F.col("v") == 0) | F.isnan(F.col("v").cast("double")), F.lit(float("nan"))).otherwise(F.signum("v") * inf)))
    return general(a, rows(a).withColumn("v", F.col("v") / x))


def scale_rows(d: DataFrame, a: SparseMatrix) -> SparseMatrix:
    """Diagonal * A, the diagonal a complete (i, v). Its size is one side of the matrix, so Spark chooses how to join."""
    out = a.entries.join(d.select("i", F.col("v").alias("d")), "i").select("i", "j", (F.col("d") * F.col("v")).alias("v"))
    return a.of(out, structure="general")


def scale_columns(a: SparseMatrix, d: DataFrame) -> SparseMatrix:
    out = a.entries.join(d.select(F.col("i").alias("j"), F.col("v").alias("d")), "j").select("i", "j", (F.col("v") * F.col("d")).alias("v"))
    return a.of(out, structure="general")


def scale_both(left: DataFrame, a: SparseMatrix, right: DataFrame) -> SparseMatrix:
    return scale_columns(scale_rows(left, a), right)


def divide_rows(d: DataFrame, a: SparseMatrix, *, check: bool = True) -> SparseMatrix:
    """Diagonal \\ A. A zero on the diagonal is an error, or gives IEEE values without the check."""
    if check and (bad := d.where("v = 0").agg(F.min("i")).first()[0]) is not None:
        raise SingularException(int(bad))
    safe = F.when(F.col("d") == 0, F.when(F.col("v") == 0, F.lit(float("nan"))).otherwise(F.signum(F.col("v").cast("double")) * float("inf"))).otherwise(F.col("v") / F.when(F.col("d") != 0, F.col("d")))
    out = a.entries.join(d.select("i", F.col("v").alias("d")), "i").select("i", "j", safe.alias("v"))
    return a.of(out, structure="general")


def divide_columns(a: SparseMatrix, d: DataFrame, *, check: bool = True) -> SparseMatrix:
    from .access import transpose

    return transpose(divide_rows(d, transpose(a), check=check))


def broadcast2(f: Fn, a, b) -> SparseMatrix:
    """f with sides of length one stretched: m x 1, 1 x n, vectors as m x 1, against each other or a matrix."""
    a, b = (SparseMatrix(x.df.select("i", F.lit(1).cast("long").alias("j"), "v"), x.n, 1) if isinstance(x, SparseVector) else x for x in (a, b))
    for p, q in ((a.m, b.m), (a.n, b.n)):
        if p != q and 1 not in (p, q):
            raise DimensionMismatch("sides must be equal or one")
    m, n = (max(p, q) if 0 not in (p, q) else 0 for p, q in ((a.m, b.m), (a.n, b.n)))
    if literal(f, 0, 0) == 0 and (a.m, a.n) == (m, n) and (b.m, b.n) != (m, n):
        out = against(f, a, b, m, n)
        if out is not None:
            return out
    return emap2(f, stretched(a, m, n), stretched(b, m, n))


def against(f: Fn, a: SparseMatrix, b: SparseMatrix, m: int, n: int) -> SparseMatrix | None:
    """A full operand against a stretched one, where f(0, w) = 0 for all w: a join on the other's own side, no stretching."""
    if literal(f, 0, 1) != 0 or literal(f, 0, -2) != 0:
        return None
    k = ["i"] if b.m == m and m != 1 else ["j"]
    if b.m != 1 and b.n != 1:
        return None
    joined = a.entries.join(b.entries.select(*k, F.col("v").alias("w"), F.lit(True).alias("q")), k, "left")
    return kept(a, joined.select("i", "j", f(F.col("v"), F.when(F.col("q"), F.col("w")).otherwise(zero_of(b.df))).alias("v")))


def stretched(a: SparseMatrix, m: int, n: int) -> SparseMatrix:
    df = a.entries
    if a.m == 1 and m != 1:
        df = df.drop("i").crossJoin(a.spark.range(1, m + 1).withColumnRenamed("id", "i"))
    if a.n == 1 and n != 1:
        df = df.drop("j").crossJoin(a.spark.range(1, n + 1).withColumnRenamed("id", "j"))
    return SparseMatrix(df.select("i", "j", "v"), m, n)


def broadcast_n(f: Fn, *args) -> SparseMatrix:
    """f of operands of which sides of length one are stretched, in one pass over their union."""
    as_m = [SparseMatrix(x.df.select("i", F.lit(1).cast("long").alias("j"), "v"), x.n, 1) if isinstance(x, SparseVector) else x for x in args]
    m, n = max(a.m for a in as_m), max(a.n for a in as_m)
    return emap_n(f, *[stretched(a, m, n) for a in as_m])


def constant(spark, value: object, m: int, n: int) -> SparseMatrix:
    """A broadcast without operands: the value in every cell, nothing where it is zero."""
    df = grid(spark, m, n, "a constant broadcast").withColumn("v", F.lit(value))
    return SparseMatrix(df if value != 0 else df.limit(0), m, n)


def outer_product(x: SparseVector, y: SparseVector) -> SparseMatrix:
    """x .* y' with the adjoint's conjugate; zero products are dropped."""
    out = x.df.crossJoin(y.df.select(F.col("i").alias("j"), F.col("v").alias("w"))).select("i", "j", (F.col("v") * F.col("w")).alias("v"))
    return SparseMatrix(out.where(nonzero()), x.n, y.n)

