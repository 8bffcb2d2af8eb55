"""Products as joins on the inner index and sums by cell, and chains of them in an order chosen by size."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import DimensionMismatch, SparseMatrix, SparseVector, conj, grid, is_complex, keys, line, rows
from .elementwise import scale


def times(v: Column, w: Column, complex_: bool) -> Column:
    if not complex_:
        return v * w
    return F.struct((v.re * w.re - v.im * w.im).alias("re"), (v.re * w.im + v.im * w.re).alias("im"))


def total(product: DataFrame, by: list[str], complex_: bool, nulls: bool) -> DataFrame:
    """Sums by cell, partial before the shuffle; a missing factor makes a missing sum."""
    if complex_:
        return product.groupBy(*by).agg(F.struct(F.sum("v.re").alias("re"), F.sum("v.im").alias("im")).alias("v"))
    s = F.sum("v")
    return product.groupBy(*by).agg((F.when(F.count_if(F.col("v").isNull()) == 0, s) if nulls else s).alias("v"))


def nullable(*frames: DataFrame) -> bool:
    return any(f.schema["v"].nullable for f in frames)


def matmul(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """A * B; cells that cancel stay stored as zeros."""
    if a.n != b.m:
        raise DimensionMismatch(f"{a.m}x{a.n} times {b.m}x{b.n}")
    x, y = a.entries, b.entries
    cx = is_complex(x)
    product = x.select("i", F.col("j").alias("k"), F.col("v").alias("a")).join(y.select(F.col("i").alias("k"), "j", F.col("v").alias("b")), "k").select("i", "j", times(F.col("a"), F.col("b"), cx).alias("v"))
    return SparseMatrix(total(product, ["i", "j"], cx, nullable(x, y)), a.m, b.n)


#: Joined rows of a product from which it is computed row by row, those that one partition gets then, and columns of B in one packed row of it.
BY_ROWS, JOINED, COLUMNS = 100_000_000, 1_000_000, 1 << 15


def whole(kind) -> bool:
    return kind.typeName() in ("long", "integer")


def matmul_by_rows(a: SparseMatrix, b: SparseMatrix, joined: float) -> SparseMatrix:
    """A * B where nearly each joined pair is a cell of its own, so that sums before the shuffle save nothing: each entry of A is sent to its row's partition with B's row packed
    beside it, short where the values are, and pairs are made and summed there. A partition gets the ``joined`` rows expected over their number; a row of more columns goes to several."""
    if a.n != b.m:
        raise DimensionMismatch(f"{a.m}x{a.n} times {b.m}x{b.n}")
    x, y = a.entries, b.entries
    cx, kind, nulls = is_complex(x), y.schema["v"].dataType, nullable(x, y)
    cell = F.struct((F.col("j") % COLUMNS).cast("short").alias("j"), F.col("v").alias("b"))
    y = y.groupBy(F.col("i").alias("k"), F.floor(F.col("j") / COLUMNS).cast("long").alias("part")).agg(F.collect_list(cell).alias("row"), *([F.min("v").alias("least"), F.max("v").alias("most")] if whole(kind) else []))
    values = F.transform("row", lambda c: c.b)
    packed = [values.alias("bs")]
    if whole(kind):
        short = F.coalesce((F.col("least") >= -(1 << 15)) & (F.col("most") < 1 << 15), F.lit(False))
        packed = [F.when(~short, values).alias("bs"), F.when(short, F.transform("row", lambda c: c.b.cast("short"))).alias("short")]
    y = y.select("k", "part", F.transform("row", lambda c: c.j).alias("js"), *packed)
    sent = x.select("i", F.col("j").alias("k"), F.col("v").alias("a")).join(y, "k").drop("k").repartition(max(1, math.ceil(joined / JOINED)), "i", "part")
    values = F.coalesce("bs", F.col("short").cast(f"array<{kind.simpleString()}>")) if whole(kind) else F.col("bs")
    pairs = sent.select("i", "part", "a", F.explode(F.zip_with("js", values, lambda j, b: F.struct(j.alias("j"), b.alias("b")))).alias("c"))
    product = pairs.select("i", "part", (F.col("part") * COLUMNS + F.col("c.j")).alias("j"), times(F.col("a"), F.col("c.b"), cx).alias("v"))
    out = total(product, ["i", "part", "j"], cx, nulls).select("i", "j", "v")
    return SparseMatrix(out, a.m, b.n)


def matvec(a: SparseMatrix, x: SparseVector) -> SparseVector:
    """A * x with a sparse vector; the result is sparse."""
    if a.n != x.n:
        raise DimensionMismatch(f"{a.m}x{a.n} times {x.n}")
    df, cx = a.entries, is_complex(a.df)
    product = df.join(x.df.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").select("i", times(F.col("v"), F.col("w"), cx).alias("v"))
    return SparseVector(total(product, ["i"], cx, nullable(df, x.df)), a.m)


def mul_dense(a: SparseMatrix, x: DataFrame, y: DataFrame | None = None, alpha: object = 1, beta: object = 0) -> DataFrame:
    """alpha * A * x + beta * y for complete (i, v); with beta = 0, y is not read."""
    product = matvec(a, SparseVector(x, a.n)).df.select("i", F.col("v").alias("w"))
    base = line(a.spark, a.m) if y is None or beta == 0 else y
    old = F.lit(0) if y is None or beta == 0 else F.lit(beta) * F.col("v")
    return base.join(product, "i", "left").select("i", (F.lit(alpha) * F.coalesce("w", F.lit(0)) + old).alias("v"))


def mul_dense_matrix(a: SparseMatrix, b: DataFrame, k: int) -> DataFrame:
    """A * B for a complete (i, j, v) of k columns, every cell of the result."""
    out = matmul(a, SparseMatrix(b, a.n, k)).df
    return grid(a.spark, a.m, k, "a dense product").join(out, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0)).alias("v"))


def mul_into(c: SparseMatrix, a: SparseMatrix, b: SparseMatrix, alpha: object = 1, beta: object = 0) -> SparseMatrix:
    """alpha * A * B + beta * C; what is stored in either stays stored."""
    product = scale(matmul(a, b), alpha)
    if beta == 0:
        return product
    both = product.df.union(scale(c, beta).df.select("i", "j", "v"))
    return c.of(total(both, ["i", "j"], False, nullable(both)), structure="general")


def dot(a, b, empty: object = 0):
    """Sum of conj(a) * b over cells that both store; ``empty`` where there are none (of complex values, zero)."""
    k = keys(a)
    cx = is_complex(rows(a))
    left = rows(a).withColumn("v", conj(F.col("v"))) if cx else rows(a)
    product = left.join(rows(b).select(*k, F.col("v").alias("w")), k).select(times(F.col("v"), F.col("w"), cx).alias("v"))
    if cx:
        r = product.agg(F.coalesce(F.sum("v.re"), F.lit(0.0)).alias("re"), F.coalesce(F.sum("v.im"), F.lit(0.0)).alias("im")).first()
        return complex(r.re, r.im)
    return product.agg(F.coalesce(F.sum("v"), F.lit(empty))).first()[0]


def dot_dense(a, b: DataFrame):
    """Against a complete relation, of which the stored cells alone are needed."""
    return rows(a).join(b.select(*keys(a), F.col("v").alias("w")), keys(a)).agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0))).first()[0]


def bilinear(x: SparseVector, a: SparseMatrix, y: SparseVector, empty: object = 0):
    """x' * A * y: both joins before one sum, nothing by row in between; ``empty`` where no entry meets both vectors."""
    out = a.entries.join(x.df.select("i", F.col("v").alias("x")), "i").join(y.df.select(F.col("i").alias("j"), F.col("v").alias("y")), "j")
    return out.agg(F.coalesce(F.sum(F.col("x") * F.col("v") * F.col("y")), F.lit(empty))).first()[0]


def kron(a, b):
    """The Kronecker product; every pair of stored entries is an entry, stored zeros stay."""
    if isinstance(a, SparseVector) and isinstance(b, SparseVector):
        both = a.df.crossJoin(b.df.select(F.col("i").alias("k"), F.col("v").alias("w")))
        return SparseVector(both.select(((F.col("i") - 1) * b.n + F.col("k")).alias("i"), (F.col("v") * F.col("w")).alias("v")), a.n * b.n)
    both = a.entries.crossJoin(b.entries.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("v").alias("w")))
    i, j = (F.col("i") - 1) * b.m + F.col("k"), (F.col("j") - 1) * b.n + F.col("l")
    return SparseMatrix(both.select(i.alias("i"), j.alias("j"), (F.col("v") * F.col("w")).alias("v")), a.m * b.m, a.n * b.n)


def lowrankupdate(a: DataFrame, x: SparseVector, y: SparseVector, alpha: object = 1) -> DataFrame:
    """A + alpha * x * y' for a complete relation."""
    more = x.df.crossJoin(y.df.select(F.col("i").alias("j"), F.col("v").alias("w"))).select("i", "j", (F.lit(alpha) * F.col("v") * F.col("w")).alias("w"))
    return a.join(more, ["i", "j"], "left").select("i", "j", (F.col("v") + F.coalesce("w", F.lit(0))).alias("v"))


def estimate_mulsize(m: int, nnz_a: int, n: int, nnz_b: int, k: int) -> float:
    """Expected entries of an (m x n) * (n x k) product of independent patterns."""
    p = 1 - (1 - nnz_a / max(1, m * n) * nnz_b / max(1, n * k)) ** n
    return m * k * p


def chain(factors: list[SparseMatrix], sizes: list[int] | None = None) -> SparseMatrix:
    """The product of several matrices in the order with the fewest expected joined rows, as Spark can't move joins over sums. ``sizes`` are the factors' entries, or bounds
    on them where counting them would take as much as the product's own sums."""
    sizes = sizes or [rows(a).count() for a in factors]
    n = len(factors)
    best: dict[tuple[int, int], tuple[float, float, Callable[[], SparseMatrix]]] = {(k, k): (0.0, float(sizes[k]), lambda k=k: factors[k]) for k in range(n)}
    for span in range(1, n):
        for i in range(n - span):
            j = i + span
            options = []
            for k in range(i, j):
                (c1, s1, f1), (c2, s2, f2) = best[i, k], best[k + 1, j]
                m, inner, out = factors[i].m, factors[k].n, factors[j].n
                joined = s1 * s2 / max(1, inner)
                made = estimate_mulsize(m, s1, inner, s2, out)
                by_rows = joined > BY_ROWS and made > joined / 4
                options.append((c1 + c2 + joined, made, lambda f1=f1, f2=f2, joined=joined, by_rows=by_rows: matmul_by_rows(f1(), f2(), joined) if by_rows else matmul(f1(), f2())))
            best[i, j] = min(options, key=lambda o: o[0])
    return best[0, n - 1][2]()


