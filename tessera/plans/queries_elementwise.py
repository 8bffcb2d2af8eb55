"""Queries: maps, broadcasts, products, reductions, differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import SparseMatrix, SparseVector
from ..functions import scalar
from ..operators import access, elementwise, predicates, products, reductions
from ..sources import build
from .matrices import with_
from .registry import query

KEYS = "(SELECT p_partkey + 1 AS i FROM part)"
COLS = "(SELECT s_suppkey + 1 AS j FROM supplier)"


def rounded(df, digits: int = 6):
    return df.withColumn("v", F.round("v", digits))


def full_part(m):
    """A complete (i, v) over suppliers."""
    return m.table("supplier").select((F.col("s_suppkey") + 1).alias("i"), F.col("s_nationkey").cast("long").alias("v"))


FULL = "(SELECT s_suppkey + 1 AS k, CAST(s_nationkey AS BIGINT) AS d FROM supplier)"

query("E01_map_zero", with_("DZ") + "SELECT i, j, v * v - v AS v FROM DZ WHERE v * v - v <> 0")(lambda m: elementwise.emap(lambda v: v * v - v, m.DZ).df)
query("E02_map_fill", with_("SM", "GRID") + "SELECT i, j, COALESCE(v, 0) + 1 AS v FROM GRID LEFT JOIN SM USING (i, j)")(lambda m: elementwise.emap(lambda v: v + 1, m.SM).df)
query("E03_map2", with_("PS", "DZ") + "SELECT i, j, 2 * COALESCE(PS.v, 0) - 3 * COALESCE(DZ.v, 0) AS v FROM PS FULL JOIN DZ USING (i, j) WHERE 2 * COALESCE(PS.v, 0) - 3 * COALESCE(DZ.v, 0) <> 0")(lambda m: elementwise.emap2(lambda a, b: 2 * a - 3 * b, m.PS, m.DZ).df)
query("E04_map2_fill", with_("SM", "SM2", "GRID") + "SELECT i, j, COALESCE(SM.v, 0) - COALESCE(SM2.v, 0) + 1 AS v FROM GRID LEFT JOIN SM USING (i, j) LEFT JOIN SM2 USING (i, j)")(lambda m: elementwise.emap2(lambda a, b: a - b + 1, m.SM, m.SM2).df)
query("E05_map_n", with_("PS", "DZ") + "SELECT i, j, v FROM (SELECT i, j, a.v * b.v + COALESCE(c.v, 0) AS v FROM PS a JOIN DZ b USING (i, j) LEFT JOIN (SELECT i, j, v FROM PS WHERE v > 30) c USING (i, j)) WHERE v <> 0")(lambda m: elementwise.emap_n(lambda a, b, c: a * b + c, m.PS, m.DZ, access.fkeep(m.PS, lambda i, j, v: v > 30)).df)
query("E06_full_needs_no_zero", with_("UE") + "SELECT i, j, CAST(100 AS BIGINT) // v AS v FROM UE WHERE CAST(100 AS BIGINT) // v <> 0")(lambda m: elementwise.emap(lambda v: F.floor(F.lit(100) / v), m.UE).df)
query("E08_broadcast_vector", with_("PS", "px") + "SELECT PS.i, j, PS.v * px.v AS v FROM PS JOIN px USING (i)")(lambda m: elementwise.broadcast2(lambda a, b: a * b, m.PS, m.px).df)
query("E09_broadcast_n", with_("SM", "SM2", "GRID") + "SELECT i, j, v FROM (SELECT g.i, g.j, COALESCE(SM.v, 0) + COALESCE(c.v, 0) * 2 - COALESCE(r.v, 0) AS v FROM GRID g LEFT JOIN SM USING (i, j) LEFT JOIN (SELECT i, v FROM SM2 WHERE j = 2) c USING (i) LEFT JOIN (SELECT j, v FROM SM2 WHERE i = 3) r USING (j)) WHERE v <> 0")(lambda m: elementwise.broadcast_n(lambda a, b, c: a + b * 2 - c, m.SM, SparseVector(m.SM2.df.where("j = 2").select("i", "v"), 40), SparseMatrix(m.SM2.df.where("i = 3").select(F.lit(1).cast("long").alias("i"), "j", "v"), 1, 10)).df)
query("E10_scalar", with_("PS") + "SELECT i, j, v * 7 AS v FROM PS")(lambda m: elementwise.emap(lambda v, c=7: v * c, m.PS).df)
query("E11_promote_banded", with_("PS", "px") + "SELECT i, j, SUM(v)::BIGINT AS v FROM (SELECT i, j, v FROM PS UNION ALL SELECT i, i, v FROM px WHERE i <= (SELECT COUNT(*) FROM supplier)) GROUP BY 1, 2")(lambda m: elementwise.add(m.PS, SparseMatrix(build.banded({0: m.px}, m.parts, m.parts).df.where(f"j <= {m.suppliers}"), m.parts, m.suppliers)).df)
query("E12_fused", with_("PS", "DZ") + "SELECT i, j, PS.v * DZ.v * 2 AS v FROM PS JOIN DZ USING (i, j) WHERE DZ.v <> 0")(lambda m: elementwise.emap2(lambda a, b: (a * b) + (a * b), m.PS, m.DZ).df)
query("E13_constant", with_("GRID") + "SELECT i, j, CAST(4 AS INTEGER) AS v FROM GRID")(lambda m: elementwise.constant(m.spark, 4, 40, 10).df)
query("E14_outer_product", with_("px", "sx") + "SELECT px.i, sx.i AS j, px.v * sx.v AS v FROM px, sx WHERE px.v * sx.v <> 0")(lambda m: elementwise.outer_product(m.px, m.sx).df)
query("E15_add", with_("PS", "DZ") + "SELECT i, j, COALESCE(PS.v, 0) + COALESCE(DZ.v, 0) AS v FROM PS FULL JOIN DZ USING (i, j) WHERE COALESCE(PS.v, 0) + COALESCE(DZ.v, 0) <> 0")(lambda m: elementwise.add(m.PS, m.DZ).df)
query("E15_subtract", with_("PS", "DZ") + "SELECT i, j, COALESCE(PS.v, 0) - COALESCE(DZ.v, 0) AS v FROM PS FULL JOIN DZ USING (i, j) WHERE COALESCE(PS.v, 0) - COALESCE(DZ.v, 0) <> 0")(lambda m: elementwise.add(m.PS, m.DZ, -1).df)
query("E16_add_dense", with_("SM", "SM2", "GRID") + "SELECT i, j, COALESCE(SM.v, 0) + COALESCE(SM2.v, 0) AS v FROM GRID LEFT JOIN SM USING (i, j) LEFT JOIN SM2 USING (i, j)")(lambda m: elementwise.add_dense(m.SM2, build.dense(m.SM)))
query("E17_add_identity", with_("NN") + "SELECT i, j, SUM(v)::BIGINT AS v FROM (SELECT i, j, v FROM NN UNION ALL SELECT n_nationkey + 1, n_nationkey + 1, 25 FROM nation) GROUP BY 1, 2")(lambda m: elementwise.add_scaled_identity(m.NN, 25).df)
query("E18_symmetric_add", with_("NN") + "SELECT i, j, SUM(v)::BIGINT AS v FROM (SELECT i, j, v FROM NN UNION ALL SELECT i, j, v FROM NN WHERE i <= j UNION ALL SELECT j, i, v FROM NN WHERE i < j) GROUP BY 1, 2")(lambda m: elementwise.add(m.NN.of(m.NN.df, structure="symmetric"), m.NN).df)
query("E19_vector_times", with_("px", "py") + "SELECT i, px.v * py.v AS v FROM px JOIN py USING (i)")(lambda m: elementwise.vector_map("*", m.px, m.py).df)
query("E19_vector_plus", with_("px", "py") + "SELECT i, COALESCE(px.v, 0) + COALESCE(py.v, 0) AS v FROM px FULL JOIN py USING (i) WHERE NOT (px.v IS NOT NULL AND py.v IS NOT NULL AND px.v + py.v = 0)")(lambda m: elementwise.vector_map("+", m.px, m.py).df)
query("E19_vector_min", with_("px", "py") + "SELECT i, LEAST(COALESCE(px.v, 0), COALESCE(py.v, 0)) AS v FROM px FULL JOIN py USING (i) WHERE LEAST(COALESCE(px.v, 0), COALESCE(py.v, 0)) <> 0")(lambda m: elementwise.vector_map("min", m.px, m.py).df)
query("E20_vector_minus", with_("px", "py") + "SELECT i, COALESCE(px.v, 0) - COALESCE(py.v, 0) AS v FROM px FULL JOIN py USING (i) WHERE COALESCE(px.v, 0) - COALESCE(py.v, 0) <> 0")(lambda m: elementwise.add(m.px, m.py, -1).df)
query("E21_negate", with_("DZ") + "SELECT i, j, -v AS v FROM DZ")(lambda m: elementwise.negate(m.DZ).df)
query("E21_real_part", with_("DZ") + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM DZ")(lambda m: elementwise.part(elementwise.conjugate(build.as_complex(m.DZ)), "re").df)
query("E22_scale", with_("DZ") + "SELECT i, j, v * 3 AS v FROM DZ")(lambda m: elementwise.scale(m.DZ, 3).df)
query("E22_divide", with_("DZ") + "SELECT i, j, ROUND(v / 8.0::DOUBLE, 6) AS v FROM DZ")(lambda m: rounded(elementwise.divide(m.DZ, 8.0).df))
query("E23_scale_columns", with_("PS") + f"SELECT i, j, v * d AS v FROM PS JOIN {FULL} ON j = k")(lambda m: elementwise.scale_columns(m.PS, full_part(m)).df)
query("E23_scale_both", with_("NN") + "SELECT i, j, v * i * j AS v FROM NN")(lambda m: elementwise.scale_both(m.spark.range(1, 26).selectExpr("id AS i", "id AS v"), m.NN, m.spark.range(1, 26).selectExpr("id AS i", "id AS v")).df)
query("E24_divide_rows", with_("NN") + "SELECT i, j, ROUND(v / i::DOUBLE, 6) AS v FROM NN")(lambda m: rounded(elementwise.divide_rows(m.spark.range(1, 26).selectExpr("id AS i", "id AS v"), m.NN).df))
query("E25_axpy", with_("sx") + f"SELECT k AS i, d + 3 * COALESCE(sx.v, 0) AS v FROM {FULL} LEFT JOIN sx ON sx.i = k")(lambda m: elementwise.axpy(3, m.sx, full_part(m)))

NAMED = {  # SQL of functions of x over the values of DZ scaled into (-1, 1)
    "abs": "abs(x)", "abs2": "x * x", "sqrt": "sqrt(x)", "cbrt": "cbrt(x)", "sign": "CAST(sign(x) AS DOUBLE)", "floor": "floor(x)", "ceil": "ceil(x)", "trunc": "trunc(x)", "log1p": "ln(1 + x)", "expm1": "exp(x) - 1",
    "sin": "sin(x)", "tan": "tan(x)", "asin": "asin(x)", "atan": "atan(x)", "sinh": "sinh(x)", "tanh": "tanh(x)", "asinh": "asinh(x)", "atanh": "atanh(x)", "sinpi": "sin(pi() * x)", "sind": "sin(radians(x))", "tand": "tan(radians(x))", "asind": "degrees(asin(x))", "atand": "degrees(atan(x))",
}
query("E01_functions", with_("SM") + ", X AS (SELECT i, j, v / 40.0::DOUBLE AS x FROM SM) SELECT i, j, " + ", ".join(f"ROUND({s}, 6) AS f_{n}" for n, s in NAMED.items()) + " FROM X")(lambda m: m.SM.df.select("i", "j", *[F.round(scalar.KEEPS_ZERO[n](F.col("v") / 40.0), 6).alias(f"f_{n}") for n in NAMED]))
FILLED = {
    "exp": "exp(x)", "exp2": "pow(2, x)", "exp10": "pow(10, x)", "log": "CASE WHEN x = 0 THEN -'inf'::DOUBLE ELSE ln(x) END", "log2": "CASE WHEN x = 0 THEN -'inf'::DOUBLE ELSE log2(x) END", "log10": "CASE WHEN x = 0 THEN -'inf'::DOUBLE ELSE log10(x) END",
    "cos": "cos(x)", "acos": "acos(x)", "cosh": "cosh(x)", "cospi": "cos(pi() * x)", "cosd": "cos(radians(x))", "sec": "1 / cos(x)", "sech": "1 / cosh(x)", "csc": "CASE WHEN x = 0 THEN 'inf'::DOUBLE ELSE 1 / sin(x) END", "cot": "CASE WHEN x = 0 THEN 'inf'::DOUBLE ELSE 1 / tan(x) END",
    "csch": "CASE WHEN x = 0 THEN 'inf'::DOUBLE ELSE 1 / sinh(x) END", "coth": "CASE WHEN x = 0 THEN 'inf'::DOUBLE ELSE 1 / tanh(x) END", "acot": "CASE WHEN x = 0 THEN pi() / 2 ELSE atan(1 / x) END",
}
query("E02_functions", with_("SM", "GRID") + ", X AS (SELECT i, j, COALESCE(v, 0) / 40.0::DOUBLE AS x FROM GRID LEFT JOIN SM USING (i, j)) SELECT i, j, " + ", ".join(f"ROUND({s}, 5) AS f_{n}" for n, s in FILLED.items()) + " FROM X")(lambda m: build.dense(m.SM).select("i", "j", *[F.round(scalar.FILLS_ZERO[n](F.col("v") / 40.0), 5).alias(f"f_{n}") for n in FILLED]))

# ---- products

PRODUCT = "SELECT a.j AS i, b.j AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM OP a JOIN OS b ON a.i = b.i GROUP BY 1, 2"
query("J01_matmul", with_("OP", "OS") + PRODUCT)(lambda m: products.matmul(access.transpose(m.OP), m.OS).df)
query("J01_chain", with_("CO", "OP", "PS") + "SELECT c.i, s.j, CAST(SUM(c.v * o.v * s.v) AS BIGINT) AS v FROM CO c JOIN OP o ON c.j = o.i JOIN PS s ON o.j = s.i GROUP BY 1, 2")(lambda m: products.chain([m.CO, m.OP, m.PS], [m.orders, m.size("lineitem"), m.size("lineitem")]).df)
query("J02_matvec", with_("OP", "px") + "SELECT OP.i, CAST(SUM(OP.v * px.v) AS BIGINT) AS v FROM OP JOIN px ON OP.j = px.i GROUP BY 1")(lambda m: products.matvec(m.OP, m.px).df)
query("J03_matvec_dense", with_("PS") + f"SELECT k.i, 2 * COALESCE(CAST(SUM(PS.v * f.d) AS BIGINT), 0) + 5 * k.i AS v FROM {KEYS} k LEFT JOIN PS ON PS.i = k.i LEFT JOIN {FULL} f ON PS.j = f.k GROUP BY k.i")(lambda m: products.mul_dense(m.PS, full_part(m), m.table("part").selectExpr("p_partkey + 1 AS i", "p_partkey + 1 AS v"), 2, 5))
query("J04_transposed_matvec", with_("PS", "px") + "SELECT PS.j AS i, CAST(SUM(PS.v * px.v) AS BIGINT) AS v FROM PS JOIN px ON PS.i = px.i GROUP BY 1")(lambda m: products.matvec(access.transpose(m.PS), m.px).df)
query("J05_matmul_dense", with_("SM", "SM2", "GRID") + "SELECT g.i, g.j, CAST(COALESCE(SUM(a.v * b.v), 0) AS BIGINT) AS v FROM (SELECT DISTINCT a.j AS i, b.j FROM GRID a, GRID b) g LEFT JOIN SM a ON a.j = g.i LEFT JOIN SM2 b ON b.i = a.i AND b.j = g.j GROUP BY 1, 2")(lambda m: products.mul_dense_matrix(access.transpose(m.SM), build.dense(m.SM2), 10))
query("J06_both_transposed", with_("PS", "OP") + "SELECT a.j AS i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM PS a JOIN OP b ON a.i = b.j GROUP BY 1, 2")(lambda m: products.matmul(access.transpose(m.PS), access.transpose(m.OP)).df)
query("J07_mul_into", with_("NN") + "SELECT i, j, CAST(SUM(v) AS BIGINT) AS v FROM (SELECT a.i, b.j, 2 * SUM(a.v * b.v) AS v FROM NN a JOIN NN b ON a.j = b.i GROUP BY 1, 2 UNION ALL SELECT i, j, 3 * v FROM NN) GROUP BY 1, 2")(lambda m: products.mul_into(m.NN, m.NN, m.NN, 2, 3).df)
query("J08_triangular", with_("NN") + "SELECT a.i, b.j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM NN a JOIN NN b ON a.j = b.i WHERE a.i >= a.j GROUP BY 1, 2")(lambda m: products.matmul(m.NN.of(m.NN.df, structure="lower"), m.NN).df)
query("J09_symmetric", with_("NN") + ", S AS (SELECT i, j, v FROM NN WHERE i <= j UNION ALL SELECT j, i, v FROM NN WHERE i < j) SELECT a.i, b.j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM S a JOIN NN b ON a.j = b.i GROUP BY 1, 2")(lambda m: products.matmul(m.NN.of(m.NN.df, structure="symmetric"), m.NN).df)
query("J10_dense_times_vector", with_("SM", "SM2") + "SELECT SM.i, CAST(SUM(SM.v * x.v) AS BIGINT) AS v FROM SM JOIN (SELECT j, v FROM SM2 WHERE i = 3) x USING (j) GROUP BY 1")(lambda m: products.matvec(m.SM, SparseVector(m.SM2.df.where("i = 3").select(F.col("j").alias("i"), "v"), 10)).df)
query("J11_dot", with_("px", "py") + "SELECT CAST(COALESCE(SUM(px.v * py.v), 0) AS BIGINT) AS v FROM px JOIN py USING (i)")(lambda m: m.row(v=products.dot(m.px, m.py)))
query("J12_frobenius", with_("PS", "DZ") + "SELECT CAST(SUM(PS.v * DZ.v) AS BIGINT) AS v FROM PS JOIN DZ USING (i, j)")(lambda m: m.row(v=products.dot(m.PS, m.DZ, None)))
query("J13_bilinear", with_("px", "PS", "sx") + "SELECT CAST(SUM(px.v * PS.v * sx.v) AS BIGINT) AS v FROM PS JOIN px ON PS.i = px.i JOIN sx ON PS.j = sx.i")(lambda m: m.row(v=products.bilinear(m.px, m.PS, m.sx, None)))
query("J14_kron", with_("SM", "SM2") + "SELECT (a.i - 1) * 40 + b.i AS i, (a.j - 1) * 10 + b.j AS j, a.v * b.v AS v FROM SM a, SM2 b")(lambda m: products.kron(m.SM, m.SM2).df)
query("J15_lowrankupdate", with_("SM", "SM2", "GRID") + "SELECT g.i, g.j, COALESCE(SM.v, 0) + 2 * COALESCE(x.v, 0) * COALESCE(y.v, 0) AS v FROM GRID g LEFT JOIN SM USING (i, j) LEFT JOIN (SELECT i, v FROM SM2 WHERE j = 2) x USING (i) LEFT JOIN (SELECT j, v FROM SM2 WHERE i = 3) y USING (j)")(lambda m: products.lowrankupdate(build.dense(m.SM), SparseVector(m.SM2.df.where("j = 2").select("i", "v"), 40), SparseVector(m.SM2.df.where("i = 3").select(F.col("j").alias("i"), "v"), 10), 2))
query("J16_estimate", "SELECT ROUND(CAST(100 * 100 * (1 - pow(1 - 0.01, 50)) AS DOUBLE), 6) AS v")(lambda m: m.row(v=round(products.estimate_mulsize(100, 500, 50, 500, 100), 6)))

# ---- reductions

Z = "(SELECT COUNT(*) FROM part) * (SELECT COUNT(*) FROM supplier) - (SELECT COUNT(*) FROM DZ)"
query("A01_sum", with_("DZ") + "SELECT CAST(SUM(v) AS BIGINT) AS v FROM DZ")(lambda m: reductions.sum_(m.DZ))
query("A01_sum_f", with_("DZ") + f"SELECT CAST((SELECT SUM(v * v + 1) FROM DZ) + {Z} AS BIGINT) AS v")(lambda m: reductions.sum_(m.DZ, lambda v: v * v + 1))
query("A02_sum_columns", with_("DZ") + f"SELECT k.j, CAST(COALESCE(SUM(v), 0) AS BIGINT) AS v FROM {COLS} k LEFT JOIN DZ USING (j) GROUP BY 1")(lambda m: reductions.sum_(m.DZ, dims=1))
query("A02_sum_rows", with_("DZ") + f"SELECT k.i, CAST(COALESCE(SUM(v), 0) AS BIGINT) AS v FROM {KEYS} k LEFT JOIN DZ USING (i) GROUP BY 1")(lambda m: reductions.sum_(m.DZ, dims=2))
query("A03_prod", with_("UE") + "SELECT j, ROUND(product(v / 50.0::DOUBLE), 6) AS v FROM UE GROUP BY 1")(lambda m: rounded(reductions.prod(m.UE, lambda v: v / 50.0, dims=1)))
query("A03_prod_zero", "SELECT 0.0::DOUBLE AS v")(lambda m: reductions.prod(m.PS))
query("A04_minimum", with_("UE", "PS") + "SELECT (SELECT MIN(v) FROM UE) AS full_, CAST(0 AS BIGINT) AS sparse_")(lambda m: reductions.minimum(m.UE).withColumnRenamed("v", "full_").crossJoin(reductions.minimum(m.PS).withColumnRenamed("v", "sparse_")))
query("A04_maximum_columns", with_("DZ") + f"SELECT k.j, GREATEST(COALESCE(MAX(v), 0), 0) AS v FROM {COLS} k LEFT JOIN DZ USING (j) GROUP BY 1")(lambda m: reductions.maximum(m.DZ, dims=1))
query("A05_extrema", with_("UE") + "SELECT i, MIN(v) AS min, MAX(v) AS max FROM UE GROUP BY 1")(lambda m: reductions.extrema(m.UE, dims=2))
query("A06_mapreduce", with_("SM") + "SELECT MAX(v * 3) AS v FROM SM")(lambda m: m.row(v=reductions.mapreduce(m.SM, lambda v: v * 3, F.greatest, None)))
query("A07_any_columns", with_("DZ") + f"SELECT k.j, COALESCE(BOOL_OR(v > 25), FALSE) AS v FROM {COLS} k LEFT JOIN DZ USING (j) GROUP BY 1")(lambda m: reductions.any_(m.DZ, lambda v: v > 25, dims=1))
query("A07_all_rows", with_("DZ", "N_SUPP") + f"SELECT k.i, COALESCE(BOOL_AND(v < 20), TRUE) AS v FROM {KEYS} k LEFT JOIN DZ USING (i) GROUP BY 1")(lambda m: reductions.all_(m.DZ, lambda v: v < 20, dims=2))
query("A08_count_rows", with_("DZ", "N_SUPP") + f"SELECT k.i, n - COUNT(v) FILTER (v >= 5) AS v FROM {KEYS} k CROSS JOIN N_SUPP LEFT JOIN DZ USING (i) GROUP BY 1, n")(lambda m: reductions.count(m.DZ, lambda v: v < 5, dims=2))
query("A09_iszero_isone", "SELECT TRUE AS z, FALSE AS nz, TRUE AS o")(lambda m: m.row(z=predicates.iszero(access.fillstored(m.DZ, 0)), nz=predicates.iszero(m.DZ), o=predicates.isone(build.identity(m.spark, 9))))
query("A10_findmax", with_("PS") + "SELECT v, i, j FROM PS ORDER BY v DESC, j, i LIMIT 1")(lambda m: reductions.findmax(m.PS))
query("A10_findmin_columns", with_("DZ", "N_PART") + f", G AS (SELECT k.i, c.j, COALESCE(v, 0) AS v FROM {KEYS} k CROSS JOIN {COLS} c LEFT JOIN DZ ON DZ.i = k.i AND DZ.j = c.j) SELECT MIN(v) AS v, arg_min(i, v * 1000000 + i) AS i, j FROM G GROUP BY j")(lambda m: reductions.findmin(m.DZ, dims=1).select("v", "i", "j"))
query("A11_argmin", with_("UE") + "SELECT i, j FROM UE ORDER BY v, j, i LIMIT 1")(lambda m: reductions.findmin(m.UE).select("i", "j"))
query("A12_vector_findmax", with_("px") + "SELECT v, i FROM px ORDER BY v DESC, i LIMIT 1")(lambda m: reductions.findmax(m.px))


def norms_row(m, a):
    two, one, inf, zero, three = reductions.norms(a, 2, 1, float("inf"), 0, 3)
    return m.row(two=round(two, 6), one=one, inf=inf, zero=zero, three=round(three, 6))


query("A13_norms", with_("DZ") + "SELECT ROUND(SQRT(SUM(v * v)), 6) AS two, CAST(SUM(ABS(v)) AS DOUBLE) AS one, CAST(MAX(ABS(v)) AS DOUBLE) AS inf, CAST(COUNT(*) FILTER (v <> 0) AS DOUBLE) AS zero, ROUND(POW(SUM(POW(ABS(v), 3)), 1.0::DOUBLE / 3), 6) AS three FROM DZ")(lambda m: norms_row(m, m.DZ))
query("A14_opnorm", with_("PS") + "SELECT (SELECT CAST(MAX(s) AS DOUBLE) FROM (SELECT SUM(ABS(v)) AS s FROM PS GROUP BY j)) AS one, (SELECT CAST(MAX(s) AS DOUBLE) FROM (SELECT SUM(ABS(v)) AS s FROM PS GROUP BY i)) AS inf")(lambda m: m.row(one=reductions.opnorm(m.PS, 1), inf=reductions.opnorm(m.PS, float("inf"))))
query("A15_equal", "SELECT TRUE AS same, FALSE AS other")(lambda m: m.row(same=predicates.equal(m.DZ, access.dropzeros(m.DZ)), other=predicates.equal(m.DZ, m.PS)))
query("A16_nnz_slices", with_("DZ") + f"SELECT k.j, COUNT(v) AS v FROM {COLS} k LEFT JOIN DZ USING (j) GROUP BY 1")(lambda m: reductions.nnz_slices(m.DZ, 1))
query("A17_sort", with_("py", "N_PART") + ", S AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) AS r FROM py) SELECT CASE WHEN v > 0 THEN r + n - (SELECT COUNT(*) FROM py) ELSE r END AS i, v FROM S, N_PART")(lambda m: reductions.sort(m.py).df)
query("A19_vector_mapreduce", with_("py", "N_PART") + "SELECT CAST((SELECT SUM(v * v + 2) FROM py) + 2 * (n - (SELECT COUNT(*) FROM py)) AS BIGINT) AS v FROM N_PART")(lambda m: reductions.sum_(m.py, lambda v: v * v + 2))
DIFF = ", D AS (SELECT i - 1 AS i, j, v FROM DZ WHERE i > 1 UNION ALL SELECT i, j, -v FROM DZ, N_PART WHERE i < n) SELECT i, j, CAST(SUM(v) AS BIGINT) AS v FROM D GROUP BY 1, 2 HAVING COUNT(*) = 1 OR SUM(v) <> 0"
query("W01_diff_rows", with_("DZ", "N_PART") + DIFF)(lambda m: reductions.diff(m.DZ, 1).df)
query("W02_diff_columns", with_("DZ", "N_SUPP") + ", D AS (SELECT i, j - 1 AS j, v FROM DZ WHERE j > 1 UNION ALL SELECT i, j, -v FROM DZ, N_SUPP WHERE j < n) SELECT i, j, CAST(SUM(v) AS BIGINT) AS v FROM D GROUP BY 1, 2 HAVING COUNT(*) = 1 OR SUM(v) <> 0")(lambda m: reductions.diff(m.DZ, 2).df)
query("W03_ordinal", with_("PS") + "SELECT ROW_NUMBER() OVER (ORDER BY j, i) AS pos, i, j, v FROM PS")(lambda m: reductions.ordinal(m.PS))
