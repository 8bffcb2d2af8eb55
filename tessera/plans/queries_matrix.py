"""Queries: constructors, accessors, filters, indexing, concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import SparseMatrix, SparseVector
from ..operators import access, concat, indexing, predicates, products, reductions
from ..sources import build
from .matrices import SQL, with_
from .registry import query

OUT = "SELECT i, j, v FROM "
ENTRY = "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM "


def flagship(m):
    """Co-purchases of parts and suppliers, OP' * OS, and the parts' row sums."""
    return reductions.sum_(products.matmul(access.transpose(m.OP), m.OS), dims=2)


FLAGSHIP = with_("OP", "OS", "N_PART") + """, P AS (SELECT OP.j AS i, OS.j AS j, SUM(OP.v * OS.v) AS v FROM OP JOIN OS ON OP.i = OS.i GROUP BY 1, 2)
SELECT k.i, CAST(COALESCE(SUM(P.v), 0) AS BIGINT) AS v FROM (SELECT p_partkey + 1 AS i FROM part) k LEFT JOIN P ON P.i = k.i GROUP BY 1"""
query("flagship", FLAGSHIP)(flagship)

# ---- constructors

query("S01_coo_sum", SQL["OP"])(lambda m: m.OP.df)
query("S02_coo_bool", "SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, BOOL_OR(l_returnflag = 'R') AS v FROM lineitem GROUP BY 1, 2")(lambda m: build.sparse(m.lines("l_partkey", "l_suppkey", "l_returnflag = 'R'"), m.parts, m.suppliers).df)
query("S03_coo_max", "SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, MAX(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2")(lambda m: build.sparse(m.lines("l_partkey", "l_suppkey"), m.parts, m.suppliers, "max").df)


@query("S03_coo_fold", "SELECT i, j, CAST(list_reduce(list(v ORDER BY k), lambda a, x: a - x) AS BIGINT) AS v FROM (SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, CAST(l_quantity AS BIGINT) AS v, l_orderkey * 8 + l_linenumber AS k FROM lineitem) GROUP BY 1, 2")
def coo_fold(m):
    df = m.table("lineitem").select((F.col("l_partkey") + 1).alias("i"), (F.col("l_suppkey") + 1).alias("j"), F.col("l_quantity").cast("long").alias("v"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return build.sparse(df, m.parts, m.suppliers, lambda a, x: a - x, order="k").df


query("S04_coo_scalar", "SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, CAST(2 * COUNT(*) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2")(lambda m: build.sparse(m.lines("l_partkey", "l_suppkey", "2L"), m.parts, m.suppliers).df)
query("S05_coo_inferred", "SELECT MAX(l_partkey) + 1 AS m, MAX(l_suppkey) + 1 AS n FROM lineitem")(lambda m: (lambda a: m.row(m=a.m, n=a.n))(build.sparse(m.lines("l_partkey", "l_suppkey"))))
query("S06_coo_checked", SQL["PS"])(lambda m: build.sparse(m.lines("l_partkey", "l_suppkey"), m.parts, m.suppliers, check=True).df)
query("S07_from_dense", "SELECT vec_id + 1 AS i, j, v FROM (SELECT vec_id, UNNEST(embedding) AS v, CAST(UNNEST(range(1, 65)) AS BIGINT) AS j FROM embeddings) WHERE v <> 0")(lambda m: (lambda e: build.from_dense_rows(e.select((F.col("vec_id") + 1).alias("r"), "embedding"), "r", "embedding", e.count(), 64).df)(m.table("embeddings")))
query("S08_banded", with_("px") + "SELECT i, i AS j, v FROM px UNION ALL SELECT i + 1, i, v FROM px")(lambda m: build.banded({0: SparseVector(m.px.df, m.parts + 1), -1: m.px}, m.parts + 1, m.parts + 1).df)
query("S09_identity", "SELECT s_suppkey + 1 AS i, s_suppkey + 1 AS j, CAST(3 AS BIGINT) AS v FROM supplier")(lambda m: build.cast(build.identity(m.spark, m.suppliers, m.parts, 3), "bigint").df)
query("S10_symmetric", with_("NN") + "SELECT i, j, v FROM NN WHERE i <= j UNION ALL SELECT j, i, v FROM NN WHERE i < j")(lambda m: m.NN.of(m.NN.df, structure="symmetric").entries)
query("S10_unit_lower", with_("NN") + "SELECT i, j, v FROM NN WHERE i > j UNION ALL SELECT CAST(n_nationkey + 1 AS BIGINT), CAST(n_nationkey + 1 AS BIGINT), CAST(1 AS BIGINT) FROM nation")(lambda m: m.NN.of(m.NN.df, structure="unit_lower").entries)
query("S12_spzeros", "SELECT CAST(0 AS BIGINT) AS nnz")(lambda m: m.row(nnz=access.nnz(build.spzeros(m.spark, 5, 7))))
query("S13_pattern", "SELECT DISTINCT l_partkey + 1 AS i, l_suppkey + 1 AS j, CAST(0 AS BIGINT) AS v FROM lineitem")(lambda m: build.pattern(m.lines("l_partkey", "l_suppkey"), m.parts, m.suppliers, "bigint").df)
query("S14_sprand", "SELECT TRUE AS inside, TRUE AS near")(lambda m: (lambda a: (lambda r: m.row(inside=bool(r.ok), near=abs(r.n - 20_000) < 800))(a.df.agg(F.count("*").alias("n"), F.bool_and(F.expr("v >= 0 AND v < 1 AND i BETWEEN 1 AND 1000 AND j BETWEEN 1 AND 200")).alias("ok")).first()))(build.sprand(m.spark, 1000, 200, 0.1, 7)))
query("S15_sprandn", "SELECT TRUE AS near")(lambda m: (lambda r: m.row(near=abs(r.m) < 0.05 and abs(r.s - 1) < 0.05))(build.sprandn(m.spark, 1000, 200, 0.1, 9).df.agg(F.avg("v").alias("m"), F.stddev("v").alias("s")).first()))
query("S17_spdiagm", with_("px", "py") + "SELECT i, j, CAST(SUM(v) AS BIGINT) AS v FROM (SELECT i, i + 1 AS j, v FROM px UNION ALL SELECT i, i + 1, v FROM px UNION ALL SELECT i + 2, i, v FROM py) GROUP BY 1, 2")(lambda m: build.diagonals({1: SparseVector(m.px.df.union(m.px.df), m.parts), -2: m.py}).df)
query("S18_sparsevec", "SELECT l_partkey + 1 AS i, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1")(lambda m: build.sparsevec(m.lines("l_partkey", "l_suppkey").select("i", "v"), m.parts).df)
query("S19_from_map", "SELECT s_suppkey + 1 AS i, CAST(s_nationkey AS BIGINT) AS v FROM supplier")(lambda m: build.from_map(m.table("supplier").select(F.create_map((F.col("s_suppkey") + 1), F.col("s_nationkey").cast("long")).alias("d")), "d", m.suppliers).df)
query("S20_dense_vector", "SELECT s_suppkey + 1 AS i, CAST(s_nationkey AS BIGINT) AS v FROM supplier WHERE s_nationkey <> 0")(lambda m: build.from_dense(m.table("supplier").select((F.col("s_suppkey") + 1).alias("i"), F.col("s_nationkey").cast("long").alias("v")), m.suppliers).df)
query("S21_flatten", with_("PS", "N_PART") + "SELECT (j - 1) * n + i AS i, v FROM PS, N_PART")(lambda m: build.flatten(m.PS).df)
query("S22_column_vector", with_("px") + "SELECT i, v FROM px")(lambda m: build.column_vector(build.as_matrix(m.px)).df)
query("S23_as_matrix", with_("px") + "SELECT i, CAST(1 AS BIGINT) AS j, v FROM px")(lambda m: build.as_matrix(m.px).df)
query("S24_dense", with_("SM", "GRID") + "SELECT i, j, COALESCE(v, 0) AS v FROM GRID LEFT JOIN SM USING (i, j)")(lambda m: build.dense(m.SM))
query("S25_convert_diagonal", with_("px") + "SELECT i, i AS j, v FROM px")(lambda m: build.converted(build.diagonals({0: m.px}), "diagonal").entries)
query("S26_cast", with_("PS") + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM PS")(lambda m: build.cast(m.PS, "double").df)
query("S27_similar", with_("PS") + "SELECT i, j, CAST(0 AS DOUBLE) AS v FROM PS")(lambda m: build.similar(m.PS, "double").df)
query("S28_copyto", with_("SM", "SM2") + "SELECT i, j, v FROM SM2 WHERE (j - 1) * 40 + i <= 200 UNION ALL SELECT i, j, v FROM SM WHERE (j - 1) * 40 + i > 200")(lambda m: build.copyto(m.SM, indexing.submatrix(m.SM2, None, range(1, 6))).df)
query("S31_spy", with_("PS", "N_PART", "N_SUPP") + "SELECT CAST(floor((i - 1) * 8 / p.n) AS BIGINT) AS y, CAST(floor((j - 1) * 8 / s.n) AS BIGINT) AS x, COUNT(*) AS n FROM PS, N_PART p, N_SUPP s GROUP BY 1, 2")(lambda m: build.spy(m.PS, 8, 8))
query("S33_one", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS i, CAST(n_nationkey + 1 AS BIGINT) AS j, CAST(1 AS BIGINT) AS v FROM nation")(lambda m: build.one(m.NN).df)
query("S34_copytrito", with_("SM", "SM2", "GRID") + "SELECT i, j, CASE WHEN i <= j THEN COALESCE(SM2.v, 0) ELSE COALESCE(SM.v, 0) END AS v FROM GRID LEFT JOIN SM USING (i, j) LEFT JOIN SM2 USING (i, j)")(lambda m: build.copytrito(build.dense(m.SM), m.SM2, "U"))

# ---- accessors

query("P01_size", with_("N_ORDERS", "N_PART") + "SELECT o.n AS m, p.n AS n FROM N_ORDERS o, N_PART p")(lambda m: m.row(m=m.OP.m, n=m.OP.n))
query("P02_nnz", with_("DZ") + "SELECT COUNT(*) AS nnz, COUNT(*) FILTER (i >= j) AS lower FROM DZ")(lambda m: m.row(nnz=access.nnz(m.DZ), lower=access.nnz(m.DZ.of(m.DZ.df, structure="lower"))))
query("P03_count", with_("DZ", "N_PART", "N_SUPP") + "SELECT (SELECT COUNT(*) FROM DZ WHERE v > 5) AS above, p.n * s.n - (SELECT COUNT(*) FROM DZ WHERE v > 5) AS others FROM N_PART p, N_SUPP s")(lambda m: m.row(above=access.count(m.DZ, lambda v: v > 5), others=access.count(m.DZ, lambda v: v <= 5)))
query("P04_nonzeros", with_("DZ") + "SELECT v FROM DZ")(lambda m: access.findnz(m.DZ).select("v"))
query("P05_nzrange", with_("PS") + "SELECT j, CAST(SUM(n) OVER (ORDER BY j) - n + 1 AS BIGINT) AS first, CAST(SUM(n) OVER (ORDER BY j) AS BIGINT) AS last FROM (SELECT j, COUNT(*) AS n FROM PS GROUP BY 1)")(lambda m: access.nzrange(m.PS))
query("P06_findnz", with_("DZ") + "SELECT i, j, v, ROW_NUMBER() OVER (ORDER BY j, i) AS pos FROM DZ")(lambda m: reductions.ordinal(m.DZ).select("i", "j", "v", "pos"))
query("P07_findall", with_("DZ") + "SELECT i, j FROM DZ WHERE v > 5")(lambda m: access.findall(m.DZ, lambda v: v > 5))
query("P07_findall_zero", with_("SM", "GRID") + "SELECT i, j FROM GRID LEFT JOIN SM USING (i, j) WHERE COALESCE(v, 0) = 0")(lambda m: access.findall(m.SM, lambda v: v == 0))
query("P08_findnext", with_("DZ", "N_PART") + "SELECT MIN(p) FILTER (p >= 1000) AS next, MAX(p) FILTER (p <= 1000) AS prev FROM (SELECT (j - 1) * n + i AS p FROM DZ, N_PART WHERE v <> 0)")(lambda m: m.row(next=access.findnext(m.DZ, 1000), prev=access.findprev(m.DZ, 1000)))
query("P09_isstored", with_("DZ") + "SELECT EXISTS (SELECT 1 FROM DZ WHERE i = 3 AND j = 5) AS stored")(lambda m: m.row(stored=access.isstored(m.DZ, 3, 5)))
query("P12_transpose", with_("OP") + "SELECT j AS i, i AS j, v FROM OP")(lambda m: access.transpose(m.OP).df)
query("P13_ftranspose", with_("OP") + "SELECT j AS i, i AS j, v * v AS v FROM OP")(lambda m: access.ftranspose(m.OP, lambda v: v * v).df)
query("P14_permute", with_("PS", "N_PART", "N_SUPP") + "SELECT p.n + 1 - i AS i, j % s.n + 1 AS j, v FROM PS, N_PART p, N_SUPP s")(lambda m: access.permute(m.PS, m.indices(range(m.parts, 0, -1)), m.indices([m.suppliers, *range(1, m.suppliers)])).df)
query("P15_reshape", with_("PS", "N_PART", "N_SUPP") + "SELECT ((j - 1) * p.n + i - 1) % s.n + 1 AS i, CAST(((j - 1) * p.n + i - 1) // s.n + 1 AS BIGINT) AS j, v FROM PS, N_PART p, N_SUPP s")(lambda m: access.reshape(m.PS, m.suppliers, m.parts).df)
query("P16_reverse", with_("PS", "N_PART") + "SELECT n + 1 - i AS i, j, v FROM PS, N_PART")(lambda m: access.reverse(m.PS, (1,)).df)
query("P16_reverse_range", with_("px") + "SELECT CASE WHEN i BETWEEN 10 AND 90 THEN 100 - i ELSE i END AS i, v FROM px")(lambda m: access.reverse(m.px, start=10, stop=90).df)
query("P17_rotr90", with_("PS", "N_PART") + "SELECT j AS i, n + 1 - i AS j, v FROM PS, N_PART")(lambda m: access.rotr90(m.PS).df)
query("P17_rotl90", with_("PS", "N_SUPP") + "SELECT n + 1 - j AS i, i AS j, v FROM PS, N_SUPP")(lambda m: access.rotl90(m.PS).df)
query("P17_rot180", with_("PS", "N_PART", "N_SUPP") + "SELECT p.n + 1 - i AS i, s.n + 1 - j AS j, v FROM PS, N_PART p, N_SUPP s")(lambda m: access.rot180(m.PS).df)
query("P18_circshift", with_("PS", "N_PART", "N_SUPP") + "SELECT (i + 4) % p.n + 1 AS i, (j - 4 + s.n) % s.n + 1 AS j, v FROM PS, N_PART p, N_SUPP s")(lambda m: access.circshift(m.PS, 5, -3).df)
query("P19_swapcols", with_("PS") + "SELECT i, CASE j WHEN 2 THEN 7 WHEN 7 THEN 2 ELSE j END AS j, v FROM PS")(lambda m: access.swapcols(m.PS, 2, 7).df)
query("P19_swaprows", with_("PS") + "SELECT CASE i WHEN 2 THEN 7 WHEN 7 THEN 2 ELSE i END AS i, j, v FROM PS")(lambda m: access.swaprows(m.PS, 2, 7).df)
query("P20_expandptr", with_("PS") + "SELECT ROW_NUMBER() OVER (ORDER BY j) AS pos, j FROM PS")(lambda m: access.expandptr(access.nzrange(m.PS)))
query("P21_diag", with_("PS") + "SELECT i, v FROM PS WHERE j - i = 3")(lambda m: access.diag(m.PS, 3).df)
query("P22_trace", with_("NN") + "SELECT CAST(COALESCE(SUM(v), 0) AS BIGINT) AS tr FROM NN WHERE i = j")(lambda m: m.row(tr=access.trace(m.NN)))
query("P23_decrement", with_("PS") + "SELECT i - 1 AS i, j - 1 AS j, v FROM PS")(lambda m: access.shifted(m.PS.df, -1))

# ---- filters

query("F01_fkeep", with_("DZ") + "SELECT i, j, v FROM DZ WHERE i % 2 = 0 AND v > 3")(lambda m: access.fkeep(m.DZ, lambda i, j, v: (i % 2 == 0) & (v > 3)).df)
query("F01_fkeep_fixed", with_("DZ") + "SELECT i, j, CASE WHEN v > 3 THEN v ELSE 0 END AS v FROM DZ")(lambda m: access.fkeep(SparseMatrix(m.DZ.df, m.DZ.m, m.DZ.n, fixed=True), lambda i, j, v: v > 3).df)
query("F02_dropzeros", with_("DZ") + "SELECT i, j, v FROM DZ WHERE v <> 0")(lambda m: access.dropzeros(m.DZ).df)
query("F03_droptol", with_("DZ") + "SELECT i, j, v FROM DZ WHERE abs(v) > 4")(lambda m: access.droptol(m.DZ, 4).df)
query("F04_tril", with_("DZ") + "SELECT i, j, v FROM DZ WHERE i + 3 >= j")(lambda m: access.tril(m.DZ, 3).df)
query("F04_triu", with_("DZ") + "SELECT i, j, v FROM DZ WHERE j >= i - 2")(lambda m: access.triu(m.DZ, -2).df)
query("F05_dropstored", with_("DZ") + "SELECT i, j, v FROM DZ WHERE NOT (i BETWEEN 1 AND 50 AND j IN (2, 4, 6))")(lambda m: access.dropstored(m.DZ, m.indices(range(1, 51)), m.indices([2, 4, 6])).df)
query("F06_fillstored", with_("DZ") + "SELECT i, j, CAST(9 AS BIGINT) AS v FROM DZ")(lambda m: access.fillstored(m.DZ, 9).df)

# ---- indexing and assignment

query("G01_scalar", with_("PS") + "SELECT COALESCE((SELECT v FROM PS WHERE i = 5 AND j = 6), 0) AS v")(lambda m: m.row(v=indexing.get(m.PS, 5, 6)))
query("G02_column", with_("PS") + "SELECT i - 9 AS i, v FROM PS WHERE j = 4 AND i BETWEEN 10 AND 60")(lambda m: indexing.column(m.PS, 4, range(10, 61)).df)
query("G03_row", with_("PS") + "SELECT j AS i, v FROM PS WHERE i = 7")(lambda m: indexing.row(m.PS, 7).df)
query("G04_columns", with_("PS") + "SELECT i, pos AS j, v FROM PS JOIN (VALUES (CAST(1 AS BIGINT), 9), (2, 3), (3, 9)) t(pos, c) ON j = c")(lambda m: indexing.submatrix(m.PS, None, m.indices([9, 3, 9])).df)
query("G05_range", with_("PS") + "SELECT CAST((61 - i) // 3 + 1 AS BIGINT) AS i, pos AS j, v FROM PS JOIN (VALUES (CAST(1 AS BIGINT), 9), (2, 3)) t(pos, c) ON j = c WHERE i BETWEEN 1 AND 61 AND (61 - i) % 3 = 0")(lambda m: indexing.submatrix(m.PS, range(61, 0, -3), m.indices([9, 3])).df)
query("G06_general", with_("PS") + "SELECT a.pos AS i, b.pos AS j, v FROM PS JOIN (VALUES (CAST(1 AS BIGINT), 8), (2, 2), (3, 8), (4, 30)) a(pos, r) ON i = r JOIN (VALUES (CAST(1 AS BIGINT), 9), (2, 3), (3, 9)) b(pos, c) ON j = c")(lambda m: indexing.submatrix(m.PS, m.indices([8, 2, 8, 30]), m.indices([9, 3, 9])).df)
query("G07_mask", with_("PS", "px") + "SELECT k AS i, j, v FROM PS JOIN (SELECT i, ROW_NUMBER() OVER (ORDER BY i) AS k FROM px) USING (i)")(lambda m: indexing.submatrix(m.PS, indexing.from_mask(m.table("part").select((F.col("p_partkey") + 1).alias("pos"), (F.col("p_size") <= 5).alias("flag")))).df.select("i", "j", "v"))
query("G07_logical", with_("PS", "N_PART") + "SELECT ROW_NUMBER() OVER (ORDER BY (j - 1) * n + i) AS i, v FROM PS, N_PART WHERE v > 40")(lambda m: indexing.masked(m.PS, m.PS.of(m.PS.df.select("i", "j", (F.col("v") > 40).alias("v")))).df)
query("G08_linear", with_("PS", "N_PART") + "SELECT (j - 1) * n + i - 100 AS i, v FROM PS, N_PART WHERE (j - 1) * n + i BETWEEN 101 AND 2000")(lambda m: indexing.at_linear(m.PS, range(101, 2001)).df)
query("G09_vector", with_("px") + "SELECT i - 4 AS i, v FROM px WHERE i BETWEEN 5 AND 80")(lambda m: indexing.take(m.px, range(5, 81)).df)
query("G10_adjoint_row", with_("PS") + "SELECT i, v FROM PS WHERE j = 4")(lambda m: indexing.row(access.adjoint(m.PS), 4).df)
query("G13_rows_of_column", with_("PS") + "SELECT pos AS i, v FROM PS JOIN (VALUES (CAST(1 AS BIGINT), 8), (2, 2), (3, 8)) a(pos, r) ON i = r WHERE j = 3")(lambda m: indexing.column(m.PS, 3, m.indices([8, 2, 8])).df)
query("U01_set", with_("PS") + "SELECT i, j, v FROM PS WHERE NOT (i = 3 AND j = 4) UNION ALL SELECT CAST(3 AS BIGINT), CAST(4 AS BIGINT), CAST(77 AS BIGINT)")(lambda m: indexing.put(m.PS, 77, 3, 4).df)
query("U02_assign", with_("SM", "SM2") + ", B AS (SELECT i + 3 AS i, j + 2 AS j, v FROM SM2 WHERE i <= 20 AND j <= 5) SELECT i, j, v FROM SM WHERE NOT (i BETWEEN 4 AND 23 AND j BETWEEN 3 AND 7) UNION ALL SELECT i, j, COALESCE(B.v, 0) FROM (SELECT * FROM SM WHERE i BETWEEN 4 AND 23 AND j BETWEEN 3 AND 7) a FULL JOIN B USING (i, j) WHERE a.v IS NOT NULL OR B.v <> 0")(lambda m: indexing.assign(m.SM, m.indices(range(4, 24)), m.indices(range(3, 8)), indexing.submatrix(m.SM2, range(1, 21), range(1, 6))).df)
query("U03_fill_zero", with_("SM") + "SELECT i, j, CASE WHEN i <= 10 AND j IN (1, 3) THEN 0 ELSE v END AS v FROM SM")(lambda m: indexing.fill_region(m.SM, m.indices(range(1, 11)), m.indices([1, 3]), 0).df)
query("U03_fill_value", with_("SM", "GRID") + "SELECT i, j, CASE WHEN i <= 10 AND j IN (1, 3) THEN 5 ELSE v END AS v FROM GRID LEFT JOIN SM USING (i, j) WHERE v IS NOT NULL OR (i <= 10 AND j IN (1, 3))")(lambda m: indexing.fill_region(m.SM, m.indices(range(1, 11)), m.indices([1, 3]), 5).df)
query("U04_mask_set", with_("PS") + "SELECT i, j, CASE WHEN v > 40 THEN 1 ELSE v END AS v FROM PS")(lambda m: indexing.fill_mask(m.PS, m.PS.of(m.PS.df.select("i", "j", (F.col("v") > 40).alias("v"))), 1).df)
query("U05_fill", with_("GRID") + "SELECT i, j, CAST(6 AS BIGINT) AS v FROM GRID")(lambda m: indexing.fill(m.SM, 6).df)
query("U06_dense_set", with_("SM", "GRID") + "SELECT i, j, CASE WHEN i <= 40 THEN COALESCE(v, 0) END AS v FROM GRID LEFT JOIN SM USING (i, j)")(lambda m: build.dense(m.SM))
query("U07_mergeinds", with_("SM", "SM2") + "SELECT i, j, COALESCE(SM.v, 0) AS v FROM SM FULL JOIN SM2 USING (i, j)")(lambda m: indexing.mergeinds(m.SM, m.SM2).df)

# ---- concatenation

query("C01_vcat", with_("PS", "DZ", "N_PART") + "SELECT i, j, v FROM PS UNION ALL SELECT i + n, j, v FROM DZ, N_PART")(lambda m: concat.vcat(m.PS, m.DZ).df)
query("C02_hcat", with_("PS", "DZ", "N_SUPP") + "SELECT i, j, v FROM PS UNION ALL SELECT i, j + n, v FROM DZ, N_SUPP")(lambda m: concat.hcat(m.PS, m.DZ).df)
query("C03_hvcat", with_("SM", "SM2") + "SELECT i, j, v FROM SM UNION ALL SELECT i, j + 10, v FROM SM2 UNION ALL SELECT i + 40, j, v FROM SM2 UNION ALL SELECT i + 40, j + 10, v FROM SM")(lambda m: concat.hvcat([2, 2], m.SM, m.SM2, m.SM2, m.SM).df)
query("C04_with_identity", with_("NN") + "SELECT i, j, v FROM NN UNION ALL SELECT CAST(n_nationkey + 1 AS BIGINT), CAST(n_nationkey + 26 AS BIGINT), CAST(1 AS BIGINT) FROM nation")(lambda m: concat.hcat(m.NN, build.cast(build.identity(m.spark, 25), "bigint")).df)
query("C05_cat", with_("SM", "SM2") + "SELECT i, j, v FROM SM UNION ALL SELECT i + 40, j + 10, v FROM SM2")(lambda m: concat.cat(m.SM, m.SM2, dims=(1, 2)).df)
query("C06_vectors", with_("px", "py") + "SELECT i, CAST(1 AS BIGINT) AS j, v FROM px UNION ALL SELECT i, CAST(2 AS BIGINT), v FROM py")(lambda m: concat.hcat(m.px, m.py).df)
query("C07_blockdiag", with_("PS", "CO", "N_PART", "N_SUPP") + "SELECT i, j, v FROM PS UNION ALL SELECT i + p.n, j + s.n, v FROM CO, N_PART p, N_SUPP s")(lambda m: concat.blockdiag(m.PS, m.CO).df)
query("C08_repeat", with_("SM") + "SELECT i + 40 * x AS i, j + 10 * y AS j, v FROM SM, (VALUES (CAST(0 AS BIGINT)), (1), (2)) a(x), (VALUES (CAST(0 AS BIGINT)), (1)) b(y)")(lambda m: concat.repeat(m.SM, 3, 2).df)
query("C09_pattern_sets", with_("SM", "SM2") + "SELECT 'both' AS kind, i, j FROM SM JOIN SM2 USING (i, j) UNION ALL SELECT 'either', i, j FROM SM FULL JOIN SM2 USING (i, j) UNION ALL SELECT 'first', i, j FROM SM WHERE (i, j) NOT IN (SELECT (i, j) FROM SM2)")(lambda m: concat.pattern_intersect(m.SM, m.SM2).selectExpr("'both' AS kind", "i", "j").union(concat.pattern_union(m.SM, m.SM2).selectExpr("'either'", "i", "j")).union(concat.pattern_except(m.SM, m.SM2).selectExpr("'first'", "i", "j")))

# ---- predicates

query("R01_issymmetric", with_("NN") + "SELECT (SELECT BOOL_AND(a.v = COALESCE(b.v, 0)) FROM NN a LEFT JOIN NN b ON a.i = b.j AND a.j = b.i) AS plain, TRUE AS product")(lambda m: m.row(plain=predicates.issymmetric(m.NN), product=predicates.issymmetric(products.matmul(access.transpose(m.NN), m.NN))))
query("R02_istriu", with_("DZ") + "SELECT BOOL_AND(v = 0 OR j >= i) AS up, BOOL_AND(v = 0 OR j <= i) AS low, TRUE AS cut FROM DZ")(lambda m: m.row(up=predicates.istriu(m.DZ), low=predicates.istril(m.DZ), cut=predicates.istril(access.tril(m.DZ, 2), 2)))
query("R03_isdiag", "SELECT TRUE AS yes, FALSE AS no")(lambda m: m.row(yes=predicates.isdiag(build.diagonals({0: m.px})), no=predicates.isdiag(m.DZ)))
query("R04_isperm", "SELECT TRUE AS yes, FALSE AS no")(lambda m: m.row(yes=predicates.isperm(m.indices(range(9, 0, -1)), 9), no=predicates.isperm(m.indices([1, 2, 2]), 3)))
