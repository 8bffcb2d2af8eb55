"""Queries: introspection, checks and the remaining forms of products and factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..core import ArgumentError, DimensionMismatch, SparseMatrix, SparseVector
from ..operators import access, concat, elementwise, indexing, predicates, products, reductions, solvers
from ..sources import build
from .matrices import SQL, with_
from .queries_solve import RHS, result, rhs, spd
from .registry import query


def raises(error: type[Exception], f) -> bool:
    try:
        f()
    except error:
        return True
    return False


query("S11_sparse_q", "SELECT TRUE AS orthogonal, CAST(40 AS BIGINT) AS m")(lambda m: (lambda q: m.row(orthogonal=predicates.isone(q_rounded(q)), m=q.m))(solvers.qr(m.SM).Q()))


def q_rounded(q: SparseMatrix) -> SparseMatrix:
    gram = products.matmul(access.transpose(q), q)
    return access.dropzeros(gram.of(gram.df.withColumn("v", F.round("v", 8))))


query("S25_convert_checked", "SELECT TRUE AS refused")(lambda m: m.row(refused=raises(ArgumentError, lambda: build.converted(m.DZ, "upper"))))
query("S26_complex", with_("SM") + "SELECT i, j, CAST(v AS DOUBLE) AS re, CAST(0 AS DOUBLE) AS im FROM SM")(lambda m: build.as_complex(m.SM).df.select("i", "j", "v.re", "v.im"))
query("S32_from_table", "SELECT CAST(p_partkey + 1 AS BIGINT) AS i, CAST(p_size + 1 AS BIGINT) AS j, CAST(SUM(p_retailprice) AS DOUBLE) AS v FROM part GROUP BY 1, 2")(lambda m: build.from_table(m.table("part"), "p_partkey", "p_size", "p_retailprice").df)
query("S33_zero", "SELECT CAST(0 AS BIGINT) AS nnz")(lambda m: m.row(nnz=access.nnz(build.zero(m.PS))))
query("S36_storage_type", "SELECT CAST(1 AS BIGINT) AS upper_, CAST(0 AS BIGINT) AS general_, CAST(1 AS BIGINT) AS found")(lambda m: m.row(upper_=solvers.storage_type(m.NN.of(m.NN.df, structure="symmetric")), general_=solvers.storage_type(m.NN), found=solvers.storage_type(spd(m))))
query("S37_vector_and_back", with_("px") + "SELECT i, v FROM px")(lambda m: build.column_vector(build.as_matrix(build.column_vector(build.as_matrix(m.px)))).df)
query("P10_introspection", "SELECT TRUE AS sparse_, FALSE AS frame_, 'bigint' AS ind, TRUE AS wrapped, FALSE AS unwrapped")(lambda m: (lambda s: m.row(sparse_=access.issparse(m.PS), frame_=access.issparse(m.PS.df), ind=access.indtype(m.PS), wrapped=access.iswrapped(s), unwrapped=access.iswrapped(access.unwrap(s))))(m.NN.of(m.NN.df, structure="symmetric")))
query("P11_widelength", with_("N_PART", "N_SUPP") + "SELECT CAST(p.n * s.n AS BIGINT) AS n FROM N_PART p, N_SUPP s")(lambda m: m.row(n=access.widelength(m.PS)))
query("G11_copy_view", with_("PS") + "SELECT i - 4 AS i, j - 2 AS j, v FROM PS WHERE i BETWEEN 5 AND 50 AND j BETWEEN 3 AND 9")(lambda m: indexing.submatrix(m.PS, range(5, 51), range(3, 10)).df)
query("G12_colon", SQL["PS"])(lambda m: indexing.submatrix(m.PS).df)
query("U08_allowscalar", "SELECT TRUE AS refused")(lambda m: m.row(refused=scalar_refused(m)))


def scalar_refused(m) -> bool:
    indexing.allowscalar(False)
    try:
        return raises(RuntimeError, lambda: indexing.get(m.PS, 1, 1))
    finally:
        indexing.allowscalar(True)


query("E07_shape_check", "SELECT TRUE AS refused")(lambda m: m.row(refused=raises(DimensionMismatch, lambda: elementwise.emap2(lambda a, b: a + b, m.PS, m.OP))))
query("E08_row_and_column", with_("SM", "SM2") + "SELECT c.i, r.j, c.v * r.v AS v FROM (SELECT i, v FROM SM WHERE j = 2) c, (SELECT j, v FROM SM2 WHERE i = 3) r WHERE c.v * r.v <> 0")(lambda m: elementwise.broadcast2(lambda a, b: a * b, indexing.column(m.SM, 2), SparseMatrix(m.SM2.df.where("i = 3").select(F.lit(1).cast("long").alias("i"), "j", "v"), 1, 10)).df)
query("E24_zero_refused", "SELECT TRUE AS refused")(lambda m: m.row(refused=raises(ArithmeticError, lambda: elementwise.divide_rows(m.spark.range(1, 26).selectExpr("id AS i", "id - 3 AS v"), m.NN))))
def frobenius_dense(m):
    """The product with a dense copy is zero where the patterns don't meet; the query, as its SQL, then has no value."""
    apart = m.SM.df.join(m.SM2.df, ["i", "j"], "left_semi").isEmpty()
    return m.row(v=None if apart else products.dot_dense(m.SM, build.dense(m.SM2)))


query("J12_frobenius_dense", with_("SM", "SM2") + "SELECT CAST(SUM(SM.v * SM2.v) AS BIGINT) AS v FROM SM JOIN SM2 USING (i, j)")(frobenius_dense)
query("J14_kron_vectors", with_("sx") + "SELECT (a.i - 1) * (SELECT COUNT(*) FROM supplier) + b.i AS i, a.v * b.v AS v FROM sx a, sx b")(lambda m: products.kron(m.sx, m.sx).df)
query("J17_dimension_check", "SELECT TRUE AS refused")(lambda m: m.row(refused=raises(DimensionMismatch, lambda: products.matmul(m.PS, m.PS))))
query("J18_times_q", "SELECT TRUE AS same")(lambda m: (lambda f, a: m.row(same=bool(np.allclose(f.apply(f.r, transposed=False)[np.argsort(f.prow)][:, np.argsort(f.pcol)], a))))(solvers.qr(m.SM), solvers.local(m.SM)))
query("J20_transposed_hermitian", RHS)(lambda m: (lambda a: result(m, solvers.solve(access.transpose(a.of(a.df, structure="symmetric")), rhs()), a))(spd(m)))
query("A03_prod_f", "SELECT CAST(1 AS DOUBLE) AS v")(lambda m: reductions.prod(access.fillstored(m.PS, 0), lambda v: v + 1))
query("A10_findmax_rows", with_("PS", "N_SUPP") + "SELECT i, MAX(v) AS v, CAST(arg_max(j, v * 100000 - j) AS BIGINT) AS j FROM PS GROUP BY i")(lambda m: reductions.findmax(m.PS, dims=2).where("v > 0").select("i", "v", "j"))
query("W04_permuted_order", with_("PS", "N_PART") + "SELECT ROW_NUMBER() OVER (ORDER BY j, n + 1 - i) AS pos, n + 1 - i AS i, j, v FROM PS, N_PART")(lambda m: reductions.ordinal(access.permute(m.PS, m.indices(range(m.parts, 0, -1)), m.indices(range(1, m.suppliers + 1)))))
query("W05_sorted", with_("DZ") + "SELECT ROW_NUMBER() OVER (ORDER BY j, i) AS pos, v FROM DZ")(lambda m: reductions.ordinal(m.DZ).select("pos", "v"))
query("C05_mixed", with_("SM", "px") + "SELECT i, j, v FROM SM UNION ALL SELECT i, CAST(11 AS BIGINT), v FROM px WHERE i <= 40")(lambda m: concat.cat(m.SM, SparseVector(m.px.df.where("i <= 40"), 40), dims=2).df)
query("D02_dense_triangular", "SELECT TRUE AS same")(lambda m: (lambda t, x: m.row(same=bool(np.allclose(t @ solvers.substituted(t, x, True), x))))(np.tril(solvers.local(m.NN)) + 200 * np.eye(25), solvers.local_vector(SparseVector(m.NN.df.where("j = 4").select("i", "v"), 25))))
query("D05_factorize", "SELECT 'LU' AS a, 'Cholesky' AS b, 'QR' AS c")(lambda m: m.row(a=type(solvers.factorize(m.NN)).__name__, b=type(solvers.factorize(spd(m))).__name__, c=type(solvers.factorize(m.SM)).__name__))
query("D10_refinement", RHS)(lambda m: result(m, solvers.refined(solvers.lu(m.NN), m.NN, rhs(), 2), m.NN))
query("D18_apply_q", "SELECT TRUE AS there_, TRUE AS right_")(lambda m: (lambda f, b: m.row(there_=bool(np.allclose(f.apply(f.apply(b, transposed=True), transposed=False), b)), right_=bool(np.allclose(solvers.right_apply(f, b.T, transposed=False), b.T @ f.q()))))(solvers.qr(m.SM), np.arange(80.0).reshape(40, 2)))
query("D21_orderings", "SELECT CAST(9 AS BIGINT) AS n, TRUE AS refused")(lambda m: m.row(n=sum(solvers.qr(m.SM, ordering=o).rank == solvers.rank(m.SM) for o in solvers.ORDERINGS), refused=raises(ArgumentError, lambda: solvers.qr(m.SM, ordering="none"))))
query("D23_opnormestinv", "SELECT TRUE AS same")(lambda m: m.row(same=abs(solvers.opnormestinv(m.NN) / float(np.abs(np.linalg.inv(solvers.local(m.NN))).sum(0).max()) - 1) < 1e-6))
query("D24_refused", "SELECT TRUE AS inv, TRUE AS eigen")(lambda m: m.row(inv=raises(ArgumentError, lambda: solvers.inv(m.NN)), eigen=raises(ArgumentError, lambda: solvers.eigen(m.NN))))
query("D25_aat", with_("SM") + "SELECT a.i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM SM a JOIN SM b USING (j) GROUP BY 1, 2")(lambda m: solvers.aat(m.SM).df)
query("D27_errors", "SELECT TRUE AS singular, TRUE AS indefinite")(lambda m: m.row(singular=raises(ArithmeticError, lambda: solvers.lu(SparseMatrix(m.NN.df.where("j < 25"), 25, 25))), indefinite=raises(ArithmeticError, lambda: solvers.cholesky(elementwise.scale(build.cast(build.identity(m.spark, 4), "double"), -1)))))
query("D28_size", "SELECT CAST(25 AS BIGINT) AS m, CAST(1 AS BIGINT) AS beyond")(lambda m: (lambda f: m.row(m=solvers.size(f, 1), beyond=solvers.size(f, 3)))(solvers.lu(m.NN)))
