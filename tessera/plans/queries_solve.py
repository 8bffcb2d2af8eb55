"""Queries: triangular and direct solvers, by reconstruction, and files.

Each returns what its factors give back next to what it should be, and the shape of the factors, so that a trivial factorization does not pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..core import SparseMatrix
from ..sources.scratch import scratch
from ..operators import access, elementwise, predicates, products, solvers
from ..sources import build, matrix_market
from .matrices import with_
from .registry import query

RHS = "SELECT CAST(n_nationkey + 1 AS BIGINT) AS i, CAST(1 + (n_nationkey % 7) AS DOUBLE) AS v FROM nation"


def rhs() -> np.ndarray:
    return 1.0 + np.arange(25) % 7


def spd(m) -> SparseMatrix:
    return elementwise.add_scaled_identity(products.matmul(access.transpose(m.NN), m.NN), 25)


def result(m, x: np.ndarray, a: SparseMatrix):
    """A * x, to be held against the right side."""
    out = products.mul_dense(build.cast(a, "double"), solvers.vector(m.spark, x).df)
    return out.select("i", F.round("v", 5).alias("v"))


def lower(m) -> SparseMatrix:
    """A well-conditioned lower triangle."""
    return elementwise.add_scaled_identity(access.tril(m.NN), 200)


query("D01_triangular_solve", RHS)(lambda m: (lambda a: result(m, solvers.triangular_solve(a.of(a.df, structure="lower"), rhs()), a))(lower(m)))
query("D01_transposed_solve", RHS)(lambda m: (lambda a: result(m, solvers.triangular_solve(a.of(a.df, structure="lower"), rhs(), transposed=True), access.transpose(a)))(lower(m)))
query("D03_solve", RHS)(lambda m: result(m, solvers.solve(m.NN, rhs()), m.NN))
query("D03_kinds", "SELECT 'lu' AS a, 'hermitian' AS b, 'lower' AS c, 'qr' AS d, 'diagonal' AS e")(lambda m: m.row(a=solvers.kind_of(m.NN), b=solvers.kind_of(spd(m)), c=solvers.kind_of(lower(m)), d=solvers.kind_of(m.SM), e=solvers.kind_of(build.identity(m.spark, 4))))
query("D04_hermitian_solve", RHS)(lambda m: result(m, solvers.solve(spd(m), rhs()), spd(m)))


def lu_back(m):
    f = solvers.lu(m.NN)
    back = np.empty_like(f.l)
    back[np.ix_(f.p, f.q)] = f.l @ f.u
    ok = predicates.istril(f.L) and predicates.istriu(f.U) and predicates.isperm(f.perm, 25) and predicates.isperm(f.colperm, 25) and bool((np.diag(f.l) == 1).all())
    return solvers.relation(m.spark, back / f.rs[:, None]).df.select("i", "j", F.round("v", 6).alias("v"), F.lit(ok).alias("ok"))


query("D06_lu", with_("NN") + "SELECT i, j, CAST(v AS DOUBLE) AS v, TRUE AS ok FROM NN")(lu_back)
query("D07_lu_again", RHS)(lambda m: (lambda a: result(m, solvers.lu_again(solvers.lu(m.NN), a).solve(rhs()), a))(elementwise.scale(m.NN, 3)))
query("D08_lu_transposed", RHS)(lambda m: result(m, solvers.lu(m.NN).solve(rhs(), transposed=True), access.transpose(m.NN)))
query("D09_det", "SELECT TRUE AS square, TRUE AS sign")(lambda m: (lambda f, g: m.row(square=abs(2 * f.logabsdet()[0] - g.logabsdet()[0]) < 1e-6, sign=g.logabsdet()[1] == 1.0))(solvers.lu(m.NN), solvers.lu(products.matmul(access.transpose(m.NN), m.NN))))


def chol_back(m):
    f = solvers.cholesky(spd(m))
    back = np.empty_like(f.l)
    back[np.ix_(f.p, f.p)] = f.l @ f.l.T
    ok = predicates.istril(f.part("L")) and f.isposdef()
    return solvers.relation(m.spark, back).df.select("i", "j", F.round("v", 4).alias("v"), F.lit(ok).alias("ok"))


SPD = "SELECT i, j, CAST(SUM(v) AS DOUBLE) AS v, TRUE AS ok FROM (SELECT a.j AS i, b.j AS j, SUM(a.v * b.v) AS v FROM NN a JOIN NN b ON a.i = b.i GROUP BY 1, 2 UNION ALL SELECT n_nationkey + 1, n_nationkey + 1, 25 FROM nation) GROUP BY 1, 2"
query("D11_cholesky", with_("NN") + SPD)(chol_back)


def ldlt_back(m):
    f = solvers.ldlt(spd(m))
    back = np.empty_like(f.l)
    back[np.ix_(f.p, f.p)] = f.l @ np.diag(f.d) @ f.l.T
    ok = bool((np.diag(f.l) == 1).all()) and predicates.istril(f.part("LD")) and predicates.isdiag(f.part("D"))
    return solvers.relation(m.spark, back).df.select("i", "j", F.round("v", 4).alias("v"), F.lit(ok).alias("ok"))


query("D12_ldlt", with_("NN") + SPD)(ldlt_back)
query("D13_factor_parts", "SELECT TRUE AS same")(lambda m: (lambda f: m.row(same=bool(np.allclose(solvers.local(products.matmul(f.part("PtL"), f.part("UP"))), solvers.local(spd(m))))))(solvers.cholesky(spd(m))))
query("D14_cholesky_solve", RHS)(lambda m: result(m, solvers.cholesky(spd(m)).solve(rhs()), spd(m)))
query("D15_logdet", "SELECT TRUE AS same, TRUE AS posdef")(lambda m: (lambda f, g: m.row(same=abs(f.logdet() - g.logdet()) < 1e-6, posdef=f.isposdef()))(solvers.cholesky(spd(m)), solvers.ldlt(spd(m))))
query("D16_lowrankupdate", "SELECT TRUE AS up, TRUE AS down")(lambda m: (lambda f, c, b: (lambda g: m.row(up=bool(np.allclose((solvers.local(spd(m)) + np.outer(c, c)) @ g.solve(b), b)), down=bool(np.allclose(solvers.lowrankupdate(g, c, -1).solve(b), f.solve(b)))))(solvers.lowrankupdate(f, c)))(solvers.cholesky(spd(m)), np.arange(25.0), rhs()))


def qr_back(m):
    f = solvers.qr(m.SM)
    back = np.empty((40, 10))
    back[np.ix_(f.prow, f.pcol)] = f.apply(f.r, transposed=False)
    q = f.q()
    ok = predicates.istriu(f.R) and bool(np.allclose(q.T @ q, np.eye(40)))
    return solvers.relation(m.spark, np.round(back, 6) + 0.0).df.select("i", "j", "v", F.lit(ok).alias("ok"))


query("D17_qr", with_("SM") + "SELECT i, j, CAST(v AS DOUBLE) AS v, TRUE AS ok FROM SM WHERE v <> 0")(qr_back)
query("D19_least_squares", "SELECT TRUE AS orthogonal")(lambda m: (lambda a, b: m.row(orthogonal=bool(np.allclose(a.T @ (b - a @ solvers.solve(m.SM, b)), 0, atol=1e-6))))(solvers.local(m.SM), np.arange(40.0)))
query("D20_rank", "SELECT CAST(25 AS BIGINT) AS nn, CAST(3 AS BIGINT) AS short")(lambda m: m.row(nn=solvers.rank(m.NN), short=solvers.rank(products.matmul(access.fkeep(m.NN, lambda i, j, v: j <= 3).of(access.fkeep(m.NN, lambda i, j, v: j <= 3).df, 25, 3), m.NN.of(m.NN.df.where("i <= 3"), 3, 25)))))
query("D22_cond", "SELECT TRUE AS same")(lambda m: (lambda a: m.row(same=abs(solvers.cond(m.NN) / float(np.linalg.cond(a, 1)) - 1) < 1e-6))(solvers.local(m.NN)))


def market(m):
    path = scratch(m.spark, "market")
    matrix_market.write_matrix_market(m.PS, path)
    return matrix_market.read_matrix_market(m.spark, path).df


query("S29_matrix_market", with_("PS") + "SELECT i, j, CAST(v AS DOUBLE) AS v FROM PS")(market)


def factors_stored(m):
    f = solvers.lu(m.NN)
    path = scratch(m.spark, "factors")
    for name, df in (("L", f.L.df), ("U", f.U.df)):
        df.write.parquet(f"{path}/{name}")
    l, u = (SparseMatrix(m.spark.read.parquet(f"{path}/{n}"), 25, 25) for n in "LU")
    return m.row(same=predicates.equal(l, f.L) and predicates.equal(u, f.U))


query("S30_factors_stored", "SELECT TRUE AS same")(factors_stored)
