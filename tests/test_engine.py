"""Semantics that the driver tables do not reach, against dense NumPy: stored zeros, nulls, NaN, empty shapes, complex values, errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.core import ArgumentError, BoundsError, DimensionMismatch, PosDefException, ScalarIndexingError, SingularException, SparseMatrix, SparseVector, ZeroPivotException
from tessera.functions import scalar
from tessera.operators import access, concat, elementwise, indexing, predicates, products, reductions, solvers
from tessera.sources import build, matrix_market


def mat(spark, dense, keep=()):
    """A matrix of a dense array without its zeros, but for the cells to keep."""
    a = np.asarray(dense, float)
    rows = [(i + 1, j + 1, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j] != 0 or (i + 1, j + 1) in keep]
    return SparseMatrix(spark.createDataFrame(rows, "i long, j long, v double"), *a.shape)


def vec(spark, dense, keep=()):
    return SparseVector(spark.createDataFrame([(k, float(v)) for k, v in enumerate(dense, 1) if v != 0 or k in keep], "i long, v double"), len(dense))


def arr(a):
    out = np.zeros(a.n if isinstance(a, SparseVector) else (a.m, a.n))
    df = a.df if isinstance(a, SparseVector) else a.entries
    for r in df.collect():
        out[(r.i - 1,) if isinstance(a, SparseVector) else (r.i - 1, r.j - 1)] = np.nan if r.v is None else r.v
    return out


def values(df, key=None):
    return [r.v for r in (df.orderBy(key) if key else df).collect()]


A = np.array([[1, 0, -2, 0], [0, 0, 3, 4], [5, 0, 0, -6]], float)
B = np.array([[0, 2, 2, 0], [1, 0, -3, 0], [5, 7, 0, 0]], float)


def test_triplets(spark):
    t = spark.createDataFrame([(0, 1, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 1, 1.0), (3, 2, 2, 1.0), (4, 2, 2, 1.0)], "k int, i long, j long, v double")
    assert arr(build.sparse(t, 2, 2)).tolist() == [[1, 1], [1, 2]]
    minus = t.withColumn("v", -F.col("v"))
    assert arr(build.sparse(minus, 2, 2, "*")).tolist() == [[-1, -1], [-1, 1]]
    x = spark.createDataFrame([(0, 1, 0.1), (1, 3, 0.1), (2, 3, 0.2), (3, 5, 0.3)], "k int, i long, v double")
    assert arr(build.sparsevec(x, 8, lambda a, b: a - b, order="k"))[2] == pytest.approx(-0.1)
    b = spark.createDataFrame([(1, True), (3, True), (1, False), (2, False), (2, False)], "i long, v boolean")
    assert sorted(map(tuple, build.sparsevec(b).df.collect())) == [(1, True), (2, False), (3, True)]
    nulls = spark.createDataFrame([(1, 1, 1), (1, 1, None), (2, 1, 3)], "i long, j long, v int")
    assert sorted(map(tuple, build.sparse(nulls).df.collect())) == [(1, 1, None), (2, 1, 3)]
    with pytest.raises(ArgumentError):
        build.sparse(t, 0, 2)
    with pytest.raises(ArgumentError):
        build.sparse(t, 2, 2, lambda a, b: a)
    with pytest.raises(Exception, match="must be in 1..1"):
        build.sparse(t, 1, 2, check=True).df.collect()


def test_stored_zeros(spark):
    a = mat(spark, A, keep={(1, 2)})
    assert access.nnz(a) == 7 and access.count(a, lambda v: v != 0) == 6 and access.nnz(access.dropzeros(a)) == 6
    assert access.nnz(SparseMatrix(access.dropzeros(SparseMatrix(a.df, 3, 4, fixed=True)).df, 3, 4)) == 7
    assert predicates.equal(a, mat(spark, A))
    assert access.nnz(products.matmul(mat(spark, [[1, -1]]), mat(spark, [[1], [1]]))) == 1  # cancelled, still stored
    assert access.nnz(elementwise.add(mat(spark, [[1]]), mat(spark, [[-1]]))) == 0
    assert access.nnz(reductions.diff(mat(spark, [[1], [1], [0]]), 1)) == 1
    x, y = vec(spark, [1, 0, 2], keep={2}), vec(spark, [-1, 0, 0])
    assert sorted(map(tuple, elementwise.vector_map("+", x, y).df.collect())) == [(2, 0.0), (3, 2.0)]
    assert elementwise.add(x, y).df.count() == 1


def test_maps(spark):
    a, b = mat(spark, A), mat(spark, B)
    for f in (lambda v: v * 2, lambda v: v + 1, lambda v: v * v - 1):
        assert np.array_equal(arr(elementwise.emap(f, a)), f(A))
    for f in (lambda v, w: v * w, lambda v, w: v - 2 * w, lambda v, w: v + w + 1):
        assert np.array_equal(arr(elementwise.emap2(f, a, b)), f(A, B))
        assert np.array_equal(arr(elementwise.emap_n(f, a, b)), f(A, B))
    row, col = mat(spark, [[1, 2, 0, 4]]), vec(spark, [0, 2, 3])
    assert np.array_equal(arr(elementwise.broadcast2(lambda v, w: v + w, a, row)), A + [[1, 2, 0, 4]])
    assert np.array_equal(arr(elementwise.broadcast2(lambda v, w: v * w, a, col)), A * np.array([[0], [2], [3]]))
    assert np.array_equal(arr(elementwise.broadcast_n(lambda u, v, w: u + v * w, a, row, col)), A + np.array([[1, 2, 0, 4]]) * np.array([[0], [2], [3]]))
    with pytest.raises(DimensionMismatch):
        elementwise.emap2(lambda v, w: v + w, a, row)
    full = mat(spark, [[2, 4], [5, 8]])
    assert np.array_equal(arr(elementwise.emap(lambda v: F.lit(40.0) / v, full)), 40 / np.array([[2, 4], [5, 8]]))


def test_missing_and_nan(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 1, None), (1, 2, 0.0)], "i long, j long, v double")
    a = SparseMatrix(df, 2, 2)
    assert sorted(map(tuple, access.dropzeros(a).df.collect()), key=str) == [(1, 1, 1.0), (2, 1, None)]
    assert values(reductions.sum_(a)) == [None]
    assert values(reductions.sum_(a, dims=1), "j") == [None, 0.0]
    assert elementwise.add(a, a).df.where("v IS NULL").count() == 1
    n = mat(spark, [[1, np.nan], [-3, 0]])
    assert np.isnan(values(reductions.minimum(n))[0]) and np.isnan(values(reductions.maximum(n))[0])
    assert tuple(reductions.findmin(n).first())[1:] == (1, 2)
    assert not predicates.equal(n, n) and access.nnz(access.droptol(n, 0.5)) == 2


def test_reductions(spark):
    for dense in (A, B, np.abs(A), np.ones((2, 3)), np.zeros((2, 2))):
        a = mat(spark, dense)
        for dims, axis in ((None, None), (1, 0), (2, 1)):
            key = {None: None, 1: "j", 2: "i"}[dims]
            assert np.allclose(values(reductions.sum_(a, dims=dims), key), np.atleast_1d(dense.sum(axis)))
            assert np.allclose(values(reductions.prod(a, dims=dims), key), np.atleast_1d(dense.prod(axis)))
            assert np.allclose(values(reductions.minimum(a, dims=dims), key), np.atleast_1d(dense.min(axis)))
            assert np.allclose(values(reductions.maximum(a, dims=dims), key), np.atleast_1d(dense.max(axis)))
            assert values(reductions.any_(a, lambda v: v > 2, dims=dims), key) == list(np.atleast_1d((dense > 2).any(axis)))
            assert values(reductions.all_(a, lambda v: v < 4, dims=dims), key) == list(np.atleast_1d((dense < 4).all(axis)))
            assert values(reductions.count(a, lambda v: v == 0, dims=dims), key) == list(np.atleast_1d((dense == 0).sum(axis)))
        for find, at in ((reductions.findmin, np.argmin), (reductions.findmax, np.argmax)):
            k = int(at(dense.T.reshape(-1)))
            r = find(a).first()
            assert (r.v, r.i, r.j) == (dense.T.reshape(-1)[k], k % dense.shape[0] + 1, k // dense.shape[0] + 1)
        assert reductions.mapreduce(a, lambda v: v, F.greatest) == dense.max()
        assert reductions.mapreduce(a, lambda v: v + 1, lambda x, y: x + y) == pytest.approx((dense + 1).sum())
    empty = build.spzeros(spark, 0, 3)
    assert values(reductions.sum_(empty)) == [0] and values(reductions.prod(empty)) == [1.0]
    with pytest.raises(ArgumentError):
        reductions.minimum(empty)
    with pytest.raises(ArgumentError):
        reductions.findmax(empty)
    x = vec(spark, [0, -2, 0, 5, -1])
    assert arr(reductions.sort(x)).tolist() == [-2, -1, 0, 0, 5] and arr(reductions.sort(x, descending=True)).tolist() == [5, 0, 0, -1, -2]
    assert tuple(reductions.findmax(vec(spark, [0, 0]))  .first()) == (0.0, 1)
    assert reductions.norm(x, 3) == pytest.approx((8 + 125 + 1) ** (1 / 3)) and reductions.opnorm(mat(spark, A), 1) == 10


def test_indexing(spark):
    a = mat(spark, A)
    rows, cols = [3, 1, 1], [4, 2, 1, 4]
    assert np.array_equal(arr(indexing.submatrix(a, indexing.index_list(spark, rows), indexing.index_list(spark, cols))), A[np.ix_([2, 0, 0], [3, 1, 0, 3])])
    assert np.array_equal(arr(indexing.submatrix(a, range(3, 0, -2), range(2, 5))), A[2::-2, 1:4])
    assert np.array_equal(arr(indexing.at_linear(a, range(2, 11, 4))), A.T.reshape(-1)[1:10:4])
    assert indexing.get(a, 1, 3) == -2 and indexing.get(a, 1, 2) == 0
    for bad in (lambda: indexing.get(a, 4, 1), lambda: indexing.column(a, 5), lambda: indexing.submatrix(a, range(1, 6)), lambda: indexing.submatrix(a, indexing.index_list(spark, [9]))):
        with pytest.raises(BoundsError):
            bad()
    want = A.copy()
    want[np.ix_([0, 2], [0, 3])] = [[0, 9], [8, 0]]
    new = indexing.assign(a, indexing.index_list(spark, [1, 3]), indexing.index_list(spark, [1, 4]), mat(spark, [[0, 9], [8, 0]]))
    assert np.array_equal(arr(new), want) and access.nnz(new) == 7  # (1, 1) and (3, 4) stay as zeros
    assert access.nnz(indexing.put(a, 0.0, 1, 2)) == 6 and access.nnz(indexing.put(a, -0.0, 1, 2)) == 7 and access.nnz(indexing.put(a, 0.0, 1, 1)) == 6
    linear = spark.createDataFrame([(1, 2, 7.0), (2, 2, 8.0), (3, 4, 0.0), (4, 1, 0.0)], "pos long, idx long, w double")
    got = indexing.put_linear(a, linear)
    assert arr(got)[1, 0] == 8 and arr(got)[0, 0] == 0 and access.nnz(got) == 7
    assert np.array_equal(arr(indexing.fill(a, 2.0)), np.full((3, 4), 2.0)) and access.nnz(indexing.fill(a, 0.0)) == 6
    indexing.allowscalar(False)
    try:
        with pytest.raises(ScalarIndexingError):
            indexing.get(a, 1, 1)
    finally:
        indexing.allowscalar(True)


def test_shapes(spark):
    a = mat(spark, A)
    assert np.array_equal(arr(access.reshape(a, 4, 3)), A.T.reshape(3, 4).T)
    assert np.array_equal(arr(access.rotr90(a)), np.rot90(A, -1)) and np.array_equal(arr(access.rotl90(a)), np.rot90(A)) and np.array_equal(arr(access.rot180(a)), np.rot90(A, 2))
    assert np.array_equal(arr(access.circshift(a, 4, -1)), np.roll(A, (4, -1), (0, 1))) and np.array_equal(arr(access.reverse(a, (2,))), A[:, ::-1])
    for k in range(-4, 5):
        assert np.array_equal(arr(access.tril(a, k)), np.tril(A, k)) and np.array_equal(arr(access.triu(a, k)), np.triu(A, k))
        assert predicates.istril(a, k) == np.array_equal(np.tril(A, k), A) and predicates.istriu(a, k) == np.array_equal(np.triu(A, k), A)
        if -3 <= k <= 4:
            assert arr(access.diag(a, k)).tolist() == np.diag(A, k).tolist()
    assert np.array_equal(arr(concat.hvcat([2, 1], a, a, mat(spark, np.ones((2, 8))))), np.vstack([np.hstack([A, A]), np.ones((2, 8))]))
    assert np.array_equal(arr(concat.repeat(a, 2, 3)), np.tile(A, (2, 3)))
    assert concat.blockdiag(spark=spark).m == 0
    for bad in (lambda: concat.vcat(a, mat(spark, [[1]])), lambda: concat.hcat(a, mat(spark, [[1]])), lambda: access.trace(a), lambda: access.reshape(a, 5, 5), lambda: products.matmul(a, a), lambda: build.one(a)):
        with pytest.raises(DimensionMismatch):
            bad()
    with pytest.raises(ArgumentError):
        access.permute(a, indexing.index_list(spark, [1, 1, 2]), indexing.index_list(spark, range(1, 5)))
    assert "3x4 matrix with 6 stored entries" in build.show(a)


def test_structures(spark):
    s = np.array([[1, 2, 0], [9, 3, 4], [9, 9, 5]], float)
    a = mat(spark, s)
    up = np.triu(s)
    assert np.array_equal(arr(a.of(a.df, structure="symmetric")), up + np.triu(s, 1).T)
    assert np.array_equal(arr(a.of(a.df, structure="unit_upper")), np.triu(s, 1) + np.eye(3))
    assert np.array_equal(arr(access.transpose(a.of(a.df, structure="upper"))), up.T)
    c = spark.createDataFrame([(1, 1, (1.0, 5.0)), (1, 2, (2.0, 3.0))], "i long, j long, v struct<re:double,im:double>")
    h = SparseMatrix(c, 2, 2, "hermitian")
    got = {(r.i, r.j): complex(r.v.re, r.v.im) for r in h.entries.collect()}
    assert got == {(1, 1): 1, (1, 2): 2 + 3j, (2, 1): 2 - 3j} and predicates.ishermitian(h) and not predicates.issymmetric(h)
    square = {(r.i, r.j): complex(r.v.re, r.v.im) for r in products.matmul(h, h).df.collect()}
    m = np.array([[1, 2 + 3j], [2 - 3j, 0]])
    assert all(square[i + 1, j + 1] == (m @ m)[i, j] for i in range(2) for j in range(2))
    assert products.dot(h, h) == pytest.approx((np.abs(m) ** 2).sum())


def test_products(spark):
    a, b = mat(spark, A), mat(spark, B)
    assert np.array_equal(arr(products.matmul(a, access.transpose(b))), A @ B.T)
    assert np.array_equal(arr(products.kron(a, b)), np.kron(A, B))
    assert products.dot(a, b) == (A * B).sum()
    x, y = vec(spark, [1, 0, 2]), vec(spark, [0, 3, 0, 1])
    assert products.bilinear(x, a, y) == np.array([1, 0, 2]) @ A @ [0, 3, 0, 1]
    assert np.array_equal(arr(products.chain([a, access.transpose(b), a, access.transpose(a)])), A @ B.T @ A @ A.T)
    assert np.array_equal(arr(products.mul_into(a, products.matmul(a, access.transpose(b)), b, 2.0, 3.0)), 2 * A @ B.T @ B + 3 * A)


def test_functions(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (-0.25,)], "v double")
    zero = [z for z in df.where("v = 0").select(F.array(*[f(F.col("v")) for f in scalar.KEEPS_ZERO.values()])).first()[0]]
    assert all(z == 0 for z in zero)
    filled = df.where("v = 0").select(F.array(*[f(F.col("v")).cast("double") for f in scalar.FILLS_ZERO.values()])).first()[0]
    assert all(z != 0 for z in filled)
    with pytest.raises(Exception, match="negative"):
        df.select(scalar.FILLS_ZERO["log"](F.col("v"))).collect()


def test_solvers(spark):
    r = np.random.default_rng(3)
    a = r.integers(-4, 5, (8, 8)) * (r.random((8, 8)) < 0.6) + 6 * np.eye(8)
    b = r.random((8, 2))
    f = solvers.lu(mat(spark, a))
    assert np.allclose(f.l @ f.u, (f.rs[:, None] * a)[np.ix_(f.p, f.q)]) and f.det() == pytest.approx(np.linalg.det(a))
    assert np.allclose(f.solve(b), np.linalg.solve(a, b)) and np.allclose(f.solve(b[:, 0], transposed=True), np.linalg.solve(a.T, b[:, 0])) and np.allclose(f.solve(b + 1j * b), np.linalg.solve(a, b + 1j * b))
    s = a @ a.T + np.eye(8)
    c, d = solvers.cholesky(mat(spark, s)), solvers.ldlt(mat(spark, s - 20 * np.eye(8)))
    assert np.allclose(c.l @ c.l.T, s[np.ix_(c.p, c.p)]) and np.allclose(c.solve(b), np.linalg.solve(s, b)) and c.logdet() == pytest.approx(np.linalg.slogdet(s)[1])
    assert np.allclose(d.l * d.d @ d.l.T, (s - 20 * np.eye(8))[np.ix_(d.p, d.p)]) and d.det() == pytest.approx(np.linalg.det(s - 20 * np.eye(8)))
    w = r.random((8, 2))
    assert np.allclose(solvers.lowrankupdate(c, w).solve(b), np.linalg.solve(s + w @ w.T, b)) and np.allclose(solvers.lowrankupdate(solvers.lowrankupdate(c, w), w, -1).solve(b), np.linalg.solve(s, b))
    with pytest.raises(SingularException):
        solvers.lu(mat(spark, np.ones((3, 3))))
    with pytest.raises(PosDefException):
        solvers.cholesky(mat(spark, -np.eye(2)))
    with pytest.raises(ZeroPivotException):
        solvers.ldlt(mat(spark, [[0, 1], [1, 0]]))
    with pytest.raises(ArgumentError):
        solvers.cholesky(mat(spark, [[1, 2], [0, 1]]))
    with pytest.raises(SingularException):
        solvers.triangular_solve(SparseMatrix(mat(spark, [[1, 0], [1, 0]]).df, 2, 2, "lower"), np.ones(2))
    for bad in (solvers.inv, solvers.eigen):
        with pytest.raises(ArgumentError):
            bad(mat(spark, a))


def test_qr(spark):
    r = np.random.default_rng(4)
    for m, n, k in ((9, 5, 5), (5, 9, 5), (10, 10, 4), (6, 3, 0)):
        a = r.random((m, k)) @ r.random((k, n))
        f = solvers.qr(mat(spark, a))
        assert f.rank == k and np.allclose(f.q() @ f.r, a[np.ix_(f.prow, f.pcol)])
        x = f.solve(np.arange(float(m)))
        assert np.allclose(a.T @ (np.arange(float(m)) - a @ x), 0, atol=1e-8) and np.count_nonzero(x) <= k
    assert np.allclose(solvers.solve(SparseMatrix(mat(spark, [[1], [1], [0], [1]]).df, 4, 1), np.ones(4)), [1])
    with pytest.raises(ArgumentError):
        solvers.qr(mat(spark, A), ordering="other")


def test_matrix_market(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 4\n1 1 1\n2 2 1\n3 2 0.5\n3 3 1\n")
    assert arr(matrix_market.read_matrix_market(spark, str(p))).tolist() == [[1, 0, 0], [0, 1, 0.5], [0, 0.5, 1]]
    p.write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 1 0\n2 1 2 3\n")
    got = {(r.i, r.j): complex(r.v.re, r.v.im) for r in matrix_market.read_matrix_market(spark, str(p)).entries.collect()}
    assert got == {(1, 1): 1, (2, 1): 2 + 3j, (1, 2): 2 - 3j}
    p.write_text("%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n")
    with pytest.raises(ArgumentError, match="indices out of range"):
        matrix_market.read_matrix_market(spark, str(p))
    p.write_text("no header\n")
    with pytest.raises(ArgumentError):
        matrix_market.read_matrix_market(spark, str(p))
    matrix_market.write_matrix_market(mat(spark, A), str(tmp_path / "out"))
    assert np.array_equal(arr(matrix_market.read_matrix_market(spark, str(tmp_path / "out"))), A)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_product_by_rows_has_one_shuffle_of_packed_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(products, "BY_ROWS", 0)
    monkeypatch.setattr(products, "COLUMNS", 4)
    monkeypatch.setattr(products, "JOINED", 50)
    rng = np.random.default_rng(3)
    X, Y = (rng.integers(-3, 4, s) * (rng.random(s) < 0.3) * f for s, f in (((30, 20), 1), ((20, 25), 1 << 14)))  # some of Y's values are too long for short ones
    of = lambda x: SparseMatrix(spark.createDataFrame([(int(i) + 1, int(j) + 1, int(x[i, j])) for i, j in zip(*np.nonzero(x))], "i long, j long, v long").withColumn("v", F.col("v").cast(kind)), *x.shape)
    a, b = of(X), of(Y)
    c = products.chain([a, b])
    assert c.df.schema["v"].dataType.typeName() == kind
    assert np.array_equal(arr(c), X @ Y)
    plan = c.df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan[: plan.index("REPARTITION_BY_NUM")].count("Exchange") == 1
    assert sorted(map(str, c.df.select("i", "j").collect())) == sorted(map(str, products.matmul(a, b).df.select("i", "j").collect()))
    missing = a.of(a.df.withColumn("v", F.when(F.col("i") != 2, F.col("v"))))
    gone = b.of(b.df.withColumn("v", F.when(F.col("j") != 3, F.col("v"))))
    got, want = (sorted(map(str, x.df.collect())) for x in (products.matmul_by_rows(missing, gone, 1), products.matmul(missing, gone)))
    assert got == want


def test_matrix_market_in_several_files(spark, tmp_path):
    folder = tmp_path / "of parts"
    folder.mkdir()
    (folder / "part-00000").write_text("")
    (folder / "part-00001").write_text("%%MatrixMarket matrix coordinate real general\n3 3 3\n1 1 5\n")
    (folder / "part-00002").write_text("".join("% a long part\n" for _ in range(100)) + "2 1 4\n3 3 3\n")  # the last entry reads as the size line does
    assert arr(matrix_market.read_matrix_market(spark, str(folder))).tolist() == [[5, 0, 0], [4, 0, 0], [0, 0, 3]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        matrix_market.write_matrix_market(mat(spark, A), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    assert np.array_equal(arr(matrix_market.read_matrix_market(spark, str(tmp_path / "out"))), A)


def test_random_and_patterns(spark):
    a = build.sprand(spark, 50, 20, 0.3, 5)
    a.validate()
    assert (a.m, a.n) == (50, 20) and 200 < access.nnz(a) < 400
    for bad in ((-1, 2, 0.5), (2, 2, 1.5)):
        with pytest.raises(ArgumentError):
            build.sprand(spark, *bad, 1)
    with pytest.raises(ArgumentError):
        SparseMatrix(spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0)], "i long, j long, v double"), 1, 1).validate()
    with pytest.raises(ArgumentError):
        build.converted(mat(spark, A), "lower")
    with pytest.raises(ArgumentError):
        build.dense(SparseMatrix(a.df, 1 << 20, 1 << 20))


def test_stream(spark, tmp_path):
    from tessera.streaming import triplets

    src = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES (1L, 1L, 2, timestamp '2024-01-01 00:00:01'), (1L, 1L, 3, timestamp '2024-01-01 00:00:09'), (2L, 1L, 4, timestamp '2024-01-01 00:02:00') t(i, j, v, ts)").write.parquet(src)
    stream = spark.readStream.schema("i long, j long, v int, ts timestamp").parquet(src)
    q = triplets.windowed(stream, "1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.i, r.j, r.v) for r in spark.table("windows").collect()) == [(1, 1, 5), (2, 1, 4)]
    held = {"a": mat(spark, [[1.0], [0]])}

    def write(new):
        held["a"] = SparseMatrix(spark.createDataFrame(new.df.collect(), new.df.schema), 2, 1)

    q = triplets.merged(stream, lambda: held["a"], write).start()
    q.processAllAvailable()
    q.stop()
    assert arr(held["a"]).tolist() == [[6], [4]]
