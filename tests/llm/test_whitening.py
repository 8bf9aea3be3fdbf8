import numpy as np
import pytest

from flowlens.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, id string, v string, n string"


def brute(rows):
    """Whole numbers, covariance and eigenpairs by definition."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in r] for r in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - sums / n).astype(float)
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    return n, ((n * x - sums) ** 2).sum(axis=1), centred, v, values[::-1], vectors[:, ::-1]


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(1, 64, 64), 1.0 / np.arange(1, 41) ** 3, np.r_[np.full(10, 5.0), np.ones(10)], [3.0], [2.0, 2.0],
    np.r_[1e6, 1e3, np.geomspace(1, 1e-8, 20)], np.r_[7, 7 - 1e-9, np.full(9, 1.0)], np.r_[np.ones(3), np.zeros(9)]])
def test_components_equal_dense_solver(values):
    v = symmetric(np.asarray(values, float), 2)
    want = np.sort(values)[::-1][:8]
    got, vectors = W.components(v, 8)
    assert np.allclose(got, want, rtol=1e-10, atol=1e-12 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-10)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-11 * max(values)


def test_inertia_counts():
    v = symmetric(np.r_[-2.0, 0.5, 0.5, 3.0, 9.0], 4)
    inertia = W.Inertia(v)
    assert [inertia.below(s) for s in (-3, 0, 1, 5, 10)] == [0, 1, 3, 4, 5]
    assert np.allclose([inertia.eigenvalue(k) for k in range(1, 6)], [9, 3, 0.5, 0.5, -2])


def test_missing_eigenvalues_are_noticed():
    """A count of eigenvalues that the Ritz values cannot meet ends the search."""
    class Wrong(W.Inertia):
        def below(self, shift):
            return super().below(shift) + 2 * (shift > 64)

    v = symmetric(np.linspace(1, 64, 12), 2)
    with pytest.raises(ArithmeticError):
        W.feast(v, 50.0, 65.0, Wrong(v))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    n, away, centred, v, values, vectors = brute(table.embedding)
    out = W.query(spark, sf).toPandas()
    assert len(out) == 8 * n and (out.n == n).all() and out.identity_error.max() < 1e-9
    place = {k: i for i, k in enumerate(table.vec_id)}
    at = out.vec_id.map(place)
    assert (out.deviation == away[at].astype(np.int64)).all()
    want = centred @ vectors[:, :8] / np.sqrt(values[:8])
    for k in range(8):
        mine = out[out.component == k + 1]
        exact = want[mine.vec_id.map(place), k]
        sign = np.sign(exact @ mine.whitened)
        assert np.allclose(mine.whitened, sign * exact, atol=1e-7)
        assert np.allclose(mine.explained, values[k] / np.trace(v), rtol=1e-9)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 4.0], "a", "b", "c"), (1, [1.0, 2.0, 4.0], None, None, None), (2, None, None, None, None),
            (3, [1.0, None, 2.0], None, None, None), (4, [nan, 1.0, 1.0], None, None, None),
            (5, [inf, 1.0, 1.0], None, None, None), (6, [], None, None, None), (7, [1.0, 2.0], None, None, None),
            (None, [0.0, 0.0, 0.0], None, None, None), (8, [-1.0, 2.5, 3.0], None, None, None),
            (9, [1e30, 1.0, 1.0], None, None, None)]
    white, found = W.whiten(spark.createDataFrame(rows, SCHEMA))
    got = white.collect()
    kept = [r for r in rows if r[0] in (1, None, 8)]
    n, away, centred, v, values, _ = brute([r[1] for r in kept])
    assert found["n"] == 4 and sorted((r.id is None, r.id or 0, int(r.deviation)) for r in got) == sorted(
        (r[0] is None, r[0] or 0, int(a)) for r, a in zip(kept, away))
    assert np.allclose(found["eigenvalues"], values) and found["identity_error"] < 1e-9
    white, found = W.whiten(spark.createDataFrame([], SCHEMA))
    assert white.count() == 0 and found["n"] == 0
    white, found = W.whiten(spark.createDataFrame([rows[0]] * 3, SCHEMA))
    assert [r.whitened for r in white.collect()] == [[None] * 3] * 3 and found["explained"] == [0.0] * 3
    # equal in two dimensions: one component lives, the others are null
    flat = [(k, [float(k), 1.0, 1.0], None, None, None) for k in range(5)]
    white, found = W.whiten(spark.createDataFrame(flat, SCHEMA))
    assert found["identity_error"] < 1e-9
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in white.collect())


def test_large_numbers_stay_exact(spark):
    rows = [(k, [3.0e12 + 1e9 * k, -2.0e12, float(k)], None, None, None) for k in range(40)]
    white, found = W.whiten(spark.createDataFrame(rows, SCHEMA.replace("float", "double")))
    x = [[int(np.floor(1024 * c)) + 100000 for c in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    assert found["sums"] == sums
    want = {k: sum((40 * c - s) ** 2 for c, s in zip(x[k], sums)) for k in range(40)}
    assert {r.id: int(r.deviation) for r in white.collect()} == want


def test_query_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert W.query(spark, str(tmp_path)).collect() == []
