import numpy as np
import pytest

from quill.llm import bidiagonal, whitening


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("fall", [0, 6])
def test_right_vectors(n, fall):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(200, n)) * 10.0 ** -np.linspace(0, fall, n)
    r = np.linalg.qr(a @ np.linalg.qr(rng.normal(size=(n, n)))[0], mode="r")
    sigma, v = bidiagonal.right_vectors(r, n)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.abs(sigma / want - 1).max() < 1e-8 if fall else np.abs(sigma / want - 1).max() < 1e-13
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-12
    assert np.abs(r.T @ (r @ v) - v * sigma**2).max() < 1e-13 * sigma[0] ** 2


@pytest.mark.parametrize("values", [[3, 3, 3, 2, 2, 1, 1, 1, 1, 0], [1] * 12, [5, 5, 1e-8, 1e-8, 0, 0], [1, 1 + 1e-9, 1 - 1e-9, 0.5]])
@pytest.mark.parametrize("turned", [True, False])
def test_equal_and_zero_values(values, turned):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))[0] if turned else np.eye(n)
    r = np.linalg.qr(np.diag(np.array(values, float)) @ q, mode="r")
    sigma, v = bidiagonal.right_vectors(r, n)
    assert len(sigma) == np.count_nonzero(values)
    assert np.abs(v.T @ v - np.eye(len(sigma))).max() < 1e-12
    assert np.abs(r.T @ (r @ v) - v * sigma**2).max() < 1e-13 * sigma[0] ** 2


def test_small_values_keep_their_accuracy():
    a, b = 10.0 ** -np.arange(0.0, 14), 0.5 * 10.0 ** -np.arange(0.0, 13)
    got = bidiagonal.squares(a, b)
    assert abs(np.log(got).sum() - 2 * np.log(a).sum()) < 1e-12  # the determinant, over 26 orders of magnitude
    assert bidiagonal.right_vectors(np.zeros((4, 4)), 4)[1].shape == (4, 0)


def brute(vectors, k=16):
    """{row: ...} by whole numbers and numpy's symmetric solver."""
    keep = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1000000) for i, v in vectors
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in keep}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s).astype(np.float64) / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    rows = []
    for i, x in keep:
        d = x.astype(object) * n - s
        w = d.astype(np.float64) / n @ vector[:, :k] / np.sqrt(value[:k])
        rows.append((i, n, int((d ** 2).sum()), w, value[:k] / value.sum()))
    return rows


def compare(got, want, k):
    assert len(got) == len(want) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    sign = {}
    for i, n, deviation, w, share in want:
        rows = by[i, deviation]
        for c in range(k):
            r = next(x for x in rows if x.component == c + 1)
            sign.setdefault(c, np.sign(r.whitened * w[c]))
            assert r.n == n and abs(r.whitened - sign[c] * w[c]) < 1e-7 and abs(r.explained / share[c] - 1) < 1e-9
            assert r.identity_error < 1e-9


def test_query_against_brute_force(spark, sf, llm_queries, duck):
    got = llm_queries.QUERIES["op12_whitening"](spark, sf).collect()
    compare(got, brute(duck.execute("select vec_id, embedding from embeddings").fetchall()), 16)


@pytest.mark.parametrize("tasks", [1, 7])
def test_odd_rows(spark, tasks, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(60)]
    rows += [rows[0]] * 30 + [(900 + i, rows[1][1]) for i in range(5)]  # repeated rows, one vector under many ids
    rows += [(70, None), (71, [None, 1.0, 1.0, 1.0, 1.0]), (72, [float("nan")] * 5), (73, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS x", "2 AS n", "3 AS component", "'d' AS v", "4 AS deviation").repartition(tasks)
    compare(whitening.whiten(df, components=9).collect(), brute(rows, 5), 5)
    compare(whitening.whiten(df, components=2).collect(), brute(rows, 2), 2)


def test_no_variance_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(6)], schema)  # all on one line
    got = whitening.whiten(flat).collect()
    assert len(got) == 6 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_large_entries_stay_exact():
    x = np.array([[2**52, -(2**52)], [1, 5], [7, 2**51]], np.int64)
    n, sums = 10**6, [int(v) for v in x.sum(axis=0)]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    got = whitening._squares(whitening._centred(x, n, sums))
    assert got == [w if w < 1 << 63 else None for w in want]


def test_triangles_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(0)
    x = rng.integers(999000, 1001000, (400, 6))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(7)
    r = whitening.triangle(fit, 400, [int(s) for s in x.sum(axis=0)])
    c = x - x.mean(axis=0)
    assert np.abs(r.T @ r - c.T @ c).max() < 1e-6 * np.abs(c.T @ c).max()
