"""Fits, inflation, leverage and elimination through the QR reduction."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import glm as M
from quill.operators import qr


@pytest.fixture(scope="module")
def wide(spark):
    """70 columns, one nearly the sum of two others."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 68))
    x = np.column_stack([x, x[:, 0] + x[:, 1] + 1e-4 * rng.normal(size=600), 1e5 * rng.normal(size=600) + 3e5])
    y = rng.poisson(np.exp(0.3 + 0.2 * x[:, 2] - 0.1 * x[:, 3]))
    names = [f"v{j}" for j in range(70)]
    df = spark.createDataFrame([(i, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))],
                               ", ".join(["id long", "y double", *[f"{n} double" for n in names]])).repartition(5)
    return df, names, x, y


@pytest.mark.parametrize("fan", [2, 32])
def test_triangle_against_numpy(wide, monkeypatch, fan):
    df, names, x, y = wide
    monkeypatch.setattr(qr, "FAN", fan)
    monkeypatch.setattr(qr, "ROWS", 50)
    w = 0.5 + np.arange(len(y)) % 3
    r, sums = qr.reduced(df, [F.col(n) for n in names], 0.5 + F.col("id") % 3, [F.lit(1.0), F.col("y")], 5)
    want = np.linalg.qr(x * np.sqrt(w)[:, None], mode="r")
    assert np.allclose(np.abs(r), np.abs(want), rtol=1e-6, atol=1e-8 * np.abs(want).max())
    assert sums.tolist() == [len(y), y.sum()]


def numpy_fit(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    mu = y + 0.1
    eta = np.log(mu)
    for _ in range(60):
        s = np.sqrt(mu)
        beta = np.linalg.lstsq(x * s[:, None], s * (eta + (y - mu) / mu), rcond=None)[0]
        eta = x @ beta
        mu = np.exp(eta)
    q = np.linalg.qr(x * np.sqrt(mu)[:, None])[0]
    return beta, mu, (q ** 2).sum(axis=1)


def test_wide_diagnostics_against_numpy(wide):
    df, names, x, y = wide
    fit = M.poisson_glm(M.design(df, "y", numeric=names, keys=["id"]))
    beta, mu, lever = numpy_fit(x, y)
    assert np.allclose(x @ fit.beta[1:] + fit.beta[0], x @ beta[1:] + beta[0], atol=1e-6)
    rows = sorted(M.glm_diagnostics(fit, qq=False).collect(), key=lambda r: r.id)
    assert np.allclose([r.fitted for r in rows], mu, rtol=1e-6)
    assert np.allclose([r.leverage for r in rows], lever, rtol=1e-6) and abs(sum(r.leverage for r in rows) - 71) < 1e-6
    assert rows[0].__fields__ == ["id", "y", "fitted", "pearson_resid", "deviance_resid", "leverage", "std_resid", "response_resid"]
    fit.design.free()


def test_inflation_of_nearly_collinear_columns(spark):
    rng = np.random.default_rng(0)
    a, e, c = rng.integers(0, 10**6, 500), rng.integers(-1, 2, 500), rng.normal(size=500)
    df = spark.createDataFrame([(1.0, float(p), float(p + q), float(r)) for p, q, r in zip(a, e, c, strict=True)], "y double, a double, b double, c double")
    assert np.corrcoef(a, a + e)[0, 1] > 0.999999
    got = {r.term: r.gvif for r in M.design_gvif(M.design(df, "y", numeric=["a", "b", "c"]), spark).collect()}
    one = np.column_stack([np.ones(500), e, c])
    for term, v, other in (("a", a, np.column_stack([np.ones(500), e, c])), ("b", a + e, one)):
        left = e - np.linalg.lstsq(np.column_stack([np.ones(500), a + (e if term == "a" else 0), c]), e, rcond=None)[0] @ \
            np.column_stack([np.ones(500), a + (e if term == "a" else 0), c]).T
        assert got[term] == pytest.approx(((v - v.mean()) ** 2).sum() / (left ** 2).sum(), rel=1e-5)


def test_elimination_reads_one_design(wide):
    df, names, x, y = wide
    fit, dropped = M.eliminate(df, "y", numeric=names, max_gvif=3.0, drop=["v69"])
    assert dropped == ["v69", "v68"] and all(n <= 3 for n in fit.passes[1:])
    assert fit.design.cached is not None and fit.terms == ["(Intercept)", *names[:68]]
    alone = M.poisson_glm(M.design(df, "y", numeric=names[:68]))
    assert np.allclose(fit.beta, alone.beta, rtol=1e-6, atol=1e-9) and fit.deviance == pytest.approx(alone.deviance, rel=1e-9)
    fit.design.free()
    alone.design.free()


def test_determined_columns_are_named(spark):
    df = spark.createDataFrame([(float(i % 3), float(i), 2.0 * i, float(i * i)) for i in range(20)], "y double, a double, b double, c double")
    with pytest.raises(M.Collinear, match="b"):
        M.poisson_glm(M.design(df, "y", numeric=["a", "b", "c"]))
    with pytest.raises(np.linalg.LinAlgError):
        M.poisson_glm(M.design(df.where("a < 0"), "y", numeric=["a"]))


def test_row_with_a_column_of_its_own(spark):
    df = spark.createDataFrame([(float(2 + i), "a" if i < 5 else "b") for i in range(6)], "y double, g string")
    rows = M.glm_diagnostics(M.poisson_glm(M.design(df, "y", factors=["g"], keys=["g"])), qq=False).collect()
    assert [r.std_resid is None for r in sorted(rows, key=lambda r: r.g)] == [False] * 5 + [True]
