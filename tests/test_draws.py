"""Counter-based draws."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import bayes as B
from quill.operators import draws as D
from quill.operators import glm as M


def test_uniforms(spark):
    df = spark.range(20000).select("id", D.uniform(1, "a", F.col("id")).alias("u"), D.uniform(1, "b", F.col("id")).alias("v"),
                                   D.normal(2, "a", F.col("id")).alias("z"))
    x = df.toPandas()
    assert 0 < x.u.min() and x.u.max() < 1 and abs(x.u.mean() - 0.5) < 0.01 and abs(np.corrcoef(x.u, x.v)[0, 1]) < 0.03
    assert abs(x.z.mean()) < 0.03 and abs(x.z.std() - 1) < 0.02
    again = df.repartition(7).toPandas().sort_values("id")
    assert (again.u.to_numpy() == x.u.to_numpy()).all()


@pytest.mark.parametrize("a", [0.3, 1.0, 3.0, 13.0, 200.0])
def test_gamma_quantiles(a):
    u = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999999])
    x = D.gamma_ppf(a, u)
    assert np.allclose(D.gamma_cdf(a, x), u, rtol=1e-9)
    if a == int(a):  # Erlang
        tail = [math.exp(-v) * sum(math.exp(k * math.log(v) - math.lgamma(k + 1)) for k in range(int(a))) for v in x]
        assert np.allclose(1 - np.array(tail), u, rtol=1e-6, atol=1e-12)


@pytest.mark.parametrize(("mu", "theta"), [(0.0, None), (0.7, None), (45.0, None), (3000.0, None), (0.5, 2.0), (45.0, 3.0), (800.0, 0.4), (900.0, 500.0)])
def test_counts_by_inversion(mu, theta):
    u = np.linspace(0.0005, 0.9995, 400)
    k = D.count_ppf(u, np.full(400, mu), theta)

    def log_p(j):
        if theta is None:
            return (j * math.log(mu) if mu else (0 if j == 0 else -math.inf)) - mu - math.lgamma(j + 1)
        return math.lgamma(j + theta) - math.lgamma(theta) - math.lgamma(j + 1) + theta * math.log(theta / (theta + mu)) + j * math.log(mu / (theta + mu))
    c = np.cumsum([math.exp(log_p(j)) for j in range(int(k.max()) + 1)])
    want = np.searchsorted(c, u)
    assert (np.abs(k - want) <= (c[np.minimum(k.astype(int), len(c) - 1)] - u < 1e-9)).all()


@pytest.fixture(scope="module")
def fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=800)
    y = rng.negative_binomial(4, 4 / (4 + np.exp(2 + 0.3 * x)))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    return df, y


def test_posterior_draws_follow_the_gaussian(fit):
    df, _ = fit
    post = B.bayes_glm(M.design(df, "y", numeric=["x"], keys=["id"]), "negbin", B.Priors())
    d = D.posterior_draws(post, 4000, seed=3).toPandas()
    wide = d.pivot(index="draw", columns="param", values="value")
    beta = wide[post.terms].to_numpy()
    sd = np.sqrt(np.diag(post.cov))
    assert (np.abs(beta.mean(0) - post.mode) < 4 * sd / math.sqrt(4000)).all()
    assert np.allclose(np.cov(beta.T), post.cov, atol=0.1 * sd.max() ** 2)
    logs = np.log(wide["reciprocal_dispersion"])
    assert abs(logs.mean() - math.log(post.theta)) < 4 * post.log_theta_sd / math.sqrt(4000) and abs(logs.std() / post.log_theta_sd - 1) < 0.05
    assert sorted(d.chain.unique()) == [0, 1, 2, 3] and len(d) == 3 * 4000


def test_replicates_do_not_depend_on_partitions(fit):
    df, y = fit
    get = lambda n: sorted(map(tuple, D.predictive_counts(B.bayes_glm(M.design(df.repartition(n), "y", numeric=["x"], keys=["id"]), "negbin"),
                                                          0.0, 60.0, 5.0, draws=6, seed=5).collect()), key=repr)
    a, b = get(2), get(5)
    assert a == b
    assert all(sum(n for d, _, n in a if d == i) == 800 for i in range(-1, 6))
    expected = {r.bin: r.expected for r in B.expected_counts(B.bayes_glm(M.design(df, "y", numeric=["x"], keys=["id"]), "negbin"), 0.0, 60.0, 5.0).collect()}
    for k in range(1, 6):
        mean = np.mean([n for d, bin_, n in a if d >= 0 and bin_ == k])
        assert abs(mean - expected[k]) < 5 * math.sqrt(expected[k])


def test_prior_draws(spark, fit):
    df, _ = fit
    d = M.design(df, "y", numeric=["x"], keys=["id"])
    p = B.Priors(autoscale=False, coef_sd=2.0, aux="gamma", aux_a=13, aux_b=3)
    x = D.prior_draws(spark, d, p, "negbin", n=3000, seed=9).toPandas().groupby("param").value.agg(["mean", "std"])
    assert abs(x.loc["(Intercept)", "mean"] - 4) < 0.3 and abs(x.loc["x", "std"] / 2 - 1) < 0.05
    assert abs(x.loc["reciprocal_dispersion", "mean"] - 13 / 3) < 0.1 and abs(x.loc["reciprocal_dispersion", "std"] - math.sqrt(13) / 3) < 0.06
    with pytest.raises(ValueError, match="keys"):
        D.predictive_counts(B.bayes_glm(M.design(df, "y"), "poisson"), 0.0, 10.0, 1.0)
