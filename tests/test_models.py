"""Chi-squared, rule pruning, Poisson closed form, NB θ recovery."""
import math

import numpy as np
from pyspark.sql import functions as F

from quill.operators import glm as M
from quill.operators import rules as R
from quill.operators import stats as ST


def _table(spark, cells):
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


def test_chi_square_yates_and_plain(spark):
    df = _table(spark, {("x", "u"): 10, ("x", "v"): 20, ("y", "u"): 30, ("y", "v"): 40})
    y = ST.chi_square_pairs(df, ["a", "b"], yates=True, symmetric=False).first()
    p = ST.chi_square_pairs(df, ["a", "b"], yates=False, symmetric=False).first()
    assert abs(y.statistic - 0.446429) < 1e-5 and y.dof == 1 and abs(y.p_value - 0.504) < 1e-3
    assert abs(p.statistic - 0.793651) < 1e-5


def test_chi_square_2x3(spark):
    df = _table(spark, {("x", "u"): 5, ("x", "v"): 10, ("x", "w"): 15, ("y", "u"): 15, ("y", "v"): 10,
                        ("y", "w"): 5})
    r = ST.chi_square_pairs(df, ["a", "b"], symmetric=False).first()
    assert abs(r.statistic - 10.0) < 1e-9 and r.dof == 2 and abs(r.p_value - math.exp(-5)) < 1e-9


def test_prune_redundant(spark):
    rules = spark.createDataFrame([
        (["a"], "b", 0.2, 0.9, 3.0), (["a", "c"], "b", 0.15, 0.8, 2.0), (["c"], "d", 0.1, 0.6, 1.5)],
        "antecedent array<string>, consequent string, support double, confidence double, lift double")
    kept = R.prune_redundant(rules, 10).collect()
    assert sorted((tuple(r.antecedent), r.consequent) for r in kept) == [(("a",), "b"), (("c",), "d")]


def test_poisson_closed_form(spark):
    rows = [("g0", 2)] * 10 + [("g1", 5)] * 10 + [("g2", 1), ("g2", 3)] * 5
    df = spark.createDataFrame(rows, "g string, y long")
    fit = M.poisson_glm(M.design(df, "y", factors=["g"]))
    c = {r.term: r for r in fit.coefficients(spark).collect()}
    assert abs(c["(Intercept)"].estimate - math.log(2)) < 1e-8
    assert abs(c["g_g1"].estimate - math.log(2.5)) < 1e-8
    assert abs(c["g_g1"].std_error - math.sqrt(1 / 20 + 1 / 50)) < 1e-7
    assert abs(c["g_g2"].estimate) < 1e-8


def test_negbin_theta_recovered(spark):
    rng = np.random.default_rng(3)
    theta, mu = 2.0, 6.0
    y = rng.poisson(rng.gamma(theta, mu / theta, 4000))
    df = spark.createDataFrame([(int(v),) for v in y], "y long").repartition(4)
    fit = M.negbin_glm(M.design(df, "y"))
    assert abs(fit.theta - theta) / theta < 0.15
    assert abs(math.exp(fit.beta[0]) - y.mean()) < 1e-6 * y.mean()


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).normal(0, 1, 500)], "x double")
    k = ST.kde(df, "x", (-6.0, 6.0, 241)).orderBy("x").collect()
    step = 12.0 / 240
    assert abs(sum(r.density for r in k) * step - 1.0) < 1e-3


def test_mlp_gradients_match_finite_differences():
    from quill.operators import mlp as N
    rng = np.random.default_rng(0)
    X = rng.normal(size=(30, 4))
    y = rng.poisson(5, 30).astype(float)
    for loss, out in (("nb", 2), ("mse", 1)):
        W1, b1, W2, b2 = N._init(4, 6, out, 1)
        if out == 2:
            b2 = np.array([1.0, 6.0])  # regular regime (variance above mean)
        params = (W1, b1, W2, b2)
        model = N.MLP(*params, loss=loss, features=["a", "b", "c", "d"])
        v = model.vector()
        _, g = N._grad_sums(params, X, y, loss)
        num = np.zeros_like(v)
        for i in range(0, v.size, 7):
            for sgn in (1, -1):
                w = v.copy()
                w[i] += sgn * 1e-6
                model.set_vector(w)
                num[i] += sgn * N._grad_sums((model.W1, model.b1, model.W2, model.b2), X, y, loss)[0] / 2e-6
        idx = np.arange(0, v.size, 7)
        assert np.allclose(g[idx], num[idx], rtol=1e-4, atol=1e-4), loss


def test_posterior_table_shrinks_to_the_prior(spark):
    from quill.operators import bayes as B
    df = spark.createDataFrame([(i, int(i % 7)) for i in range(200)], "k long, y long")
    d = M.design(df, "y", keys=["k"])
    wide, tight = (B.posterior_table(B.bayes_glm(d, "poisson", B.Priors(intercept_mean=4.0, intercept_sd=s))).first() for s in (1e6, 1e-3))
    assert abs(wide.mode - math.log(sum(i % 7 for i in range(200)) / 200)) < 1e-6 and abs(tight.mode - 4.0) < 0.02
    assert wide.q2_5 < wide.q50 < wide.q97_5


def test_expected_counts_keep_what_is_outside(spark):
    from quill.operators import bayes as B
    df = spark.createDataFrame([(i, 3 if i % 2 else 30) for i in range(100)], "k long, y long")
    post = B.bayes_glm(M.design(df, "y", keys=["k"]), "negbin")
    rows = B.expected_counts(post, 0.0, 20.0, 5.0).collect()
    out = next(r for r in rows if r.bin is None)
    assert sum(r.observed for r in rows) == 100 and out.observed == 50
    assert abs(sum(r.expected for r in rows) - 100) < 1e-6 and out.expected > 1


def test_no_overdispersion_is_the_poisson_limit(spark):
    df = spark.createDataFrame([(5,)] * 50 + [(4,)] * 20 + [(6,)] * 20, "y long")
    fit = M.negbin_glm(M.design(df, "y"))
    assert fit.theta is None and fit.poisson_limit and fit.converged
    assert abs(math.exp(fit.beta[0]) - 5.0) < 1e-8


def test_fits_that_do_not_converge_raise(spark):
    import pytest
    df = spark.createDataFrame([(1, 0.1), (9, 2.0), (3, 1.0), (40, 3.0)], "y long, x double")
    with pytest.raises(M.NotConverged):
        M.poisson_glm(M.design(df, "y", numeric=["x"]), max_iter=2)


def test_quasi_p_values_use_t(spark):
    from quill.functions.mathx import t_sf2
    assert abs(t_sf2(1.64, 3) - 0.1996) < 5e-4 and abs(t_sf2(2.0, 1) - 0.295167) < 1e-6
    df = spark.createDataFrame([(1, 0.0), (4, 1.0), (3, 2.0), (9, 3.0), (6, 4.0)], "y long, x double")
    fit = M.poisson_glm(M.design(df, "y", numeric=["x"]), quasi=True)
    r = fit.coefficients(spark).where("term = 'x'").first()
    assert fit.df_resid == 3 and abs(r.p_value - t_sf2(r.z_value, 3)) < 1e-12


def test_wide_design_meets_its_score_equations(spark):
    rng = np.random.default_rng(8)
    n, p = 1500, 45
    x = rng.normal(size=(n, p)) * 0.3
    y = rng.poisson(np.exp(0.5 + x @ rng.normal(0, 0.2, p)))
    cols = [f"x{i}" for i in range(p)]
    df = spark.createDataFrame([(int(v), *map(float, r)) for v, r in zip(y, x)], "y long, " + ", ".join(f"{c} double" for c in cols))
    fit = M.poisson_glm(M.design(df.repartition(3), "y", numeric=cols))
    full = np.column_stack([np.ones(n), x])
    assert np.abs(full.T @ (y - np.exp(full @ fit.beta))).max() < 1e-3


def test_kde_of_large_values(spark):
    values = np.random.default_rng(2).normal(1e9, 0.3, 1000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    k = ST.kde(df, "x", (1e9 - 3, 1e9 + 3, 301)).collect()
    assert abs(sum(r.density for r in k) * 0.02 - 1.0) < 1e-3


def test_kde_without_cutoff_is_the_same(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(3).normal(0, 1, 300)], "x double")
    a, b = ({r.x: r.density for r in ST.kde(df, "x", (-4.0, 4.0, 41), cutoff=c).collect()} for c in (9.0, 1e6))
    assert all(abs(a[x] - b[x]) < 1e-12 for x in a)


def test_constant_values_have_no_density(spark):
    import pytest
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0)], "g string, x double")
    with pytest.raises(ValueError, match="bandwidth"):
        ST.kde(df.where("g = 'a'"), "x", (0.0, 2.0, 5))
    rows = ST.kde_by(df, ["g"], "x", num=8).collect()
    assert [(r.x, r.density) for r in rows if r.g == "a"] == [(1.0, None)] and sum(r.g == "b" for r in rows) == 8


def test_held_out_loss_beats_the_mean(spark, sf):
    """The full-sized network on held-out rows."""
    from quill.plans.catalog import REGISTRY
    rows = REGISTRY["mlp_nb_predictions"].build(spark, sf).collect()
    assert len(rows) > 20 and all(math.isfinite(r.prediction) and r.prediction > 0 for r in rows)
    assert len({r.test_nb_loss for r in rows}) == 1 and rows[0].test_nb_loss < 4.5
