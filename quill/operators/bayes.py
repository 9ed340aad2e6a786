"""Bayesian count regression, re-aimed for Spark.

The reference samples posteriors with Hamiltonian Monte Carlo on one machine.
Here the same questions — posterior summaries, intervals, predictive checks —
are answered from the posterior **mode with a Laplace (Gaussian)
approximation**: penalised IRLS (prior precision added to the Gram) gives the
mode, the inverse penalised Gram the covariance; intervals and predictive
counts follow in closed form. This approximates a sampler's output and draws
nothing; tables of draws made elsewhere can be summarised (M19, M22, W4).
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mathx import digamma, lgamma, norm_ppf, trigamma
from ..session import cut_lineage
from .aggregates import FUZZ
from .common import measured_broadcast
from .glm import Design, NotConverged, _eta, _family, _gram, batch_sums, moment_theta, theta_step
from .windows import acf, running_total


@dataclass
class Priors:
    """Normal priors: intercept N(m0, s0²), coefficients N(0, s²) — the second
    number is the standard deviation (§2.17 #19). With ``autoscale`` the
    coefficient sd is divided by each predictor's sd (rstanarm). Dispersion θ:
    ``exponential(rate)`` or ``gamma(shape, rate)``."""
    intercept_mean: float = 4.0
    intercept_sd: float = 4.0
    coef_sd: float = 16.0
    autoscale: bool = True
    aux: str = "exponential"
    aux_a: float = 1.0
    aux_b: float = 1.0

    def sds(self, d: Design) -> np.ndarray:
        sd = np.full(d.p, float(self.coef_sd))
        sd[0] = self.intercept_sd
        if self.autoscale and d.p > 1:
            r = d.df.agg(*[F.stddev_samp(f"_x{j}").alias(f"s{j}") for j in range(1, d.p)]).collect()[0]
            for j in range(1, d.p):
                s = r[f"s{j}"]
                sd[j] = self.coef_sd / s if s else self.coef_sd
        return sd

    def means(self, d: Design) -> np.ndarray:
        m = np.zeros(d.p)
        m[0] = self.intercept_mean
        return m


@dataclass
class Posterior:
    family: str
    terms: list[str]
    mode: np.ndarray
    cov: np.ndarray
    theta: float | None = None
    log_theta_sd: float | None = None
    design: Design | None = None

    def params(self) -> list[str]:
        return self.terms + (["reciprocal_dispersion"] if self.theta is not None else [])


def bayes_glm(d: Design, family: str = "poisson", priors: Priors | None = None, tol: float = 1e-10,
              max_iter: int = 200) -> Posterior:
    """Posterior mode and Laplace covariance of a Poisson or NB2 GLM.

    Each pass makes one penalised IRLS step for β and, for the negative
    binomial, one Newton step for log θ (likelihood plus the prior's terms).
    Convergence is judged on the penalised deviance and on θ."""
    pr = priors or Priors()
    m0, sd = pr.means(d), pr.sds(d)
    lam = np.diag(1.0 / sd ** 2)
    y, pw = F.col("_y"), F.col("_w")
    theta, beta, pen_old, done = None, None, None, False
    for _ in range(max_iter):
        if beta is None:
            mu = y + 0.1
            eta = F.log(mu)
        else:
            eta = _eta(beta, d.p)
            mu = F.exp(eta)
        var, devf = _family(family, theta)
        extra = {"dev": pw * devf(mu)}
        if theta is not None:
            t = F.lit(theta)
            extra["score"] = pw * (digamma(y + t) - digamma(t) + math.log(theta) + 1.0 - F.log(t + mu) - (y + t) / (mu + t))
            extra["info"] = pw * (-trigamma(y + t) + trigamma(t) - 1.0 / theta + 2.0 / (mu + t) - (y + t) / ((mu + t) * (mu + t)))
        G, b, ex = _gram(d, pw * mu * mu / var(mu), eta + (y - mu) / mu, extra)
        pen = ex["dev"] + (0.0 if beta is None else float((beta - m0) @ lam @ (beta - m0)))
        still = pen_old is not None and abs(pen - pen_old) < tol * (abs(pen) + 0.1)
        beta, pen_old = np.linalg.solve(G + lam, b + lam @ m0), pen
        if family == "negbin":
            if theta is None:
                if still:  # from the Poisson mode on; without extra variance the prior alone bounds θ
                    theta, pen_old = moment_theta(d, beta) or 100.0, None
                continue
            score, info = _with_prior(pr, theta, ex["score"], ex["info"])
            new = theta_step(theta, score, info)
            still, theta = still and abs(new - theta) < 1e-9 * theta, new
        if still:
            done = True
            break
    if not done:
        raise NotConverged(f"{family} posterior mode: {max_iter} steps")
    mu = F.exp(_eta(beta, d.p))
    var, _ = _family(family, theta)
    extra = {}
    if theta is not None:
        t = F.lit(theta)
        extra["info"] = pw * (-trigamma(y + t) + trigamma(t) - 1.0 / theta + 2.0 / (mu + t) - (y + t) / ((mu + t) * (mu + t)))
    G, _, ex = _gram(d, pw * mu * mu / var(mu), F.lit(0.0), extra)
    lt_sd = None
    if theta is not None:
        _, info = _with_prior(pr, theta, 0.0, ex["info"])
        lt_sd = 1.0 / (theta * math.sqrt(info)) if info > 0 else None
    return Posterior(family, list(d.terms), beta, np.linalg.inv(G + lam), theta, lt_sd, d)


def _with_prior(pr: Priors, theta: float, score: float, info: float) -> tuple[float, float]:
    """Score and information of θ with its prior's terms added."""
    if pr.aux == "gamma":
        return score + (pr.aux_a - 1) / theta - pr.aux_b, info + (pr.aux_a - 1) / theta ** 2
    return score - pr.aux_a, info


def posterior_table(post: Posterior, probs=(0.025, 0.5, 0.975)) -> DataFrame:
    """M19 for a fitted model: per parameter mode, sd and quantiles of its
    Gaussian (θ: log-normal) approximation, in closed form."""
    from statistics import NormalDist
    z = [NormalDist().inv_cdf(p) for p in probs]
    rows = [(t, float(m), float(s), *[float(m + s * q) for q in z])
            for t, m, s in zip(post.terms, post.mode, np.sqrt(np.diag(post.cov)), strict=True)]
    if post.theta is not None:
        sd = post.log_theta_sd
        rows.append(("reciprocal_dispersion", float(post.theta), None if sd is None else float(post.theta * sd),
                     *[None if sd is None else float(post.theta * math.exp(sd * q)) for q in z]))
    names = ", ".join(f"{_qname(p)} double" for p in probs)
    return post.design.df.sparkSession.createDataFrame(rows, f"param string, mode double, sd double, {names}")


def summarise_draws(d: DataFrame, probs=(0.025, 0.5, 0.975), max_lag: int = 50, ess: bool = True) -> DataFrame:
    """Per parameter mean, sd, quantiles (exact, distributed), classic
    R-hat (between/within chain variances) and, optionally, the effective
    sample size from chain-averaged autocorrelations (Geyer's initial positive
    sequence, applied to the small lag table)."""
    ch = d.groupBy("param", "chain").agg(F.avg("value").alias("cm"), F.var_samp("value").alias("cv"),
                                         F.count(F.lit(1)).alias("cn"))
    rh = ch.groupBy("param").agg(F.count(F.lit(1)).alias("m"), F.avg("cn").alias("n"),
                                 F.var_samp("cm").alias("bvar"), F.avg("cv").alias("W"))
    rh = rh.select("param", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("W") + F.col("bvar")) / F.col("W"))
                   .alias("rhat"), "m", "n")
    base = d.groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    wide_q = _quantiles_by(d, "param", "value", probs)
    out = base.join(wide_q, "param").join(rh, "param")
    if ess:
        out = out.join(effective_size(d, max_lag), "param")
    return out.drop("m", "n")


def effective_size(d: DataFrame, max_lag: int = 50, name: str = "ess") -> DataFrame:
    """(param, ess): draws over the integrated chain-averaged autocorrelation. The
    lags grow fourfold until the pair sums of every parameter have turned negative;
    a slowly mixing chain asks for long transforms, not for a larger plan."""
    ch = d.groupBy("param", "chain").agg(F.count(F.lit(1)).alias("cn"))
    size = ch.groupBy("param").agg(F.sum("cn").alias("n"))
    longest = int(ch.agg(F.max("cn")).first()[0] or 1)
    lags, tau = max_lag, None
    while tau is None:
        lags = min(lags, longest - 1)
        rho: dict[str, dict[int, float]] = {}
        a = acf(d, ["param", "chain"], "iter", "value", lags).groupBy("param", "lag").agg(F.avg("acf").alias("rho"))
        for r in a.where("rho IS NOT NULL").collect():  # params × lags rows
            rho.setdefault(r["param"], {})[r["lag"]] = r["rho"]
        ended = {p: _geyer(v, lags) for p, v in rho.items()}  # a parameter that never moves has none
        if all(e for _, e in ended.values()) or lags >= longest - 1:
            tau = [(p, t) for p, (t, _) in ended.items()]
        else:  # the pair sums have not turned negative yet
            lags *= 4
    tau = d.sparkSession.createDataFrame(tau, "param string, tau double")
    return size.join(tau, "param").select("param", (F.col("n") / F.col("tau")).alias(name))


def split_chains(d: DataFrame) -> DataFrame:
    """Every chain (iter 0, 1, …) as two of half its length; an odd last draw is
    left out."""
    half = d.groupBy("param", "chain").agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    number = F.row_number().over(Window.partitionBy("param").orderBy("chain"))  # a row per chain
    half = half.withColumn("number", 2 * number - 2)
    x = d.join(measured_broadcast(half), ["param", "chain"]).where(F.col("iter") < 2 * F.col("half"))
    second = (F.col("iter") >= F.col("half")).cast("int")
    return x.select("param", (F.col("number") + second).alias("chain"), (F.col("iter") - second * F.col("half")).alias("iter"), "value")


def rank_normalised(d: DataFrame) -> DataFrame:
    """Draws as the normal scores of their ranks within a parameter: ranks are
    counted over all chains, ties get their mean rank."""
    counts = d.groupBy("param", "value").agg(F.count(F.lit(1)).alias("c"))
    n = d.groupBy("param").agg(F.count(F.lit(1)).alias("s"))
    below = running_total(counts, ["param"], "value", "c")
    score = below.join(measured_broadcast(n), "param").select(
        "param", "value", norm_ppf((F.col("before") + (F.col("c") + 1) / 2 - 0.375) / (F.col("s") + 0.25)).alias("z"))
    return d.join(score, ["param", "value"]).select("param", "chain", "iter", F.col("z").alias("value"))


def rank_diagnostics(d: DataFrame, max_lag: int = 50) -> DataFrame:
    """(param, rhat, bulk_ess, tail_ess) as the summary of a sampler prints
    them: R-hat and effective size of the rank-normalised halves of the chains, and
    the smaller effective size of the indicators of the outer twentieths."""
    halves = cut_lineage(split_chains(d))
    z = cut_lineage(rank_normalised(halves))
    out = summarise_draws(z, probs=(0.5,), ess=False).select("param", "rhat").join(effective_size(z, max_lag, "bulk_ess"), "param")
    q = _quantiles_by(halves, "param", "value", (0.05, 0.95))
    x = halves.join(measured_broadcast(q), "param")
    for name, hit in (("low", F.col("value") <= F.col("q5")), ("high", F.col("value") >= F.col("q95"))):
        marked = x.select("param", "chain", "iter", hit.cast("double").alias("value"))
        out = out.join(effective_size(marked, max_lag, name), "param")
    return out.select("param", "rhat", "bulk_ess", F.least("low", "high").alias("tail_ess"))


def _geyer(rho: dict[int, float], lags: int) -> tuple[float, bool]:
    """1 + 2 Σ of autocorrelations over pairs until a pair's sum is negative,
    and whether that happened within ``lags``."""
    total = 0.0
    for t in range(1, lags, 2):
        pair = rho.get(t, 0.0) + rho.get(t + 1, 0.0)
        if pair < 0:
            return 1.0 + 2.0 * total, True
        total += pair
    return 1.0 + 2.0 * total, False


def _quantiles_by(df: DataFrame, group: str, col: str, probs) -> DataFrame:
    """Exact type-7 quantiles per group, wide (q2_5, q50, …), distributed."""
    from .features import quantiles_by
    q = quantiles_by(df, [group], col, probs)
    return q.groupBy(group).agg(*[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(_qname(p)) for p in probs])


def _qname(p: float) -> str:
    s = f"{p * 100:g}".replace(".", "_")
    return f"q{s}"


def prior_table(spark: SparkSession, d: Design, priors: Priors, family: str = "poisson") -> DataFrame:
    """The prior actually used per parameter (after autoscaling)."""
    sd, m = priors.sds(d), priors.means(d)
    rows = [(t, "normal", float(m[i]), float(sd[i])) for i, t in enumerate(d.terms)]
    if family == "negbin":
        rows.append(("reciprocal_dispersion", priors.aux, float(priors.aux_a), float(priors.aux_b)))
    return spark.createDataFrame(rows, "param string, dist string, a double, b double")


def expected_counts(post: Posterior, start: float, stop: float, width: float) -> DataFrame:
    """Observed and expected counts per bin at the posterior mode:
    (bin, lo, hi, observed, expected). The expected count of a bin is the sum
    over all rows of the fitted probability that a count falls into (lo, hi],
    the lowest edge included. What lies outside the breaks is kept in a row
    with NULL edges. Each task runs the recurrence of the probabilities over
    its rows in numpy; nothing is simulated."""
    d = post.design
    bins = int(round((stop - start) / width))
    last = int(math.floor(stop + FUZZ * width))
    of = np.full(last + 1, bins)  # bin of every count 0..last; ``bins`` is outside
    for k in range(last + 1):
        if k >= start - FUZZ * width:
            of[k] = max(1, math.ceil((k - start) / width - FUZZ)) - 1
    theta = post.theta

    def add(m):
        y, mu, w = m[:, 0], m[:, 1], np.ones(len(m))
        out = np.zeros((2, bins + 1))
        inside = (y >= start - FUZZ * width) & (y <= stop + FUZZ * width)
        seen = np.maximum(1, np.ceil((y - start) / width - FUZZ)).astype(int) - 1
        out[0] = np.bincount(np.where(inside, seen, bins), minlength=bins + 1)
        p = np.exp(-mu) if theta is None else np.exp(-theta * np.log1p(mu / theta))
        left = float(len(m))
        for k in range(last + 1):
            total = float((p * w).sum())
            out[1, of[k]] += total
            left -= total
            p = p * mu / (k + 1) if theta is None else p * (k + theta) / (k + 1) * (mu / (mu + theta))
        out[1, bins] += max(left, 0.0)
        return out.ravel()

    s = batch_sums(d.df, [F.col("_y"), F.exp(_eta(post.mode, d.p))], add, 2 * (bins + 1)).reshape(2, bins + 1)
    rows = [(i + 1 if i < bins else None, start + i * width if i < bins else None, start + (i + 1) * width if i < bins else None,
             int(s[0, i]), float(s[1, i])) for i in range(bins + 1)]
    return d.df.sparkSession.createDataFrame(rows, "bin long, lo double, hi double, observed long, expected double")


def trace(d: DataFrame) -> DataFrame:
    """Draws in trace order (param, chain, iter)."""
    return d.orderBy("param", "chain", "iter")


def density_by_chain(d: DataFrame, num: int = 128) -> DataFrame:
    """Gaussian KDE of each (param, chain), grid over its range ± 3 bw."""
    from .stats import kde_by
    return kde_by(d, ["param", "chain"], "value", num=num)


def nb_shape_regression(d: Design, zcols: list[str], priors: Priors | None = None, shape_sd: float = 4.0,
                        max_iter: int = 100, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """NB2 with log-linear mean (design X) and log-linear shape
    φ = exp(γ₀ + Σ γ_k z_k); posterior mode by Newton steps on the joint
    log posterior (normal priors, shape prior sd ``shape_sd``), each step one
    pass of gradient/Hessian sums. Returns (β, γ, covariance)."""
    pr = priors or Priors(autoscale=False)
    y, pw = F.col("_y"), F.col("_w")
    x = d.xcols()
    zc = [F.lit(1.0)] + [F.col(c).cast("double") for c in zcols]
    p, q = d.p, len(zc)
    m0 = np.concatenate([pr.means(d), np.zeros(q)])
    sd = np.concatenate([pr.sds(d), np.full(q, shape_sd)])
    theta = np.concatenate([np.zeros(p), np.zeros(q)])
    theta[0] = math.log(max(d.df.agg(F.avg("_y")).collect()[0][0], 1e-3))
    lp_old, done = None, False
    for _ in range(max_iter):
        b, g = theta[:p], theta[p:]
        mu = F.exp(_eta(b, p))
        ge = F.lit(0.0)
        for k in range(q):
            ge = ge + zc[k] * float(g[k])
        phi = F.exp(ge)
        A = digamma(y + phi) - digamma(phi) + F.log(phi / (phi + mu)) + (mu - y) / (phi + mu)
        dA = trigamma(y + phi) - trigamma(phi) + 1.0 / phi - 1.0 / (phi + mu) - (mu - y) / ((phi + mu) * (phi + mu))
        g_mu = phi * (y - mu) / (mu + phi)
        g_phi = phi * A
        h_mm = -phi * mu * (y + phi) / ((mu + phi) * (mu + phi))
        h_mp = phi * mu * (y - mu) / ((mu + phi) * (mu + phi))
        h_pp = phi * A + phi * phi * dA
        ll = lgamma(y + phi) - lgamma(phi) - lgamma(y + 1.0) + phi * F.log(phi / (phi + mu)) + \
            F.when(y > 0, y * F.log(mu / (phi + mu))).otherwise(F.lit(0.0))

        def add(m):
            xm, zm = m[:, :p], m[:, p:p + q]
            w, gm, gp, hm, hx, hp, lv = (m[:, p + q + i:p + q + i + 1] for i in range(7))
            hess = np.zeros((p + q, p + q))
            hess[:p, :p] = xm.T @ (xm * (w * hm))
            hess[:p, p:] = xm.T @ (zm * (w * hx))
            hess[p:, :p] = hess[:p, p:].T
            hess[p:, p:] = zm.T @ (zm * (w * hp))
            return np.concatenate([(xm * (w * gm)).sum(0), (zm * (w * gp)).sum(0), hess.ravel(), (w * lv).sum(0)])

        s = batch_sums(d.df, [*x, *zc, pw, g_mu, g_phi, h_mm, h_mp, h_pp, ll], add, (p + q) * (p + q + 1) + 1)
        grad = s[:p + q] - (theta - m0) / sd ** 2
        H = s[p + q:-1].reshape(p + q, p + q).copy()
        r = {"ll": s[-1]}
        H -= np.diag(1.0 / sd ** 2)
        lp = r["ll"] - 0.5 * np.sum((theta - m0) ** 2 / sd ** 2)
        done = lp_old is not None and abs(lp - lp_old) < tol * (abs(lp) + 1)
        if done:
            break
        lp_old = lp
        try:
            step = np.linalg.solve(H, grad)
        except np.linalg.LinAlgError:
            step = -grad * 1e-3
        if not np.all(np.linalg.eigvalsh(H) < 0):
            step = -grad / (np.abs(np.diag(H)) + 1.0)  # not concave here: scaled gradient step
        theta = theta - np.clip(step, -2.0, 2.0)
    if not done:
        raise NotConverged(f"shape regression: {max_iter} steps")
    cov = np.linalg.inv(-H)
    return theta[:p], theta[p:], cov
