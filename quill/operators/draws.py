"""Random draws that depend on what they are for, not on where they are made
(SURVEY M20-M22): prior and posterior draws, posterior predictive replicates.

Every uniform number is a hash of (seed, name, draw, row), so partitions, retries
and the number of executors do not change a draw, and SQL can make the same one.
Normals come by the inverse distribution function, exponentials by the logarithm,
gammas, Poisson and negative binomial counts by inverting their distribution
functions in numpy, a batch at a time.

Draws of parameters are from the Gaussian approximation at the posterior mode
(θ on the log scale); replicates are counts drawn for every row and draw.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mathx import lgamma_np, norm_ppf
from .aggregates import FUZZ
from .bayes import Posterior, Priors
from .glm import Design, batch_sums


def uniform(seed: int, name: str, *keys: Column) -> Column:
    """A number in (0, 1): (the first 52 bits of the md5 of ``seed:name:key…`` +
    1/2) / 2**52. NULL keys are empty texts."""
    text = F.concat_ws(":", F.lit(f"{seed}:{name}"), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def normal(seed: int, name: str, *keys: Column) -> Column:
    return norm_ppf(uniform(seed, name, *keys))


def gamma_cdf(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: its series below a + 1, the continued
    fraction above."""
    x = np.asarray(x, float)
    out, small = np.zeros_like(x), x < a + 1
    front = np.exp(np.where(x > 0, -x + a * np.log(np.maximum(x, 1e-300)), -np.inf) - math.lgamma(a))
    term = total = np.full_like(x, 1 / a)
    for n in range(1, 500):
        term = term * np.where(small, x, 0) / (a + n)
        total = total + term
        if not (term > 1e-17 * total).any():
            break
    out[small] = (front * total)[small]
    b = x + 1 - a
    b = np.where(small, 1.0, b)
    c, d = np.full_like(x, 1e300), 1 / b
    h = d
    for n in range(1, 500):
        an = -n * (n - a)
        b = b + 2
        d, c = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b), np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-16)[~small].all():
            break
    out[~small] = (1 - front * h)[~small]
    return out


def gamma_ppf(a: float, u: np.ndarray) -> np.ndarray:
    """Quantiles of the gamma distribution of shape ``a`` by bisection."""
    lo, hi = np.zeros_like(u), np.full_like(u, a + 10 * math.sqrt(a) + 50.0)
    while (gamma_cdf(a, hi) < u).any():
        hi = np.where(gamma_cdf(a, hi) < u, 2 * hi, hi)
    for _ in range(100):
        mid = (lo + hi) / 2
        low = gamma_cdf(a, mid) < u
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def count_ppf(u: np.ndarray, mu: np.ndarray, theta=None) -> np.ndarray:
    """Smallest count whose distribution function reaches u: Poisson of mean mu,
    or negative binomial with shape ``theta``. Sums begin 12 standard deviations
    under the mean: less than 1e-30 lies below."""
    u, mu = np.broadcast_arrays(np.asarray(u, float), np.asarray(mu, float))
    th = None if theta is None else np.broadcast_to(np.asarray(theta, float), mu.shape)
    sd = np.sqrt(mu if th is None else mu + mu * mu / th)
    k = np.floor(np.maximum(0.0, mu - 12 * sd))
    if th is None:
        p = np.exp(k * np.log(np.maximum(mu, 1e-300)) - mu - lgamma_np(k + 1.0))
    else:
        p = np.exp(lgamma_np(k + th) - lgamma_np(th) - lgamma_np(k + 1.0) - th * np.log1p(mu / th) + k * np.log(np.maximum(mu, 1e-300) / (mu + th)))
    cdf, last, at = p.copy(), mu + 60 * sd + 100, np.arange(u.size)
    out = k.ravel().copy()
    flat = [x.ravel().copy() for x in (u, mu, k, p, cdf, last)] + [None if th is None else th.ravel().copy()]
    while True:
        more = (flat[4] < flat[0]) & (flat[2] < flat[5])
        out[at[~more]] = flat[2][~more]
        if not more.any():
            return out.reshape(u.shape)
        at = at[more]
        flat = [None if x is None else x[more] for x in flat]
        uu, m, kk, pp, cc, ll, t = flat
        pp = pp * m / (kk + 1) if t is None else pp * (kk + t) / (kk + 1) * (m / (m + t))
        flat = [uu, m, kk + 1, pp, cc + pp, ll, t]


def prior_draws(spark: SparkSession, d: Design, priors: Priors, family: str = "poisson", n: int = 1000, seed: int = 42) -> DataFrame:
    """(param, draw, value): ``n`` draws of every parameter from its prior,
    scaled to the predictors as ``prior_table`` tells."""
    sd, mean = priors.sds(d), priors.means(d)
    i = F.col("id")
    out = [F.struct(F.lit(t).alias("param"), (F.lit(float(mean[j])) + F.lit(float(sd[j])) * normal(seed, t, i)).alias("value"))
           for j, t in enumerate(d.terms)]
    if family == "negbin":
        u = uniform(seed, "reciprocal_dispersion", i)
        value = -F.log(u) / F.lit(float(priors.aux_a)) if priors.aux == "exponential" else u
        out.append(F.struct(F.lit("reciprocal_dispersion").alias("param"), value.alias("value")))
    rows = spark.range(n).select(i.alias("draw"), F.inline(F.array(*out))).select("param", "draw", "value")
    if family != "negbin" or priors.aux == "exponential":
        return rows
    shape, rate = float(priors.aux_a), float(priors.aux_b)

    def turned(batches):
        for b in batches:
            v = b.column("value").to_numpy().copy()
            mine = np.array([p == "reciprocal_dispersion" for p in b.column("param").to_pylist()], bool)
            v[mine] = gamma_ppf(shape, v[mine]) / rate
            yield pa.RecordBatch.from_arrays([b.column("param"), b.column("draw"), pa.array(v)], names=["param", "draw", "value"])

    return rows.mapInArrow(turned, rows.schema)


def _normals(n: int, seed: int, terms: list[str]) -> DataFrame:
    """(draw, z): a standard normal per term."""
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().range(n).select(F.col("id").alias("draw"), F.array(*[normal(seed, t, F.col("id")) for t in terms]).alias("z"))


def posterior_draws(post: Posterior, n: int = 1000, seed: int = 42, chains: int = 4) -> DataFrame:
    """(param, chain, iter, draw, value): draws of the Gaussian at the
    mode; the draws are dealt to ``chains`` in turn."""
    names = post.params()
    chol = np.linalg.cholesky(post.cov)
    mode, th, lsd = post.mode, post.theta, post.log_theta_sd or 0.0

    def turned(batches):
        for b in batches:
            z = b.column("z").flatten().to_numpy().reshape(b.num_rows, len(names))
            v = np.empty_like(z)
            p = len(mode)
            v[:, :p] = mode + z[:, :p] @ chol.T
            if th is not None:
                v[:, p] = th * np.exp(lsd * z[:, p])
            draw = np.repeat(b.column("draw").to_numpy(), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names * b.num_rows), pa.array(draw % chains), pa.array(draw // chains), pa.array(draw),
                                              pa.array(v.ravel())], names=["param", "chain", "iter", "draw", "value"])

    return _normals(n, seed, names).mapInArrow(turned, "param string, chain long, iter long, draw long, value double")


def predictive_counts(post: Posterior, start: float, stop: float, width: float, draws: int = 50, seed: int = 42) -> DataFrame:
    """(draw, bin, n): a count drawn for every row under every draw of the
    parameters, binned right-closed as ``expected_counts`` bins; draw -1 holds the
    observed counts, bin NULL what lies outside the breaks.

    The design's keys name the rows. A task makes all draws of its rows at once
    and hands on one table of counts; rows are not multiplied."""
    d = post.design
    if not d.keys:
        raise ValueError("replicates are drawn by the design's keys: it has none")
    table = posterior_draws(post, draws, seed).toPandas().pivot(index="draw", columns="param", values="value")
    beta = table[post.terms].to_numpy().T  # columns by name: a draw each
    theta = table["reciprocal_dispersion"].to_numpy() if post.theta is not None else None
    bins, p = int(round((stop - start) / width)), d.p
    row = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in d.keys])
    us = [uniform(seed, "row", F.lit(i), row) for i in range(draws)]

    def binned(y):
        inside = (y >= start - FUZZ * width) & (y <= stop + FUZZ * width)
        return np.where(inside, np.maximum(1, np.ceil((y - start) / width - FUZZ)).astype(int) - 1, bins)

    def add(m):
        x, y, u = m[:, :p], m[:, p], m[:, p + 1:]
        out = np.zeros((draws + 1, bins + 1))
        out[0] = np.bincount(binned(y), minlength=bins + 1)
        for i in range(draws):
            rep = count_ppf(u[:, i], np.exp(x @ beta[:, i]), None if theta is None else theta[i])
            out[i + 1] = np.bincount(binned(rep), minlength=bins + 1)
        return out.ravel()

    s = batch_sums(d.df, [*d.xcols(), F.col("_y"), *us], add, (draws + 1) * (bins + 1)).reshape(draws + 1, bins + 1)
    rows = [(i - 1, b + 1 if b < bins else None, int(s[i, b])) for i in range(draws + 1) for b in range(bins + 1)]
    return d.df.sparkSession.createDataFrame(rows, "draw long, bin long, n long")
