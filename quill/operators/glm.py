"""Count regression: Poisson, quasi-Poisson and negative
binomial GLMs with a log link, fitted by IRLS.

Each IRLS step is one pass over a cached design. Weights, working response and
likelihood terms are column expressions; the weighted design and response are
reduced by a tall-skinny QR (``qr``): a triangle per task, joined in levels. So
the time is linear in the rows, and nearly collinear columns, which inflation
factors are there to find, lose no more digits than the design itself (XᵀWX would
lose twice as many). The driver solves one triangle. θ of the negative binomial is
found by Newton steps on its profile score from the same passes. A fit that does
not converge raises ``NotConverged``, one with a column that the others determine
``Collinear``.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.mathx import digamma, lgamma, nb_logpmf, norm_ppf, norm_sf2, poisson_logpmf, t_sf2, trigamma
from .features import levels
from .qr import reduced
from .windows import dense_index

INTERCEPT = "(Intercept)"


@dataclass
class Design:
    """A cached design: response ``_y``, prior weight ``_w`` and columns ``_x0…``."""
    df: DataFrame
    terms: list[str]                 # design column names, intercept first
    blocks: dict[str, list[int]]     # model term → design column positions
    keys: list[str] = field(default_factory=list)
    cached: DataFrame | None = None  # what is cached, where ``df`` is a view of it
    tasks: int = 0                   # partitions of the cached rows, counted once

    @property
    def p(self) -> int:
        return len(self.terms)

    def xcols(self) -> list[Column]:
        return [F.col(f"_x{j}") for j in range(self.p)]

    def view(self, keep: list[int]) -> Design:
        """The design with the columns ``keep`` alone, over the same cached rows."""
        at = {j: k for k, j in enumerate(keep)}
        df = self.df.select(*self.keys, "_y", "_w", *[F.col(f"_x{j}").alias(f"_x{k}") for j, k in at.items()])
        blocks = {t: [at[j] for j in idx] for t, idx in self.blocks.items() if all(j in at for j in idx)}
        return Design(df, [self.terms[j] for j in keep], blocks, self.keys, self.cached if self.cached is not None else self.df, self.tasks)

    def free(self) -> None:
        """Release the cached rows; later reads compute them again."""
        (self.cached if self.cached is not None else self.df).unpersist()


class NotConverged(RuntimeError):
    """A fit that stopped at its last allowed step."""


class Collinear(np.linalg.LinAlgError):
    """A design column that the others determine."""


def design(df: DataFrame, y: str, numeric=(), factors=(), weight: str | None = None,
           keys=(), level_map: dict | None = None, cache: bool = True) -> Design:
    """Design with intercept; factors are dummy-coded with the alphabetically
    first level as reference (all levels plus intercept would be collinear,
    §2.17 #18). Rows with a NULL response or predictor are dropped (R's
    ``na.omit``)."""
    numeric, factors, keys = list(numeric), list(factors), list(keys)
    lv = level_map or (levels(df, factors) if factors else {})
    cols = [F.lit(1.0)]
    terms, blocks = [INTERCEPT], {INTERCEPT: [0]}
    for c in numeric:
        blocks[c] = [len(cols)]
        cols.append(F.col(c).cast("double"))
        terms.append(c)
    for c in factors:
        idx = []
        for v in lv[c][1:]:
            idx.append(len(cols))
            cols.append((F.col(c).cast("string") == F.lit(v)).cast("double"))
            terms.append(f"{c}_{v}")
        blocks[c] = idx
    need = [y] + numeric + factors + ([weight] if weight else [])
    d = df.dropna(subset=need).select(
        *keys, F.col(y).cast("double").alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
        *[c.alias(f"_x{j}") for j, c in enumerate(cols)])
    if cache:
        d = d.persist()
    return Design(d, terms, blocks, keys)


def _eta(beta: np.ndarray, p: int) -> Column:
    e = F.lit(0.0)
    for j in range(p):
        if beta[j] != 0.0:
            e = e + F.col(f"_x{j}") * F.lit(float(beta[j]))
    return e


def batch_sums(df: DataFrame, columns: list[Column], fn, size: int) -> np.ndarray:
    """Σ over Arrow batches of ``fn(matrix of the columns) -> vector``: every
    task adds up its batches and hands on one vector, Spark sums these."""
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += fn(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "v"])

    out = np.zeros(size)
    for r in named.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def _gram(d: Design, w: Column, z: Column, extra: dict[str, Column]) -> tuple[np.ndarray, np.ndarray, dict]:
    """XᵀWX, XᵀWz and the sums of the ``extra`` row expressions, in one pass."""
    p = d.p

    def add(m):
        x, wx = m[:, :p], m[:, :p] * m[:, p:p + 1]
        return np.concatenate([(x.T @ wx).ravel(), wx.T @ m[:, p + 1], m[:, p + 2:].sum(0)])

    s = batch_sums(d.df, [*d.xcols(), w, z, *extra.values()], add, p * p + p + len(extra))
    return s[:p * p].reshape(p, p), s[p * p:p * p + p], dict(zip(extra, s[p * p + p:].tolist(), strict=True))


def _qr(d: Design, w: Column, z: Column, extra: dict[str, Column]) -> tuple[np.ndarray, np.ndarray, dict]:
    """R of √W·X, Qᵀ√W·z and the sums of the ``extra`` row expressions, in one pass."""
    p = d.p
    if not d.tasks:
        d.tasks = d.df.select(F.spark_partition_id().alias("i")).distinct().count()
    r, sums = reduced(d.df, [*d.xcols(), z], w, list(extra.values()), d.tasks)
    scale = np.linalg.norm(r[:, :p], axis=0)
    low = np.flatnonzero(~(np.abs(np.diag(r)[:p]) > 16 * p * np.finfo(float).eps * scale))
    if len(low):
        raise Collinear(f"determined by the others: {', '.join(d.terms[j] for j in low)}")
    return r[:p, :p], r[:p, p], dict(zip(extra, sums.tolist(), strict=True))


def _family(family: str, theta: float | None):
    """Variance and deviance terms; a negative binomial without θ is Poisson."""
    y = F.col("_y")
    family = "poisson" if theta is None else family

    def var(mu):
        return mu if family == "poisson" else mu + mu * mu / F.lit(theta)

    def dev(mu):
        ylog = F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0))
        if family == "poisson":
            return 2.0 * (ylog - (y - mu))
        th = F.lit(theta)
        return 2.0 * (ylog - (y + th) * F.log((y + th) / (mu + th)))
    return var, dev


def _irls(d: Design, family: str, theta: float | None, beta0: np.ndarray | None,
          tol: float = 1e-12, max_iter: int = 50):
    """(β, R, Qᵀz, sums, passes): the pass that finds the deviance unchanged has
    the sums at its β already, so none follows it."""
    var, devf = _family(family, theta)
    y, pw = F.col("_y"), F.col("_w")
    beta, dev_old = beta0, None
    for it in range(1, max_iter + 1):
        if beta is None:
            mu = y + 0.1 if family == "poisson" else y + F.lit(1.0 / 6.0)
            eta, extra = F.log(mu), {}
        else:
            eta = _eta(beta, d.p)
            mu = F.exp(eta)
            ll = poisson_logpmf(y, mu) if family == "poisson" else nb_logpmf(y, mu, F.lit(theta))
            extra = {"dev": pw * devf(mu), "pearson": pw * (y - mu) * (y - mu) / var(mu), "ll": pw * ll, "n": F.lit(1.0), "sw": pw}
        R, b, ex = _qr(d, pw * mu * mu / var(mu), eta + (y - mu) / mu, extra)
        if beta is not None:
            if dev_old is not None and abs(ex["dev"] - dev_old) / (abs(ex["dev"]) + 0.1) < tol:
                return beta, R, b, ex, it
            dev_old = ex["dev"]
        beta = np.linalg.solve(R, b)
    raise NotConverged(f"{family} fit: {max_iter} steps")


@dataclass
class GLMFit:
    family: str
    design: Design
    beta: np.ndarray
    r: np.ndarray                     # triangle of the weighted design: RᵀR = XᵀWX
    deviance: float
    pearson: float
    loglik: float
    n: int
    iterations: int
    theta: float | None = None        # NULL: Poisson, or the negative binomial's Poisson limit
    theta_se: float | None = None
    quasi: bool = False
    poisson_limit: bool = False       # a negative binomial whose θ is infinite
    converged: bool = True            # a fit that is not raises NotConverged
    qtz: np.ndarray | None = None     # Qᵀ of the weighted working response
    passes: list[int] = field(default_factory=list)  # over the rows, per fit of an elimination

    @property
    def terms(self):
        return self.design.terms

    @property
    def df_resid(self) -> int:
        return self.n - self.design.p

    @property
    def dispersion(self) -> float:
        return self.pearson / self.df_resid if self.quasi else 1.0

    @property
    def cov(self) -> np.ndarray:
        c = np.linalg.solve(self.r, np.eye(len(self.r)))
        return c @ c.T * self.dispersion

    @property
    def aic(self) -> float:
        k = self.design.p + (1 if self.family == "negbin" else 0)
        return -2.0 * self.loglik + 2.0 * k

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Coefficient table (term, estimate, std_error, z_value, p_value); a
        quasi fit's statistics are referred to t with the residual df."""
        se = np.sqrt(np.diag(self.cov))
        tail = (lambda v: t_sf2(v, self.df_resid)) if self.quasi else norm_sf2
        rows = [(t, float(b), float(s), float(b / s), float(tail(b / s)))
                for t, b, s in zip(self.terms, self.beta, se)]
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, "
                                           "z_value double, p_value double")

    def summary(self, spark: SparkSession) -> DataFrame:
        row = [(self.family + ("-quasi" if self.quasi else ""), float(self.deviance), int(self.df_resid),
                float(self.pearson), float(self.dispersion), float(self.loglik), float(self.aic),
                float(self.theta) if self.theta is not None else None, int(self.iterations), self.poisson_limit, self.converged)]
        return spark.createDataFrame(row, "family string, deviance double, df_resid long, pearson_chi2 double, "
                                          "dispersion double, loglik double, aic double, theta double, "
                                          "iterations int, poisson_limit boolean, converged boolean")


def poisson_glm(d: Design, quasi: bool = False, tol: float = 1e-12, max_iter: int = 50, beta0: np.ndarray | None = None) -> GLMFit:
    """M4/M5: Poisson GLM; with ``quasi`` SEs are scaled by √(Pearson χ²/df)."""
    beta, R, b, ex, it = _irls(d, "poisson", None, beta0, tol, max_iter)
    return GLMFit("poisson", d, beta, R, float(ex["dev"]), float(ex["pearson"]), float(ex["ll"]),
                  int(ex["n"]), it, quasi=quasi, qtz=b)


def overdispersion(fit: GLMFit) -> dict:
    """M6: Σ deviance residual² / residual df (> 1 flags overdispersion)."""
    r = fit.deviance / fit.df_resid
    return {"deviance": fit.deviance, "df_resid": fit.df_resid, "ratio": r, "overdispersed": r > 1}


def moment_theta(d: Design, beta: np.ndarray) -> float | None:
    """Moment estimate of θ at μ = exp(Xβ) (Var = μ + μ²/θ). None where
    Σ w ((y − μ)² − y) ≤ 0: twice the slope of the likelihood in 1/θ at zero,
    so the most likely θ is infinite, the Poisson limit."""
    y, pw = F.col("_y"), F.col("_w")
    mu = F.exp(_eta(beta, d.p))
    r = d.df.agg(F.sum(pw * ((y - mu) * (y - mu) - y)).alias("num"), F.sum(pw * mu * mu).alias("den")).collect()[0]
    return float(r["den"]) / float(r["num"]) if r["num"] is not None and r["num"] > 0 else None


def theta_step(th: float, score: float, info: float) -> float:
    """θ after one Newton step on log θ, at most a factor e² away."""
    slope, bend = th * score, th * th * info - th * score
    step = slope / bend if bend > 0 else math.copysign(2.0, slope)
    return th * math.exp(min(2.0, max(-2.0, step)))


def _nb_pass(d: Design, beta: np.ndarray, th: float):
    """One pass at (β, θ): NB working triangle and right side, deviance,
    log-likelihood and θ's profile score / information."""
    var, devf = _family("negbin", th)
    y, pw = F.col("_y"), F.col("_w")
    eta = _eta(beta, d.p)
    mu = F.exp(eta)
    t = F.lit(th)
    w = pw * mu * mu / var(mu)
    z = eta + (y - mu) / mu
    return _qr(d, w, z, {
        "dev": pw * devf(mu), "ll": pw * nb_logpmf(y, mu, t),
        "pearson": pw * (y - mu) * (y - mu) / var(mu), "n": F.lit(1.0),
        "score": pw * (digamma(y + t) - digamma(t) + math.log(th) + 1.0 - F.log(t + mu) - (y + t) / (mu + t)),
        "info": pw * (-trigamma(y + t) + trigamma(t) - 1.0 / th + 2.0 / (mu + t)
                      - (y + t) / ((mu + t) * (mu + t)))})


def negbin_glm(d: Design, theta: float | None = None, tol: float = 1e-10, max_iter: int = 100,
               beta0: np.ndarray | None = None) -> GLMFit:
    """M8 (and M9 through the design's prior weights): NB2 GLM, log link.

    Starts from the Poisson fit and a moment estimate of θ, then each pass
    makes one IRLS step for β and one Newton step for log θ (profile score, as
    MASS ``theta.ml``) from the same sums — the joint fixed point is the
    ``glm.nb`` estimate, reached in a few passes instead of nested loops.
    A fixed ``theta`` skips the θ steps; ``beta0`` starts the Poisson fit. Data without more variance than a
    Poisson have no finite θ: the fit is the Poisson one, ``poisson_limit``."""
    beta, R, b, ex, total = _irls(d, "poisson", None, beta0)
    th = float(theta) if theta is not None else moment_theta(d, beta)
    if th is None:
        return GLMFit("negbin", d, beta, R, ex["dev"], ex["pearson"], ex["ll"], int(ex["n"]), total, poisson_limit=True, qtz=b)
    ll_old, done = None, False
    for _ in range(max_iter):
        R, b, ex = _nb_pass(d, beta, th)
        total += 1
        beta = np.linalg.solve(R, b)
        th_new = th if theta is not None else theta_step(th, ex["score"], ex["info"])
        done = ll_old is not None and abs(ex["ll"] - ll_old) < tol * (abs(ex["ll"]) + 1) and abs(th_new - th) < 1e-9 * th
        th, ll_old = th_new, ex["ll"]
        if done:
            break
    if not done:
        raise NotConverged(f"negative binomial fit: {max_iter} steps, θ at {th:.4g}")
    R, b, ex = _nb_pass(d, beta, th)
    th_se = 1.0 / math.sqrt(ex["info"]) if theta is None and ex["info"] > 0 else None
    return GLMFit("negbin", d, beta, R, ex["dev"], ex["pearson"], ex["ll"], int(ex["n"]), total, theta=th, theta_se=th_se, qtz=b)


def with_inverse_residual_weights(df: DataFrame, fit: GLMFit, out: str = "w_resid",
                                  floor: float = 1e-8) -> DataFrame:
    """M9: weights 1/|Pearson residual| of a fit (guarded at zero residual),
    computed on the fit's design rows (keys kept)."""
    var, _ = _family(fit.family, fit.theta)
    mu = F.exp(_eta(fit.beta, fit.design.p))
    r = (F.col("_y") - mu) / F.sqrt(var(mu))
    return fit.design.df.withColumn(out, 1.0 / F.greatest(F.abs(r), F.lit(floor)))


def refit_weighted(fit: GLMFit, weights_df: DataFrame, weight_col: str = "w_resid") -> GLMFit:
    """M9: refit the same design with prior weights."""
    d = Design(weights_df.withColumn("_w", F.col(weight_col)).drop(weight_col).persist(),
               fit.design.terms, fit.design.blocks, fit.design.keys)
    return negbin_glm(d) if fit.family == "negbin" else poisson_glm(d, quasi=fit.quasi)


def gvif_from_r(r: np.ndarray, terms: list[str], blocks: dict[str, list[int]]) -> list[tuple]:
    """GVIF per model term from the triangle of a design whose first column is the
    intercept: det(R₁₁)·det(R₂₂)/det(R) of the coefficients' correlations is the
    same for the centred columns', whose triangle is what is left of ``r`` without
    its first row and column. Determinants are products of diagonals, so nothing
    is squared or inverted."""
    keep = [i for i, t in enumerate(terms) if t != INTERCEPT]
    c = r[np.ix_(keep, keep)] if terms[0] == INTERCEPT else r
    log_det = lambda a: 2 * float(np.log(np.abs(np.diag(np.linalg.qr(c[:, a], mode="r")))).sum()) if a else 0.0
    pos = {j: k for k, j in enumerate(keep)}
    whole, out = log_det(list(range(len(keep)))), []
    for term, idx in blocks.items():
        if term == INTERCEPT or not idx:
            continue
        a = [pos[j] for j in idx]
        g = math.exp(log_det(a) + log_det([k for k in range(len(keep)) if k not in a]) - whole)
        out.append((term, g, len(a), g ** (1.0 / (2 * len(a)))))
    return out


def gvif(fit: GLMFit, spark: SparkSession) -> DataFrame:
    """GVIF table of a fitted model."""
    rows = gvif_from_r(fit.r, fit.terms, fit.design.blocks)
    return spark.createDataFrame(rows, "term string, gvif double, df int, gvif_adj double")


def design_gvif(d: Design, spark: SparkSession) -> DataFrame:
    """M10 at unit working weight: GVIF from (XᵀWX)⁻¹ with the design's prior
    weights only (for two numerics this is 1/(1−r²))."""
    R, _, _ = _qr(d, F.col("_w"), F.lit(0.0), {})
    return spark.createDataFrame(gvif_from_r(R, d.terms, d.blocks), "term string, gvif double, df int, gvif_adj double")


def without(fit: GLMFit, term: str) -> tuple[Design, np.ndarray]:
    """The design without a term, as a view of the cached rows, and the weighted
    least squares solution that the fit's triangle gives for it: no pass."""
    keep = [j for j in range(fit.design.p) if j not in fit.design.blocks[term]]
    q, r = np.linalg.qr(fit.r[:, keep])
    return fit.design.view(keep), np.linalg.solve(r, q.T @ fit.qtz)


def eliminate(df: DataFrame, y: str, numeric=(), factors=(), drop=(), max_gvif: float | None = None,
              family: str = "poisson", weight: str | None = None) -> tuple[GLMFit, list[str]]:
    """Drop the listed terms, then (with ``max_gvif``) repeatedly drop the
    term with the largest GVIF^(1/(2df)) above the bound and refit.

    One design is cached for all fits. Each later fit reads the columns that are
    left of it and starts from the solution that the triangle of the fit before
    gives without the dropped term, so it takes two or three passes (``passes``)."""
    d = design(df, y, [c for c in numeric if c not in drop], [c for c in factors if c not in drop], weight=weight)
    dropped, passes, beta0 = list(drop), [], None
    while True:
        fit = negbin_glm(d, beta0=beta0) if family == "negbin" else poisson_glm(d, beta0=beta0)
        passes.append(fit.iterations)
        fit.passes = passes
        if max_gvif is None or len(d.blocks) <= 2:
            return fit, dropped
        worst = max(gvif_from_r(fit.r, fit.terms, d.blocks), key=lambda g: g[3])
        if worst[3] <= max_gvif:
            return fit, dropped
        dropped.append(worst[0])
        d, beta0 = without(fit, worst[0])


def glm_diagnostics(fit: GLMFit, qq: bool = True) -> DataFrame:
    """Per row fitted value, response / Pearson / deviance residuals,
    leverage w·xᵀ(XᵀWX)⁻¹x (one product with R⁻¹ per Arrow batch), standardised
    residual, and Q-Q positions (R ``ppoints``) from a distributed rank."""
    d = fit.design
    var, devf = _family(fit.family, fit.theta)
    y = F.col("_y")
    eta = _eta(fit.beta, d.p)
    mu = F.exp(eta)
    w = F.col("_w") * mu * mu / var(mu)
    out = d.df.select(*d.keys, y.alias("y"), mu.alias("fitted"), ((y - mu) / F.sqrt(var(mu))).alias("pearson_resid"),
                      (F.signum(y - mu) * F.sqrt(F.greatest(devf(mu), F.lit(0.0)))).alias("deviance_resid"),
                      F.sqrt(w).alias("_s"), F.array(*d.xcols()).alias("_x"))
    turn = np.linalg.solve(fit.r, np.eye(d.p))  # leverage = ‖R⁻ᵀ x √w‖²
    kept = len(out.columns) - 2

    def lever(batches):
        for b in batches:
            s = b.column(kept).to_numpy(zero_copy_only=False)
            x = b.column(kept + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(turn))
            h = np.concatenate([((x[i:i + 8192] @ turn) ** 2).sum(axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0)]) * s * s
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(h)], names=[*b.schema.names[:kept], "leverage"])

    schema = StructType([*out.schema.fields[:kept], StructField("leverage", DoubleType())])
    out = out.mapInArrow(lever, schema)
    free = 1.0 - F.col("leverage")  # a row that its own columns fit exactly has no standardised residual
    out = out.withColumn("std_resid", F.when(free > 1e-12, F.col("deviance_resid") / F.sqrt(F.lit(fit.dispersion) * free)))
    out = out.withColumn("response_resid", F.col("y") - F.col("fitted"))
    if not qq:
        return out
    n = fit.n
    a = 3.0 / 8.0 if n <= 10 else 0.5
    ranked = dense_index(out, [F.round("std_resid", 9), *d.keys], index_col="_r")
    return ranked.withColumn("theoretical_q", norm_ppf((F.col("_r") + 1.0 - a) / (n + 1.0 - 2.0 * a))).drop("_r")
