"""Special functions as ``Column`` expressions plus
driver-side scalars for small result tables.

Spark SQL has no ``lgamma``/``digamma``; they are closed forms here so they
stay inside whole-stage codegen.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["lgamma", "digamma", "trigamma", "poisson_logpmf", "nb_logpmf", "norm_ppf",
           "clamp_min", "chi2_sf", "norm_sf2", "lgamma_np", "digamma_np", "trigamma_np"]

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
_SHIFT = 10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def _lgamma_pos(x: Column) -> Column:
    """x > 0: log Γ(x) = log Γ(x + 10) − Σ log(x + i); Stirling series at x + 10."""
    prod = x
    for i in range(1, _SHIFT):
        prod = prod * (x + float(i))
    z = x + float(_SHIFT)
    z2 = z * z
    st = ((z - 0.5) * F.log(z) - z + F.lit(_HALF_LOG_2PI) + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z2)
          + 1.0 / (1260.0 * z * z2 * z2) - 1.0 / (1680.0 * z * z2 * z2 * z2))
    return st - F.log(prod)


def lgamma(x) -> Column:
    """log Γ(x) for x > 0 (reflection below 0.5). ``+ 0.0`` normalises −0.0."""
    x = _c(x).cast("double")
    refl = F.log(F.lit(math.pi) / F.abs(F.sin(F.lit(math.pi) * x))) - _lgamma_pos(1.0 - x)
    return F.when(x < 0.5, refl).otherwise(_lgamma_pos(x)) + F.lit(0.0)


def digamma(x) -> Column:
    """ψ(x), x > 0: shift by 6 with the recurrence, then the asymptotic series."""
    x = _c(x).cast("double")
    acc = F.lit(0.0)
    for i in range(6):
        acc = acc - 1.0 / (x + float(i))
    z = x + 6.0
    z2 = z * z
    series = (F.log(z) - 0.5 / z - 1.0 / (12.0 * z2) + 1.0 / (120.0 * z2 * z2)
              - 1.0 / (252.0 * z2 * z2 * z2) + 1.0 / (240.0 * z2 * z2 * z2 * z2)
              - 5.0 / (660.0 * z2 * z2 * z2 * z2 * z2))
    return acc + series


def trigamma(x) -> Column:
    """ψ′(x), x > 0, same scheme."""
    x = _c(x).cast("double")
    acc = F.lit(0.0)
    for i in range(6):
        acc = acc + 1.0 / ((x + float(i)) * (x + float(i)))
    z = x + 6.0
    z2 = z * z
    series = (1.0 / z + 0.5 / z2 + 1.0 / (6.0 * z2 * z) - 1.0 / (30.0 * z2 * z2 * z)
              + 1.0 / (42.0 * z2 * z2 * z2 * z) - 1.0 / (30.0 * z2 * z2 * z2 * z2 * z))
    return acc + series


def poisson_logpmf(y, mu) -> Column:
    """log P(Y = y | μ) = y log μ − μ − log Γ(y + 1)."""
    y, mu = _c(y).cast("double"), _c(mu).cast("double")
    return F.when(y == 0, -mu).otherwise(y * F.log(mu) - mu) - lgamma(y + 1.0)


def nb_logpmf(y, mu, theta) -> Column:
    """NB2 log-density with mean μ and size θ."""
    y, mu, th = _c(y).cast("double"), _c(mu).cast("double"), _c(theta).cast("double")
    return (lgamma(y + th) - lgamma(th) - lgamma(y + 1.0) + th * F.log(th / (th + mu))
            + F.when(y == 0, F.lit(0.0)).otherwise(y * F.log(mu / (th + mu))))


def clamp_min(x, lo: float = 1e-10) -> Column:
    return F.greatest(_c(x).cast("double"), F.lit(lo))


# Rational approximation of the normal quantile (Acklam), published.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]


def _poly(cs, x: Column) -> Column:
    acc = F.lit(cs[0])
    for c in cs[1:]:
        acc = acc * x + c
    return acc


def norm_ppf(p) -> Column:
    """Standard normal quantile (relative error about 1e-9)."""
    p = _c(p).cast("double")
    plow = 0.02425
    q = F.sqrt(-2.0 * F.log(p))
    low = _poly(_C, q) / (_poly(_D, q) * q + 1.0)
    qh = F.sqrt(-2.0 * F.log(1.0 - p))
    high = -_poly(_C, qh) / (_poly(_D, qh) * qh + 1.0)
    qc = p - 0.5
    r = qc * qc
    mid = _poly(_A, r) * qc / (_poly(_B, r) * r + 1.0)
    return F.when(p < plow, low).when(p > 1 - plow, high).otherwise(mid)


# ---- driver / pandas-side scalars (small tables only) ----

def chi2_sf_one(x: float, k: int) -> float:
    """Upper tail of χ² with ``k`` (whole) degrees of freedom, h = x / 2:
    even k: e^-h Σ_{j < k/2} h^j / j!; odd k: erfc(√h) + e^-h Σ_{j < (k-1)/2}
    h^(j+1/2) / Γ(j+3/2). All terms are positive; they are summed in logs."""
    if x <= 0:
        return 1.0
    h, half = x / 2.0, k % 2 / 2.0
    terms = np.arange(k // 2) + half
    total = math.erfc(math.sqrt(h)) if k % 2 else 0.0
    return float(total + np.exp(terms * math.log(h) - h - lgamma_np(terms + 1.0)).sum()) if len(terms) else total


def chi2_sf(stat, dof):
    """Upper tail of χ²(dof); vectorised over numpy arrays / pandas Series."""
    f = np.vectorize(lambda s, k: float("nan") if (s is None or k is None or k <= 0 or s != s)
                     else chi2_sf_one(float(s), int(k)), otypes=[float])
    return f(stat, dof)


def t_sf2(t: float, dof: float) -> float:
    """Two-sided tail 2·P(T > |t|) of Student's t. With u = √dof tan φ it is
    2 Γ((dof+1)/2) / (√π Γ(dof/2)) ∫ cos(φ)^(dof-1) dφ from atan(|t|/√dof) to
    π/2, integrated by Gauss-Legendre over the part that matters."""
    at = math.atan(abs(t) / math.sqrt(dof))
    if at >= math.pi / 2:
        return 0.0
    scale = 1.0 / ((dof - 1.0) * math.tan(at) + math.sqrt(max(dof - 1.0, 1.0)))
    end = min(math.pi / 2, at + 40.0 * scale)
    node, weight = np.polynomial.legendre.leggauss(20)
    edges = np.linspace(at, end, 41)
    mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
    phi = mid[:, None] + half[:, None] * node
    area = float((half[:, None] * weight * np.exp((dof - 1.0) * np.log(np.cos(phi)))).sum())
    return min(1.0, 2.0 * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi) * area)


def norm_sf2(z: float) -> float:
    """Two-sided normal tail 2·P(Z > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2.0))


lgamma_np = np.vectorize(math.lgamma, otypes=[float])


def digamma_np(x):
    x = np.asarray(x, dtype=float)
    acc = np.zeros_like(x)
    for i in range(6):
        acc -= 1.0 / (x + i)
    z = x + 6.0
    z2 = z * z
    return acc + (np.log(z) - 0.5 / z - 1 / (12 * z2) + 1 / (120 * z2 ** 2) - 1 / (252 * z2 ** 3)
                  + 1 / (240 * z2 ** 4) - 5 / (660 * z2 ** 5))


def trigamma_np(x):
    x = np.asarray(x, dtype=float)
    acc = np.zeros_like(x)
    for i in range(6):
        acc += 1.0 / (x + i) ** 2
    z = x + 6.0
    z2 = z * z
    return acc + (1 / z + 0.5 / z2 + 1 / (6 * z2 * z) - 1 / (30 * z2 ** 2 * z) + 1 / (42 * z2 ** 3 * z)
                  - 1 / (30 * z2 ** 4 * z))
