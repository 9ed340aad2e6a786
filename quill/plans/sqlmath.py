"""DuckDB SQL fragments for the oracles: tails of distributions, θ of a
negative binomial by bisection. They use no arithmetic of the operators."""
from __future__ import annotations


def simpson(f: str, lo: str, width: float, steps: int = 400) -> str:
    """∫ f(x) dx from ``lo`` over ``width``; ``f`` has ``x``."""
    h = width / steps
    coef = f"(case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end)"
    return f"(select sum({coef} * ({f})) * {h} / 3 from (select i, {lo} + i * {h} as x from range(0, {steps + 1}) t(i)))"


def normal_p(z: str) -> str:
    """Two-sided normal tail."""
    return f"(2 / sqrt(2 * pi()) * {simpson('exp(-0.5 * x * x)', f'abs({z})', 10.0)})"


def student_p(t: str, dof: str) -> str:
    """Two-sided tail of Student's t, for many degrees of freedom."""
    density = f"exp(-(({dof}) + 1) / 2.0 * ln(1 + x * x / ({dof})))"
    return (f"(2 * exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(({dof}) * pi()) "
            f"* {simpson(density, f'abs({t})', 12.0)})")


def chi2_p(x: str, k: str) -> str:
    """Upper χ² tail for a whole number of degrees of freedom."""
    half = f"(({k}) % 2) / 2.0"
    terms = (f"coalesce((select sum(exp((j + {half}) * ln(({x}) / 2) - ({x}) / 2 - lgamma(j + {half} + 1))) "
             f"from range(0, cast(floor(({k}) / 2) as bigint)) r(j)), 0)")
    return f"(case when ({x}) <= 0 then 1 else (case when ({k}) % 2 = 1 then {normal_p(f'sqrt({x})')} else 0 end) + {terms} end)"


def theta_ctes(name: str, groups: str, tails: str, steps: int = 60, by: str | None = None) -> str:
    """CTEs ``name0 … name{steps}`` (lo, hi) that bisect θ of a one-factor
    negative binomial: its score is Σ_j N(y > j) / (θ + j) + Σ n ln(θ / (θ + m))
    over ``groups`` (n, m) and ``tails`` (j, nj). ``by``: a θ for each value."""
    key, where = (f"{by}, ", lambda t, b: f" where {t}.{by} = {b}.{by}") if by else ("", lambda t, b: "")
    first = f"select distinct {by}, 1e-4 as lo, 1e6 as hi from {groups}" if by else "select 1e-4 as lo, 1e6 as hi"
    out = [f"{name}0 as ({first})"]
    for i in range(steps):
        score = (f"(select sum(nj / (sqrt(b.lo * b.hi) + j)) from {tails} t{where('t', 'b')}) "
                 f"+ (select sum(n * ln(sqrt(b.lo * b.hi) / (sqrt(b.lo * b.hi) + m))) from {groups} g{where('g', 'b')})")
        out.append(f"{name}{i + 1} as materialized (select {key}case when s > 0 then sqrt(lo * hi) else lo end as lo, "
                   f"case when s > 0 then hi else sqrt(lo * hi) end as hi from (select b.*, {score} as s from {name}{i} b))")
    return ",\n".join(out)
