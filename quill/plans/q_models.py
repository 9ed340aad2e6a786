"""Registered queries: count regression (M4-M12). One-factor fits have closed
forms (fitted mean = group mean), which the oracle SQL computes directly."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mathx
from ..operators import glm as M
from ..session import table
from .registry import query
from .sqlmath import normal_p, student_p, theta_ctes


def lines_per_order(spark, sf):
    """Response: number of lines of each order (0 for orders without lines)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", F.coalesce("n_lines", F.lit(0)).cast("long").alias("y"))


def lines_per_customer(spark, sf):
    """Response: number of lines bought by each customer, with its segment."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey")
    per = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(per, c.c_custkey == per.o_custkey, "left").select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.coalesce("n", F.lit(0)).cast("long").alias("y"))


SQL_Y = """y as (select o.o_orderkey, o.o_orderpriority, coalesce(n.n, 0) as y from orders o left join
  (select l_orderkey, count(*) as n from lineitem group by 1) n on n.l_orderkey = o.o_orderkey
  where o.o_orderpriority is not null),
g as (select o_orderpriority as lv, avg(y) as m, sum(y) as s, count(*) as k from y group by 1),
b as (select * from g where lv = (select min(lv) from g)),
fit as (select y.*, g.m as mu, g.k as k from y join g on g.lv = y.o_orderpriority),
st as (select sum(power(y - mu, 2) / mu) as pearson, count(*) as n, (select count(*) from g) as p,
         2 * sum(case when y > 0 then y * ln(y / mu) else 0 end - (y - mu)) as deviance,
         sum(case when y > 0 then y * ln(mu) else 0 end - mu - lgamma(y + 1)) as ll from fit)"""


def _coef_sql(scale: str, p_value) -> str:
    return f"""with {SQL_Y},
c as (select '(Intercept)' as term, ln(b.m) as est, sqrt(1 / b.s) * {scale} as se, n - p as dof from b, st
union all
select 'o_orderpriority_' || g.lv, ln(g.m / b.m), sqrt(1 / b.s + 1 / g.s) * {scale}, n - p from g, b, st where g.lv <> b.lv)
select term, round(est, 6) as estimate, round(se, 6) as std_error, round(est / se, 4) as z_value,
  round({p_value('est / se', 'dof')}, 6) as p_value from c"""


def _coef_df(fit, spark):
    c = fit.coefficients(spark)
    fit.design.free()
    return c.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
                    F.round("z_value", 4).alias("z_value"), F.round("p_value", 6).alias("p_value"))


@query("poisson_priority_coefficients", "M4", _coef_sql("1", lambda z, dof: normal_p(z)))
def poisson_priority_coefficients(spark, sf):
    d = M.design(lines_per_order(spark, sf), "y", factors=["o_orderpriority"], keys=["o_orderkey"])
    return _coef_df(M.poisson_glm(d), spark)


@query("quasipoisson_priority_coefficients", "M5", _coef_sql("sqrt(st.pearson / (st.n - st.p))", student_p))
def quasipoisson_priority_coefficients(spark, sf):
    d = M.design(lines_per_order(spark, sf), "y", factors=["o_orderpriority"], keys=["o_orderkey"])
    return _coef_df(M.poisson_glm(d, quasi=True), spark)


@query("poisson_fit_stats", "M6 M7", f"""with {SQL_Y}
select round(deviance, 4) as deviance, n - p as df_resid, round(deviance / (n - p), 8) as ratio,
       deviance / (n - p) > 1 as overdispersed, round(ll, 4) as loglik, round(-2 * ll + 2 * p, 4) as aic from st""")
def poisson_fit_stats(spark, sf):
    d = M.design(lines_per_order(spark, sf), "y", factors=["o_orderpriority"], keys=["o_orderkey"])
    fit = M.poisson_glm(d)
    od = M.overdispersion(fit)
    d.free()
    row = [(round(od["deviance"], 4), int(od["df_resid"]), round(od["ratio"], 8), bool(od["overdispersed"]),
            round(fit.loglik, 4), round(fit.aic, 4))]
    return spark.createDataFrame(row, "deviance double, df_resid long, ratio double, overdispersed boolean, "
                                      "loglik double, aic double")


@query("poisson_diagnostics", "M12", f"""with {SQL_Y}
select o_orderkey, cast(y as double) as y, round(mu, 8) as fitted, round((y - mu) / sqrt(mu), 8) as pearson_resid,
  round(sign(y - mu) * sqrt(greatest(2 * (case when y > 0 then y * ln(y / mu) else 0 end - (y - mu)), 0)), 8)
    as deviance_resid,
  round(1.0 / k, 8) as leverage,
  round(sign(y - mu) * sqrt(greatest(2 * (case when y > 0 then y * ln(y / mu) else 0 end - (y - mu)), 0))
    / sqrt(1 - 1.0 / k), 6) as std_resid
from fit""")
def poisson_diagnostics(spark, sf):
    d = M.design(lines_per_order(spark, sf), "y", factors=["o_orderpriority"], keys=["o_orderkey"])
    r = M.glm_diagnostics(M.poisson_glm(d), qq=False)
    return r.select("o_orderkey", "y", *[F.round(c, 8).alias(c) for c in
                                         ["fitted", "pearson_resid", "deviance_resid", "leverage"]],
                    F.round("std_resid", 6).alias("std_resid"))


def _ppf_sql(p: str) -> str:
    """The standard normal quantile as the operator approximates it."""
    poly = lambda cs, x: "(" * len(cs) + "0" + "".join(f" * {x} + {c!r})" for c in cs)
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    q = f"(({p}) - 0.5)"
    tail = lambda x: f"{poly(mathx._C, x)} / ({poly(mathx._D, x)} * {x} + 1)"
    return (f"(case when ({p}) < 0.02425 then {tail(low)} when ({p}) > 1 - 0.02425 then -({tail(high)}) else "
            f"{poly(mathx._A, f'({q} * {q})')} * {q} / ({poly(mathx._B, f'({q} * {q})')} * ({q} * {q}) + 1) end)")


@query("poisson_qq", "M12", f"""with {SQL_Y},
d as (select o_orderkey, sign(y - mu) * sqrt(greatest(2 * (case when y > 0 then y * ln(y / mu) else 0 end - (y - mu)), 0))
    / sqrt(1 - 1.0 / k) as std_resid from fit),
r as (select *, row_number() over (order by round(std_resid, 9), o_orderkey) as i, count(*) over () as n from d)
select o_orderkey, round(std_resid, 6) as std_resid, round({_ppf_sql('(i - 0.5) / n')}, 6) as theoretical_q from r""")
def poisson_qq(spark, sf):
    d = M.design(lines_per_order(spark, sf), "y", factors=["o_orderpriority"], keys=["o_orderkey"])
    return M.glm_diagnostics(M.poisson_glm(d), qq=True).select(
        "o_orderkey", F.round("std_resid", 6).alias("std_resid"), F.round("theoretical_q", 6).alias("theoretical_q"))


SQL_CUST = """y as (select c.c_custkey, c.c_mktsegment as lv, coalesce(n.n, 0) as y from customer c left join
  (select o.o_custkey, count(*) as n from lineitem l join orders o on o.o_orderkey = l.l_orderkey group by 1) n
  on n.o_custkey = c.c_custkey where c.c_mktsegment is not null),
g as (select lv, avg(y) as m, count(*)::double as n from y group by 1),
j as (select range as j from range(0, 2000) where range < (select max(y) from y))"""

# θ of the one-factor fit, and of its refit with weights 1 / |Pearson residual|
SQL_THETA = SQL_CUST + """,
tl as materialized (select j, count(*)::double as nj from j join y on y.y > j.j group by j),
""" + theta_ctes("th", "g", "tl") + """,
nb as materialized (select sqrt(lo * hi) as theta from th60),
info as (select (select sum(nj / ((theta + j) * (theta + j))) from tl) - (select sum(n / theta - n / (theta + m)) from g) as i from nb)"""
SQL_WEIGHTED = SQL_THETA + """,
wt as materialized (select y.lv, y.y, 1 / greatest(abs((y.y - g.m) / sqrt(g.m + g.m * g.m / theta)), 1e-8) as w
  from y join g on y.lv = g.lv, nb),
gw as materialized (select lv, sum(w * y) / sum(w) as m, sum(w) as n from wt group by 1),
tw as materialized (select j, sum(w) as nj from j join wt on wt.y > j.j group by j),
""" + theta_ctes("tv", "gw", "tw") + """,
nw as materialized (select sqrt(lo * hi) as theta from tv60)"""


def _nb_coef_sql(groups: str, fit: str) -> str:
    return f"""v as (select {groups}.*, n * m / (1 + m / theta) as i, theta from {groups}, {fit}),
b as (select * from v where lv = (select min(lv) from v)),
c as (select '(Intercept)' as term, ln(m) as est, sqrt(1 / i) as se, theta from b
  union all select 'c_mktsegment_' || v.lv, ln(v.m / b.m), sqrt(1 / b.i + 1 / v.i), v.theta from v, b where v.lv <> b.lv)"""


@query("negbin_segment_coefficients", "M8", f"""with {SQL_THETA}, {_nb_coef_sql('g', 'nb')}
select term, round(est, 6) as estimate, round(se, 6) as std_error, round({normal_p('est / se')}, 6) as p_value,
  round(theta, 5) as theta, round(1 / sqrt(i), 5) as theta_se from c, info""")
def negbin_segment_coefficients(spark, sf):
    d = M.design(lines_per_customer(spark, sf), "y", factors=["c_mktsegment"], keys=["c_custkey"])
    fit = M.negbin_glm(d)
    c = fit.coefficients(spark)
    d.free()
    return c.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
                    F.round("p_value", 6).alias("p_value"), F.round(F.lit(fit.theta), 5).alias("theta"),
                    F.round(F.lit(fit.theta_se), 5).alias("theta_se"))


@query("negbin_segment_summary", "M8 M9", f"""with {SQL_WEIGHTED}, {_nb_coef_sql('gw', 'nw')}
select term, round(est, 5) as estimate, round(se, 5) as std_error, excess <= 0 as poisson_limit,
  case when excess > 0 then round(theta, 4) end as theta
from c, (select sum(w * ((y - m) * (y - m) - y)) as excess from wt join gw using (lv))""")
def negbin_segment_summary(spark, sf):
    """Refit with the inverse absolute Pearson residuals as weights."""
    d = M.design(lines_per_customer(spark, sf), "y", factors=["c_mktsegment"], keys=["c_custkey"])
    fit = M.negbin_glm(d)
    wfit = M.refit_weighted(fit, M.with_inverse_residual_weights(fit.design.df, fit))
    c = wfit.coefficients(spark)
    wfit.design.free()
    d.free()
    return c.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"),
                    F.lit(wfit.poisson_limit).alias("poisson_limit"),
                    F.round(F.lit(wfit.theta).cast("double"), 4).alias("theta"))


@query("gvif_two_numerics", "M10", f"""with {SQL_Y.split(',' + chr(10) + 'g as')[0]},
x as (select y.y as n_lines, o.o_totalprice from y join orders o using (o_orderkey)),
r as (select corr(n_lines, o_totalprice) as r from x)
select 'o_totalprice' as term, round(1 / (1 - r * r), 6) as gvif, 1 as df, round(sqrt(1 / (1 - r * r)), 6)
  as gvif_adj from r
union all select 'n_lines', round(1 / (1 - r * r), 6), 1, round(sqrt(1 / (1 - r * r)), 6) from r""")
def gvif_two_numerics(spark, sf):
    x = lines_per_order(spark, sf).withColumnRenamed("y", "n_lines").withColumn("one", F.lit(1.0))
    d = M.design(x, "one", numeric=["o_totalprice", "n_lines"])
    g = M.design_gvif(d, spark)
    d.free()
    return g.select("term", F.round("gvif", 6).alias("gvif"), "df", F.round("gvif_adj", 6).alias("gvif_adj"))


def _irls_sql(steps: int = 12) -> str:
    """Poisson fit of y on an intercept and x1, x2: unrolled IRLS, each step a
    3 × 3 system by Cramer's rule."""
    sums = "sum(w) as a, sum(w * x1) as b, sum(w * x2) as c, sum(w * x1 * x1) as d, sum(w * x1 * x2) as e, sum(w * x2 * x2) as f, " \
           "sum(w * z) as p, sum(w * x1 * z) as q, sum(w * x2 * z) as r"
    det = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
    out = [f"s0 as materialized (select {sums} from (select x1, x2, y + 0.1 as w, ln(y + 0.1) - 0.1 / (y + 0.1) as z from x))"]
    for i in range(steps):
        out.append(f"b{i} as materialized (select (p * (d * f - e * e) - b * (q * f - r * e) + c * (q * e - r * d)) / {det} as b0, "
                   f"(a * (q * f - r * e) - p * (b * f - c * e) + c * (b * r - c * q)) / {det} as b1, "
                   f"(a * (d * r - e * q) - b * (b * r - c * q) + p * (b * e - c * d)) / {det} as b2 from s{i})")
        out.append(f"s{i + 1} as materialized (select {sums} from (select x1, x2, exp(eta) as w, eta + (y - exp(eta)) / exp(eta) as z "
                   f"from (select x.*, b0 + b1 * x1 + b2 * x2 as eta from x, b{i})))")
    return ",\n".join(out)


@query("gvif_elimination", "M10 M11", f"""with {SQL_Y.split(',' + chr(10) + 'g as')[0]},
x as materialized (select y.y, o.o_totalprice / 100000.0 as x1, ln(o.o_totalprice) - 11 as x2 from y join orders o using (o_orderkey)),
{_irls_sql()},
v as (select 1 / (1 - power(a * e - b * c, 2) / ((a * f - c * c) * (a * d - b * b))) as g from s12)
select 'price' as term, round(b1, 6) as estimate, round(g, 5) as gvif, round(sqrt(g), 5) as gvif_adj, 'o_totalprice' as dropped from v, b11
union all select 'log_price', round(b2, 6), round(g, 5), round(sqrt(g), 5), 'o_totalprice' from v, b11""")
def gvif_elimination(spark, sf):
    """A listed term is dropped, the rest refitted; inflation at the fit's weights."""
    x = lines_per_order(spark, sf).withColumn("log_price", F.log("o_totalprice") - 11).withColumn(
        "price", F.col("o_totalprice") / 100000.0)
    fit, dropped = M.eliminate(x, "y", numeric=["o_totalprice", "price", "log_price"], drop=["o_totalprice"], max_gvif=1e6)
    beta = spark.createDataFrame([(t, float(b)) for t, b in zip(fit.terms, fit.beta)], "term string, estimate double")
    g = M.gvif(fit, spark).join(beta, "term")
    fit.design.free()
    return g.select("term", F.round("estimate", 6).alias("estimate"), F.round("gvif", 5).alias("gvif"),
                    F.round("gvif_adj", 5).alias("gvif_adj"), F.lit(",".join(dropped)).alias("dropped"))


def lines_per_order_by_month(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    y = lines_per_order(spark, sf)
    return y.join(d, y.o_orderkey == d.k).drop("k")


@query("poisson_month_leverage", "M12", """with y as (select o.o_orderkey, strftime(o.o_orderdate, '%Y-%m') as month, coalesce(n.n, 0) as y
  from orders o left join (select l_orderkey, count(*) as n from lineitem group by 1) n on n.l_orderkey = o.o_orderkey),
g as (select month, avg(y) as m, count(*) as k from y group by 1)
select o_orderkey, round(m, 6) as fitted, round((y - m) / sqrt(m), 6) as pearson_resid, round(1.0 / k, 8) as leverage,
  case when k > 1 then round(sign(y - m) * sqrt(greatest(2 * (case when y > 0 then y * ln(y / m) else 0 end - (y - m)), 0))
    / sqrt(1 - 1.0 / k), 5) end as std_resid
from y join g using (month)""")
def poisson_month_leverage(spark, sf):
    """Diagnostics of a design of some 80 columns, a month each."""
    d = M.design(lines_per_order_by_month(spark, sf), "y", factors=["month"], keys=["o_orderkey"])
    r = M.glm_diagnostics(M.poisson_glm(d), qq=False)
    return r.select("o_orderkey", F.round("fitted", 6).alias("fitted"), F.round("pearson_resid", 6).alias("pearson_resid"),
                    F.round("leverage", 8).alias("leverage"), F.round("std_resid", 5).alias("std_resid"))


@query("gvif_collinear", "M10", """
with x as (select o_totalprice as price, cast(o_orderkey % 7 as double) as e from orders),
v as (select price, e, price + e as near from x),
s as (select var_pop(near) as vn, var_pop(price) as vp, var_pop(e) as ve, corr(price, e) as r, corr(near, e) as rn from v)
select 'price' as term, round(ln(vp / (ve * (1 - rn * rn))), 6) as log_gvif from s
union all select 'near', round(ln(vn / (ve * (1 - r * r))), 6) from s""")
def gvif_collinear(spark, sf):
    """Two columns correlated at 1 - 1e-10: what is left of one beside the other
    is the small number that was added."""
    x = table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"),
                                          (F.col("o_totalprice") + F.col("o_orderkey") % 7).alias("near"), F.lit(1.0).alias("one"))
    d = M.design(x, "one", numeric=["price", "near"])
    g = M.design_gvif(d, spark)
    d.free()
    return g.select("term", F.round(F.log("gvif"), 6).alias("log_gvif"))


@query("gvif_chain", "M10 M11", f"""with {SQL_Y.split(',' + chr(10) + 'g as')[0]},
x as materialized (select y.y, o.o_totalprice / 100000.0 as x1, cast(o.o_orderkey % 1000 as double) / 1000.0 as x2
  from y join orders o using (o_orderkey)),
{_irls_sql()},
v as (select 1 / (1 - power(a * e - b * c, 2) / ((a * f - c * c) * (a * d - b * b))) as g from s12)
select 'price' as term, round(b1, 6) as estimate, round(g, 6) as gvif, 'both' as dropped, true as few_passes from v, b11
union all select 'part', round(b2, 6), round(g, 6), 'both', true from v, b11""")
def gvif_chain(spark, sf):
    """Of three columns, one the sum of the others but for a trace, the sum goes;
    the second fit starts from the first and takes at most three passes."""
    x = lines_per_order(spark, sf).withColumn("price", F.col("o_totalprice") / 100000.0).withColumn(
        "part", (F.col("o_orderkey") % 1000) / 1000.0)
    x = x.withColumn("both", F.col("price") + F.col("part") + (F.col("o_orderkey") % 11) * 1e-6)
    fit, dropped = M.eliminate(x, "y", numeric=["price", "part", "both"], max_gvif=10.0)
    beta = spark.createDataFrame([(t, float(b)) for t, b in zip(fit.terms, fit.beta)], "term string, estimate double")
    g = M.gvif(fit, spark).join(beta, "term")
    fit.design.free()
    return g.select("term", F.round("estimate", 6).alias("estimate"), F.round("gvif", 6).alias("gvif"),
                    F.lit(",".join(dropped)).alias("dropped"), F.lit(all(n <= 3 for n in fit.passes[1:])).alias("few_passes"))
