"""Registered queries: Bayesian re-aim (M18-M23, W4) and the neural regressor
(M24-M30)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bayes as B
from ..operators import draws as D
from ..operators import features as FE
from ..operators import glm as M
from ..operators import mlp as N
from ..operators import windows as W
from ..session import table
from .q_models import SQL_CUST, SQL_Y, _ppf_sql, lines_per_customer, lines_per_order
from .registry import query
from .sqlmath import theta_ctes

FLAT = B.Priors(intercept_mean=0.0, intercept_sd=1e8, coef_sd=1e8, autoscale=False)


@query("bayes_poisson_flat_mode", "M18", f"""with {SQL_Y}
select '(Intercept)' as term, round(ln(b.m), 6) as estimate from b
union all select 'o_orderpriority_' || g.lv, round(ln(g.m / b.m), 6) from g, b where g.lv <> b.lv""")
def bayes_poisson_flat_mode(spark, sf):
    """With (practically) flat priors the posterior mode is the Poisson MLE."""
    d = M.design(lines_per_order(spark, sf), "y", factors=["o_orderpriority"], keys=["o_orderkey"])
    post = B.bayes_glm(d, "poisson", FLAT)
    d.free()
    return spark.createDataFrame([(t, round(float(b), 6)) for t, b in zip(post.terms, post.mode)],
                                 "term string, estimate double")


def _customer_post(spark, sf, priors=None):
    """Lines per customer: one mean, negative binomial, informative priors."""
    return B.bayes_glm(M.design(lines_per_customer(spark, sf), "y", keys=["c_custkey"]), "negbin", priors or B.Priors())


def _mode_sql(m0: float, s0: float, score: str, info: str, steps: int = 40) -> str:
    """Posterior mode (b, th) of a one-mean negative binomial by unrolled
    Newton steps; ``score`` and ``info`` are the prior's terms in θ."""
    out = ["yc as materialized (select coalesce(n.n, 0) as y from customer c left join (select o.o_custkey, count(*) as n from lineitem l "
           "join orders o on o.o_orderkey = l.l_orderkey group by 1) n on n.o_custkey = c.c_custkey)",
           "k as materialized (select count(*)::double as n, avg(y) as m, var_pop(y) as v from yc)",
           "tl as materialized (select j, count(*)::double as nj from range(0, 2000) r(j) join yc on yc.y > j group by j)",
           "s0 as materialized (select ln(m) as b, m * m / (v - m) as th from k)"]
    for i in range(steps):
        sums = (f"(select sum(nj / (th + j)) from tl) + n * ln(th / (th + mu)) + n - n * (m + th) / (mu + th) + {score} as sc, "
                f"(select sum(nj / ((th + j) * (th + j))) from tl) - n / th + 2 * n / (mu + th) - n * (m + th) / ((mu + th) * (mu + th)) + {info} as inf")
        out.append(f"s{i + 1} as materialized (select (w * (b + (m - mu) / mu) + {m0} / {s0 * s0}) / (w + 1 / {s0 * s0}) as b, "
                   f"th * exp(least(2, greatest(-2, th * sc / (th * th * inf - th * sc)))) as th from "
                   f"(select b, th, m, mu, n * mu * th / (mu + th) as w, {sums} from (select *, exp(b) as mu from s{i}, k)))")
    out.append(f"mode as materialized (select b, th, 1 / sqrt(n * mu * th / (mu + th) + 1 / {s0 * s0}) as sd, 1 / (th * sqrt(inf)) as lsd, n, mu from "
               f"(select b, th, n, mu, (select sum(nj / ((th + j) * (th + j))) from tl) - n / th + 2 * n / (mu + th) "
               f"- n * (m + th) / ((mu + th) * (mu + th)) + {info} as inf from (select *, exp(b) as mu from s{steps}, k)))")
    return ",\n".join(out)


SQL_POST = """
select '(Intercept)' as param, round(b, 5) as mode, round(sd, 5) as sd, round(b - 1.959963984540054 * sd, 5) as q2_5,
  round(b, 5) as q50, round(b + 1.959963984540054 * sd, 5) as q97_5 from mode
union all select 'reciprocal_dispersion', round(th, 5), round(th * lsd, 5), round(th * exp(-1.959963984540054 * lsd), 5),
  round(th, 5), round(th * exp(1.959963984540054 * lsd), 5) from mode"""


def _post_out(post):
    t = B.posterior_table(post)
    post.design.free()
    return t.select("param", *[F.round(c, 5).alias(c) for c in t.columns[1:]])


@query("bayes_negbin_posterior", "M18 M19", f"with {_mode_sql(4.0, 4.0, '(-1)', '0')} {SQL_POST}")
def bayes_negbin_posterior(spark, sf):
    return _post_out(_customer_post(spark, sf))


@query("bayes_negbin_gamma_prior", "M18 M19", f"with {_mode_sql(4.0, 4.0, '(12 / th - 3)', '12 / (th * th)')} {SQL_POST}")
def bayes_negbin_gamma_prior(spark, sf):
    return _post_out(_customer_post(spark, sf, B.Priors(autoscale=False, aux="gamma", aux_a=13, aux_b=3)))


def event_draws(spark, sf):
    """Events read as sampler output: chain = event type, iteration = position
    in time within the type, two parameters (value and its log)."""
    e = table(spark, sf, "events")
    idx = W.dense_index(e, ["ts", "event_id"], partition_cols=["event_type"], index_col="iter")
    return idx.select(F.col("event_type").alias("chain"), "iter", F.inline(F.array(
        F.struct(F.lit("value").alias("param"), F.col("value").alias("value")),
        F.struct(F.lit("log_value").alias("param"), F.log1p(F.col("value")).alias("value")))))


@query("event_draws_summary", "M19", """
with d as (select event_type as chain, 'value' as param, value from events
           union all select event_type, 'log_value', ln(1 + value) from events),
ch as (select param, chain, avg(value) as cm, var_samp(value) as cv, count(*) as cn from d group by all),
rh as (select param, sqrt(((avg(cn) - 1) / avg(cn) * avg(cv) + var_samp(cm)) / avg(cv)) as rhat from ch
       group by param),
b as (select param, avg(value) as mean, stddev_samp(value) as sd,
        quantile_cont(value, 0.025) as q2_5, quantile_cont(value, 0.5) as q50,
        quantile_cont(value, 0.975) as q97_5 from d group by param)
select b.param, round(mean, 8) as mean, round(sd, 8) as sd, round(q2_5, 8) as q2_5, round(q50, 8) as q50,
       round(q97_5, 8) as q97_5, round(rhat, 8) as rhat from b join rh using (param)""")
def event_draws_summary(spark, sf):
    s = B.summarise_draws(event_draws(spark, sf), ess=False)
    return s.select("param", *[F.round(c, 8).alias(c) for c in ["mean", "sd", "q2_5", "q50", "q97_5", "rhat"]])


SQL_DRAWS = """d as materialized (select event_type as chain, row_number() over (partition by event_type order by ts, event_id) - 1 as i,
    unnest([{'param': 'value', 'value': value}, {'param': 'log_value', 'value': ln(1 + value)}], recursive := true) from events)"""


@query("event_draws_ess", "M19 W4", f"""with {SQL_DRAWS},
m as (select param, chain, avg(value) as m, var_samp(value) as v, count(*)::double as n from d group by all),
c as materialized (select param, chain, i, value - m as x from d join m using (param, chain)),
r as (select a.param, a.chain, l as lag, sum(a.x * b.x) / any_value(q) as r from range(0, 41) g(l), c a join c b
  on a.param = b.param and a.chain = b.chain and b.i = a.i + g.l
  join (select param, chain, sum(x * x) as q from c group by all) z on z.param = a.param and z.chain = a.chain group by all),
rho as (select param, lag, avg(r) as rho from r group by all),
pairs as (select a.param, a.lag, a.rho + b.rho as s from rho a join rho b on a.param = b.param and b.lag = a.lag + 1 where a.lag % 2 = 1),
stop as (select param, min(lag) as at from pairs where s < 0 group by 1),
tau as (select s.param, 1 + 2 * coalesce(sum(p.s), 0) as tau from stop s left join pairs p on p.param = s.param and p.lag < s.at group by s.param)
select param, round(any_value(k.m) * any_value(k.n) / any_value(tau), 5) as ess, round(any_value(sqrt(((k.n - 1) / k.n * w + bv) / w)), 6) as rhat
from tau join (select param, count(*) as m, avg(n) as n, avg(v) as w, var_samp(m) as bv from m group by param) k using (param) group by param""")
def event_draws_ess(spark, sf):
    s = B.summarise_draws(event_draws(spark, sf), max_lag=4)
    return s.select("param", F.round("ess", 5).alias("ess"), F.round("rhat", 6).alias("rhat"))


@query("prior_predictive_draws", "M20", """
with l as (select distinct c_mktsegment as lv from customer where c_mktsegment is not null),
x as (select stddev_samp(c_acctbal) as s from customer where c_mktsegment is not null and c_acctbal is not null),
f as (select lv, stddev_samp(case when c.c_mktsegment = lv then 1.0 else 0 end) as s from l, customer c
      where c.c_mktsegment is not null and c.c_acctbal is not null and lv <> (select min(lv) from l) group by lv)
select '(Intercept)' as param, 'normal' as dist, 4.0::double as a, 4.0::double as b
union all select 'c_acctbal', 'normal', 0.0::double, round(16 / s, 8) from x
union all select 'c_mktsegment_' || lv, 'normal', 0.0::double, round(16 / s, 8) from f
union all select 'reciprocal_dispersion', 'exponential', 1.0::double, 1.0::double""")
def prior_predictive_draws(spark, sf):
    """The priors in use after scaling to the predictors."""
    d = M.design(lines_per_customer(spark, sf), "y", numeric=["c_acctbal"], factors=["c_mktsegment"], keys=["c_custkey"])
    t = B.prior_table(spark, d, B.Priors(), family="negbin")
    d.free()
    return t.select("param", "dist", "a", F.round("b", 8).alias("b"))


@query("posterior_predictive_hist", "M21 G15", f"""with {_mode_sql(4.0, 4.0, '(-1)', '0')},
p as (select k, exp(lgamma(k + th) - lgamma(th) - lgamma(k + 1) + th * ln(th / (th + mu)) + k * ln(mu / (th + mu))) as p, n from range(0, 201) r(k), mode),
e as (select greatest(cast(ceil(k / 10.0) as bigint), 1) as bin, sum(p) * any_value(n) as expected from p group by 1),
o as (select case when y <= 200 then greatest(cast(ceil(y / 10.0) as bigint), 1) end as bin, count(*) as observed from yc group by 1)
select b.bin, (b.bin - 1) * 10.0::double as lo, b.bin * 10.0::double as hi, cast(coalesce(observed, 0) as bigint) as observed,
  round(expected, 4) as expected from range(1, 21) b(bin) join e using (bin) left join o using (bin)
union all select null, null, null, cast(coalesce((select observed from o where bin is null), 0) as bigint),
  round((select n from mode) - (select sum(expected) from e), 4)""")
def posterior_predictive_hist(spark, sf):
    """Observed counts per bin beside those the fitted model expects."""
    post = _customer_post(spark, sf)
    t = B.expected_counts(post, 0.0, 200.0, 10.0)
    post.design.free()
    return t.withColumn("expected", F.round("expected", 4))


def _u_sql(name: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'7:{name}'", *[f"coalesce(cast({k} as varchar), '')" for k in keys]])
    return f"((('0x' || substr(md5({text}), 1, 13))::bigint + 0.5) / 4503599627370496.0)"


@query("prior_draws", "M20", f"""
with l as (select distinct c_mktsegment as lv from customer where c_mktsegment is not null),
x as (select stddev_samp(c_acctbal) as s from customer where c_mktsegment is not null and c_acctbal is not null),
f as (select lv, stddev_samp(case when c.c_mktsegment = lv then 1.0 else 0 end) as s from l, customer c
      where c.c_mktsegment is not null and c.c_acctbal is not null and lv <> (select min(lv) from l) group by lv),
pr as (select '(Intercept)' as param, 4.0 as a, 4.0 as b union all select 'c_acctbal', 0.0, 16 / s from x
  union all select 'c_mktsegment_' || lv, 0.0, 16 / s from f),
u as materialized (select param, a, b, draw, {_u_sql("' || param || '", "draw")} as u from pr, range(0, 400) r(draw))
select param, draw, round(a + b * {_ppf_sql('u')}, 6) as value from u
union all select 'reciprocal_dispersion', draw, round(-ln({_u_sql('reciprocal_dispersion', 'draw')}), 6) from range(0, 400) r(draw)""")
def prior_draws(spark, sf):
    """Draws of every parameter from its prior, scaled to the customers' columns."""
    d = M.design(lines_per_customer(spark, sf), "y", numeric=["c_acctbal"], factors=["c_mktsegment"], keys=["c_custkey"])
    t = D.prior_draws(spark, d, B.Priors(), family="negbin", n=400, seed=7)
    d.free()
    return t.withColumn("value", F.round("value", 6))


def _posterior_draw_sql(n: int) -> str:
    return f"""{_mode_sql(4.0, 4.0, '(-1)', '0')},
u as materialized (select draw, {_u_sql('(Intercept)', 'draw')} as ub, {_u_sql('reciprocal_dispersion', 'draw')} as ut from range(0, {n}) r(draw)),
dr as materialized (select draw, b + sd * {_ppf_sql('ub')} as beta, th * exp(lsd * {_ppf_sql('ut')}) as theta from u, mode)"""


@query("posterior_draws", "M19 M22", f"""with {_posterior_draw_sql(400)}
select '(Intercept)' as param, draw % 4 as chain, draw // 4 as iter, round(beta, 5) as value from dr
union all select 'reciprocal_dispersion', draw % 4, draw // 4, round(theta, 5) from dr""")
def posterior_draws(spark, sf):
    """Draws of the customers' model from the Gaussian at its mode, in four chains."""
    post = _customer_post(spark, sf)
    post.design.free()
    return D.posterior_draws(post, 400, seed=7).select("param", "chain", "iter", F.round("value", 5).alias("value"))


@query("posterior_draws_summary", "M19 M22", f"""with {_posterior_draw_sql(400)},
d as (select '(Intercept)' as param, draw % 4 as chain, beta as value from dr
  union all select 'reciprocal_dispersion', draw % 4, theta from dr),
ch as (select param, chain, avg(value) as cm, var_samp(value) as cv, count(*) as cn from d group by all),
rh as (select param, sqrt(((avg(cn) - 1) / avg(cn) * avg(cv) + var_samp(cm)) / avg(cv)) as rhat from ch group by param)
select param, round(avg(value), 5) as mean, round(stddev_samp(value), 5) as sd, round(quantile_cont(value, 0.025), 5) as q2_5,
  round(quantile_cont(value, 0.5), 5) as q50, round(quantile_cont(value, 0.975), 5) as q97_5, round(any_value(rhat), 5) as rhat
from d join rh using (param) group by param""")
def posterior_draws_summary(spark, sf):
    """The summary table over draws of the engine's own."""
    post = _customer_post(spark, sf)
    post.design.free()
    s = B.summarise_draws(D.posterior_draws(post, 400, seed=7), ess=False)
    return s.select("param", *[F.round(c, 5).alias(c) for c in ["mean", "sd", "q2_5", "q50", "q97_5", "rhat"]])


@query("posterior_predictive_draws", "M21 G15", f"""with {_posterior_draw_sql(8)},
pm as materialized (select draw, k, exp(lgamma(k + theta) - lgamma(theta) - lgamma(k + 1) + theta * ln(theta / (theta + exp(beta)))
  + k * ln(exp(beta) / (theta + exp(beta)))) as p from dr, range(0, 3000) r(k)),
cdf as materialized (select draw, k, sum(p) over (partition by draw order by k) as c from pm),
cu as (select c_custkey, draw, {_u_sql('row', 'draw', 'c_custkey')} as u from customer, dr),
re as (select cu.draw, cdf.k as y from cu asof join cdf on cu.draw = cdf.draw and cdf.c >= cu.u),
al as (select draw, cast(y as double) as y from re union all select -1, cast(y as double) from yc),
bn as (select draw, case when y <= 200 then greatest(cast(ceil(y / 10.0) as bigint), 1) end as bin, count(*) as n from al group by all)
select g.draw, g.bin, coalesce(bn.n, 0) as n from (select draw, bin from (select unnest(range(-1, 8)) as draw), (select unnest(range(1, 21)) as bin
  union all select null)) g left join bn on bn.draw = g.draw and bn.bin is not distinct from g.bin""")
def posterior_predictive_draws(spark, sf):
    """Lines per customer drawn anew under eight draws of the parameters, beside
    those observed (draw -1)."""
    post = _customer_post(spark, sf)
    t = D.predictive_counts(post, 0.0, 200.0, 10.0, draws=8, seed=7)
    post.design.free()
    return t


@query("trace_and_density", "M22", f"""with {SQL_DRAWS},
s as (select param, chain, count(*)::double as n, stddev_samp(value) * pow(count(*), -0.2) as bw, min(value) as lo, max(value) as hi from d group by all),
g as (select *, lo - 3 * bw + point * (hi - lo + 6 * bw) / 63 as x from s, range(0, 64) r(point))
select g.param, g.chain, point, round(any_value(x), 8) as x,
  round(sum(exp(-0.5 * pow((x - value) / bw, 2))) / any_value(n * bw * sqrt(2 * pi())), 8) as density
from g join d on d.param = g.param and d.chain = g.chain group by g.param, g.chain, point""")
def trace_and_density(spark, sf):
    k = B.density_by_chain(event_draws(spark, sf), num=64)
    w = Window.partitionBy("param", "chain").orderBy("x")  # 64 points each
    return k.select("param", "chain", (F.row_number().over(w) - 1).cast("long").alias("point"),
                    F.round("x", 8).alias("x"), F.round("density", 8).alias("density"))


TWO = "case when c_mktsegment < 'D' then 'low' else 'rest' end"


@query("nb_varying_shape", "M23", f"""with {SQL_CUST.replace('c.c_mktsegment as lv', TWO + ' as lv')},
tl as materialized (select lv, j, count(*)::double as nj from j join y on y.y > j.j group by all),
{theta_ctes('th', 'g', 'tl', by='lv')},
f as (select g.lv, m, n, sqrt(lo * hi) as t from g join th60 using (lv)),
v as (select f.*, n * t * m / (t + m) as im, t * t * ((select sum(nj / ((t + j) * (t + j))) from tl where tl.lv = f.lv) - n / t + n / (t + m)) as it from f),
b as (select * from v where lv = (select min(lv) from v))
select 'mu:(Intercept)' as param, round(ln(m), 5) as mode, round(1 / sqrt(im), 5) as sd from b
union all select 'mu:half_' || v.lv, round(ln(v.m / b.m), 5), round(sqrt(1 / b.im + 1 / v.im), 5) from v, b where v.lv <> b.lv
union all select 'shape:(Intercept)', round(ln(t), 4), round(1 / sqrt(it), 4) from b
union all select 'shape:half_' || v.lv, round(ln(v.t / b.t), 4), round(sqrt(1 / b.it + 1 / v.it), 4) from v, b where v.lv <> b.lv""")
def nb_varying_shape(spark, sf):
    """A factor in the mean and in the shape, practically flat priors."""
    x = lines_per_customer(spark, sf).where("c_mktsegment IS NOT NULL").withColumn("half", F.expr(TWO))
    d = M.design(x, "y", factors=["half"], keys=["c_custkey"])
    beta, gamma, cov = B.nb_shape_regression(d, [f"_x{i}" for i in range(1, d.p)], FLAT, shape_sd=1e8, tol=1e-12)
    d.free()
    rows = [(f"mu:{t}", round(float(v), 5), round(float(s), 5)) for t, v, s in zip(d.terms, beta, cov.diagonal()[:d.p] ** 0.5)]
    rows += [(f"shape:{t}", round(float(v), 4), round(float(s), 4)) for t, v, s in zip(d.terms, gamma, cov.diagonal()[d.p:] ** 0.5)]
    return spark.createDataFrame(rows, "param string, mode double, sd double")


SQL_GROUP_FIT = """y as (select o.o_orderkey, o.o_orderpriority, cast(coalesce(n.n, 0) as double) as y from orders o
  left join (select l_orderkey, count(*) as n from lineitem group by 1) n on n.l_orderkey = o.o_orderkey),
g as (select o_orderpriority, avg(y) as m, var_samp(y) as v from y group by 1),
f as (select y.o_orderkey, y.y, g.m, g.v from y join g using (o_orderpriority))"""


def _group_fit(spark, sf):
    y = lines_per_order(spark, sf).withColumn("y", F.col("y").cast("double"))
    g = y.groupBy("o_orderpriority").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    return y.join(g, "o_orderpriority", "left")


SQL_CUST_FIT = """y as (select c.c_custkey, c.c_mktsegment, cast(coalesce(n.n, 0) as double) as y from customer c
  left join (select o.o_custkey, count(*) as n from lineitem l join orders o on o.o_orderkey = l.l_orderkey
  group by 1) n on n.o_custkey = c.c_custkey),
g as (select c_mktsegment, avg(y) as m, var_samp(y) as v from y group by 1),
f as (select y.c_custkey, y.y, g.m, g.v from y join g using (c_mktsegment))"""


@query("nb_loss_group_means", "M24 M27", f"""with {SQL_CUST_FIT},
c as (select y, greatest(m, 1e-10) as mm, greatest(v, greatest(m, 1e-10) + 1e-10) as vv from f),
r as (select y, mm, vv, mm * mm / greatest(vv - mm, 1e-10) as r from c)
select round(-avg(lgamma(y + r) - lgamma(y + 1) - lgamma(r) + r * ln(mm / vv)
       + case when y = 0 then 0 else y * ln(1 - mm / vv) end), 6) as nb_loss from r""")
def nb_loss_group_means(spark, sf):
    """NB loss of per-segment mean/variance predictions of lines per customer."""
    y = lines_per_customer(spark, sf).withColumn("y", F.col("y").cast("double"))
    g = y.groupBy("c_mktsegment").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    f = y.join(g, "c_mktsegment", "left")
    return N.nb_nll(f, "y", "m", "v").select(F.round("nb_loss", 6).alias("nb_loss"))


@query("mse_group_means", "M27", f"""with {SQL_GROUP_FIT}
select round(avg(power(y - m, 2)), 8) as mse from f""")
def mse_group_means(spark, sf):
    return N.mse(_group_fit(spark, sf), "y", "m").select(F.round("mse", 8).alias("mse"))


@query("pred_vs_actual_head", "M28 S1", f"""with {SQL_GROUP_FIT}
select o_orderkey, y as actual, round(m, 8) as prediction from f order by o_orderkey limit 10""")
def pred_vs_actual_head(spark, sf):
    r = N.pred_vs_actual(_group_fit(spark, sf), "y", "m", 10, "o_orderkey")
    return r.withColumn("prediction", F.round("prediction", 8))


def embedding_frame(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.select(F.size("embedding").alias("n")).where("n > 0").first()["n"]
    return e.select("vec_id", F.col("label").cast("double").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


# literal weights of a network with two inputs, two hidden units, one output
W1, B1, W2, B2 = [[0.3, -0.2], [0.5, 0.4]], [0.1, 0.05], [[0.7], [-0.6]], [0.2]
RATE = 0.01


def _net_sql(src: str, w: str) -> str:
    """Rows of ``src`` (x0, x1, y) through the network whose weights are in ``w``."""
    return (f"(select *, ln(1 + exp(a2)) as o from (select *, greatest(a0, 0) * v0 + greatest(a1, 0) * v1 + c as a2 from "
            f"(select s.*, w.*, x0 * w00 + x1 * w10 + b0 as a0, x0 * w01 + x1 * w11 + b1 as a1 from {src} s, {w} w)))")


_W0 = (f"{W1[0][0]} as w00, {W1[0][1]} as w01, {W1[1][0]} as w10, {W1[1][1]} as w11, {B1[0]} as b0, {B1[1]} as b1, "
       f"{W2[0][0]} as v0, {W2[1][0]} as v1, {B2[0]} as c")
SQL_EMB = f"""e as (select vec_id, label::double as y, embedding[1]::double as e0, embedding[2]::double as e1,
    row_number() over (order by md5('123' || cast(vec_id as varchar)), vec_id) <= ceil(0.2 * count(*) over ()) as val from embeddings),
sc as (select avg(e0) as m0, stddev_pop(e0) as s0, avg(e1) as m1, stddev_pop(e1) as s1 from e where not val),
x as materialized (select vec_id, y, val, (e0 - m0) / s0 as x0, (e1 - m1) / s1 as x1 from e, sc),
w0 as (select {_W0})"""
_GRADS = {"w00": "d * v0 * (a0 > 0)::int * x0", "w01": "d * v1 * (a1 > 0)::int * x0", "w10": "d * v0 * (a0 > 0)::int * x1",
          "w11": "d * v1 * (a1 > 0)::int * x1", "b0": "d * v0 * (a0 > 0)::int", "b1": "d * v1 * (a1 > 0)::int",
          "v0": "d * greatest(a0, 0)", "v1": "d * greatest(a1, 0)", "c": "d"}
SQL_STEP = SQL_EMB + f""",
n0 as materialized (select *, 2 * (o - y) / (1 + exp(-a2)) as d from {_net_sql('x', 'w0')}),
g as (select {', '.join(f'avg({e}) as {k}' for k, e in _GRADS.items())} from n0 where not val),
w1 as (select {', '.join(f'w0.{k} - {RATE} * g.{k} / (abs(g.{k}) + 1e-7) as {k}' for k in _GRADS)} from w0, g),
n1 as materialized (select * from {_net_sql('x', 'w1')})"""


def _literal_net():
    return [np.array(W1), np.array(B1), np.array(W2), np.array(B2)]


@query("mlp_history_mse", "M25 M29 F8 F9", f"""with {SQL_STEP}
select 1 as epoch, round(avg(power(o - y, 2)) filter (where not val), 6) as loss, round(avg(power(o - y, 2)) filter (where val), 6) as val_loss from n0
union all select 2, round(avg(power(o - y, 2)) filter (where not val), 6), round(avg(power(o - y, 2)) filter (where val), 6) from n1""")
def mlp_history_mse(spark, sf):
    """Two full-batch epochs from literal weights: the second shows the step."""
    m = N.mlp_fit(embedding_frame(spark, sf).select("vec_id", "label", "e0", "e1"), "label", ["e0", "e1"], loss="mse", hidden=2,
                  epochs=2, lr=RATE, seed=123, key="vec_id", init=_literal_net())
    return N.history_df(spark, m).select("epoch", F.round("loss", 6).alias("loss"), F.round("val_loss", 6).alias("val_loss"))


@query("mlp_predictions", "M26 M28", f"""with {SQL_EMB}
select vec_id, y as actual, round(o, 6) as prediction from {_net_sql('x', 'w0')}""")
def mlp_predictions(spark, sf):
    """All rows scored by the network with the literal weights."""
    x = embedding_frame(spark, sf).select("vec_id", "label", "e0", "e1")
    train = FE.split(x, "vec_id", 0.2, seed=123).where("NOT is_test")
    net = N.MLP(*_literal_net(), loss="mse", features=["e0", "e1"], scaler=FE.fit_scaler(train, ["e0", "e1"], population=True))
    return N.mlp_predict(net, x).select("vec_id", F.col("label").alias("actual"), F.round("pred", 6).alias("prediction"))


@query("mlp_early_stop", "M30", """
with h as (select cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) + 1 as epoch, avg(value) as val_loss from events group by 1),
b as (select *, min(val_loss) over (order by epoch rows between unbounded preceding and 1 preceding) as best from h),
i as (select *, best is null or val_loss < best - 0.05 as better from b),
w as (select *, epoch - max(case when better then epoch end) over (order by epoch) as wait from i)
select epoch, round(val_loss, 8) as val_loss, wait = 0 as improved, cast(wait as integer) as wait,
  epoch = (select min(epoch) from w where wait >= 4) as stops from w""")
def mlp_early_stop(spark, sf):
    """Early stopping on a given history: the daily means of the events."""
    h = table(spark, sf, "events").groupBy((F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("epoch")).agg(
        F.avg("value").alias("val_loss"))
    s = N.early_stopping(h, patience=4, min_delta=0.05)
    return s.select("epoch", F.round("val_loss", 8).alias("val_loss"), "improved", "wait", "stops")


STOP_RATE, STOP_EPOCHS, STOP_PATIENCE, STOP_DELTA = 0.5, 10, 2, 0.02


def _sql_training(epochs: int, rate: float) -> str:
    """Full-batch Adam from the literal weights, unrolled: n{k} the rows through
    the weights after k epochs."""
    ks = list(_GRADS)
    out = [SQL_EMB, f"s0 as (select *, {', '.join(f'0.0::double as m_{k}, 0.0::double as q_{k}' for k in ks)} from w0)"]
    for t in range(epochs + 1):
        out.append(f"n{t} as materialized (select *, 2 * (o - y) / (1 + exp(-a2)) as d from {_net_sql('x', f's{t}')})")
        if t < epochs:
            out.append(f"g{t} as (select {', '.join(f'avg({e}) as {k}' for k, e in _GRADS.items())} from n{t} where not val)")
            out.append(f"u{t} as (select {', '.join(f's.{k}, 0.9 * s.m_{k} + 0.1 * g.{k} as m_{k}, 0.999 * s.q_{k} + 0.001 * g.{k} * g.{k} as q_{k}' for k in ks)}"
                       f" from s{t} s, g{t} g)")
            step = lambda k, t=t: (f"{k} - {rate} * (m_{k} / (1 - power(0.9, {t + 1}))) / (sqrt(q_{k} / (1 - power(0.999, {t + 1}))) + 1e-7) as {k}")
            out.append(f"s{t + 1} as materialized (select {', '.join(f'{step(k)}, m_{k}, q_{k}' for k in ks)} from u{t})")
    return ",\n".join(out)


@query("mlp_patience", "M25 M29 M30", f"""with {_sql_training(STOP_EPOCHS, STOP_RATE)},
h as ({' union all '.join(f"select {t} as epoch, avg(power(o - y, 2)) filter (where not val) as loss, avg(power(o - y, 2)) filter (where val) as val_loss from n{t}" for t in range(1, STOP_EPOCHS + 1))}),
b as (with recursive best as (
    select epoch, val_loss as best, epoch as kept from h where epoch = 1
    union all select h.epoch, case when h.val_loss < b.best - {STOP_DELTA} then h.val_loss else b.best end,
      case when h.val_loss < b.best - {STOP_DELTA} then h.epoch else b.kept end from best b join h on h.epoch = b.epoch + 1)
  select * from best),
f as (select coalesce(min(epoch), {STOP_EPOCHS}) as last from b where epoch - kept >= {STOP_PATIENCE})
select h.epoch, round(h.loss, 6) as loss, round(h.val_loss, 6) as val_loss, h.epoch = (select kept from b, f where b.epoch = f.last) as restored,
  h.epoch = f.last and b.epoch - b.kept >= {STOP_PATIENCE} as stopped,
  round((select hh.val_loss from h hh where hh.epoch = (select kept from b, f where b.epoch = f.last)), 6) as kept_val_loss
from h join b using (epoch), f where h.epoch <= f.last""")
def mlp_patience(spark, sf):
    """Epochs of one group and one batch from the literal weights, until patience
    ends the fit; the loss of the weights that it gives back."""
    x = embedding_frame(spark, sf).select("vec_id", "label", "e0", "e1")
    m = N.mlp_fit_local(x, "label", ["e0", "e1"], "vec_id", loss="mse", hidden=2, epochs=STOP_EPOCHS, batch=None, lr=STOP_RATE,
                        local_epochs=1, groups=1, patience=STOP_PATIENCE, min_delta=STOP_DELTA, init=_literal_net())
    held = FE.split(x, "vec_id", 0.2, seed=123).where("is_test")
    kept = N.mse(N.mlp_predict(m, held), "label", "pred").first()[0]
    best, at = float("inf"), 0
    for e, _, v in m.history:
        best, at = (v, e) if v < best - STOP_DELTA else (best, at)
    last = m.history[-1][0]
    return N.history_df(spark, m).select(
        "epoch", F.round("loss", 6).alias("loss"), F.round("val_loss", 6).alias("val_loss"), (F.col("epoch") == at).alias("restored"),
        ((F.col("epoch") == last) & F.lit(last - at >= STOP_PATIENCE)).alias("stopped"), F.round(F.lit(kept), 6).alias("kept_val_loss"))


@query("mlp_nb_predictions", "M25 M26 M27 M28")
def mlp_nb_predictions(spark, sf):
    """The full-sized network (64 units, 150 epochs of mini-batches of 20) fitted
    on four fifths of the customers; all held-out rows are scored, the loss is
    theirs. Thousands of steps are beyond SQL: tests compare its loss."""
    x = lines_per_customer(spark, sf).withColumn("y", F.col("y").cast("double"))
    x = x.withColumn("seg_b", (F.col("c_mktsegment") == "BUILDING").cast("double")).withColumn(
        "seg_m", (F.col("c_mktsegment") == "MACHINERY").cast("double"))
    x = FE.split(x, "c_custkey", 0.2, seed=42)
    feats = ["c_acctbal", "seg_b", "seg_m"]
    m = N.mlp_fit_local(x.where("NOT is_test"), "y", feats, "c_custkey", loss="nb", hidden=64, epochs=150, batch=20, lr=0.03, seed=123,
                        local_epochs=15, patience=4)
    p = N.mlp_predict(m, x.where("is_test"))
    loss = N.nb_nll(p, "y", "pred", "pred_var").collect()[0][0]
    return p.select("c_custkey", F.col("y").alias("actual"), F.col("pred").alias("prediction"), F.lit(loss).alias("test_nb_loss"))
