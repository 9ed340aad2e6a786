"""Registered queries: feature engineering (F1-F11) and exploratory
statistics (M1-M3)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import features as FE
from ..operators import stats as ST
from ..session import cut_lineage, table
from .registry import query
from .sqlmath import chi2_p

# Fixed values for the tag/topic queries over part names (stand-ins for the
# reference's topic list and synonym merges).
TOPICS = ["ring", "widget", "gadget", "red", "bolt", "tiny"]
SYNONYMS = {"gear": "gadget", "blue": "red"}


@query("part_topics", "F1 X4 X12 U2", """
with w as (select p_partkey, unnest(string_split(p_name, ' ')) as w0,
                  generate_subscripts(string_split(p_name, ' '), 1) as pos from part),
m as (select p_partkey, pos, case w0 when 'gear' then 'gadget' when 'blue' then 'red' else w0 end as w from w
      where w0 <> ''),
h as (select p_partkey, arg_min(w, pos) as topic from m
      where w in ('ring', 'widget', 'gadget', 'red', 'bolt', 'tiny') group by p_partkey)
select p.p_partkey, h.topic from part p left join h using (p_partkey)""")
def part_topics(spark, sf):
    p = table(spark, sf, "part")
    return FE.assign_topic(p, "p_name", TOPICS, SYNONYMS, out="topic", sep=" ").select("p_partkey", "topic")


@query("customer_order_band", "F2 J3 G12", """
with f as (select o_custkey, count(*) as f from orders where o_custkey is not null group by 1),
q as (select quantile_cont(cast(f as double), [0.25, 0.5, 0.75]) as q from f)
select o.o_orderkey, coalesce(case when f.f <= q.q[1] then 'Q1' when f.f <= q.q[2] then 'Q2'
  when f.f <= q.q[3] then 'Q3' when f.f is not null then 'Q4' end, 'Q1') as band
from orders o left join f using (o_custkey) cross join q""")
def customer_order_band(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return FE.frequency_band(o, "o_custkey").select("o_orderkey", "band")


@query("rare_customer_orders", "F3", """
select o_orderkey, case when count(*) over (partition by o_custkey) < 12 then null else o_custkey end
  as o_custkey from orders""")
def rare_customer_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return FE.collapse_rare(o, "o_custkey", 12)


@query("labels_other", "F4", """
select d.doc_id, coalesce(cast(l.quality as varchar), 'Other') as quality,
       coalesce(cast(l.toxic as varchar), 'Other') as toxic from documents d left join labels l using (doc_id)""")
def labels_other(spark, sf):
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return FE.na_to_other(x, ["quality", "toxic"])


STATUS = ["F", "O", "P"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _dummy_sql(drop_first: bool) -> str:
    cols = []
    for c, lv in (("o_orderstatus", STATUS), ("o_orderpriority", PRIORITY)):
        for v in (lv[1:] if drop_first else lv):
            cols.append(f"case when {c} is null then null else cast({c} = '{v}' as integer) end as \"{c}_{v}\"")
    return "select o_orderkey, o_totalprice, " + ", ".join(cols) + " from orders"


@query("order_dummies", "F5", _dummy_sql(False))
def order_dummies(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return FE.dummies(o, ["o_orderstatus", "o_orderpriority"])


@query("order_dummies_drop_first", "F6", _dummy_sql(True))
def order_dummies_drop_first(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return FE.dummies(o, ["o_orderstatus", "o_orderpriority"], drop_first=True)


@query("lineitem_scaled", "F7", """
select l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) over ()) / stddev_samp(l_quantity) over (), 5) as l_quantity,
  round((l_extendedprice - avg(l_extendedprice) over ()) / stddev_samp(l_extendedprice) over (), 5)
    as l_extendedprice from lineitem""")
def lineitem_scaled(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    s = FE.scale(li, ["l_quantity", "l_extendedprice"])
    return s.select("l_orderkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in ["l_quantity", "l_extendedprice"]])


SQL_SPLIT = """(select o_orderkey, o_totalprice, row_number() over (order by md5('42' || cast(o_orderkey as varchar)),
   o_orderkey) <= ceil(0.2 * count(*) over ()) as is_test from orders)"""


@query("order_split", "F9", f"select o_orderkey, is_test from {SQL_SPLIT}")
def order_split(spark, sf):
    return FE.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2, seed=42)


@query("order_price_scaled_on_train", "F8 F9", f"""with s as {SQL_SPLIT},
st as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as sd from s where not is_test)
select o_orderkey, is_test, round((o_totalprice - m) / sd, 5) as price_z from s, st""")
def order_price_scaled_on_train(spark, sf):
    o = FE.split(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.2, seed=42)
    stats = FE.fit_scaler(o.where(~F.col("is_test")), ["o_totalprice"], population=True)
    z = FE.scale(o, ["o_totalprice"], stats=stats, suffix="_z")
    return z.select("o_orderkey", "is_test", F.round("o_totalprice_z", 5).alias("price_z"))


DISC_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _disc_sql(disc_cols=None):
    DISC = disc_cols or DISC_COLS
    qs = ", ".join(f"""select '{c}' as col, list_sort(list_distinct(quantile_cont({c}, [0.0, 1/3, 2/3, 1.0]))) as q
        from lineitem""" for c in DISC).replace(", select", " union all select")
    lab = lambda c: f"""(select '[' || cast(round(b.lo, 4) as varchar) || ',' || cast(round(b.hi, 4) as varchar)
       || case when b.last then ']' else ')' end from bins b where b.col = '{c}' and l.{c} >= b.lo
       and (l.{c} < b.hi or (b.last and l.{c} <= b.hi)))"""
    items = " || ';' || ".join(
        ["'l_returnflag=' || l.l_returnflag", "'l_linestatus=' || l.l_linestatus"]
        + [f"'{c}=' || {lab(c)}" for c in DISC])
    return f"""with q as ({qs}),
bins as (select col, q[i] as lo, q[i + 1] as hi, i = len(q) - 1 as last
         from q, range(1, 4) r(i) where i < len(q))
select l.l_orderkey, l.l_linenumber, {items} as items from lineitem l"""


@query("lineitem_items", "F10 F11", _disc_sql())
def lineitem_items(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                             *DISC_COLS)
    d = FE.discretize(li, DISC_COLS, 3)
    it = FE.to_items(d, ["l_returnflag", "l_linestatus"] + DISC_COLS)
    return it.select("l_orderkey", "l_linenumber", F.array_join("items", ";").alias("items"))


def flag_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_returnflag", "l_linestatus",
                     F.when(F.col("l_discount") >= 0.05, "Y").otherwise("N").alias("hi_disc"),
                     F.when(F.col("l_tax") >= 0.04, "Y").otherwise("N").alias("taxed"),
                     F.col("l_quantity").cast("int").cast("string").alias("qty"))


FLAG_COLS = ["l_returnflag", "l_linestatus", "hi_disc", "taxed", "qty"]


def _chi_sql():
    frame = """(select l_returnflag, l_linestatus, case when l_discount >= 0.05 then 'Y' else 'N' end as hi_disc,
      case when l_tax >= 0.04 then 'Y' else 'N' end as taxed, cast(cast(l_quantity as integer) as varchar) as qty
      from lineitem)"""
    parts = []
    for i, a in enumerate(FLAG_COLS):
        for b in FLAG_COLS[i + 1:]:
            parts.append(f"""select '{a}' as var1, '{b}' as var2, cast({a} as varchar) as va,
                cast({b} as varchar) as vb from x where {a} is not null and {b} is not null""")
    return f"""with x as {frame},
p as ({' union all '.join(parts)}),
o as (select var1, var2, va, vb, count(*)::double as o from p group by all),
r as (select var1, var2, va, sum(o) as r from o group by all),
c as (select var1, var2, vb, sum(o) as c from o group by all),
t as (select var1, var2, sum(r) as n, count(*) as nr from r group by all),
tc as (select var1, var2, count(*) as nc from c group by all),
full_ as (select r.var1, r.var2, r.va, c.vb, r.r, c.c, t.n, coalesce(o.o, 0) as o, t.nr, tc.nc
          from r join c using (var1, var2) join t using (var1, var2) join tc using (var1, var2)
          left join o using (var1, var2, va, vb)),
s as (select var1, var2, any_value(nr) as nr, any_value(nc) as nc,
        sum(case when o > 0 then o * o / (r * c) else 0 end) * any_value(n) - any_value(n) as pearson,
        sum(power(abs(o - r * c / n) - least(0.5, abs(o - r * c / n)), 2) / (r * c / n)) as yates
      from full_ group by var1, var2),
res as (select var1, var2, round(case when nr = 2 and nc = 2 then yates else pearson end, 6) as statistic,
        cast((nr - 1) * (nc - 1) as integer) as dof from s)
select * from res union all select var2, var1, statistic, dof from res"""


@query("chi_square_pairs", "M1", _chi_sql())
def chi_square_pairs(spark, sf):
    r = ST.chi_square_pairs(flag_frame(spark, sf), FLAG_COLS, with_p=False)
    return r.withColumn("statistic", F.round("statistic", 6)).withColumn("dof", F.col("dof").cast("int"))


@query("chi_square_pvalues", "M1", f"""with m as ({_chi_sql()})
select var1, var2, statistic, dof, round({chi2_p('statistic', 'dof')}, 4) as p_value from m""")
def chi_square_pvalues(spark, sf):
    r = ST.chi_square_pairs(flag_frame(spark, sf), FLAG_COLS, with_p=True)
    return r.select("var1", "var2", F.round("statistic", 6).alias("statistic"), F.col("dof").cast("int").alias("dof"), F.round("p_value", 4).alias("p_value"))


# 45 three-level columns: five measures cut at nine pairs of thresholds
WIDE_RANGES = {"l_quantity": (1.0, 50.0), "l_extendedprice": (900.0, 100000.0), "l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08),
               "l_partkey": (1.0, 2000.0)}
WIDE = [(f"{c}_{k}", c, lo + (hi - lo) * k / 13, lo + (hi - lo) * (k + 3) / 13) for c, (lo, hi) in WIDE_RANGES.items()
        for k in range(1, 10)]


def _pairs_sql(frame: str, names: list[str], digits: int) -> str:
    """χ² of all pairs of the columns of a frame; two-by-two tables by Yates."""
    pairs = " union all ".join(
        f"select {i} as i, {j} as j, cast({names[i]} as varchar) as va, cast({names[j]} as varchar) as vb, count(*)::double as o from x "
        f"where {names[i]} is not null and {names[j]} is not null group by all" for i in range(len(names)) for j in range(i + 1, len(names)))
    lst = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"""x as materialized ({frame}), o as materialized ({pairs}),
r as (select i, j, va, sum(o) as r from o group by all), c as (select i, j, vb, sum(o) as c from o group by all),
t as (select i, j, sum(r) as n, count(*) as nr from r group by all), tc as (select i, j, count(*) as nc from c group by all),
s as (select i, j, sum(o * o / (r * c)) as s from o join r using (i, j, va) join c using (i, j, vb) group by all),
g as (select i, j, n, r.va, c.vb, r * c / n as e from t join tc using (i, j) join r using (i, j) join c using (i, j) where nr = 2 and nc = 2),
y as (select i, j, sum(power(d - least(0.5, d), 2) / e) as yates from (select g.*, abs(coalesce(o, 0) - e) as d from g left join o using (i, j, va, vb)) group by all),
z as (select {lst}[i + 1] as var1, {lst}[j + 1] as var2, coalesce(yates, n * (s - 1)) as raw, round(raw, {digits}) as statistic,
  cast((nr - 1) * (nc - 1) as integer) as dof from s join t using (i, j) join tc using (i, j) left join y using (i, j))"""


_WIDE_FRAME = "select " + ", ".join(f"case when {c} < {lo!r} then 'a' when {c} < {hi!r} then 'b' else 'c' end as {n}"
                                    for n, c, lo, hi in WIDE) + " from lineitem"


@query("chi_square_wide", "M1", f"""with {_pairs_sql(_WIDE_FRAME, [w[0] for w in WIDE], 4)}
select var1, var2, statistic, dof, case when dof > 0 then round({chi2_p('raw', 'dof')}, 6) end as p_value from z""")
def chi_square_wide(spark, sf):
    """All 990 pairs of 45 columns from one scan, two-level columns among them."""
    li = table(spark, sf, "lineitem")
    x = li.select(*[F.when(F.col(c) < lo, "a").when(F.col(c) < hi, "b").otherwise("c").alias(n) for n, c, lo, hi in WIDE])
    r = ST.chi_square_pairs(x, [w[0] for w in WIDE], symmetric=False)
    return r.select("var1", "var2", F.round("statistic", 4).alias("statistic"), F.col("dof").cast("int").alias("dof"), F.round("p_value", 6).alias("p_value"))


UNCUT = {"o_totalprice": "cast(o_totalprice as {t})", "o_custkey": "cast(o_custkey as {t})", "o_orderdate": "cast(cast(o_orderdate as date) as {t})",
         "o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus", "dear": "case when o_totalprice >= 150000 then 'Y' else 'N' end",
         "late": "case when o_orderdate >= timestamp '1998-06-01 00:00:00' then 'Y' else 'N' end",
         "odd": "case when o_custkey % 2 = 1 then 'Y' when o_custkey % 10 <> 0 then 'N' end"}


def _uncut_frame(text: str) -> str:
    return "select " + ", ".join(f"{e.format(t=text)} as {n}" for n, e in UNCUT.items()) + " from orders"


@query("chi_square_uncut", "M1", f"with {_pairs_sql(_uncut_frame('varchar'), list(UNCUT), 3)} select var1, var2, statistic, dof from z")
def chi_square_uncut(spark, sf):
    """Prices, customers and dates as they are, thousands of levels each, beside
    factors and two-level columns, NULLs among them. Degrees of freedom are int as
    in the SQL while all of them fit, else long (SQL raises there)."""
    x = table(spark, sf, "orders").selectExpr(*[f"{e.format(t='string')} AS {n}" for n, e in UNCUT.items()])
    r = cut_lineage(ST.chi_square_pairs(x, list(UNCUT), with_p=False, symmetric=False).withColumn("statistic", F.round("statistic", 3)))
    return r if r.where(F.col("dof") > (1 << 31) - 1).count() else r.withColumn("dof", F.col("dof").cast("int"))


@query("chi_square_long", "M2", f"""with m as ({_chi_sql()})
select var1 as "Var1", var2 as "Var2", statistic as value from m""")
def chi_square_long(spark, sf):
    r = ST.chi_square_pairs(flag_frame(spark, sf), FLAG_COLS, with_p=False).withColumn(
        "statistic", F.round("statistic", 6))
    wide = ST.pivot_matrix(r, "var1", "var2", "statistic", FLAG_COLS)
    return ST.melt(wide, "var1", "value")


@query("quantity_kde", "M3", """
with s as (select stddev_samp(l_quantity) * pow(count(l_quantity), -0.2) as bw, count(l_quantity) as n
           from lineitem),
g as (select range as i, cast(range * 0.5 as double) as x from range(0, 121))
select g.x, round(sum(exp(-0.5 * pow((g.x - l.l_quantity) / s.bw, 2))) / (any_value(s.n) * any_value(s.bw)
  * sqrt(2 * pi())), 8) as density from g, lineitem l, s where l.l_quantity is not null group by g.x""")
def quantity_kde(spark, sf):
    k = ST.kde(table(spark, sf, "lineitem"), "l_quantity", (0.0, 60.0, 121))
    return k.select("x", F.round("density", 8).alias("density"))
