"""Registered queries: association rules over lineitem transactions
(F10, F11, M13-M17, J8, W3, C8, G13, S3)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import rules as R
from ..session import table
from .q_features import DISC_COLS, _disc_sql
from .registry import query

RULE_DISC = DISC_COLS + ["l_tax"]
ITEM_COLS = ["l_returnflag", "l_linestatus"] + RULE_DISC


def transactions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                             *RULE_DISC)
    return FE.to_items(FE.discretize(li, RULE_DISC, 3), ITEM_COLS)


def mined(spark, sf):
    r = R.mine_rules(transactions(spark, sf), min_support=0.1, min_confidence=0.5)
    # rounded measures: the same ranking in every engine
    return r.select("antecedent", "consequent", *[F.round(c, 10).alias(c) for c in ["support", "confidence", "lift"]],
                    "count")


def _out(r):
    return r.select(F.array_join("antecedent", "|").alias("antecedent"), "consequent", "support", "confidence",
                    "lift", "count")


# every non-empty subset of a transaction's six items is an item set
SQL_RULES = f"""with tx as ({_disc_sql(RULE_DISC)}),
n as (select count(*) as n from tx),
t as (select list_sort(string_split(items, ';')) as l, count(*) as k from tx group by 1),
m as (select unnest(range(1, {2 ** len(ITEM_COLS)})) as m),
fs as (select l as s, sum(k) as c from (
    select [l[i] for i in generate_series(1, len(l)) if (m >> (i - 1)) & 1 = 1] as l, k from t, m)
  group by 1 having sum(k) >= 0.1 * (select n from n)),
cand as (select [x for x in f.s if x <> y] as a, y, f.c as c_s from (select s, c, unnest(s) as y from fs where len(s) > 1) f),
rules as (
  select array_to_string(a, '|') as antecedent, y as consequent, round(c_s / n, 10) as support, round(c_s / fa.c, 10) as confidence,
         round((c_s / fa.c) / (fy.c / n), 10) as lift, cast(c_s as bigint) as count
  from cand join fs fa on fa.s = a join fs fy on fy.s = [y], n where c_s / fa.c >= 0.5
  union all select '', s[1], round(c / n, 10), round(c / n, 10), 1.0, cast(c as bigint) from fs, n
  where len(s) = 1 and c / n >= 0.5)"""


@query("association_rules", "M13 M14 F10 F11", SQL_RULES + "\nselect * from rules")
def association_rules(spark, sf):
    return _out(mined(spark, sf))


SQL_RANKED = SQL_RULES + """,
ranked as (select *, row_number() over (order by lift desc, confidence desc, support desc,
  replace(antecedent, '|', chr(1)), consequent) as rank from rules)"""


@query("top_rules_by_lift", "W3 S3", SQL_RANKED + "\nselect * from ranked where rank <= 10")
def top_rules_by_lift(spark, sf):
    return _ranked_out(R.rank_rules(mined(spark, sf), 10))


def _ranked_out(r):
    return r.select(F.array_join("antecedent", "|").alias("antecedent"), "consequent", "support", "confidence",
                    "lift", "count", "rank")


SQL_PRUNED = SQL_RANKED + """,
it as (select *, list_sort(case when antecedent = '' then [consequent]
          else list_concat(string_split(antecedent, '|'), [consequent]) end) as items
       from ranked),
pruned as (select j.* from it j where not exists (select 1 from it i where i.rank < j.rank
           and list_has_all(j.items, i.items)))"""


@query("pruned_rules", "M15 J8", SQL_PRUNED + """
select antecedent, consequent, support, confidence, lift, count, rank from pruned""")
def pruned_rules(spark, sf):
    return _ranked_out(R.prune_redundant(mined(spark, sf)))


@query("antecedent_item_freq", "M16 G4 C6", SQL_PRUNED + """,
ai as (select unnest(string_split(antecedent, '|')) as item from pruned where antecedent <> '')
select item, count(*) as n, count(*) > 10 as important from ai group by item""")
def antecedent_item_freq(spark, sf):
    return R.antecedent_freq(R.prune_redundant(mined(spark, sf)), 10)


@query("antecedent_base_freq", "M16 G13", SQL_PRUNED + """,
ai as (select unnest(string_split(antecedent, '|')) as item from pruned where antecedent <> '')
select regexp_replace(item, '=.*$', '') as variable, cast(count(*) as bigint) as n from ai group by 1""")
def antecedent_base_freq(spark, sf):
    return R.antecedent_base_freq(R.prune_redundant(mined(spark, sf)))


@query("response_rules", "M17 C8", SQL_PRUNED + """
select antecedent, consequent, support, confidence, lift, count, rank from pruned
where contains(consequent, 'l_linestatus')""")
def response_rules(spark, sf):
    return _ranked_out(R.response_rules(R.prune_redundant(mined(spark, sf)), "l_linestatus"))


@query("rules_for_consequent", "C8", SQL_RULES + """
select * from rules where contains(consequent, 'l_linestatus=O')""")
def rules_for_consequent(spark, sf):
    r = mined(spark, sf).withColumn("consequent", F.array("consequent"))
    r = R.rules_for(r, "l_linestatus=O")
    return _out(r.withColumn("consequent", F.col("consequent")[0]))


# Rules over all factors of a wide table: lineitem with its order and part, 17
# columns with some 60 frequent items
WIDE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "o_totalprice", "o_custkey",
            "p_size", "p_retailprice"]
WIDE_CAT = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "p_type", "ship_year", "order_year"]


def wide_transactions(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    x = (table(spark, sf, "lineitem").join(o, "l_orderkey").join(p, "l_partkey")
         .withColumn("ship_year", F.year("l_shipdate")).withColumn("order_year", F.year("o_orderdate")))
    return FE.to_items(FE.discretize(x.select(*WIDE_CAT, *WIDE_NUM), WIDE_NUM, 3), WIDE_CAT + WIDE_NUM).select("items")


def _sql_wide(levels: int, support: float, confidence: float) -> str:
    """The rules in SQL: sets as masks of item numbers, each level's occurrences
    joined with the rows' later items."""
    q = " union all ".join(f"select '{c}' as col, list_sort(list_distinct(quantile_cont({c}, [0.0, 1/3, 2/3, 1.0]))) as q from base"
                           for c in WIDE_NUM)
    num = " union all ".join(f"select tx, '{c}' as col, cast({c} as double) as x from base" for c in WIDE_NUM)
    cat = " union all ".join(f"select tx, '{c}=' || cast({c} as varchar) as item from base where {c} is not null" for c in WIDE_CAT)
    steps = "".join(f""",
o{k} as materialized (select o.tx, o.m | (cast(1 as hugeint) << t.bit) as m, t.bit as last
  from o{k - 1} o join f{k - 1} f on f.m = o.m join ti t on t.tx = o.tx and t.bit > o.last),
f{k} as materialized (select m, count(*) as c from o{k} group by m having count(*) >= {support} * (select n from n))"""
                    for k in range(2, levels + 1))
    every = " union all ".join(f"select m, c, {k} as k from f{k}" for k in range(1, levels + 1))
    return f"""with base as (select row_number() over () as tx, l.*, o.*, p.*, year(l_shipdate) as ship_year, year(o_orderdate) as order_year
  from lineitem l join orders o on l_orderkey = o_orderkey join part p on l_partkey = p_partkey),
q as ({q}),
bins as (select col, q[i] as lo, q[i + 1] as hi, i = len(q) - 1 as last from q, range(1, 4) r(i) where i < len(q)),
items as ({cat}
  union all select tx, b.col || '=[' || cast(round(b.lo, 4) as varchar) || ',' || cast(round(b.hi, 4) as varchar)
    || case when b.last then ']' else ')' end
  from ({num}) v join bins b on b.col = v.col and v.x >= b.lo and (v.x < b.hi or (b.last and v.x <= b.hi))),
n as (select count(*) as n from base),
code as (select item, count(*) as c, cast(row_number() over (order by item) - 1 as integer) as bit from items group by item
  having count(*) >= {support} * (select n from n)),
ti as materialized (select tx, bit from items join code using (item)),
o1 as (select tx, cast(1 as hugeint) << bit as m, bit as last from ti),
f1 as (select cast(1 as hugeint) << bit as m, c from code){steps},
fs as materialized ({every}),
pairs as (select f.m, f.c, f.k, y.item as consequent, y.c as cy, xor(f.m, cast(1 as hugeint) << y.bit) as a
  from fs f join code y on (f.m >> y.bit) & 1 = 1 where f.k > 1),
kept as (select p.*, fa.c as ca from pairs p join fs fa on fa.m = p.a where p.c / fa.c >= {confidence}),
rules as (
  select string_agg(x.item, '|' order by x.item) as antecedent, consequent, round(any_value(kept.c) / any_value(n.n), 10) as support,
    round(any_value(kept.c / ca), 10) as confidence, round(any_value((kept.c / ca) / (cy / n.n)), 10) as lift,
    cast(any_value(kept.c) as bigint) as count, m
  from kept join code x on (kept.a >> x.bit) & 1 = 1, n group by m, consequent
  union all select '', item, round(c / n, 10), round(c / n, 10), 1.0, cast(c as bigint), cast(1 as hugeint) << bit from code, n
  where c / n >= {confidence})"""


def wide_mined(spark, sf, min_support, min_confidence, max_len):
    r = R.mine_rules(wide_transactions(spark, sf), min_support=min_support, min_confidence=min_confidence, max_len=max_len)
    return r.select("antecedent", "consequent", *[F.round(c, 10).alias(c) for c in ["support", "confidence", "lift"]], "count")


@query("wide_association_rules", "M13 M14 F10 F11", _sql_wide(4, 0.02, 0.5) + """
select antecedent, consequent, support, confidence, lift, count from rules""")
def wide_association_rules(spark, sf):
    return _out(wide_mined(spark, sf, 0.02, 0.5, 4))


@query("wide_pruned_rules", "M15 J8 W3 S3", _sql_wide(5, 0.02, 0.3) + """,
ranked as materialized (select *, row_number() over (order by lift desc, confidence desc, support desc,
  replace(antecedent, '|', chr(1)), consequent) as rank from rules qualify rank <= 25000)
select antecedent, consequent, support, confidence, lift, count, rank from ranked j
where not exists (select 1 from ranked i where i.rank < j.rank and i.m & j.m = i.m)""")
def wide_pruned_rules(spark, sf):
    return _ranked_out(R.prune_redundant(wide_mined(spark, sf, 0.02, 0.3, 10), 25_000))
