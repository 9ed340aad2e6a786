"""Registered queries: sources, parsing, filters, joins, aggregates, windows,
sorts, scalar functions (SURVEY A, B, C, J, G, W, S, U, X). Every query reads
the driver tables whole; oracle SQL is DuckDB over the same views."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.mathx import lgamma, poisson_logpmf
from ..operators import aggregates as G
from ..operators import filters as C
from ..operators import joins as J
from ..operators import sorting as S
from ..operators import windows as W
from ..operators.common import feature_columns
from ..session import stage_path, table
from ..sources.io import read_report, read_stage, write_stage
from ..sources.io import read_pages
from .registry import query

# Sections that are not articles (listed in the reference).
NON_ARTICLE_SECTIONS = ["autores", "usuario", "autor", "buscador", "aviso-legal",
                        "quienes-somos", "publicidad", "politica-cookies"]
NON_ARTICLE_SQL = ", ".join(f"'{s}'" for s in NON_ARTICLE_SECTIONS)
# Stand-ins on the driver tables for the reference's URL rules: mobile hosts and
# paged listings are not article URLs; a bare "/section" URL is a section front.
URL_TOKENS = ["://m.", "page="]
SECTION_FRONT_RX = r"^https?://[^/]+/[^/]+/?$"


def articles(spark, sf):
    p = read_pages(spark, f"{sf}/pages.parquet")
    p = C.drop_containing(p, "url", URL_TOKENS)
    p = C.drop_matching(p, "url", SECTION_FRONT_RX)
    p = p.withColumn("section", P.section_of("url"))
    return C.drop_in(p, "section", NON_ARTICLE_SECTIONS)


SQL_SECTION = ("nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^/?#]*)', 1), '')")
SQL_ARTICLES = f"""select page_id, url, html, {SQL_SECTION} as section from pages
 where not contains(url, '://m.') and not contains(url, 'page=')
   and not regexp_matches(url, '^https?://[^/]+/[^/]+/?$')"""


@query("articles_per_section", "A4 C1 C2 C4 X6 G4 S4", f"""
with a as ({SQL_ARTICLES})
select section, count(*) as n_articles from a
where section is not null and (section not in ({NON_ARTICLE_SQL}))
group by section""")
def articles_per_section(spark, sf):
    return G.freq(articles(spark, sf), "section", sort="desc", name="n_articles")


@query("customer_renamed", "B1 B2", """
select c_custkey as customer_id, c_name as name_author, c_acctbal as balance_author
from customer""")
def customer_renamed(spark, sf):
    c = table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "customer_id", "c_name": "name",
                                                          "c_acctbal": "balance"})
    c = c.select("customer_id", "name", "balance")
    return c.withColumnsRenamed({k: f"{k}_author" for k in ["name", "balance"]})


@query("balance_to_int", "B3", """
select c_custkey, cast(trunc(c_acctbal) as integer) as balance_int,
       cast(null as integer) as name_int from customer""")
def balance_to_int(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", P.to_int("c_acctbal").alias("balance_int"),
                    P.to_int("c_name").alias("name_int"))


@query("priority_codes", "B4", """
select o_orderkey, o_orderpriority,
       cast(dense_rank() over (order by o_orderpriority) - 1 as integer) as priority_code from orders""")
def priority_codes(spark, sf):
    from ..operators.features import levels
    o = table(spark, sf, "orders")
    lv = levels(o, ["o_orderpriority"])["o_orderpriority"]
    arr = F.array(*[F.lit(v) for v in lv])
    return o.select("o_orderkey", "o_orderpriority",
                    (F.array_position(arr, F.col("o_orderpriority")) - 1).cast("int").alias("priority_code"))


@query("priority_masked", "B5", """
select o_orderkey, case when o_orderstatus = 'P' then 'Other' else o_orderpriority end as o_orderpriority
from orders""")
def priority_masked(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("Other"))
                    .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


def _locale_text(c, decimals=2):
    # 1234567.5 → "1.234.567,50": swap separators of format_number
    t = F.format_number(c, decimals)
    return F.translate(t, ",.", ".,")


@query("locale_numbers", "B6 B7", """
select l_orderkey, l_linenumber, round(l_extendedprice, 2) as price,
       round(l_discount * 100, 2) as discount_pct, cast(l_quantity as bigint) as qty from lineitem""")
def locale_numbers(spark, sf):
    li = table(spark, sf, "lineitem")
    t = li.select("l_orderkey", "l_linenumber",
                  _locale_text(F.col("l_extendedprice")).alias("price_txt"),
                  F.concat(_locale_text(F.col("l_discount") * 100), F.lit("%")).alias("pct_txt"),
                  _locale_text(F.col("l_quantity"), 0).alias("qty_txt"))
    return t.select("l_orderkey", "l_linenumber", P.parse_locale_number("price_txt").alias("price"),
                    P.parse_percent("pct_txt").alias("discount_pct"),
                    P.parse_locale_number("qty_txt").cast("long").alias("qty"))


@query("session_seconds", "B8", """
select event_id, case when event_type = 'error' then 0.0
       else cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as double) end as avg_session
from events""")
def session_seconds(spark, sf):
    e = table(spark, sf, "events")
    txt = F.when(F.col("event_type") == "error", F.lit("<00:00:01")).otherwise(F.date_format("ts", "HH:mm:ss"))
    return e.select("event_id", P.parse_duration(txt).alias("avg_session"))


def report_from_events(spark, sf):
    """An analytics-export-shaped frame (raw text columns) derived from events."""
    e = table(spark, sf, "events")
    users = F.round(F.col("value") * 1000).cast("long")
    return e.select(
        F.col("event_id").alias("url (cd 41)"),
        F.col("event_type").alias("Edad"),
        F.translate(F.format_number(users, 0), ",", ".").alias("Usuarios"),
        F.col("user_id").alias("Usuarios nuevos"),
        F.when(F.col("event_type") == "click", F.lit("<00:00:01"))
         .otherwise(F.date_format("ts", "HH:mm:ss")).alias("Duración media de la sesión"),
        _locale_text(F.col("value")).alias("Páginas/sesión"),
        F.translate(F.format_number(users * 2, 0), ",", ".").alias("Sesiones"),
        F.concat(_locale_text(F.col("value") * 3), F.lit("%")).alias("Porcentaje de rebote"))


@query("clean_report", "B9 C3 B1", """
select event_id as url, cast(round(value * 1000) as bigint) as users, user_id as new_users,
       case when event_type = 'click' then 0.0
            else cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as double) end as avg_session,
       round(value, 2) as pages_session, cast(round(value * 1000) * 2 as bigint) as sessions,
       round(value * 3, 2) as p_rebound
from events where event_type <> 'view'""")
def clean_report_q(spark, sf):
    from ..plans.stages import clean_report
    r = clean_report(report_from_events(spark, sf), drop_band="view")
    return r.withColumnsRenamed({"URL": "url", "Users": "users", "New_users": "new_users",
                                 "Avg_session": "avg_session", "Pages_session": "pages_session",
                                 "Sessions": "sessions", "P_rebound": "p_rebound"})


@query("report_csv_roundtrip", "A1 A2 A3 B9", """
select event_id as url, cast(round(value * 1000) as bigint) as users, user_id as new_users,
       case when event_type = 'click' then 0.0
            else cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as double) end as avg_session,
       round(value, 2) as pages_session, cast(round(value * 1000) * 2 as bigint) as sessions,
       round(value * 3, 2) as p_rebound
from events where event_type <> 'view'""")
def report_csv_roundtrip(spark, sf):
    """Export-shaped text written as CSV (A3) into the shared stage folder,
    read back as a report by header (A1, each part file's header skipped) and
    cleaned (B9); the cleaned stage is written as Parquet and re-read (A2)."""
    from ..plans.stages import clean_report
    path = stage_path(spark, "report")
    write_stage(report_from_events(spark, sf), path, fmt="csv")
    raw = read_report(spark, path, skip_rows=0, max_rows=None)
    clean = clean_report(raw, drop_band="view")
    out = stage_path(spark, "clean")
    write_stage(clean, out)
    r = read_stage(spark, out)
    return r.select(F.col("URL").cast("long").alias("url"), F.col("Users").alias("users"),
                    F.col("New_users").cast("long").alias("new_users"), F.col("Avg_session").alias("avg_session"),
                    F.col("Pages_session").alias("pages_session"), F.col("Sessions").alias("sessions"),
                    F.col("P_rebound").alias("p_rebound"))


@query("line_net_columns", "B10 X13", """
select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as gross,
       round(ln(l_extendedprice), 6) as log_price, round(abs(l_discount - 0.05), 6) as disc_dev,
       round(greatest(l_discount, 1e-10), 10) as disc_clamped from lineitem""")
def line_net_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", F.round(net, 4).alias("net"),
                     F.round(net * (1 + F.col("l_tax")), 6).alias("gross"),
                     F.round(F.log("l_extendedprice"), 6).alias("log_price"),
                     F.round(F.abs(F.col("l_discount") - 0.05), 6).alias("disc_dev"),
                     F.round(F.greatest(F.col("l_discount"), F.lit(1e-10)), 10).alias("disc_clamped"))


@query("customers_not_building", "C3", """
select c_custkey from customer where c_mktsegment is distinct from 'BUILDING'""")
def customers_not_building(spark, sf):
    return C.drop_equal(table(spark, sf, "customer"), "c_mktsegment", "BUILDING").select("c_custkey")


@query("building_keys", "C3", "select c_custkey from customer where c_mktsegment = 'BUILDING'")
def building_keys(spark, sf):
    return C.keys_where(table(spark, sf, "customer"), "c_mktsegment", "BUILDING", "c_custkey")


@query("parts_not_promo_small", "C4", """
select p_partkey, p_type from part where p_type is null or p_type not in ('PROMO', 'SMALL')""")
def parts_not_promo_small(spark, sf):
    return C.drop_in(table(spark, sf, "part"), "p_type", ["PROMO", "SMALL"]).select("p_partkey", "p_type")


@query("orders_of_big_customers", "C4", """
select o_orderkey from orders where o_custkey in
  (select o_custkey from orders group by o_custkey having count(*) >= 15)""")
def orders_of_big_customers(spark, sf):
    o = table(spark, sf, "orders")
    big = o.groupBy("o_custkey").count().where("count >= 15").select("o_custkey")
    return C.keep_in(o, "o_custkey", big).select("o_orderkey")


def docs_labels(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


@query("unlabeled_docs", "C5 J2", """
select d.doc_id from documents d left join labels l using (doc_id) where l.quality is null""")
def unlabeled_docs(spark, sf):
    return C.null_keys(docs_labels(spark, sf), "quality", "doc_id")


@query("labeled_docs", "C5", """
select d.doc_id, l.quality from documents d left join labels l using (doc_id) where l.quality is not null""")
def labeled_docs(spark, sf):
    return C.drop_null(docs_labels(spark, sf), "quality").select("doc_id", "quality")


@query("long_docs_count", "C6", "select count(*) filter (where n_chars > 5000) as n from documents")
def long_docs_count(spark, sf):
    return C.count_where(table(spark, sf, "documents"), F.col("n_chars") > 5000)


@query("regions_after_first", "C7", """
select r_regionkey, r_name from (select *, row_number() over (order by r_regionkey) as rn from region)
where rn > 1""")
def regions_after_first(spark, sf):
    return C.drop_first(table(spark, sf, "region"), ["r_regionkey"])


@query("metric_match", "J1", """
with l as (select l_orderkey as k, l_linenumber as ln, l_suppkey as s, l_quantity as q,
                  case when l_discount = 0 then null else l_discount end as d, l_tax as t
           from lineitem where l_linestatus = 'O'),
     r as (select l_orderkey as k2, l_linenumber as ln2, l_suppkey as s, l_quantity as q,
                  case when l_discount = 0 then null else l_discount end as d, l_tax as t
           from lineitem where l_linestatus = 'F')
select l.k, l.ln, l.s, l.q, l.d, l.t, r.k2, r.ln2 from l left join r
  on l.s is not distinct from r.s and l.q is not distinct from r.q and l.d is not distinct from r.d
  and l.t is not distinct from r.t""")
def metric_match(spark, sf):
    """Open lines matched to filled lines on four metric columns (NULL
    discount matches NULL), as the reference matches its reports; the
    supplier key keeps the fan-out linear in the data."""
    li = table(spark, sf, "lineitem")
    d = F.when(F.col("l_discount") == 0, F.lit(None)).otherwise(F.col("l_discount"))
    cols = [F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), d.alias("d"), F.col("l_tax").alias("t")]
    left = li.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
                                                 *cols)
    right = li.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k2"),
                                                  F.col("l_linenumber").alias("ln2"), *cols)
    return J.match_on_metrics(left, right, ["s", "q", "d", "t"])


@query("doc_word_counts", "J2", """
select d.doc_id, d.lang, coalesce(w.n_words, 0) as n_words from documents d left join
 (select doc_id, count(*) as n_words from (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) as w
  from documents) where w <> '' group by doc_id) w using (doc_id)""")
def doc_word_counts(spark, sf):
    d = table(spark, sf, "documents")
    words = d.select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).where(F.col("w") != "")
    res = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))
    out = J.attach(d.select("doc_id", "lang"), res, "doc_id")
    return out.withColumn("n_words", F.coalesce("n_words", F.lit(0)).cast("long"))


# A small alias map (stands for the reference's alias lists).
BRAND_OVERRIDES = [("Brand#1", "Brand#10"), ("Brand#2", "Brand#20"), ("Brand#3", "Brand#30")]


@query("brand_overrides", "J4", """
select p_partkey, case p_brand when 'Brand#1' then 'Brand#10' when 'Brand#2' then 'Brand#20'
  when 'Brand#3' then 'Brand#30' else p_brand end as p_brand from part""")
def brand_overrides(spark, sf):
    ov = spark.createDataFrame(BRAND_OVERRIDES, "key string, value string")
    return J.apply_overrides(table(spark, sf, "part"), "p_brand", ov).select("p_partkey", "p_brand")


# A small first-word → class dictionary (stands for a name→gender table).
NAME_CLASSES = [("small", "F"), ("red", "M"), ("blue", "M"), ("green", "F"), ("large", "F"),
                ("black", "M"), ("white", "F"), ("tiny", "M")]


@query("name_gender", "J5", """
with d(first_name, gender) as (values ('small','F'),('red','M'),('blue','M'),('green','F'),('large','F'),
     ('black','M'),('white','F'),('tiny','M'))
select p.p_partkey, d.gender from part p left join d
  on lower(string_split(trim(p.p_name), ' ')[1]) = d.first_name""")
def name_gender(spark, sf):
    names = spark.createDataFrame(NAME_CLASSES, "first_name string, gender string")
    return J.gender_of(table(spark, sf, "part"), "p_name", names).select("p_partkey", "gender")


NAME_PAIRS = [("red", "widget"), ("blue", "bolt"), ("small", "ring"), ("green", "gear")]


@query("name_cooccurrence", "J9 X4 X11 U1", """
with t as (select string_split(p_name, ' ') as w from part),
p(tag_a, tag_b, i) as (values ('red','widget',0),('blue','bolt',1),('small','ring',2),('green','gear',3))
select tag_a, tag_b, count(*) filter (where list_contains(w, tag_a)) as n_a,
       count(*) filter (where list_contains(w, tag_b)) as n_b,
       count(*) filter (where list_contains(w, tag_a) and list_contains(w, tag_b)) as n_both
from p, t group by tag_a, tag_b""")
def name_cooccurrence(spark, sf):
    p = table(spark, sf, "part").withColumn("w", P.split_tags("p_name", " "))
    return J.cooccurrence(p, "w", NAME_PAIRS)


@query("label_null_counts", "G1", """
with x as (select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id))
select 'doc_id' as "column", cast(count(*) filter (where doc_id is null) as bigint) as n_null from x
union all select 'text', count(*) filter (where text is null) from x
union all select 'lang', count(*) filter (where lang is null) from x
union all select 'source', count(*) filter (where source is null) from x
union all select 'n_chars', count(*) filter (where n_chars is null) from x
union all select 'quality', count(*) filter (where quality is null) from x
union all select 'toxic', count(*) filter (where toxic is null) from x
union all select '__total__', (count(*) filter (where quality is null)) + (count(*) filter (where toxic is null))
  + count(*) filter (where text is null) + count(*) filter (where lang is null)
  + count(*) filter (where source is null) + count(*) filter (where n_chars is null)
  + count(*) filter (where doc_id is null) from x""")
def label_null_counts(spark, sf):
    return G.null_counts(docs_labels(spark, sf))


@query("lineitem_zero_counts", "G2", """
select 'l_discount' as "column", count(*) filter (where l_discount = 0) as n_zero from lineitem
union all select 'l_tax', count(*) filter (where l_tax = 0) from lineitem
union all select 'l_quantity', count(*) filter (where l_quantity = 0) from lineitem""")
def lineitem_zero_counts(spark, sf):
    return G.zero_counts(table(spark, sf, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


@query("part_distinct", "G3", """
select 'p_brand' as "column", (select count(*) from (select distinct p_brand from part)) as n_distinct
union all select 'p_type', (select count(distinct p_type) from part)
union all select 'o_orderpriority', (select count(*) from (select distinct o_orderpriority from orders))""")
def part_distinct(spark, sf):
    p = table(spark, sf, "part")
    a = G.distinct_values(p, "p_brand").agg(F.lit("p_brand").alias("column"),
                                            F.count(F.lit(1)).alias("n_distinct"))
    b = G.n_distinct(p, "p_type", count_null=False).select(F.lit("p_type").alias("column"), "n_distinct")
    c = G.n_distinct(table(spark, sf, "orders"), "o_orderpriority").select(
        F.lit("o_orderpriority").alias("column"), "n_distinct")
    return a.unionByName(b).unionByName(c)


@query("event_type_freq", "G4", "select event_type, count(*) as n from events where event_type is not null group by 1")
def event_type_freq(spark, sf):
    return G.freq(table(spark, sf, "events"), "event_type")


@query("top_name_words", "G5 X4 X10", """
select w as word, count(*) as n from (select unnest(string_split(p_name, ' ')) as w from part) where w <> ''
group by w order by n desc, w limit 10""")
def top_name_words(spark, sf):
    p = table(spark, sf, "part").select(F.explode(P.split_tags("p_name", " ")).alias("word"))
    return G.top_k(p, "word", 10)


@query("user_type_value", "G6", """
select user_id, event_type, round(sum(value), 4) as total from events group by all""")
def user_type_value(spark, sf):
    r = G.group_sum(table(spark, sf, "events"), ["user_id", "event_type"], "value")
    return r.withColumn("total", F.round("total", 4))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("user_type_pivot", "G7", """
select user_id, """ + ", ".join(f"cast(count(*) filter (where event_type = '{t}') as bigint) as {t}_n"
                                  for t in EVENT_TYPES) + " from events group by user_id")
def user_type_pivot(spark, sf):
    e = table(spark, sf, "events").withColumn("one", F.lit(1).cast("long"))
    return G.pivot_fill(e, "user_id", "event_type", "one", EVENT_TYPES, fill=0, suffix="_n")


LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("lineitem_shares", "G9", """
with s as (select sum(l_quantity) a, sum(l_extendedprice) b, sum(l_discount) c, sum(l_tax) d from lineitem)
select "column", round(total, 4) as total, round(total / (a + b + c + d), 8) as share from s,
 (select 'l_quantity' as "column", a as total from s union all select 'l_extendedprice', b from s
  union all select 'l_discount', c from s union all select 'l_tax', d from s)""")
def lineitem_shares(spark, sf):
    r = G.shares(table(spark, sf, "lineitem"), LINE_NUM)
    return r.select("column", F.round("total", 4).alias("total"), F.round("share", 8).alias("share"))


@query("lineitem_ranges", "G10", " union all ".join(
    f"select '{c}' as \"column\", cast(min({c}) as double) + 0.0 as min, cast(max({c}) as double) + 0.0 as max "
    f"from lineitem"
    for c in LINE_NUM + ["l_linenumber"]))
def lineitem_ranges(spark, sf):
    r = G.ranges(table(spark, sf, "lineitem"), LINE_NUM + ["l_linenumber"])
    return r.select("column", (F.col("min") + 0.0).alias("min"), (F.col("max") + 0.0).alias("max"))


@query("lines_per_order_meanvar", "G11", """
select round(avg(n), 8) as mean, round(var_samp(n), 8) as variance
from (select l_orderkey, count(*) as n from lineitem group by 1)""")
def lines_per_order_meanvar(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    r = G.mean_var(n, "n")
    return r.select(F.round("mean", 8).alias("mean"), F.round("variance", 8).alias("variance"))


@query("orders_per_customer_quantiles", "G12", """
with f as (select o_custkey, count(*) as n from orders where o_custkey is not null group by 1)
select unnest([0.0, 0.25, 0.5, 0.75, 1.0]::double[]) as prob,
       round(unnest(quantile_cont(cast(n as double), [0.0, 0.25, 0.5, 0.75, 1.0])), 6) as value from f""")
def orders_per_customer_quantiles(spark, sf):
    q = G.freq_quantiles(table(spark, sf, "orders"), "o_custkey")
    return q.withColumn("value", F.round("value", 6))


@query("status_priority_crosstab", "G14", """
select o_orderstatus, o_orderpriority, count(*) as n from orders
where o_orderstatus is not null and o_orderpriority is not null group by all""")
def status_priority_crosstab(spark, sf):
    return G.crosstab_long(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("quantity_histogram", "G15", """
with b as (select range as bin from range(1, 17)),
e as (select bin, case when bin = 1 then -1e-6 else (bin - 1) * 10 + 1e-6 end as above, bin * 10 + 1e-6 as upto from b),
c as (select bin, count(*) as n from lineitem join e on l_quantity > above and l_quantity <= upto group by 1)
select b.bin, cast((b.bin - 1) * 10.0 as double) as lo, cast(b.bin * 10.0 as double) as hi, coalesce(c.n, 0) as n
from b left join c using (bin)""")
def quantity_histogram(spark, sf):
    return G.histogram(table(spark, sf, "lineitem"), "l_quantity", 0.0, 160.0, 10.0)


HIST_COLS = ['l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']


@query("lineitem_histograms", "G16 U3", """
with s as (select 'l_linenumber' as col, count(l_linenumber) as n, cast(min(l_linenumber) as double) as lo, cast(max(l_linenumber) as double) as hi from lineitem union all select 'l_quantity' as col, count(l_quantity) as n, cast(min(l_quantity) as double) as lo, cast(max(l_quantity) as double) as hi from lineitem union all select 'l_extendedprice' as col, count(l_extendedprice) as n, cast(min(l_extendedprice) as double) as lo, cast(max(l_extendedprice) as double) as hi from lineitem union all select 'l_discount' as col, count(l_discount) as n, cast(min(l_discount) as double) as lo, cast(max(l_discount) as double) as hi from lineitem union all select 'l_tax' as col, count(l_tax) as n, cast(min(l_tax) as double) as lo, cast(max(l_tax) as double) as hi from lineitem),
c as (select *, (hi - lo) / ceil(log2(n) + 1) as cell from s),
b as (select *, pow(10, floor(log10(cell))) as base from c),
u as (select *, case when 2 * base - cell < 1.5 * (cell - base) then
        case when 5 * base - cell < 2.75 * (cell - 2 * base) then
          case when 10 * base - cell < 1.5 * (cell - 5 * base) then 10 * base else 5 * base end
        else 2 * base end else base end as unit from b),
g as (select col, unit, floor(lo / unit + 1e-7) as ns, ceil(hi / unit - 1e-7) as nu from u),
spec as (select col, ns * unit as start, unit as width, cast(nu - ns as bigint) as nbins from g),
v as (select 'l_linenumber' as col, cast(l_linenumber as double) as x from lineitem where l_linenumber is not null union all select 'l_quantity' as col, cast(l_quantity as double) as x from lineitem where l_quantity is not null union all select 'l_extendedprice' as col, cast(l_extendedprice as double) as x from lineitem where l_extendedprice is not null union all select 'l_discount' as col, cast(l_discount as double) as x from lineitem where l_discount is not null union all select 'l_tax' as col, cast(l_tax as double) as x from lineitem where l_tax is not null),
grid as (select col, start, width, unnest(range(1, nbins + 1)) as bin from spec),
edges as (select col, bin, case when bin = 1 then start - 1e-7 * width else start + (bin - 1 + 1e-7) * width end as above,
                 start + (bin + 1e-7) * width as upto from grid),
f as (select col, x, count(*) as k from v group by all),
binned as (select f.col, bin, cast(sum(k) as bigint) as n from f join edges e on f.col = e.col and x > above and x <= upto group by all)
select grid.col as "column", grid.bin, grid.start + (grid.bin - 1) * grid.width as lo,
       grid.start + grid.bin * grid.width as hi, coalesce(binned.n, 0) as n
from grid left join binned using (col, bin)""")
def lineitem_histograms(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = [c for c in feature_columns(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag",
                                            "l_linestatus", "l_shipdate"])]
    return G.histograms(li, cols)


@query("order_scatter", "G17", """
select o.o_orderkey, o.o_totalprice, cast(count(l.l_orderkey) as bigint) as n_lines
from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by o.o_orderkey, o.o_totalprice""")
def order_scatter(spark, sf):
    o = table(spark, sf, "orders")
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    x = o.join(n, o.o_orderkey == n.l_orderkey, "left").select(
        "o_orderkey", "o_totalprice", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
    return G.scatter(x, "o_totalprice", "n_lines", key="o_orderkey")


@query("first_event_per_user", "W1", """
select event_id, ts, user_id, event_type, value, props from
 (select *, row_number() over (partition by user_id order by ts, event_id) rn from events) where rn = 1""")
def first_event_per_user(spark, sf):
    return W.dedup_first(table(spark, sf, "events"), "user_id", ["ts", "event_id"])


@query("source_prefer_labeled", "W2", """
select doc_id, source, quality from
 (select d.doc_id, d.source, l.quality, row_number() over (partition by d.source
   order by l.quality is null, d.doc_id) rn from documents d left join labels l using (doc_id)) where rn = 1""")
def source_prefer_labeled(spark, sf):
    x = docs_labels(spark, sf).select("doc_id", "source", "quality")
    return W.dedup_prefer_nonnull(x, "source", "quality", ["doc_id"])


@query("user_value_acf", "W4", """
with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as t
           from events),
m as (select user_id, avg(value) as m from events group by 1),
d as (select e.user_id, e.t, e.value - m.m as d from e join m using (user_id)),
lags as (select range as lag from range(0, 4)),
num as (select a.user_id, lags.lag, sum(a.d * b.d) as num from d a, lags, d b
        where b.user_id = a.user_id and b.t = a.t + lags.lag group by all)
select n.user_id, n.lag, round(n.num / z.num, 8) as acf from num n join num z
  on z.user_id = n.user_id and z.lag = 0""")
def user_value_acf(spark, sf):
    e = table(spark, sf, "events")
    idx = W.dense_index(e, ["ts", "event_id"], partition_cols=["user_id"], index_col="t")
    r = W.acf(idx, "user_id", "t", "value", 3)
    return r.withColumn("acf", F.round("acf", 8))


@query("doc_row_ids", "A5", """
select doc_id, row_number() over (order by doc_id) - 1 as row_id from documents""")
def doc_row_ids(spark, sf):
    return W.with_row_id(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query("orders_head", "S1", """
select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit 10""")
def orders_head(spark, sf):
    return S.head(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), 10,
                  ["o_orderdate", "o_orderkey"])


@query("orders_tail", "S1", """
select o_orderkey, o_orderdate from orders order by o_orderdate desc nulls last, o_orderkey desc limit 10""")
def orders_tail(spark, sf):
    return S.head(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), 10,
                  ["o_orderdate", "o_orderkey"], ascending=False)


@query("top_order_prices", "S2", """
select o_orderkey, o_totalprice from orders where o_totalprice is not null
order by o_totalprice desc, o_orderkey limit 20""")
def top_order_prices(spark, sf):
    return S.top_values(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20,
                        key="o_orderkey")


@query("customers_f_and_o", "U1", """
select o_custkey from orders where o_orderstatus = 'F'
intersect select o_custkey from orders where o_orderstatus = 'O'""")
def customers_f_and_o(spark, sf):
    o = table(spark, sf, "orders")
    return S.intersect_keys(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


@query("doc_text_stats", "X1 X2 X3 X5", """
select doc_id,
  cast(length(replace(replace(text, chr(10) || chr(10), ' '), chr(10), ' ')) as integer) as content_length,
  cast(length(text) as integer) as raw_length,
  regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g') as first_line,
  array_to_string(string_split(lang || '-' || source, '-'), '/') as lang_source
from documents""")
def doc_text_stats(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.text_length("text", clean=True).alias("content_length"),
                    P.text_length("text").alias("raw_length"),
                    P.strip(F.get(F.split("text", "\n"), 0)).alias("first_line"),
                    F.array_join(F.split(F.concat_ws("-", "lang", "source"), "-"), "/").alias("lang_source"))


@query("order_dates", "X7 X8 X9", """
with o as (select o_orderkey, case when o_orderstatus = 'P' then null else cast(o_orderdate as date) end as d
           from orders), i as (select o_orderkey, coalesce(d, date '1998-08-02') as d from o)
select o_orderkey, strftime(d, '%Y') as year, strftime(d, '%m') as month, strftime(d, '%d') as day,
       cast(date '2024-02-29' - d as integer) as days_count from i""")
def order_dates(spark, sf):
    from ..plans.stages import impute_date
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.to_date("o_orderdate"))
        .alias("d"))
    o = impute_date(o, "d", "1998-08-02")
    return o.select("o_orderkey", F.col("Year").alias("year"), F.col("Month").alias("month"),
                    F.col("Day").alias("day"), F.col("Days_count").alias("days_count"))


@query("lines_lgamma", "X14 X13 M7", """
with n as (select l_orderkey, count(*) as y from lineitem group by 1), m as (select avg(y) as mu from n)
select l_orderkey, round(lgamma(y + 1), 6) as lgamma_y1, round(y * ln(mu) - mu - lgamma(y + 1), 6) as logpmf
from n, m""")
def lines_lgamma(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("y"))
    mu = n.agg(F.avg("y")).collect()[0][0]  # one scalar
    return n.select("l_orderkey", F.round(lgamma(F.col("y") + 1), 6).alias("lgamma_y1"),
                    F.round(poisson_logpmf("y", F.lit(mu)), 6).alias("logpmf"))
