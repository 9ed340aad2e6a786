"""Registered queries: the workflow's stages one after the other,
on three exports shaped from ``events`` and articles from ``pages``."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules as R
from ..session import cut_lineage, stage_path, table
from ..sources.io import read_report
from ..sources.pages import Field
from . import stages as ST
from .q_text import SQL_H1, SQL_NAV, _sql_lexicon, _sql_strip, _sql_unescape, lexicon
from .registry import query

HEAD = ["Edad", "Usuarios", "Usuarios nuevos", "Duración media de la sesión", "Páginas/sesión", "Sesiones", "Porcentaje de rebote"]
TOPICS = ["Fútbol", "Ucrania", "Cine"]
SYNONYMS = {"Guerra": "Ucrania"}
# What the given pages have in place of the reference's article markup.
FIELDS = {"Title": Field("text", "article h2"), "Subtitle": Field("attr", "html", attr="lang"), "Author": Field("text", "footer b"),
          "Date": Field("attr", "time", attr="datetime", max_len=10), "Content": Field("paragraphs", "nav li")}
BACKFILL = {"Title": Field("text", "h1"), "Author": Field("text", "footer i")}


def _metrics(spark, sf) -> DataFrame:
    """One article per user: its page and metrics as raw export text."""
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.round(F.avg("value"), 2).alias("v"))
    p = table(spark, sf, "pages").select("page_id", "url")
    comma = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    text = [F.when(F.col("user_id") % 10 == 0, "25-34").otherwise("18-24").alias("Edad"),
            F.translate(F.format_number(F.col("n") * 37, 0), ",", ".").alias("Usuarios"),
            F.col("clicks").cast("string").alias("Usuarios nuevos"),
            F.concat(F.lit("00:"), F.lpad((F.col("n") % 60).cast("string"), 2, "0"), F.lit(":05")).alias("Duración media de la sesión"),
            comma(F.col("v")).alias("Páginas/sesión"), F.translate(F.format_number(F.col("n") * 41, 0), ",", ".").alias("Sesiones"),
            F.concat(comma(F.col("clicks") * 100 / F.col("n")), F.lit("%")).alias("Porcentaje de rebote")]
    return e.join(p, e.user_id == p.page_id).select("user_id", "url", *text)


def _written_report(spark, df: DataFrame, dim: str) -> DataFrame:
    """The rows as export files, each with six preamble lines and a header, and
    read back as reports (A1)."""
    names = [dim, *HEAD]
    path = stage_path(spark, "export")

    def lines(batches):
        import csv
        import io
        first = True
        for b in batches:
            out = io.StringIO()
            w = csv.writer(out, lineterminator="\n")
            if first:
                out.write("# export\n# site\n# period\n#\n# rows\n#\n")
                w.writerow(names)
                first = False
            w.writerows(b.itertuples(index=False))
            yield pd.DataFrame({"value": out.getvalue().split("\n")[:-1]})

    df.select(F.col(df.columns[0]).alias(dim), *HEAD).repartition(3, dim).mapInPandas(lines, "value string").write.text(path)
    return read_report(spark, path, skip_rows=6, positions=True)


def reports(spark, sf):
    m = cut_lineage(_metrics(spark, sf))
    tag = F.element_at(F.array(*[F.lit(t) for t in ("Cine,Fútbol", "Guerra,Cine", "Otra", "Fútbol")]), (F.col("user_id") % 4 + 1).cast("int"))
    url = m.select("url", *HEAD)
    author = m.select(F.concat(F.lit("Ana Autor"), F.col("user_id") % 17), *HEAD).union(m.select(F.lit("Zoe Otra"), *HEAD))
    tags = m.select(tag, *HEAD).union(m.select(F.lit("A"), *HEAD))
    return (_written_report(spark, url, "url (cd 41)"), _written_report(spark, author, "autores (cd 6)"),
            _written_report(spark, tags, "tags (cd 20)"))


def articles(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages")
    return ST.article_table(*reports(spark, sf), pages, topics=TOPICS, synonyms=SYNONYMS, fields=FIELDS, drop_tokens=["?page="])


_ITEMS = (f"coalesce(array_to_string([{_sql_strip(_sql_unescape(chr(114) + 'egexp_replace(x, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')'))}"
          f" for x in regexp_extract_all({SQL_NAV}, '(?s)<li>(.*?)</li>', 1)], chr(10)), '')")
SQL_ARTICLES = f"""ev as (select user_id, count(*) as n, count(*) filter (where event_type = 'click') as clicks, round(avg(value), 2) as v
  from events group by 1),
art as materialized (select p.url as "URL", p.html, n * 37 as "Users", clicks as "New_users", cast((n % 60) * 60 + 5 as double) as "Avg_session",
  v as "Pages_session", n * 41 as "Sessions", round(clicks * 100.0 / n, 2) as "P_rebound", 'Ana Autor' || (user_id % 17) as "Author",
  ['Cine,Fútbol', 'Guerra,Cine', 'A', 'Fútbol'][user_id % 4 + 1] as "Tags", {_ITEMS} as "Content",
  nullif(regexp_extract(p.url, '^[a-z]+://[^/]+/+([^/?#]+)', 1), '') as "Section",
  regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1) as "Subtitle"
  from ev join pages p on p.page_id = ev.user_id where user_id % 10 <> 0 and not contains(p.url, '?page='))"""


@query("stage_articles", "A1 A4 B9 J1 C1 X6 P7 A5", f"""with {SQL_ARTICLES}
select "URL", "Users", "New_users", "Avg_session", "Pages_session", "Sessions", "P_rebound", "Author", "Tags", "Section",
  cast(null as varchar) as "Title", "Subtitle", md5("Content") as content_md5 from art""")
def stage_articles(spark, sf):
    """Stage 3.1: exports with preambles → cleaned, joined on six metrics,
    sections, article fields."""
    a = articles(spark, sf)
    return a.select("URL", "Users", "New_users", "Avg_session", "Pages_session", "Sessions", "P_rebound", "Author", "Tags", "Section",
                    "Title", "Subtitle", F.md5(F.col("Content").cast("binary")).alias("content_md5"))


def modelling(spark, sf) -> DataFrame:
    names = spark.createDataFrame([("ana", "F"), ("ana", "M"), ("zoe", "F")], "first_name string, gender string")
    aliases = spark.createDataFrame([("Ana Autor3", "Ana Autor4")], "key string, value string")
    fixes = spark.createDataFrame([("Ana Autor5", "M")], "key string, value string")
    return ST.modelling_table(articles(spark, sf), table(spark, sf, "pages"), TOPICS, SYNONYMS, author_aliases=aliases, names=names,
                              gender_overrides=fixes, lexicon=lexicon(spark, sf), min_section=20, fields=BACKFILL)


_EMO = "(select word, emotion from lex)"
SQL_MODEL = f"""{SQL_ARTICLES}, {_sql_lexicon('benchmark')},
kept as materialized (select *, case when contains(html, '<h1') then {SQL_H1} end as "Title",
  case when "Author" = 'Ana Autor3' then 'Ana Autor4' else "Author" end as author2,
  case "Tags" when 'Cine,Fútbol' then 'Cine' when 'Guerra,Cine' then 'Ucrania' when 'Fútbol' then 'Fútbol' end as "Topics"
  from art where regexp_matches("Content", '\\S')),
emo as (select "URL", sum(case when emotion = 'joy' and f = 't' then 1 else 0 end) as joy_title,
    sum(case when emotion = 'fear' and f = 'c' then 1 else 0 end) as fear_content from
  (select "URL", 't' as f, unnest(regexp_split_to_array(lower("Title"), '[^\\p{{L}}'']+')) as word from kept
   union all select "URL", 'c', unnest(regexp_split_to_array(lower("Content"), '[^\\p{{L}}'']+')) from kept) t join lex using (word) group by 1),
fa as (select author2, count(*) as fa from kept group by 1),
qa as (select quantile_cont(fa::double, [0.25, 0.5, 0.75]) as q from fa),
fs as (select "Section", count(*) as fs from kept group by 1),
d6 as materialized (select k.*, length("Title") as title_length, length(replace(replace("Content", chr(10) || chr(10), ' '), chr(10), ' ')) as content_length,
  coalesce(joy_title, 0) as joy_title, coalesce(fear_content, 0) as fear_content,
  case when fa <= q[1] then 'Q1' when fa <= q[2] then 'Q2' when fa <= q[3] then 'Q3' else 'Q4' end as author_quartiles,
  case when author2 = 'Ana Autor5' then 'M' else 'F' end as author_gender,
  case when fs >= 20 then k."Section" end as section2
  from kept k left join emo using ("URL") join fa using (author2) join fs on fs."Section" is not distinct from k."Section", qa)"""


@query("stage_modelling", "C5 X9 J7 X2 T5 F1 W2 J4 F2 J5 F3", f"""with {SQL_MODEL}
select "URL", "Users", "Title", title_length as "Title_length", content_length as "Content_length", cast(joy_title as bigint) as joy_title,
  cast(fear_content as bigint) as fear_content, "Topics", author2 as "Author", author_quartiles, author_gender as "Author_gender",
  section2 as "Section", '2024' as "Year", date_diff('day', date '2024-01-01', date '2024-02-29') as "Days_count" from d6""")
def stage_modelling(spark, sf):
    """Stage 3.2: back-filled titles measured and scored, topics, one row per
    URL, aliases, bands, gender with overrides, rare sections."""
    return modelling(spark, sf).select(
        "URL", "Users", "Title", "Title_length", "Content_length", F.col("joy_title").cast("long").alias("joy_title"),
        F.col("fear_content").cast("long").alias("fear_content"), "Topics", "Author", "author_quartiles", "Author_gender", "Section",
        "Year", F.col("Days_count").cast("long").alias("Days_count"))


RULE_FACTORS = ["Topics", "author_quartiles", "Author_gender", "Section"]


@query("stage_rules", "F11 M13 M14 W3 M15 M16 M17", f"""with {SQL_MODEL},
it as (select list_sort([x for x in ['Topics=' || "Topics", 'author_quartiles=' || author_quartiles, 'Author_gender=' || author_gender,
  'Section=' || section2] if x is not null]) as l from d6),
n as (select count(*) as n from it),
fs2 as (select s, count(*) as c from (select [l[i] for i in generate_series(1, len(l)) if (m >> (i - 1)) & 1 = 1] as s from it,
  range(1, 16) r(m) where m < pow(2, len(l))) group by 1 having count(*) >= 0.1 * (select n from n)),
cand as (select [x for x in s if x <> y] as a, y, c from (select s, c, unnest(s) as y from fs2 where len(s) > 1)),
ru as (select a, y, round(k.c / n, 10) as sup, round(k.c / fa.c, 10) as conf, round((k.c / fa.c) / (fy.c / n), 10) as lift
  from cand k join fs2 fa on fa.s = a join fs2 fy on fy.s = [y], n where k.c / fa.c >= 0.5
  union all select [], s[1], round(c / n, 10), round(c / n, 10), 1.0 from fs2, n where len(s) = 1 and c / n >= 0.5),
rk as (select *, row_number() over (order by lift desc, conf desc, sup desc, array_to_string(a, chr(1)), y) as rank,
  list_sort(list_append(a, y)) as items from ru),
pr as (select * from rk j where not exists (select 1 from rk i where i.rank < j.rank and list_has_all(j.items, i.items))),
mine as (select * from pr where contains(y, 'author_quartiles'))
select item, cast(count(*) as bigint) as n, 'all' as rules from (select unnest(a) as item from pr) group by 1
union all select item, cast(count(*) as bigint), 'response' from (select unnest(a) as item from mine) group by 1""")
def stage_rules(spark, sf):
    """Stage 3.3a: rules over the modelling table's factors, pruned; how often
    items stand in the antecedents of all and of the response's rules."""
    d6 = cut_lineage(modelling(spark, sf).select(*RULE_FACTORS))
    from ..operators.features import to_items
    rules = R.mine_rules(to_items(d6, RULE_FACTORS), min_support=0.1, min_confidence=0.5)
    rules = rules.select("antecedent", "consequent", *[F.round(c, 10).alias(c) for c in ("support", "confidence", "lift")], "count")
    pruned = cut_lineage(R.prune_redundant(rules))
    mine = R.response_rules(pruned, "author_quartiles")
    return R.antecedent_freq(pruned).select("item", "n", F.lit("all").alias("rules")).unionByName(
        R.antecedent_freq(mine).select("item", "n", F.lit("response").alias("rules")))


@query("stage_models", "M4 M5 M6 M8 M9 F6 F7", f"""with {SQL_MODEL},
g as (select author_quartiles as lv, avg("Users") as m, sum("Users") as s, count(*)::double as k from d6 group by 1),
b as (select * from g where lv = (select min(lv) from g)),
st as (select sum(power("Users" - m, 2) / m) / (count(*) - (select count(*) from g)) as phi from d6 join g on lv = author_quartiles),
c as (select '(Intercept)' as term, ln(b.m) as est, sqrt(1 / b.s) as se from b
  union all select 'author_quartiles_' || g.lv, ln(g.m / b.m), sqrt(1 / b.s + 1 / g.s) from g, b where g.lv <> b.lv)
select fit, term, round(est, 6) as estimate, round(se * case when fit = 'quasi' then sqrt(phi) else 1 end, 6) as std_error
from c, st, (select unnest(['poisson', 'quasi', 'poisson_scaled', 'poisson_dummies']) as fit)""")
def stage_models(spark, sf):
    """Stage 3.3b: the count models of the modelling table, one factor."""
    d6 = cut_lineage(modelling(spark, sf).select("Users", "author_quartiles"))
    fits = ST.model_stage(d6, "Users", factors=["author_quartiles"])
    out = None
    for name in ("poisson", "quasi", "poisson_scaled", "poisson_dummies"):
        c = fits[name].coefficients(spark).select(F.lit(name).alias("fit"), "term", F.round("estimate", 6).alias("estimate"),
                                                  F.round("std_error", 6).alias("std_error"))
        out = c if out is None else out.unionByName(c)
    for f in fits.values():
        if hasattr(f, "design"):
            f.design.free()
    return out
