"""Mixing sources to target weights: raking, then sampling.

Tokens are summed per cell (one level of every dimension), cell ratios are
raked by iterative proportional fitting until the weighted tokens of every
level of every dimension meet their targets, and each document comes as often
as its cell's ratio says: the whole part of it as copies, one more by a draw
below the rest. So the kept tokens meet the targets but for the draws, also where
a small source has to be repeated.

All sums are grouped in Spark: documents are pre-aggregated to cells, and the
fitting works on the cell table with one window per dimension, so no number of
sources, languages or topics meets on the driver.

Defined results: NULL is a level like any other; a level without tokens, or
with target zero and no tokens, leaves its cells' ratios as they are; a level
with target zero gets ratio zero; rows with equal ids share their draw; an
empty table gives an empty result. The fit ends when no factor of a sweep
differs from one by more than ``tol``. Targets that contradict each other (a
source that alone holds a language) have no such fit: ``rake`` raises after
``max_sweeps``, or, if not ``strict``, returns the last sweep as soon as sweeps
no longer change the ratios; then the last dimension's targets are met and
``gaps`` tells what the others lack. ``calibrated`` is not strict.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: documents have no topic column; as a stand-in for a topic model the first rule
#: that holds names the topic
TOPIC_RULES = [
    ("empty", "text IS NULL OR trim(text) = ''"),
    ("license", "contains(text, 'icense')"),
    ("table", "contains(text, ' | ')"),
    ("shouting", "contains(text, '!!')"),
    ("symbols", "contains(text, '***') OR contains(text, '%%%') OR contains(text, '$$$')"),
    ("letters", "contains(text, 'Dear ') OR contains(text, '@')"),
]


def topic(text_col: str = "text"):
    cases = " ".join(f"WHEN {rule.replace('text', f'`{text_col}`')} THEN '{name}'" for name, rule in TOPIC_RULES)
    return F.expr(f"CASE {cases} ELSE 'prose' END")


def token_count(text_col: str = "text"):
    words = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def draw(id_: Column, seed: int = 42):
    """A uniform number in [0, 1) from the id: 52 bits of an md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def flattened(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, share): target shares proportional to token share ** power."""
    levels = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    total = levels.agg(F.sum(F.pow("t", F.lit(power)))).first()[0] or 1.0
    return levels.select(dim, (F.pow("t", F.lit(power)) / F.lit(float(total))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float, tol: float = 1e-10,
         max_sweeps: int = 200, strict: bool = True) -> DataFrame:
    """Cells (dimensions, tokens) with one more column: ``ratio``. ``targets``
    has (level, share) per dimension; shares are of ``budget`` tokens."""
    now = cells.withColumn("ratio", F.lit(1.0))
    for dim, want in targets.items():
        w = want.select(F.col(dim).alias("__level"), (F.col("share") * F.lit(float(budget))).alias(f"__want_{dim}"))
        now = now.join(w, F.col(dim).eqNullSafe(F.col("__level")), "left").drop("__level")
    now, kept = written(now, "cells"), [*cells.columns, "ratio", *[f"__want_{d}" for d in targets]]
    for _ in range(max_sweeps):
        step, moved = now.withColumn("__old", F.col("ratio")), []
        for dim in targets:
            have = F.sum(F.col("tokens") * F.col("ratio")).over(Window.partitionBy(dim))
            step = step.withColumn("__have", have).withColumn(
                f"__f_{dim}", F.when(F.col("__have") > 0, F.coalesce(F.col(f"__want_{dim}"), F.lit(0.0)) / F.col("__have"))
                .otherwise(1.0)).withColumn("ratio", F.col("ratio") * F.col(f"__f_{dim}"))
            moved.append(F.abs(F.col(f"__f_{dim}") - 1))
        change = F.when(F.col("__old") > 0, F.abs(F.col("ratio") / F.col("__old") - 1)).otherwise(F.col("ratio"))
        after = written(step.select(*kept, reduce(F.greatest, moved).alias("__moved"), change.alias("__change")), "cells")
        dropped(now)
        far, change = after.agg(F.max("__moved"), F.max("__change")).first()
        now = after.select(*kept)
        if far is None or far <= tol or (not strict and change <= tol):
            return now.select(*cells.columns, "ratio")
    if not strict:
        return now.select(*cells.columns, "ratio")
    raise ValueError(f"no fit after {max_sweeps} sweeps: the targets contradict each other (last factor off by {far})")


def gaps(fit: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """(dim, level, want, have) of every level: tokens wanted and weighted."""
    out = []
    for dim, want in targets.items():
        have = fit.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("ratio")).alias("have"))
        w = want.select(F.col(dim).alias("__level"), (F.col("share") * F.lit(float(budget))).alias("want"))
        out.append(have.join(w, F.col(dim).eqNullSafe(F.col("__level")), "left").select(
            F.lit(dim).alias("dim"), F.col(dim).cast("string").alias("level"), F.coalesce("want", F.lit(0.0)).alias("want"), "have"))
    return reduce(DataFrame.unionByName, out)


def calibrated(docs: DataFrame, dims: list[str], power: float = 0.8, budget_share: float = 1.0, seed: int = 42,
               id_col: str = "doc_id", tokens_col: str = "n_tokens") -> DataFrame:
    """(row, ratio, prob, draw, copies, kept): ``row`` is a row of ``docs``, which
    has ``dims`` and ``tokens_col``; its names cannot clash with the others.
    Targets: the token share of every level to ``power``, of ``budget_share`` of
    all tokens. ``prob`` is the chance that the row is kept at all."""
    cells = written(docs.groupBy(*dims).agg(F.sum(tokens_col).alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fit = rake(cells, {d: flattened(cells, d, power) for d in dims}, total * budget_share, strict=False)
    fit = fit.select(*[F.col(d).alias(f"d{i}") for i, d in enumerate(dims)], "ratio")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = reduce(lambda a, b: a & b, [F.col("row")[d].eqNullSafe(F.col(f"d{i}")) for i, d in enumerate(dims)])
    whole = F.floor("ratio").cast("long")
    return (rows.join(fit, same).select("row", "ratio", F.least(F.lit(1.0), F.col("ratio")).alias("prob"),
                                        draw(F.col("row")[id_col], seed).alias("draw"))
            .withColumn("copies", whole + (F.col("draw") < F.col("ratio") - whole).cast("long"))
            .withColumn("kept", F.col("copies") > 0))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The sampled rows of ``docs``, columns as they are, each as often as drawn."""
    had = docs.columns
    c = docs.select(F.col("doc_id"), "source", "lang", topic().alias("topic"), token_count().alias("n_tokens"),
                    F.struct(*[F.col(f"`{x}`") for x in had]).alias("had"))
    drawn = calibrated(c, ["source", "lang", "topic"], **kw).where("kept")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.had.*")


def oracle(power: float = 0.8, budget_share: float = 1.0, seed: int = 42, sweeps: int = 40) -> str:
    """The same in DuckDB SQL, with a fixed number of sweeps."""
    dims = ["source", "lang", "topic"]
    cases = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in TOPIC_RULES)
    ctes = [
        f"docs AS (SELECT doc_id, source, lang, CASE {cases} ELSE 'prose' END AS topic, "
        "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents)",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)"]
    for d in dims:
        ctes.append(f"l_{d} AS (SELECT {d}, sum(tokens) AS t FROM cells GROUP BY ALL)")
        ctes.append(f"w_{d} AS (SELECT {d}, pow(t, {power}) / (SELECT sum(pow(t, {power})) FROM l_{d}) * {budget_share} "
                    f"* (SELECT sum(tokens) FROM cells) AS want_{d} FROM l_{d})")
    ctes.append("s0 AS (SELECT cells.*, want_source, want_lang, want_topic, 1.0::DOUBLE AS ratio FROM cells "
                + " ".join(f"JOIN w_{d} ON cells.{d} IS NOT DISTINCT FROM w_{d}.{d}" for d in dims) + ")")
    n = 0
    for _ in range(sweeps):
        for d in dims:
            n += 1
            ctes.append(f"s{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN h > 0 THEN ratio * want_{d} / h ELSE ratio END AS ratio) "
                        f"FROM (SELECT *, sum(tokens * ratio) OVER (PARTITION BY {d}) AS h FROM (SELECT * EXCLUDE (h) FROM s{n - 1})))"
                        if n > 1 else
                        f"s{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN h > 0 THEN ratio * want_{d} / h ELSE ratio END AS ratio) "
                        f"FROM (SELECT *, sum(tokens * ratio) OVER (PARTITION BY {d}) AS h FROM s{n - 1}))")
    u = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0"
    same = " AND ".join(f"docs.{d} IS NOT DISTINCT FROM s{n}.{d}" for d in dims)
    more = f"{u} < ratio - floor(ratio)"
    return (f"WITH {', '.join(ctes)} SELECT doc_id, docs.source, docs.lang, docs.topic, n_tokens, round(least(1.0, ratio), 6) AS prob, "
            f"round(ratio, 6) AS ratio, round({u}, 9) AS draw, CAST(floor(ratio) + CAST({more} AS INTEGER) AS BIGINT) AS copies, "
            f"ratio >= 1 OR {more} AS kept FROM docs JOIN s{n} ON {same}")
