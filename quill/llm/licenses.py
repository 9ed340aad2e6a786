"""License scans: sparse TF-IDF cosine to templates, then inheritance by path.

Every line of a text that holds a licence cue is scanned as one sparse vector:
term frequency times an inverse document frequency counted over all scanned
lines. Its cosine to each template decides the line's licence. A document's
own licence is its best line's. A document that is little else than such lines
counts as a licence file of its directory; documents without a licence of
their own take that of the nearest directory above them that has a file.

DataFrame functions only. What is broadcast has at most as many rows as the
templates have terms and ``HOT``. Lines are scored where they are, so a line that a third
of all documents share needs no join on its text; directories are resolved on
the table of distinct directories.

Defined results: NULL and empty texts have no licence of their own but
inherit; NULL path: no directory, nothing inherited; ties go to the licence
first by name; repeated rows get equal results; columns not named here pass
through untouched in ``row``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Short licence statements as they stand in file headers.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
]
# A line is scanned if it holds one of these (lower case).
CUES = ["licens", "licenc", "copyright", "permission is", "redistribut", "spdx", "cc by"]
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
ROOT = "."
HOT = 10000  # terms that may be broadcast because many lines hold them


def templates_of(spark: SparkSession, templates) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "t long, license string, text string")


def _terms(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, term, tf) of a lower-cased text."""
    return (df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term"))
            .groupBy(*keys, "term").agg(F.count("*").alias("tf")))


def cue_lines(docs: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """(id, path, line_no, line) of lines that hold a cue; equal rows once."""
    holds = lambda c: F.expr(" OR ".join(f"contains(lower({c}), '{x}')" for x in CUES))
    return (docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
            .where(holds("text"))
            .select("id", "path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
            .where(holds("line")).distinct())


def line_scores(spark: SparkSession, lines: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(id, path, line_no, terms, license, cosine): every line's best licence."""
    unit = ["id", "path", "line_no"]
    tf = written(_terms(lines, "line", *unit), "license-terms")
    n = lines.count()
    want = _terms(templates_of(spark, templates), "text", "t", "license")
    vocabulary = want.select("term").distinct()  # at most the templates' terms
    df = written(tf.groupBy("term").agg(F.count("*").alias("df")), "license-df")
    total = df.agg(F.sum("df")).first()[0] or 0
    in_lines = F.log((1.0 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1
    idf = F.broadcast(vocabulary).join(df, "term", "left").select("term", in_lines.alias("idf"))
    weight = want.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    size = weight.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    weight = weight.join(size, "t").groupBy("term").agg(F.collect_list(F.struct(
        "t", "license", (F.col("w") / F.col("size")).alias("w"))).alias("to"))
    # at most HOT terms hold more than total / HOT rows: these and the templates' are broadcast, the others joined by a shuffle
    other = df.join(F.broadcast(vocabulary), "term", "left_anti").select("term", "df", in_lines.alias("idf"))
    near = written(idf.join(weight, "term").unionByName(other.where(F.col("df") * HOT > total).select("term", "idf"), True), "license-hot")
    rest = other.where(F.col("df") * HOT <= total).select("term", "idf")
    v = (tf.join(F.broadcast(near), "term").unionByName(
        tf.join(F.broadcast(near.select("term")), "term", "left_anti").join(rest, "term"), True)
        .withColumn("v", F.col("tf") * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")))
    lengths = v.groupBy(*unit).agg(norm.alias("norm"), F.sum("tf").alias("terms"))
    dots = (v.select(*unit, "v", F.explode("to").alias("to"))
            .groupBy(*unit, "to.t", "to.license").agg(F.sum(F.col("v") * F.col("to.w")).alias("dot"))
            .groupBy(*unit).agg(F.min(F.struct((-F.round("dot", 9)).alias("less"), F.col("license"))).alias("best")))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & F.col("a.path").eqNullSafe(F.col("b.path")) \
        & (F.col("a.line_no") == F.col("b.line_no"))
    return lengths.alias("a").join(dots.alias("b"), same).select(
        "a.id", "a.path", "a.line_no", "terms", "best.license", (-F.col("best.less") / F.col("norm")).alias("cosine"))


def scan(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
         least: float = 0.6, file_share: float = 0.5, templates=TEMPLATES) -> DataFrame:
    """(row, own_license, own_cosine, is_file, inherited_license,
    inherited_from, license): one row per input row."""
    spark = docs.sparkSession
    lines = cue_lines(docs, id_col, path_col, text_col)
    hits = line_scores(spark, lines, templates).where(F.col("cosine") >= least)
    own = hits.groupBy("id", "path").agg(
        F.min(F.struct((-F.round("cosine", 9)).alias("less"), "license")).alias("best"), F.sum("terms").alias("terms"))
    all_terms = F.size(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}0-9]+(?:\.[0-9]+)*"), F.lit(0)))
    row = docs.select(F.col(id_col).alias("__id"), F.col(path_col).alias("__path"),
                      F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
                      F.when(F.expr(" OR ".join(f"contains(lower(`{text_col}`), '{x}')" for x in CUES)), all_terms).alias("__all"))
    same = F.col("__id").eqNullSafe(F.col("id")) & F.col("__path").eqNullSafe(F.col("path"))
    rows = written(row.join(own, same, "left").select(
        "row", F.regexp_extract("__path", "^(.*)/[^/]*$", 1).alias("dir0"), "__path",
        F.col("best.license").alias("own_license"), (-F.col("best.less")).alias("own_cosine"),
        (F.coalesce(F.col("terms") >= file_share * F.col("__all"), F.lit(False))).alias("is_file"))
        .withColumn("dir", F.when(F.col("__path").isNotNull(), F.when(F.col("dir0") == "", ROOT).otherwise(F.col("dir0"))))
        .drop("dir0", "__path"), "license-rows")
    files = (rows.where("is_file AND dir IS NOT NULL").groupBy("dir", "own_license").count()
             .groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("less"), "own_license")).alias("f"))
             .select(F.col("dir").alias("above"), F.col("f.own_license").alias("inherited_license")))
    parts = F.split("dir", "/")
    ups = F.expr("transform(sequence(1, size(parts)), i -> struct(i AS depth, concat_ws('/', slice(parts, 1, i)) AS above))")
    nearest = (rows.where("dir IS NOT NULL").select("dir").distinct().withColumn("parts", parts)
               .select("dir", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit(ROOT).alias("above"))), ups)).alias("u"))
               .select("dir", "u.depth", "u.above").join(files, "above")
               .groupBy("dir").agg(F.max(F.struct("depth", "above", "inherited_license")).alias("n"))
               .select("dir", F.col("n.above").alias("inherited_from"), "n.inherited_license"))
    nearest = written(nearest, "license-dirs")  # a table of its own, so a directory with many rows can be split in the join
    bare = F.col("own_license").isNull()
    return rows.join(nearest, "dir", "left").select(
        "row", "own_license", "own_cosine", "is_file",
        F.when(bare, F.col("inherited_license")).alias("inherited_license"),
        F.when(bare, F.col("inherited_from")).alias("inherited_from"),
        F.coalesce("own_license", "inherited_license").alias("license"))


def oracle(path: str, least: float = 0.6, file_share: float = 0.5, templates=TEMPLATES) -> str:
    """``scan`` of ``documents`` in DuckDB SQL; ``path`` is an SQL expression."""
    cue = "(" + " OR ".join(f"contains(lower({{c}}), '{x}')" for x in CUES) + ")"
    rows = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(templates))
    every = r"[\p{L}0-9]+(?:\.[0-9]+)*"
    return f"""
WITH docs AS (SELECT doc_id, {path} AS path, text FROM documents),
temps(t, license, text) AS (VALUES {rows}),
cut AS (SELECT DISTINCT doc_id, path, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM docs WHERE {cue.format(c='text')}),
lines AS (SELECT doc_id, path, line_no, line FROM
  (SELECT doc_id, path, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM cut) WHERE {cue.format(c='line')}),
n AS (SELECT count(*) AS n FROM lines),
tf AS (SELECT doc_id, path, line_no, term, count(*) AS tf FROM
  (SELECT doc_id, path, line_no, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM lines) GROUP BY ALL),
want AS (SELECT t, license, term, count(*) AS tf FROM
  (SELECT t, license, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM temps) GROUP BY ALL),
vocab AS (SELECT DISTINCT term FROM want),
idf AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1 + count(doc_line))) + 1 AS idf FROM
  (SELECT term, line_no AS doc_line FROM tf UNION ALL SELECT term, NULL FROM vocab) GROUP BY term),
weight AS (SELECT t, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w
  FROM want JOIN idf USING (term)),
v AS (SELECT tf.*, tf * idf AS v FROM tf JOIN idf USING (term)),
norms AS (SELECT doc_id, path, line_no, sqrt(sum(v * v)) AS norm, sum(tf) AS terms FROM v GROUP BY ALL),
dots AS (SELECT doc_id, path, line_no, t, license, round(sum(v * w), 9) AS dot FROM v JOIN weight USING (term) GROUP BY ALL),
hits AS (SELECT d.*, dot / norm AS cosine, terms FROM
  (SELECT * FROM dots QUALIFY row_number() OVER (PARTITION BY doc_id, path, line_no ORDER BY dot DESC, license) = 1) d
  JOIN norms USING (doc_id, path, line_no) WHERE dot / norm >= {least}),
own AS (SELECT doc_id, path, license, cosine, terms FROM (SELECT doc_id, path, license, round(cosine, 9) AS cosine,
  sum(terms) OVER (PARTITION BY doc_id, path) AS terms FROM hits)
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY cosine DESC, license) = 1),
marked AS (SELECT d.doc_id, d.path, CASE WHEN contains(d.path, '/') THEN regexp_replace(d.path, '/[^/]*$', '') ELSE '{ROOT}' END AS dir,
  license AS own_license, cosine AS own_cosine,
  coalesce(terms >= {file_share} * len(regexp_extract_all(lower(text), '{every}')), false) AS is_file
  FROM docs d LEFT JOIN own ON d.doc_id IS NOT DISTINCT FROM own.doc_id AND d.path IS NOT DISTINCT FROM own.path),
files AS (SELECT dir AS above, own_license AS inherited FROM (SELECT dir, own_license, count(*) AS c FROM marked WHERE is_file GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY c DESC, own_license) = 1),
near AS (SELECT dir, above, inherited FROM (SELECT DISTINCT dir FROM marked) JOIN files
  ON above = '{ROOT}' OR dir = above OR starts_with(dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY CASE WHEN above = '{ROOT}' THEN 0 ELSE length(above) END DESC) = 1)
SELECT doc_id, path, own_license, round(own_cosine, 6) AS own_cosine, is_file,
  CASE WHEN own_license IS NULL THEN inherited END AS inherited_license,
  CASE WHEN own_license IS NULL THEN above END AS inherited_from,
  coalesce(own_license, inherited) AS license
FROM marked LEFT JOIN near USING (dir)"""
