import math
import re
from collections import Counter

from pyspark.sql import functions as F

from quill.llm import licenses


def brute(rows, least=0.6, share=0.5):
    """{id: (own, inherited, from)} of (id, path, text) rows, in plain Python."""
    terms = lambda s: re.findall(licenses.TERM, s.lower())
    cue = lambda s: any(c in s.lower() for c in licenses.CUES)
    lines = [(i, [x for x in re.split(r"\r\n|\r|\n", t or "") if cue(x)]) for i, _, t in rows]
    every = [Counter(terms(x)) for _, xs in lines for x in xs]
    df = Counter(t for c in every for t in c)
    idf = lambda t: math.log((1 + len(every)) / (1 + df[t])) + 1
    vec = lambda s: {t: k * idf(t) for t, k in Counter(terms(s)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def best(s):
        v, out = vec(s), []
        for name, t in licenses.TEMPLATES:
            w = vec(t)
            out.append((-sum(v[x] * w[x] for x in v if x in w) / norm(v) / norm(w), name))
        return min((round(a, 9), b) for a, b in out)
    own, is_file = {}, {}
    for (i, _, text), (_, xs) in zip(rows, lines, strict=True):
        hits = [(best(x), x) for x in xs if terms(x) and -best(x)[0] >= least]
        own[i] = min(h[0] for h in hits)[1] if hits else None
        n = len(re.findall(r"[^\W_]+(?:\.[0-9]+)*", (text or "").lower()))
        is_file[i] = bool(hits) and sum(len(terms(x)) for _, x in hits) >= share * n
    files = {}
    for i, p, _ in rows:
        if is_file[i] and p is not None:
            files.setdefault(p.rpartition("/")[0] or licenses.ROOT, Counter())[own[i]] += 1
    out = {}
    for i, p, _ in rows:
        found = (None, None)
        if own[i] is None and p is not None:
            d = p.rpartition("/")[0] or licenses.ROOT
            while True:
                if d in files:
                    found = (min(files[d].items(), key=lambda x: (-x[1], x[0]))[0], d)
                    break
                if d == licenses.ROOT:
                    break
                d = d.rpartition("/")[0] or licenses.ROOT
        out[i] = (own[i], *found)
    return out


def test_against_brute_force(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/x.txt", "some words here"), (3, "a/b/c/LICENSE", apache),
            (4, "a/b/c/d/e.py", "code"), (5, "a/b/c/d/f.py", f"words and words and words\n{mit}\nmore words of it and more"),
            (6, "z/x.py", "nothing"), (7, "top.txt", "nothing"), (8, "LICENSE", "Licensed under CC BY-NC 4.0."),
            (9, None, "no path"), (10, "q/r.txt", None), (11, "q/s.txt", ""), (12, "q/t.txt", "a driving license is not one " * 4),
            (13, "a/LICENSE2", mit), (14, "a/LICENSE3", apache), (15, "a/b/c/x", f"{mit}\r\n{apache}"),
            (16, "q/GPL", "This work is licensed under the GNU General Public License, version 3."), (16, "q/GPL", "This work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = licenses.scan(df).collect()
    want = brute(list(dict.fromkeys(rows)))
    assert len(got) == len(rows)
    for r in got:
        assert (r.own_license, r.inherited_license, r.inherited_from) == want[r.row.doc_id], r
    assert want[2] == (None, "MIT", "a") and want[4] == (None, "Apache-2.0", "a/b/c") and want[6][1] == "CC-BY-NC-4.0"


def test_query_equals_sql(spark, sf, llm_queries, duck):
    got = llm_queries.op7_license_scan(spark, sf).toPandas()
    want = duck.execute(llm_queries.ORACLES["op7_license_scan"]).df()[list(got.columns)]
    tidy = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).values.tolist()))
    assert tidy(got) == tidy(want)
    assert got.own_license.notna().sum() >= 3


def test_odd_rows(spark, odd_docs, no_docs):
    named = odd_docs.withColumnRenamed("source", "path")
    assert licenses.scan(named).count() == odd_docs.count()
    assert licenses.scan(no_docs.withColumnRenamed("source", "path")).count() == 0


def test_no_python_in_the_plan(spark, sf, llm_queries):
    plan = llm_queries.op7_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_common_extra_words_do_not_hide_a_header(spark):
    """Words that most lines hold weigh little, however many lines there are."""
    header = "Released under the MIT License by Acme Corporation."
    found = []
    for n in (40, 2000):
        docs = spark.range(n).select(
            F.col("id").alias("doc_id"), F.concat(F.lit("src/"), F.col("id")).alias("path"),
            F.when(F.col("id") % 20 == 0, header).otherwise("Copyright by Acme Corporation.").alias("text"))
        hits = licenses.scan(docs).where("row.doc_id % 20 = 0").collect()
        assert len(hits) == n // 20 and {r.own_license for r in hits} == {"MIT"}
        assert licenses.scan(docs).where("row.doc_id % 20 <> 0 AND own_license IS NOT NULL").count() == 0
        found.append(hits[0].own_cosine)
    assert abs(found[0] - found[1]) < 0.1


def test_terms_joined_by_shuffle_weigh_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"d/{i}", f"Licensed under the Apache License, Version 2.0. word{i % 3} x{i}") for i in range(30)],
                                 "doc_id long, path string, text string")
    get = lambda: sorted((r.row.doc_id, r.own_license, round(r.own_cosine, 9)) for r in licenses.scan(docs, least=0.1).collect())
    want = get()
    monkeypatch.setattr(licenses, "HOT", 0)
    assert get() == want and len(want) == 30
