import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.llm import mixing


def test_query_equals_sql(spark, sf, llm_queries, duck):
    got = llm_queries.op10_mixing(spark, sf).toPandas()
    want = duck.execute(llm_queries.ORACLES["op10_mixing"]).df()[list(got.columns)]
    key = ["doc_id"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert (a.kept == b.kept).all() and (a.topic == b.topic).all() and (a.copies == b.copies).all() and (a.copies > 1).any()
    assert np.allclose(a[["prob", "ratio", "draw"]], b[["prob", "ratio", "draw"]], atol=2e-6)


def test_margins_meet_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{a}", f"l{b}" if b else None, int(t)) for a in range(6) for b in range(4) for t in [rng.integers(1, 900)]]
    cells = spark.createDataFrame(rows, "s string, l string, tokens long")
    ts = spark.createDataFrame([(f"s{a}", (a + 1) / 21) for a in range(6)], "s string, share double")
    tl = spark.createDataFrame([(None, 0.1), ("l1", 0.2), ("l2", 0.3), ("l3", 0.4)], "l string, share double")
    fit = mixing.rake(cells, {"s": ts, "l": tl}, 5000.0).withColumn("w", F.col("tokens") * F.col("ratio"))
    by = {r.s: r.w for r in fit.groupBy("s").agg(F.sum("w").alias("w")).collect()}
    assert all(abs(by[f"s{a}"] - 5000 * (a + 1) / 21) < 1e-4 for a in range(6))
    by = {r.l: r.w for r in fit.groupBy("l").agg(F.sum("w").alias("w")).collect()}
    assert abs(by[None] - 500) < 1e-4 and abs(by["l3"] - 2000) < 1e-4


def test_targets_that_contradict(spark):
    cells = spark.createDataFrame([("a", "x", 5), ("b", "y", 5)], "s string, l string, tokens long")
    ts = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "s string, share double")
    tl = spark.createDataFrame([("x", 0.1), ("y", 0.9)], "l string, share double")
    with pytest.raises(ValueError, match="contradict"):
        mixing.rake(cells, {"s": ts, "l": tl}, 10.0, max_sweeps=3)


def test_odd_rows(spark, odd_docs, no_docs):
    kept = mixing.mix(odd_docs, power=1.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()  # targets met: all stay
    assert mixing.mix(odd_docs, power=1.0, budget_share=2.0).count() == 2 * odd_docs.count()
    assert mixing.mix(no_docs).count() == 0
    clash = odd_docs.selectExpr("*", "1 AS ratio", "2 AS prob", "3 AS kept", "4 AS row", "5 AS had", "6 AS copies", "7 AS d0")
    assert mixing.mix(clash, power=1.0).columns == clash.columns


def test_kept_tokens_meet_their_targets(spark):
    """Levels with ratios above and below one, within the error of the draws."""
    n = 24000
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 12 == 2, "rare").otherwise("other").alias("source"),
        F.when(F.col("id") % 5 == 0, "fr").otherwise("en").alias("lang"), (5 + F.col("id") % 11).alias("n_tokens"))
    got = mixing.calibrated(docs, ["source", "lang"], power=0.3).select("row.*", "ratio", "prob", "copies", "kept")
    assert got.agg(F.max("ratio")).first()[0] > 1.5 and got.where("kept != (copies > 0) OR prob > 1").count() == 0
    cells = docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"))
    total = docs.agg(F.sum("n_tokens")).first()[0]
    for dim in ("source", "lang"):
        want = {r[dim]: r["share"] * total for r in mixing.flattened(cells, dim, 0.3).collect()}
        have = got.groupBy(dim).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"),
                                    F.sqrt(F.sum(F.pow("n_tokens", F.lit(2)) / 4)).alias("sd")).collect()
        assert len(have) == len(want) and all(abs(r["t"] - want[r[dim]]) < 4 * r["sd"] for r in have)


def test_a_source_with_a_language_of_its_own(spark):
    """Contradicting margins have a result, and what they lack is told."""
    rows = [("hot", "en", 900), ("hot", "de", 300), ("a", "en", 100), ("a", "de", 120), ("b", "en", 70), ("b", "de", 60), ("c", "fr", 40)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, n_tokens long")
    got = mixing.calibrated(docs, ["source", "lang"], power=0.5).collect()
    assert len(got) == len(rows) and all(0 < r["ratio"] < 100 for r in got)
    cells = docs.select("source", "lang", F.col("n_tokens").alias("tokens"))
    targets = {d: mixing.flattened(cells, d, 0.5) for d in ("source", "lang")}
    fit = mixing.rake(cells, targets, 1590.0, strict=False)
    gap = {(r.dim, r.level): r.have / r.want - 1 for r in mixing.gaps(fit, targets, 1590.0).collect()}
    assert len(gap) == 7 and all(abs(g) < 1e-6 for (d, _), g in gap.items() if d == "lang")
    assert abs(gap["source", "c"]) > 0.01 and max(map(abs, gap.values())) < 0.5
