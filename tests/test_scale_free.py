"""Operators that sorted, shuffled or grew with the input or their parameters."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import bayes as B
from quill.operators import features as FE
from quill.operators import windows as W
from quill.sources.io import read_report


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_report_of_several_splits(spark, tmp_path):
    for f in range(3):
        lines = [f"# note {i}" for i in range(6)] + ["a,b"] + [f'{f}-{i},"x, {i}"' for i in range(500 * f + 40)]
        (tmp_path / f"r{f}.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "3000b", "40b"):  # preamble and header may lie in several splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            if size == "40b":
                got = read_report(spark, str(tmp_path / "r0.csv"), positions=True)
                want = [(f"0-{i}", f"x, {i}", i + 7) for i in range(40)]
            else:
                got = read_report(spark, str(tmp_path), positions=True)
                want = [(f"{f}-{i}", f"x, {i}", i + 7) for f in range(3) for i in range(500 * f + 40)]
            assert sorted((r.a, r.b, r._ln) for r in got.collect()) == sorted(want)
            assert read_report(spark, str(tmp_path / "r0.csv"), max_rows=5).count() == 5
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            spark.conf.unset("spark.sql.files.openCostInBytes")
    text = plan(read_report(spark, str(tmp_path)))
    assert "RepartitionByExpression" not in text and "Sort" not in text.replace("SortMerge", "")
    (tmp_path / "other.csv").write_text("\n".join(["#"] * 6 + ["c,d", "1,2"]))
    with pytest.raises(ValueError, match="headers differ"):
        read_report(spark, str(tmp_path))


def test_split_moves_no_rows(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit("payload").alias("p"))
    rows = sorted(df.select("k", F.md5(F.concat(F.lit("7"), F.col("k").cast("string"))).alias("h")).collect(), key=lambda r: r.h)
    for few in (50_000, 3):
        monkeypatch.setattr(FE, "FEW", few)
        s = FE.split(df, "k", 0.2, seed=7)
        assert {r.k for r in s.where("is_test").collect()} == {r.k for r in rows[:1000]}
    assert "RepartitionByExpression" not in plan(s) and "Sort" not in plan(s) and "Join" not in plan(s)
    hot = df.withColumn("k", F.when(F.col("k") < 3000, 1).otherwise(F.col("k")))  # equal keys stay together
    got = FE.split(hot, "k", 0.2, seed=7)
    assert got.where("k = 1").select("is_test").distinct().count() == 1
    none = FE.split(df.withColumn("k", F.lit(None).cast("long")), "k", 0.2)
    assert none.where("is_test").count() == 5000 and FE.split(df.where("k < 0"), "k").count() == 0
    assert FE.split(df, "k", 0.0).where("is_test").count() == 0


@pytest.mark.parametrize(("n", "lags", "block"), [(50, 10, 16), (300, 299, 64), (1000, 40, 100), (5, 9, 4)])
def test_lag_sums_against_numpy(spark, monkeypatch, n, lags, block):
    monkeypatch.setattr(W, "BLOCK", block)
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), np.cumsum(rng.normal(size=n))
    gone = set(rng.choice(n, n // 10, replace=False).tolist())  # positions that are not there
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [(None, i, float(v)) for i, v in enumerate(y) if i not in gone]
    got = {(r.g, r.lag): r.acf for r in W.acf(spark.createDataFrame(rows, "g string, t long, v double").repartition(4), "g", "t", "v", lags).collect()}
    want = {}
    for g, v, out in (("a", x, set()), (None, y, gone)):
        here = np.array([i not in out for i in range(n)])
        d = np.where(here, v - v[here].mean(), 0)
        for k in range(min(lags, n - 1) + 1):
            if (here[k:] & here[:n - k]).any():
                want[g, k] = (d[k:] * d[:n - k]).sum() / (d * d).sum()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def chains(spark, rho, n=20000, m=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(m):
        e, x = rng.normal(size=n) * np.sqrt(1 - rho * rho), np.zeros(n)
        x[0] = rng.normal()
        for i in range(1, n):
            x[i] = rho * x[i - 1] + e[i]
        rows += [("p", c, i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "param string, chain int, iter long, value double")


def test_slow_chains_have_plans_of_fixed_size(spark):
    d = chains(spark, 0.999)
    assert len(plan(W.acf(d, ["param", "chain"], "iter", "value", 12800))) < 1.2 * len(plan(W.acf(d, ["param", "chain"], "iter", "value", 50)))
    ess = B.effective_size(d, 50).first().ess
    assert 5 < ess < 80  # about 40,000 * 0.001 / 2


def test_rank_diagnostics(spark):
    r = B.rank_diagnostics(chains(spark, 0.5, n=4000, m=4)).first()
    assert abs(r.rhat - 1) < 0.01 and 3500 < r.bulk_ess < 7500 and 3000 < r.tail_ess < 16000  # 16,000 / 3
    one = chains(spark, 0.0, n=500)
    apart = one.withColumn("value", F.col("value") + 3 * F.col("chain"))  # chains that do not agree
    assert B.rank_diagnostics(apart).first().rhat > 1.3
    z = B.rank_normalised(one.withColumn("value", F.round("value", 1))).toPandas().value
    assert abs(z.mean()) < 1e-2 and abs(z.std() - 1) < 0.02


def test_running_total(spark):
    rows = [(f"g{i % 3}" if i % 7 else None, float(i * 37 % 101), i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, v double, k long").repartition(3)
    got = {(r.g, r.v): r.before for r in W.running_total(df, ["g"], "v", "k", num_partitions=4).collect() if r.g}
    assert all(b == sum(k for g2, v2, k in rows if g2 == g and v2 < v) for (g, v), b in got.items()) and len(got) > 80
