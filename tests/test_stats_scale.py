"""χ² over many levels (M1) and density by the fast Gauss transform."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import stats as ST


def brute_chi(a, b, yates=True):
    ok = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
    ra, rb = sorted({x for x, _ in ok}), sorted({y for _, y in ok})
    o = np.zeros((len(ra), len(rb)))
    for x, y in ok:
        o[ra.index(x), rb.index(y)] += 1
    e = o.sum(1, keepdims=True) @ o.sum(0, keepdims=True) / o.sum()
    d = np.abs(o - e)
    if yates and o.shape == (2, 2):
        d = d - np.minimum(0.5, d)
    return (d * d / e).sum(), (len(ra) - 1) * (len(rb) - 1)


def test_pairs_against_numpy(spark):
    rng = np.random.default_rng(0)
    n = 3000
    cols = {"many": [float(x) for x in rng.normal(size=n).round(3)], "some": [int(x) for x in rng.integers(0, 40, n)],
            "two": [None if i % 11 == 0 else "y" if i % 3 else "n" for i in range(n)], "flag": [bool(i % 2) for i in range(n)],
            "one": ["x"] * n, "none": [None] * n}
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), "many double, some int, two string, flag boolean, one string, none string").repartition(4)
    got = {(r.var1, r.var2): r for r in ST.chi_square_pairs(df, list(cols), symmetric=False, with_p=False).collect()}
    names = list(cols)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if b == "none":
                assert (a, b) not in got
            else:
                stat, dof = brute_chi(cols[a], cols[b])
                assert got[a, b].dof == dof and got[a, b].statistic == pytest.approx(stat, rel=1e-9, abs=1e-9)


def test_wider_codes_when_levels_collide(spark):
    """120,000 levels in a column are too many for 31 bits without a collision."""
    df = spark.range(120_000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).alias("b"))
    coded, bits = ST.level_codes(df, ["a", "b"])
    assert bits == 62 and coded.select("c0").distinct().count() == 120_000
    r = ST.chi_square_pairs(df, ["a", "b"], with_p=False, symmetric=False).first()
    assert r.dof == 119_999 * 2 and r.statistic == pytest.approx(240_000, rel=1e-9)
    assert ST.level_codes(df, ["b"])[1] == 31


def test_degrees_of_freedom_beyond_an_int(spark):
    df = spark.range(50_000).select(F.col("id").cast("string").alias("a"), (F.col("id") * 3).cast("string").alias("b"))
    r = ST.chi_square_pairs(df, ["a", "b"], with_p=False, symmetric=False).first()
    assert r.dof == 49_999 ** 2 > (1 << 31) and r.statistic == pytest.approx(50_000 * 49_999, rel=1e-9)


@pytest.mark.parametrize("totals", [0, 60, 1 << 17])
def test_totals_are_joined_by_their_number(spark, monkeypatch, totals):
    """The optimizer takes the totals of thousands of levels to be small and would gather
    them on the driver: they are broadcast up to TOTALS, and the others shuffled."""
    ran, cut = [], ST.cut_lineage
    monkeypatch.setattr(ST, "TOTALS", totals, raising=False)
    monkeypatch.setattr(ST, "cut_lineage", lambda df: (ran.append(df), cut(df))[1])
    rng = np.random.default_rng(1)
    n = 4000
    cols = {"many": [int(x) + 0.5 for x in rng.integers(0, 600, n)], "two": [None if i % 7 == 0 else "y" if i % 3 else "n" for i in range(n)],
            "more": [int(x) for x in rng.integers(0, 900, n)], "flag": [bool(x) for x in rng.integers(0, 2, n)], "some": [int(x) for x in rng.integers(0, 5, n)]}
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), "many double, two string, more int, flag boolean, some int").repartition(3)
    r = ST.chi_square_pairs(df, list(cols), symmetric=False, with_p=False)
    got = {(x.var1, x.var2): x for x in r.collect()}
    names = list(cols)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    for (a, b), x in got.items():
        stat, dof = brute_chi(cols[a], cols[b])
        assert x.dof == dof and x.statistic == pytest.approx(stat, rel=1e-9, abs=1e-9)
    text = "\n".join(x._jdf.queryExecution().executedPlan().toString() for x in [*ran, r])
    joins = set(re.findall(r"(\w+Join) \[pair#\d+L?, v[ab]#\d+L?\], ", text))
    # flag, two and some have 2 * 4 + 2 * 3 + 5 * 2 totals; more's 900 are beyond 60
    assert joins == {0: {"SortMergeJoin"}, 60: {"SortMergeJoin", "BroadcastHashJoin"}, 1 << 17: {"BroadcastHashJoin"}}[totals]


def test_products_count_like_pairs(monkeypatch):
    """Indicator products in narrow groups and few rows at a time, NULLs (−1) left out."""
    monkeypatch.setattr(ST, "WIDTH", 4)
    monkeypatch.setattr(ST, "INDICATORS", 40)
    rng = np.random.default_rng(5)
    sizes = [2, 3, 16, 1, 5]
    known = [(rng.integers(-1, s, 777), rng.permutation(100)[:s].astype(np.int64)) for s in sizes]
    got = {}
    for i, j, va, vb, n in ST._joint_counts(known, [0, 1, 2, 4], 777):
        for key, c in zip(zip(i.tolist(), j.tolist(), va.tolist(), vb.tolist(), strict=True), n.tolist(), strict=True):
            assert key not in got
            got[key] = c
    want = {}
    for i, j in ((0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)):
        for x, y in zip(known[i][0], known[j][0], strict=True):
            if x >= 0 and y >= 0:
                key = (i, j, int(known[i][1][x]), int(known[j][1][y]))
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_codes_are_no_wide_projection(spark):
    """45 columns go to Python as one array made by a lambda, in both scans."""
    df = spark.range(10).select(*[F.when(F.col("id") < i, "a").otherwise("b").alias(f"x{i}") for i in range(45)])
    coded, _ = ST._coded(df, df.columns)
    assert coded.columns == ["a"] and "transform(array(" in coded._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [3, 5000])
def test_density_against_the_sum(spark, n):
    rng = np.random.default_rng(n)
    x = np.r_[rng.normal(size=n), rng.normal(40, 5, size=n // 2), [1000.0]]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
    for grid, bw in (((-5.0, 60.0, 131), 0.4), ((-5.0, 60.0, 7), 3.0), ((0.0, 0.0, 1), 2.0)):
        got = ST.kde(df, "x", grid, bw=bw).orderBy("x").collect()
        pts = np.linspace(*grid)
        want = np.exp(-0.5 * ((pts[:, None] - x) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
        assert np.allclose([r.x for r in got], pts) and np.allclose([r.density for r in got], want, rtol=1e-10, atol=1e-14)


def test_boxes_bound_the_rows_between(spark):
    df = spark.range(100_000).select((F.rand(3) * 10).alias("x"))
    text = ST.kde(df, "x", (0.0, 10.0, 200))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "explode" not in text  # no value is copied to grid points
    by = ST.kde_by(df.withColumn("g", (F.col("x") > 5).cast("int")), ["g"], "x", num=50).groupBy("g").count().collect()
    assert all(r["count"] == 50 for r in by)
