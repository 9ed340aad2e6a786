"""U5, U9-U12, U18, U19 and friends: filters, dedup, bands, joins, histograms, I/O."""
import os
import tempfile

from pyspark.sql import functions as F

from quill.operators import aggregates as G
from quill.operators import features as FE
from quill.operators import filters as C
from quill.operators import joins as J
from quill.operators import windows as W
from quill.sources import io as IO


def test_drop_containing_is_literal(spark):
    df = spark.createDataFrame([("https://x/others",), ("https://x/(other)",), ("https://x/?utm_source=a",),
                                (None,)], "url string")
    out = C.drop_containing(df, "url", ["(other)", "/?utm_source="])
    assert sorted(r.url or "" for r in out.collect()) == ["", "https://x/others"]


def test_drop_equal_keeps_null(spark):
    df = spark.createDataFrame([("25-34",), ("18-24",), (None,)], "edad string")
    assert C.drop_equal(df, "edad", "25-34").count() == 2


def test_dedup_first_and_prefer_nonnull(spark):
    df = spark.createDataFrame([("u", 1, None), ("u", 2, "sport"), ("v", 1, "x")], "url string, pos int, topic string")
    first = {r.url: r.topic for r in W.dedup_first(df, "url", ["pos"]).collect()}
    pref = {r.url: r.topic for r in W.dedup_prefer_nonnull(df, "url", "topic", ["pos"]).collect()}
    assert first == {"u": None, "v": "x"}
    assert pref == {"u": "sport", "v": "x"}


def test_frequency_band_equal_cuts(spark):
    rows = [("a",), ("b",), ("c",), ("d",)] + [("e",)] * 9 + [(None,)]
    df = spark.createDataFrame(rows, "author string")
    out = FE.frequency_band(df, "author").groupBy("author", "band").count().collect()
    band = {r.author: r.band for r in out}
    assert band == {"a": "Q1", "b": "Q1", "c": "Q1", "d": "Q1", "e": "Q4", None: "Q1"}


def test_collapse_rare(spark):
    rows = [("s1",)] * 29 + [("s2",)] * 30
    out = FE.collapse_rare(spark.createDataFrame(rows, "section string"), "section", 30)
    got = {r.section: r["count"] for r in out.groupBy("section").count().collect()}
    assert got == {None: 29, "s2": 30}


def test_match_on_metrics_null_keys_match(spark):
    l = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 3.0)], "k int, a double, b double")
    r = spark.createDataFrame([(None, 2.0, "x"), (None, 2.0, "y"), (5.0, 5.0, "z")], "a double, b double, v string")
    out = J.match_on_metrics(l, r, ["a", "b"]).orderBy("k", "v").collect()
    assert [(o.k, o.v) for o in out] == [(1, "x"), (1, "y"), (2, None)]


def test_histogram_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.5,), (20.0,)], "x double")
    h = {r.bin: r.n for r in G.histogram(df, "x", 0.0, 30.0, 10.0).collect()}
    assert h == {1: 2, 2: 2, 3: 0}


def test_pretty_breaks():
    assert G.pretty_breaks(0, 100, 5) == [0, 20, 40, 60, 80, 100]
    assert G.pretty_breaks(0, 1, 5) == [0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]
    assert G.sturges_bins(60000) == 17


def test_dense_index_exact_under_repartition(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1000).alias("x"))
    a = W.dense_index(df.repartition(1), ["x"], ["g"], "i").select("g", "x", "i").collect()
    b = W.dense_index(df.repartition(13), ["x"], ["g"], "i").select("g", "x", "i").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    per = {}
    for g, x, i in a:
        per.setdefault(g, []).append((x, i))
    for g, v in per.items():
        v.sort()
        assert [i for _, i in v] == list(range(len(v)))


def test_split_exact_and_disjoint(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "k")
    s = FE.split(df, "k", 0.2, seed=7)
    assert s.where("is_test").count() == 21
    s2 = FE.split(df.repartition(5), "k", 0.2, seed=7)
    assert sorted(r.k for r in s.where("is_test").collect()) == sorted(r.k for r in s2.where("is_test").collect())


def test_dummies_sum_to_one(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "f string")
    d = FE.dummies(df, ["f"])
    assert all(r.f_a + r.f_b + r.f_c == 1 for r in d.collect())
    assert FE.dummies(df, ["f"], drop_first=True).columns == ["f_b", "f_c"]


def test_read_stage_multiline_csv(spark):
    d = tempfile.mkdtemp(prefix="quill-test-")
    p = os.path.join(d, "s.csv")
    with open(p, "w") as fh:
        fh.write('URL,Content\nu1,"line one\nline two"\nu2,plain\n')
    df = IO.read_stage(spark, p, "URL string, Content string", fmt="csv")
    assert df.count() == 2
    assert df.where("URL = 'u1'").first().Content == "line one\nline two"


def test_read_report_skips_preamble_and_caps(spark):
    d = tempfile.mkdtemp(prefix="quill-test-")
    p = os.path.join(d, "r.csv")
    with open(p, "w") as fh:
        for i in range(6):
            fh.write(f"# preamble {i}\n")
        fh.write("url (cd 41),Usuarios\n")
        for i in range(10):
            fh.write(f"https://x/{i},\"1.{i:03d}\"\n")
    df = IO.read_report(spark, p, skip_rows=6, max_rows=5)
    rows = df.collect()
    assert df.columns == ["url (cd 41)", "Usuarios"]
    assert [r[0] for r in rows] == [f"https://x/{i}" for i in range(5)]
    assert rows[1][1] == "1.001"


def test_report_reads_all_rows_and_checks_headers(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="quill-test-")
    for n in range(2):
        with open(os.path.join(d, f"r{n}.csv"), "w") as fh:
            fh.write("#\n" * 6 + "url,n\n" + "".join(f"u{n}-{i},{i}\n" for i in range(6000)))
    assert IO.read_report(spark, d).count() == 12000
    assert IO.read_report(spark, d, max_rows=10).count() == 20
    rows = IO.read_report(spark, d, positions=True).where("url = 'u1-3'").first()
    assert rows._ln == 10 and rows._file.endswith("r1.csv")
    with open(os.path.join(d, "r2.csv"), "w") as fh:
        fh.write("#\n" * 6 + "url,other\nx,1\n")
    with pytest.raises(ValueError, match="headers differ"):
        IO.read_report(spark, d)


def test_small_values_keep_their_bins(spark):
    df = spark.createDataFrame([(i * 1e-6,) for i in range(1, 31)], "x double")
    got = {r.x: r["count"] for r in FE.discretize(df, ["x"], 3).groupBy("x").count().collect()}
    assert len(got) == 3 and sorted(got.values()) == [10, 10, 10]


def test_quantiles_of_a_hot_value(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(FE, "RANGE_VALUES", 50)
    rng = np.random.default_rng(1)
    values = np.r_[np.full(700, 0.25), rng.normal(0, 1, 1400)]
    df = spark.createDataFrame([("g" if i % 3 else None, float(v)) for i, v in enumerate(values)], "g string, x double")
    probs = [0, 0.1, 1 / 3, 0.5, 0.975, 1]
    for g in ("g", None):
        own = [v for i, v in enumerate(values) if ("g" if i % 3 else None) == g]
        got = {r.prob: r.value for r in FE.quantiles_by(df, ["g"], "x", probs).collect() if r.g == g}
        assert all(abs(got[p] - np.quantile(own, p)) < 1e-12 for p in probs)


def test_quantile_ranges_hold_distinct_values(spark, monkeypatch):
    """No range exchange on raw values: a value in a third of the rows is one row."""
    seen = []
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    real = Classic.repartitionByRange
    monkeypatch.setattr(Classic, "repartitionByRange", lambda self, *a: (seen.append(self.count()), real(self, *a))[1])
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") % 100) / 7.0).alias("x"))
    FE.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]).collect()
    assert seen == [df.distinct().count()]


def test_index_ranges_follow_the_input(spark, monkeypatch):
    seen = []
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    real = Classic.repartitionByRange
    monkeypatch.setattr(Classic, "repartitionByRange", lambda self, n, *a: (seen.append(n), real(self, n, *a))[1])
    monkeypatch.setattr(W, "SORT_BYTES", 500)
    W.dense_index(spark.range(0, 1000), ["id"], index_col="i").count()
    assert seen == [16]


def test_drop_first_drops_one_row(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a"), (None, "x"), (None, "x")], "k int, v string")
    left = sorted(map(tuple, C.drop_first(df, ["k"]).collect()), key=repr)
    assert left == sorted([(2, "b"), (1, "a"), (1, "a"), (None, "x")], key=repr)
    assert C.drop_first(df.where("1 = 0"), ["k"]).count() == 0


def test_levels_are_guarded(spark):
    import pytest
    df = spark.range(0, 50).select(F.col("id").cast("string").alias("f"))
    with pytest.raises(ValueError, match="50 levels"):
        FE.levels(df, ["f"], max_levels=49)


def test_histogram_edges_are_fuzzy(spark):
    df = spark.createDataFrame([(0.07,), (0.065,), (0.0700001,)], "x double")
    h = {round(r.hi, 4): r.n for r in G.histogram(df, "x", 0.0, 0.1, 0.005).collect() if r.hi}
    assert h[0.065] == 1 and h[0.07] == 1 and h[0.075] == 1


def test_acf_across_blocks(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=9000))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [(None, 0, 1.0), (None, 1, 3.0)], "g string, t long, v double")
    got = {(r.g, r.lag): r.acf for r in W.acf(df, ["g"], "t", "v", 30).collect()}
    d = x - x.mean()
    for lag in (0, 1, 7, 30):
        assert abs(got["a", lag] - (d[:len(d) - lag] * d[lag:]).sum() / (d * d).sum()) < 1e-9
    assert abs(got[None, 1] + 0.5) < 1e-12


def test_salted_metric_match_equals_plain(spark):
    l = spark.createDataFrame([(i, None if i % 3 else 1.0, 2.0) for i in range(60)], "k int, a double, b double")
    r = spark.createDataFrame([(None, 2.0, "x"), (1.0, 2.0, "y"), (5.0, 5.0, "z")], "a double, b double, v string")
    plain, salted = (sorted(map(tuple, J.match_on_metrics(l, r, ["a", "b"], salt_buckets=s).select("k", "v").collect())) for s in (None, 4))
    assert plain == salted
