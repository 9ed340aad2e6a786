"""Plan checks, partition invariance and the driver contract."""
import duckdb
import pytest

import __spark_entry__ as E
from quill.plans import catalog
from quill.plans.registry import REGISTRY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chi_square_pairs", "pruned_rules", "doc_emotions", "quantity_kde"])
def test_no_cartesian_products(spark, sf, name):
    txt = plan_text(REGISTRY[name].build(spark, sf))
    assert "CartesianProduct" not in txt and "BroadcastNestedLoopJoin" not in txt


def test_single_scan_for_null_counts(spark, sf):
    txt = plan_text(REGISTRY["label_null_counts"].build(spark, sf))
    assert txt.count("FileScan parquet") <= 2  # documents + labels, once each


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["section", "n_articles"]


def test_every_query_declares_ops():
    for q in REGISTRY.values():
        assert q.ops, q.name


def _norm(v):
    if isinstance(v, float):
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


FAST = [n for n, q in REGISTRY.items() if q.sql and not n.startswith(("negbin", "bayes"))]


@pytest.mark.parametrize("name", FAST)
def test_oracle_matches(spark, sf, con, name):
    q = REGISTRY[name]
    df = catalog.builders()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    exp = sorted(repr(tuple(_norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == exp


@pytest.mark.parametrize("name", ["first_event_per_user", "customer_order_band", "lineitem_items"])
def test_partition_invariance(spark, sf, name):
    a = REGISTRY[name].build(spark, sf).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = REGISTRY[name].build(spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("gone", [["quill/llm", "tests/llm"], ["quill/llm", "tests/llm", "corpus_pipeline.py"], ["quill/llm/*.py"]])
def test_entry_without_the_training_data_package(tmp_path, gone):
    """On a copy without the optional folders the entry imports, its queries are
    the others, and the remaining tests are all there."""
    import glob
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    paths = [p for g in gone for p in glob.glob(os.path.join(root, g))]
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(d, n) in paths])
    code = ("import __spark_entry__ as e\n"
            "q, o = e.queries(), e.oracle_sql()\n"
            "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q) and set(o) <= set(q)\n"
            "from quill.session import get_spark\n"
            "print('QUERIES', len(q), e.entry(get_spark('local[2]', shuffle_partitions=2)).count())")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
    assert "QUERIES" in done.stdout, done.stderr[-1500:]
    if "tests/llm" in gone:
        found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True,
                               text=True, timeout=300)
        assert found.returncode == 0, found.stdout[-1500:]


@pytest.mark.parametrize("force", [True, False])
def test_both_sides_of_the_broadcast_checks_give_the_same_rows(spark, monkeypatch, force):
    """Size switches choose how rows meet, never which rows."""
    from quill.operators import common, features, windows
    df = spark.createDataFrame([(i, f"g{i % 3}" if i % 4 else None, float(i * 7 % 11)) for i in range(60)], "k long, g string, v double")
    if force:
        for m in (features, windows):
            monkeypatch.setattr(m, "measured_broadcast", lambda d, max_bytes=0: common.measured_broadcast(d, -1))
    a = windows.dense_index(df, ["v", "k"], ["g"], "i").select("k", "i").collect()
    b = features.frequency_band(df, "g").select("k", "band").collect()
    c = features.collapse_rare(df, "g", 16).select("k", "g").collect()
    got = tuple(sorted(map(tuple, x), key=repr) for x in (a, b, c))
    seen = getattr(test_both_sides_of_the_broadcast_checks_give_the_same_rows, "rows", got)
    test_both_sides_of_the_broadcast_checks_give_the_same_rows.rows = seen
    assert got == seen
