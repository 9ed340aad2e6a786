"""Level-wise mining (M13) and the bitset prune."""
import inspect
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import itemsets as I
from quill.operators import rules as R


def brute(rows, least, max_len):
    count = {}
    for row in rows:
        items = sorted({x for x in row or [] if x is not None})
        for k in range(1, max_len + 1):
            for c in itertools.combinations(items, k):
                count[c] = count.get(c, 0) + 1
    return {c: k for c, k in count.items() if k >= least}


def random_rows(n=400, items=12, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.1, 0.9, items)
    return [[f"i{j:02d}" for j in range(items) if rng.random() < p[j]] for _ in range(n)]


@pytest.fixture(scope="module")
def tx(spark):
    rows = random_rows() + [None, [], [None, "i01", "i01"], ["i01", None]] + [["i03", "i05", "i07"]] * 50
    return rows, spark.createDataFrame([(r,) for r in rows], "items array<string>").repartition(5)


@pytest.mark.parametrize(("support", "max_len"), [(0.1, 4), (0.02, 3), (0.3, 12), (0.5, 1)])
def test_sets_against_brute_force(tx, support, max_len):
    rows, df = tx
    m = I.frequent_sets(df, "items", support, max_len)
    want = brute(rows, max(1, np.ceil(support * len(rows))), max_len)
    got = {tuple(r["items"]): r["count"] for r in m.frame(df.sparkSession).collect()}
    assert m.n == len(rows) and got == want
    assert max(lv.sets.shape[1] for lv in m.levels) <= max_len  # nothing longer is ever counted
    assert all(lv.passes == 1 for lv in m.levels)


def test_many_candidates_take_several_passes(tx, monkeypatch):
    rows, df = tx
    monkeypatch.setattr(I, "BROADCAST_BYTES", 200)
    monkeypatch.setattr(I, "AND_BYTES", 64)
    m = I.frequent_sets(df, "items", 0.1, 3)
    assert max(lv.passes for lv in m.levels) > 3
    assert {tuple(r["items"]): r["count"] for r in m.frame(df.sparkSession).collect()} == brute(rows, np.ceil(0.1 * len(rows)), 3)


def test_candidates_have_frequent_subsets_only():
    sets = np.array([[0, 1], [0, 2], [0, 3], [1, 2], [2, 3]], np.uint32)
    assert I.candidates(sets).tolist() == [[0, 1, 2], [0, 2, 3]]
    assert I.candidates(sets[:1]).shape == (0, 3)


def test_no_rows_no_sets(spark):
    none = spark.createDataFrame([], "items array<string>")
    assert I.frequent_sets(none).levels == [] and R.mine_rules(none).count() == 0
    assert R.mine_rules(spark.createDataFrame([([],), (None,)], "items array<string>")).count() == 0


def ranked(rules):
    """(rank, items) of rules given as item lists."""
    return [(i + 1, sorted(set(r))) for i, r in enumerate(rules)]


@pytest.mark.parametrize("probes", [50_000, 3])
def test_prune_against_all_pairs(spark, monkeypatch, probes):
    monkeypatch.setattr(R, "PROBES", probes)  # few: items are split over salts
    rng = np.random.default_rng(7)
    rules = [rng.choice(90, rng.integers(1, 11), replace=False) for _ in range(600)]
    rules += [r for r in rules[:40]]  # equal sets
    rows = ranked([[f"x{j:02d}" for j in r] for r in rules])
    df = spark.createDataFrame(rows, "rank long, _items array<string>")
    want = {j for j, b in rows if any(i < j and set(a) <= set(b) for i, a in rows)}
    assert {r.rank for r in R.redundant(df).collect()} == want
    shuffled = R.probes_of(df)[0].count()
    assert shuffled < sum(len(b) for _, b in rows) * 2 + 2 * len(rows) < sum(2 ** len(b) - 1 for _, b in rows) / 10 or probes == 3


def test_prune_of_long_rules(spark):
    """Subset keys of 40 items would be 2**40."""
    rows = [(1, ["a39"]), (2, [f"a{i:02d}" for i in range(40)]), (3, [f"b{i:02d}" for i in range(40)]), (4, [f"b{i:02d}" for i in range(39)])]
    df = spark.createDataFrame(rows, "rank long, _items array<string>")
    assert {r.rank for r in R.redundant(df).collect()} == {2}
    assert R.redundant(df.where("rank < 0")).count() == 0


def test_rules_measures(spark):
    df = spark.createDataFrame([(["a", "b"],)] * 6 + [(["a"],)] * 2 + [(["b", "c"],)] * 2, "items array<string>")
    got = {(tuple(r.antecedent), r.consequent): (r.support, r.confidence, round(r.lift, 9), r["count"])
           for r in R.mine_rules(df, min_support=0.1, min_confidence=0.7).collect()}
    assert got == {(("a",), "b"): (0.6, 0.75, 0.9375, 6), (("b",), "a"): (0.6, 0.75, 0.9375, 6), (("c",), "b"): (0.2, 1.0, 1.25, 2),
                   ((), "a"): (0.8, 0.8, 1.0, 8), ((), "b"): (0.8, 0.8, 1.0, 8)}
    assert R.mine_rules(df).where(F.size("antecedent") == 0).count() == 2


def test_transactions_are_written_as_they_come(spark):
    """Repeats and NULLs are passed over where items are counted, not by a pass of their own."""
    tx = spark.createDataFrame([(["a", "a", None, "b"],), (None,), (["b"],)], "items array<string>")
    m = I.frequent_sets(tx, min_support=0.3)
    assert "array_distinct" not in inspect.getsource(I.frequent_sets)
    assert m.n == 3 and m.names == ["a", "b"] and [c for lv in m.levels for c in lv.counts.tolist()] == [1, 2, 1]
    repeats = I.frequent_sets(tx, min_support=0.6)  # a is in one of three rows
    assert [(lv.sets.tolist(), lv.counts.tolist()) for lv in repeats.levels] == [([[1]], [2])]
    alone = I.frequent_sets(spark.createDataFrame([(["a", "a"],), ([],), ([],)], "items array<string>"), min_support=0.6)
    assert alone.frame(spark).count() == 0
