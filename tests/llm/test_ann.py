import numpy as np

from quill.llm import ann


def exact(ids, x, qids, k):
    out = {}
    for q in qids:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:min(k, len(ids) - 1)]
        out[int(q)] = [(int(ids[b]), float(d[b])) for b in best]
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_query_recall(spark, sf, llm_queries, duck):
    rows = duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = by_query(llm_queries.op4_nearest(spark, sf).collect())
    want = exact(ids, x, ids[ids % 100 == 0], 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.97
    for q, found in got.items():
        for v, score in found:
            assert abs(score - np.sqrt(((x[ids == v][0] - x[ids == q][0]) ** 2).sum())) < 1e-12
        assert found == sorted(found, key=lambda p: (p[1], p[0]))


def test_recall_on_clusters_and_blocks(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((40, 24)) * 5
    x = np.repeat(centre, 60, 0) + rng.standard_normal((2400, 24))
    ids = np.arange(2400)
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 50 = 0")
    want = exact(ids, x, ids[::50], 10)
    for rows in (500, 16384):
        assert recall(by_query(ann.nearest(df, q, block_rows=rows, query_rows=20).collect()), want) >= 0.95


def test_candidates_are_fewer_than_all():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((100, 32)) * 6
    x = np.repeat(centre, 50, 0) + rng.standard_normal((5000, 32)) * 0.3
    index = ann.Index(np.arange(5000), x)
    index.search(0, x[0], 10)
    assert 10 <= index.verified < 1000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1),
            (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [2.0, 0.0, 1.0], 1), (9, [1.0, 1.0], 1), (9, [1.0, 1.0], 1), (None, [1.0, 2.0], 1),
            (100, [1.0, 0.5], 1), (200, [], 1), (300, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = by_query(ann.nearest(df, df.where("vec_id % 100 = 0"), k=10).collect())
    assert [v for v, _ in got[0]] == [1, 2, 100, 9] and [s for _, s in got[0]] == [0.0, 0.0, 0.5, 1.0]
    assert [v for v, _ in got[100]] == [0, 1, 2, 9] and set(got) == {0, 100}
    none = df.where("1 = 0")
    assert ann.nearest(none, none).count() == 0 and ann.nearest(df, none).count() == 0
    one = df.where("vec_id = 0")
    assert ann.nearest(one, one).count() == 0
