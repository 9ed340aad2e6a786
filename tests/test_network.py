"""Mini-batch training by local SGD."""
import numpy as np
import pytest

from quill.operators import features as FE
from quill.operators import mlp as N


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 2))
    y = np.round(np.exp(0.4 * x[:, 0]) * 3 + x[:, 1] ** 2)
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))],
                                 "id long, a double, b double, y double").cache()


def weights(m):
    return m.vector().tolist()


def test_local_sgd_does_not_depend_on_partitions(spark, rows):
    fit = lambda d: N.mlp_fit_local(d, "y", ["a", "b"], "id", hidden=4, epochs=4, batch=20, lr=0.01, local_epochs=2, groups=5)
    first = fit(rows.repartition(3))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        second = fit(rows.repartition(7))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert weights(first) == pytest.approx(weights(second), rel=1e-9)  # the scaler's sums differ in their last digits
    assert np.array(first.history) == pytest.approx(np.array(second.history), rel=1e-9)


def test_local_sgd_against_numpy(rows, monkeypatch):
    """Five groups for two rounds, averaged by rows over two levels."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(N, "FAN", 2)
    m = N.mlp_fit_local(rows, "y", ["a", "b"], "id", hidden=3, epochs=4, batch=16, lr=0.01, seed=9, local_epochs=2, groups=5)
    d = FE.split(rows, "id", 0.2, seed=9).withColumn("h", F.xxhash64("id", F.lit(9))).withColumn("g", F.pmod("h", F.lit(5))).toPandas()
    tr = d[~d.is_test]
    mean, sd = tr[["a", "b"]].mean().to_numpy(), tr[["a", "b"]].std(ddof=0).to_numpy()
    first = N._init(2, 3, 1, 9)
    shapes = [a.shape for a in first]
    theta = np.concatenate([a.ravel() for a in first])
    mo, step = (np.zeros_like(theta), np.zeros_like(theta)), 0
    for number in range(2):
        out = []
        for g, part in tr.sort_values(["h", "y"]).groupby("g"):
            x = (part[["a", "b"]].to_numpy() - mean) / sd
            t, mm, st = N._train_rows(theta, mo, step, x, part.y.to_numpy(), "mse", shapes, 16, 2, 0.01, np.random.default_rng([9, number, g, 0]))
            out.append((len(part), t, mm, st))
        n = sum(o[0] for o in out)
        theta = sum(o[0] * o[1] for o in out) / n
        mo = tuple(sum(o[0] * o[2][i] for o in out) / n for i in (0, 1))
        step = round(sum(o[0] * o[3] for o in out) / n)
        x, va = (tr[["a", "b"]].to_numpy() - mean) / sd, d[d.is_test]
        xv = (va[["a", "b"]].to_numpy() - mean) / sd
        epoch, loss, val = m.history[number]
        assert epoch == 2 * number + 2
        assert loss == pytest.approx(N._loss_sum(theta, shapes, x, tr.y.to_numpy(), "mse") / len(tr), rel=1e-9)
        assert val == pytest.approx(N._loss_sum(theta, shapes, xv, va.y.to_numpy(), "mse") / len(va), rel=1e-9)
    assert np.allclose(m.vector(), theta, rtol=1e-9, atol=1e-12)


def test_patience_restores_the_best_weights(rows):
    kw = dict(y="y", features=["a", "b"], key="id", hidden=4, batch=20, lr=0.3, local_epochs=1, groups=2, seed=3)
    m = N.mlp_fit_local(rows, epochs=40, patience=2, **kw)
    losses = [v for _, _, v in m.history]
    best = losses.index(min(losses))
    assert len(losses) < 40 and len(losses) - 1 - best == 2
    again = N.mlp_fit_local(rows, epochs=best + 1, **kw)
    assert weights(again) == pytest.approx(weights(m), rel=1e-9)


def test_groups_larger_than_memory_are_worked_through_in_pieces(rows, monkeypatch):
    monkeypatch.setattr(N, "GROUP_BYTES", 8 * 4 * 100)  # 100 rows
    m = N.mlp_fit_local(rows, "y", ["a", "b"], "id", hidden=4, epochs=2, lr=0.01, local_epochs=1, groups=1)
    monkeypatch.undo()
    whole = N.mlp_fit_local(rows, "y", ["a", "b"], "id", hidden=4, epochs=2, lr=0.01, local_epochs=1, groups=1)
    assert all(np.isfinite(m.vector())) and len(m.history) == len(whole.history) == 2
    assert abs(m.history[-1][2] / whole.history[-1][2] - 1) < 0.3


def test_odd_rows(spark, rows):
    some = rows.limit(40).unionByName(spark.createDataFrame([(900, None, 1.0, 2.0), (901, 1.0, 1.0, None), (None, 1.0, 2.0, 3.0)], rows.schema))
    m = N.mlp_fit_local(some.unionByName(some), "y", ["a", "b"], "id", hidden=2, epochs=1, local_epochs=1)
    assert all(np.isfinite(m.vector()))
    with pytest.raises(ValueError, match="no rows"):
        N.mlp_fit_local(rows.where("id < 0"), "y", ["a", "b"], "id")


def test_groups_are_bounded_by_rows(spark, monkeypatch):
    """A group is one task's work, so a larger table makes more groups of the same size."""
    monkeypatch.setattr(N, "GROUP_ROWS", 50)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(a), float(2 + a)) for i, a in enumerate(rng.normal(size=200))], "k long, a double, y double")
    fit = lambda g: N.mlp_fit_local(df, "y", ["a"], "k", hidden=2, epochs=2, local_epochs=1, batch=10, lr=0.05, groups=g).vector()
    assert np.array_equal(fit(None), fit(4)) and not np.array_equal(fit(None), fit(1))  # 160 rows are trained on
