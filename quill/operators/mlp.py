"""Dense count regressor trained data-parallel on Spark.

One hidden ReLU layer, softplus outputs: one output for MSE, two (mean,
variance) for the negative-binomial loss. ``mlp_fit_local`` trains in
mini-batches: tasks run whole epochs on the rows they hold and their weights are
averaged, a pass per round. ``mlp_fit`` takes full-batch (or a few large
hash-assigned batches) steps of one pass each: every partition computes the
gradient sum of its rows, Spark sums the vectors, the driver applies Adam.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.mathx import clamp_min, digamma_np, lgamma, lgamma_np


def nb_nll_terms(y, mean, var) -> Column:
    """M24 per-row NB log-likelihood from predicted mean and variance with the
    reference's clamps: mean ≥ 1e-10, var ≥ mean + 1e-10, r = mean²/(var − mean)."""
    y = F.col(y) if isinstance(y, str) else y
    m = clamp_min(mean, 1e-10)
    v = F.greatest(F.col(var) if isinstance(var, str) else var, m + 1e-10)
    r = m * m / F.greatest(v - m, F.lit(1e-10))
    return (lgamma(y + r) - lgamma(y + 1.0) - lgamma(r) + r * F.log(m / v)
            + F.when(y == 0, F.lit(0.0)).otherwise(y * F.log(1.0 - m / v)))


def nb_nll(df: DataFrame, y: str, mean: str, var: str, name: str = "nb_loss") -> DataFrame:
    """Mean negative log-likelihood."""
    return df.agg((-F.avg(nb_nll_terms(y, mean, var))).alias(name))


def mse(df: DataFrame, y: str, pred: str, name: str = "mse") -> DataFrame:
    """Mean squared error."""
    return df.agg(F.avg(F.pow(F.col(y) - F.col(pred), 2)).alias(name))


@dataclass
class MLP:
    W1: np.ndarray
    b1: np.ndarray
    W2: np.ndarray
    b2: np.ndarray
    loss: str
    features: list[str]
    scaler: dict = field(default_factory=dict)
    history: list = field(default_factory=list)

    def vector(self):
        return np.concatenate([self.W1.ravel(), self.b1, self.W2.ravel(), self.b2])

    def set_vector(self, v):
        d, h = self.W1.shape
        o = self.W2.shape[1]
        i = 0
        self.W1 = v[i:i + d * h].reshape(d, h); i += d * h
        self.b1 = v[i:i + h]; i += h
        self.W2 = v[i:i + h * o].reshape(h, o); i += h * o
        self.b2 = v[i:i + o]


def _softplus(a):
    return np.logaddexp(0.0, a)


def _forward(params, X):
    W1, b1, W2, b2 = params
    a1 = X @ W1 + b1
    h = np.maximum(a1, 0.0)
    a2 = h @ W2 + b2
    return a1, h, a2, _softplus(a2)


def _loss_grad_out(out, y, loss, value=True):
    """Per-row loss (None without ``value``) and d loss / d output."""
    if loss == "mse":
        e = out[:, 0] - y
        return e * e if value else None, (2.0 * e)[:, None]
    m_raw, v_raw = out[:, 0], out[:, 1]
    m = np.maximum(m_raw, 1e-10)
    vclamp = v_raw < m + 1e-10
    v = np.where(vclamp, m + 1e-10, v_raw)
    s = np.maximum(v - m, 1e-10)
    r = m * m / s
    lr = np.log(m / v)
    l1 = np.log1p(-m / v)
    nll = -(lgamma_np(y + r) - lgamma_np(y + 1.0) - lgamma_np(r) + r * lr + y * l1) if value else None
    dr = digamma_np(y + r) - digamma_np(r) + lr
    dldm = dr * (m * (2 * v - m) / s ** 2) + r / m - y / s
    dldv = dr * (-m * m / s ** 2) - r / v + y * (1.0 / s - 1.0 / v)
    dldm = np.where(vclamp, dldm + dldv, dldm) * (m_raw > 1e-10)
    dldv = np.where(vclamp, 0.0, dldv)
    return nll, -np.stack([dldm, dldv], axis=1)


def _grad_sums(params, X, y, loss, value=True):
    W1, b1, W2, b2 = params
    a1, h, a2, out = _forward(params, X)
    lval, g_out = _loss_grad_out(out, y, loss, value)
    g_a2 = g_out / (1.0 + np.exp(-a2))
    gW2 = h.T @ g_a2
    gb2 = g_a2.sum(0)
    g_h = (g_a2 @ W2.T) * (a1 > 0)
    gW1 = X.T @ g_h
    gb1 = g_h.sum(0)
    return float(lval.sum()) if value else None, np.concatenate([gW1.ravel(), gb1, gW2.ravel(), gb2])


def _init(d, hidden, out, seed):
    g = np.random.default_rng(seed)
    l1 = math.sqrt(6.0 / (d + hidden))
    l2 = math.sqrt(6.0 / (hidden + out))
    # output biases: the NB variance head starts above the mean head, outside
    # the clamp (var ≥ mean + 1e-10) where the loss is flat or unstable
    b2 = np.array([1.0, 3.0]) if out == 2 else np.full(out, 1.0)
    return (g.uniform(-l1, l1, (d, hidden)), np.zeros(hidden), g.uniform(-l2, l2, (hidden, out)), b2)


def mlp_fit(df: DataFrame, y: str, features: list[str], loss: str = "mse", hidden: int = 64,
            epochs: int = 150, lr: float = 1e-4, seed: int = 123, batches_per_epoch: int = 1,
            validation_frac: float = 0.2, patience: int | None = None, min_delta: float = 0.0,
            scale: bool = True, key: str | None = None, init: list | None = None) -> MLP:
    """M25 (+M29 history, M30 early stopping): train on ``df``.

    Validation rows are an exact seeded hash split of ``df`` (F9). Features
    are standardised with population statistics of the training rows (F8) —
    the fitted network uses the scaled inputs (§2.17 #15). Each step returns
    (train loss, gradient) sums from one pass; the validation loss is computed
    in the same pass with the same weights. ``init`` gives the first weights
    (W1, b1, W2, b2) instead of the seeded ones."""
    from .features import fit_scaler, split
    k = key or "_rowkey"
    data = df if key else df.withColumn(k, F.xxhash64(*[F.col(c) for c in df.columns]))
    data = split(data.select(k, y, *features), k, validation_frac, seed=seed, col="_val")
    stats = fit_scaler(data.where(~F.col("_val")), features, population=True) if scale else \
        {c: (0.0, 1.0) for c in features}
    X = F.array(*[((F.col(c).cast("double") - stats[c][0]) / stats[c][1]) for c in features])
    nb = max(1, batches_per_epoch)
    prep = data.select(X.alias("x"), F.col(y).cast("double").alias("y"), "_val",
                       F.pmod(F.xxhash64(F.col(k), F.lit(seed)), F.lit(nb)).alias("_b")).persist()
    n_tr = prep.where(~F.col("_val")).groupBy("_b").count().collect()
    n_b = {r["_b"]: r["count"] for r in n_tr}
    n_val = prep.where(F.col("_val")).count()
    out_dim = 2 if loss == "nb" else 1
    first = [np.array(a, float) for a in init] if init else _init(len(features), hidden, out_dim, seed)
    model = MLP(*first, loss=loss, features=list(features), scaler=stats)
    theta = model.vector()
    m_t = np.zeros_like(theta)
    v_t = np.zeros_like(theta)
    b1_, b2_, eps = 0.9, 0.999, 1e-7
    step = 0
    best, wait = float("inf"), 0
    P = theta.size

    for epoch in range(1, epochs + 1):
        tr_sum, tr_n, va_sum = 0.0, 0, 0.0
        for b in range(nb):
            model.set_vector(theta)
            params = (model.W1, model.b1, model.W2, model.b2)

            def run(batches, params=params, b=b):
                g_acc = np.zeros(P)
                l_tr = 0.0
                l_va = 0.0
                for pdf in batches:
                    Xb = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
                    yb = pdf["y"].to_numpy(dtype=float)
                    val = pdf["_val"].to_numpy(dtype=bool)
                    tr = (~val) & (pdf["_b"].to_numpy() == b)
                    if tr.any():
                        l, g = _grad_sums(params, Xb[tr], yb[tr], loss)
                        l_tr += l
                        g_acc += g
                    if b == nb - 1 and val.any():
                        _, _, _, out = _forward(params, Xb[val])
                        l_va += float(_loss_grad_out(out, yb[val], loss)[0].sum())
                yield pd.DataFrame({"i": [np.arange(P + 2)], "v": [np.concatenate([g_acc, [l_tr, l_va]])]})

            # a training step reads its batch only; validation rows ride on the last one
            mine = ~F.col("_val") & (F.col("_b") == b)
            rows_ = prep.where(mine | F.col("_val") if b == nb - 1 else mine)
            parts = rows_.mapInPandas(run, "i array<int>, v array<double>")
            g = np.zeros(P + 2)
            # one vector per task: (gradient, training loss, validation loss), summed per position
            for r in parts.select(F.explode(F.arrays_zip("i", "v")).alias("p")).groupBy("p.i").agg(F.sum("p.v").alias("v")).collect():
                g[r["i"]] = r["v"]
            lt, lv, g = g[P], g[P + 1], g[:P]
            nbatch = max(n_b.get(b, 0), 1)
            g /= nbatch
            tr_sum += lt
            tr_n += nbatch
            va_sum = lv
            step += 1
            m_t = b1_ * m_t + (1 - b1_) * g
            v_t = b2_ * v_t + (1 - b2_) * g * g
            mh = m_t / (1 - b1_ ** step)
            vh = v_t / (1 - b2_ ** step)
            theta = theta - lr * mh / (np.sqrt(vh) + eps)
        val_loss = va_sum / n_val if n_val else float("nan")
        model.history.append((epoch, tr_sum / max(tr_n, 1), val_loss))
        if patience is not None:
            if val_loss < best - min_delta:
                best, wait = val_loss, 0
            else:
                wait += 1
                if wait >= patience:
                    break
    model.set_vector(theta)
    prep.unpersist()
    return model


#: bytes of rows that a group of ``mlp_fit_local`` should hold, and rows: a group is
#: one task's work, some 800 steps an epoch in batches of 20
GROUP_BYTES, GROUP_ROWS = 32 << 20, 1 << 14
#: weight vectors averaged by one task
FAN = 32
_ADAM = (0.9, 0.999, 1e-7)


def _train_rows(theta, moments, step, X, y, loss, shapes, batch, epochs, lr, rng):
    """Adam over mini-batches of the rows, in a new order each epoch."""
    b1, b2, eps = _ADAM
    m, v = moments
    n = len(y)
    size = n if batch is None else min(batch, n)
    for _ in range(epochs):
        order = rng.permutation(n) if size < n else np.arange(n)
        for i in range(0, n, size):
            rows = order[i:i + size]
            _, g = _grad_sums(_unpacked(theta, shapes), X[rows], y[rows], loss, value=False)
            g /= len(rows)
            step += 1
            m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
            theta = theta - lr * (m / (1 - b1 ** step)) / (np.sqrt(v / (1 - b2 ** step)) + eps)
    return theta, (m, v), step


def _unpacked(theta, shapes):
    out, i = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(theta[i:i + n].reshape(s))
        i += n
    return out


def _loss_sum(theta, shapes, X, y, loss) -> float:
    return float(_loss_grad_out(_forward(_unpacked(theta, shapes), X)[3], y, loss)[0].sum()) if len(y) else 0.0


def mlp_fit_local(df: DataFrame, y: str, features: list[str], key: str, loss: str = "mse", hidden: int = 64,
                  epochs: int = 150, batch: int | None = 20, lr: float = 1e-4, seed: int = 123, local_epochs: int = 10,
                  groups: int | None = None, validation_frac: float = 0.2, patience: int | None = None, min_delta: float = 0.0,
                  scale: bool = True, init: list | None = None) -> MLP:
    """M25 in mini-batches (+M29 history, M30 early stopping with the best weights
    restored): local SGD.

    Rows are dealt to ``groups`` by the hash of ``key`` (its rows' number over the
    rows that fit ``GROUP_BYTES``, ``GROUP_ROWS`` at most, unless given) and cached there in hash order,
    so a fit does not depend on partitions. In a round every task runs
    ``local_epochs`` epochs of mini-batches of ``batch`` rows (None: all of the
    group) on its own groups, from the same weights and Adam moments; these are
    averaged by rows, in levels of ``FAN``. A round is one pass over the cached
    rows: the losses of the weights it starts from are taken on the way, so there
    is a job per round, not per step. ``patience`` counts rounds.

    Rows with NULL in a feature or response are left out; equal keys share a
    group, worked through in pieces of a group's size; a table without training
    rows raises."""
    from .features import fit_scaler, split
    if epochs < 1 or local_epochs < 1:
        raise ValueError("at least one epoch")
    data = split(df.select(key, y, *features).dropna(subset=[y, *features]), key, validation_frac, seed=seed, col="_val")
    n_tr, n_va = data.agg(F.count(F.when(~F.col("_val"), 1)), F.count(F.when(F.col("_val"), 1))).first()
    if not n_tr:
        raise ValueError("no rows to train on")
    train = data.where(~F.col("_val"))
    stats = fit_scaler(train, features, population=True) if scale else {c: (0.0, 1.0) for c in features}
    X = F.array(*[((F.col(c).cast("double") - stats[c][0]) / stats[c][1]) for c in features])
    d, out_dim = len(features), 2 if loss == "nb" else 1
    most = max(1, GROUP_BYTES // (8 * (d + 2)))  # rows held at once
    G = groups or -(-n_tr // min(most, GROUP_ROWS))
    h = F.xxhash64(F.col(key), F.lit(seed))
    prep = (data.select(F.pmod(h, F.lit(G)).cast("int").alias("g"), h.alias("h"), "_val", X.alias("x"), F.col(y).cast("double").alias("y"))
            .repartitionById(G, F.col("g")).sortWithinPartitions("g", "h", "y", "x").persist())
    first = [np.array(a, float) for a in init] if init else list(_init(d, hidden, out_dim, seed))
    shapes = [a.shape for a in first]
    model = MLP(*first, loss=loss, features=list(features), scaler=stats)
    theta = model.vector()
    moments, step, P = (np.zeros_like(theta), np.zeros_like(theta)), 0, theta.size
    # a row a group: number of rows, then weights, both moments, steps, both losses
    schema = "g long, n double, v binary"

    def one_round(theta, moments, step, number, more):
        def run(batches):
            at, held, done = None, [], None

            def piece(done):
                x, yy, val = (np.concatenate(c) for c in zip(*held, strict=True))
                n, t, mo, st, l_tr, l_va = done
                tr = ~val
                l_tr += _loss_sum(theta, shapes, x[tr], yy[tr], loss)
                l_va += _loss_sum(theta, shapes, x[val], yy[val], loss)
                if more and tr.any():
                    t, mo, st = _train_rows(t, mo, st, x[tr], yy[tr], loss, shapes, batch, more, lr,
                                            np.random.default_rng([seed, number, at, n]))
                return n + int(tr.sum()), t, mo, st, l_tr, l_va

            def closed(done):
                n, t, (m, v), st, l_tr, l_va = done
                row = np.concatenate([t * n, m * n, v * n, [st * n, l_tr, l_va]])
                return pa.RecordBatch.from_pylist([{"g": at, "n": float(n), "v": row.tobytes()}],
                                                  schema=pa.schema([("g", pa.int64()), ("n", pa.float64()), ("v", pa.binary())]))

            for b in batches:
                gs = b.column("g").to_numpy()
                for g in np.unique(gs).tolist():
                    rows = np.flatnonzero(gs == g)
                    if g != at:
                        if at is not None:
                            yield closed(piece(done) if held else done)
                        at, held, done = g, [], (0, theta, moments, step, 0.0, 0.0)
                    part = b.take(pa.array(rows))
                    held.append((part.column("x").flatten().to_numpy().reshape(-1, d), part.column("y").to_numpy(),
                                 part.column("_val").to_numpy(zero_copy_only=False)))
                    if sum(len(r[1]) for r in held) >= most:
                        done, held = piece(done), []
            if at is not None:
                yield closed(piece(done) if held else done)

        def joined(key, rows):
            rows = rows.sort_by("g")
            total = np.sum([np.frombuffer(v) for v in rows.column("v").to_pylist()], axis=0)
            return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "n": [float(np.sum(rows.column("n").to_numpy()))],
                             "v": pa.array([total.tobytes()], pa.binary())})

        parts, left = prep.mapInArrow(run, schema), G
        while left > 1:
            parts = parts.withColumn("k", F.floor(F.col("g") / FAN).cast("long")).groupBy("k").applyInArrow(joined, schema)
            left = -(-left // FAN)
        got = parts.collect()
        n, v = sum(r["n"] for r in got), np.sum([np.frombuffer(r["v"]) for r in got], axis=0)
        return v[:P] / n, (v[P:2 * P] / n, v[2 * P:3 * P] / n), int(round(v[3 * P] / n)), v[-2] / n_tr, v[-1] / n_va if n_va else float("nan")

    done, number, wait = 0, 0, 0
    best, best_theta = float("inf"), theta
    while True:
        more = min(local_epochs, epochs - done)
        new = one_round(theta, moments, step, number, more)
        if done:
            model.history.append((done, new[3], new[4]))
        if done and patience is not None:
            if new[4] < best - min_delta:
                best, best_theta, wait = new[4], theta, 0
            else:
                wait += 1
            if wait >= patience:
                break
        if not more:
            break
        (theta, moments, step), done, number = new[:3], done + more, number + 1
    model.set_vector(best_theta if patience is not None else theta)
    prep.unpersist()
    return model


def early_stopping(history: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """M30 on a history (epoch, val_loss): whether an epoch improved on the best
    loss so far by more than ``min_delta``, the epochs since the last one that
    did, and the epoch at which training stops. One row per epoch."""
    w = Window.orderBy("epoch")
    best = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("improved", best.isNull() | (F.col("val_loss") < best - min_delta))
    h = h.withColumn("wait", (F.col("epoch") - F.max(F.when(F.col("improved"), F.col("epoch"))).over(w)).cast("int"))
    stop = F.min(F.when(F.col("wait") >= patience, F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return h.withColumn("stops", F.col("epoch") == stop)


def history_df(spark, model: MLP) -> DataFrame:
    """Learning curve."""
    return spark.createDataFrame([(int(e), float(a), float(b)) for e, a, b in model.history],
                                 "epoch int, loss double, val_loss double")


def mlp_predict(model: MLP, df: DataFrame, out: str = "pred") -> DataFrame:
    """Batch scoring with a vectorised pandas UDF; weights travel in the
    UDF closure (small), features are scaled with the training statistics.
    One output → ``pred``; two → ``pred`` (mean) and ``pred_var``."""
    params = (model.W1, model.b1, model.W2, model.b2)

    @pandas_udf(ArrayType(DoubleType()))
    def score(x: pd.Series) -> pd.Series:
        X = np.array(x.tolist(), dtype=float).reshape(len(x), -1)
        return pd.Series(list(_forward(params, X)[3]))

    X = F.array(*[((F.col(c).cast("double") - model.scaler[c][0]) / model.scaler[c][1]) for c in model.features])
    res = df.withColumn("_o", score(X))
    res = res.withColumn(out, F.col("_o")[0])
    if model.W2.shape[1] == 2:
        res = res.withColumn(f"{out}_var", F.col("_o")[1])
    return res.drop("_o")


def pred_vs_actual(df: DataFrame, y: str, pred: str, n: int, order) -> DataFrame:
    """First ``n`` rows (explicit order) with prediction and actual value."""
    order = [order] if isinstance(order, str) else list(order)
    return df.select(*order, F.col(y).alias("actual"), F.col(pred).alias("prediction")).orderBy(*order).limit(n)
