"""Whitening of embeddings by a bidiagonal qd solver.

Entries become fixed-point longs ``x = floor(64 * c) + 1000000``. The fit list,
each distinct x vector once, is one aggregate, written to the shared folder.
From it come n and the exact sums S. Blocks of centred rows (n*x - S in whole
numbers, divided by n) are reduced by QR to one triangle a task, the triangles
in levels of 64 to one; bidiagonalisation, dqds and twisted factorisations
(``bidiagonal``) of that small matrix give variances and directions. A second
pass over the fit list measures the whitened covariance.

Rows whose vector is NULL or holds NULL or non-finite entries are dropped;
repeated rows count once in the fit and each come back; directions whose
variance is zero to rounding are left out (so equal rows, one row or an empty
table give no rows); a deviation beyond a long is NULL. Vectors of different
lengths, and entries whose fixed-point form is beyond 2**53, raise. Only id and
vector are read, so other names cannot clash.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import right_vectors
from .common import written

SCALE, OFFSET = 64, 1_000_000
ROWS = 2048  # rows of a QR step
FAN = 64  # triangles joined at once


def fixed_point(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with whole, finite vectors."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    small = F.when(F.forall("v", lambda c: F.abs(c) < 2.0**53 / SCALE), F.col("v")).otherwise(
        F.raise_error(F.lit("an entry is too large for its fixed-point form")).cast("array<double>"))
    return v.where(F.col("v").isNotNull() & fine).select(
        "vec_id", F.transform(small, lambda c: F.floor(c * SCALE).cast("long") + F.lit(OFFSET).cast("long")).alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S exactly: longs, or Python's numbers where longs could overflow."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if 2 * n * max(most, 1) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(d: np.ndarray) -> list:
    """Exact sum of squares of every row, None beyond a long."""
    if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in ((d.astype(object) ** 2).sum(axis=1).tolist() if d.size else [0] * len(d))]


def exact_sums(fit: DataFrame, d: int) -> list[int]:
    """Sum of every dimension; tasks hand over one row a dimension."""
    def run(batches):
        total = np.zeros(d, object)
        for b in batches:
            x = _matrix(b.column(0), d)
            for i in range(0, len(x), 1 << 9):  # 2**9 numbers below 2**54 fit a long
                total += x[i:i + (1 << 9)].sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([str(int(t)) for t in total])], names=["i", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, s string")
    got = {r.i: int(r.s) for r in rows.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return [got.get(i, 0) for i in range(d)]


def _triangle(blocks: np.ndarray) -> np.ndarray:
    return np.linalg.qr(blocks, mode="r")


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list: per task block after block, then in levels."""
    d = len(sums)

    def run(batches):
        r = np.zeros((0, d))
        for b in batches:
            x = _matrix(b.column(0), d)
            for i in range(0, len(x), ROWS):
                r = _triangle(np.vstack([r, _centred(x[i:i + ROWS], n, sums).astype(np.float64) / n]))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                                         names=["i", "r"])

    def joined(key, rows):
        r = _triangle(np.vstack([np.frombuffer(x, np.float64).reshape(-1, d) for x in rows.column("r").to_pylist()]))
        return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    parts = written(fit.select("x").mapInArrow(run, "i long, r binary"), "triangles")
    while parts.count() > 1:
        up = parts.withColumn("g", F.floor(F.col("i") / FAN).cast("long"))
        parts = written(up.groupBy("g").applyInArrow(joined, "i long, r binary"), "triangles")
    got = parts.first()
    return np.frombuffer(got.r, np.float64).reshape(-1, d) if got else np.zeros((0, d))


def identity_error(fit: DataFrame, n: int, sums: list[int], turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the
    identity."""
    d, k = turn.shape

    def run(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            x = _matrix(b.column(0), d)
            for i in range(0, len(x), ROWS):
                w = _centred(x[i:i + ROWS], n, sums).astype(np.float64) / n @ turn
                one, two = one + w.sum(axis=0), two + w.T @ w
        v = np.r_[one, two.ravel()] / n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["i", "v"])

    got = {r.i: r.v for r in fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    v = np.array([got[i] for i in range(k + k * k)])
    return float(np.abs(v[k:].reshape(k, k) - np.outer(v[:k], v[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per whole vector and component: n, the exact deviation, the
    whitened coordinate, the component's share of the variance and the error of
    the whitened covariance."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = fixed_point(vectors, id_col, vec_col)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    n, short, d = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if short != d:
        raise ValueError(f"vectors of {short} to {d} dimensions")
    if not n or not d:
        return spark.createDataFrame([], schema)
    sums = exact_sums(fit, d)
    r = triangle(fit, n, sums)
    sigma, directions = right_vectors(r, components)
    if not len(sigma):
        return spark.createDataFrame([], schema)
    turn = directions * (np.sqrt(n) / sigma)  # sigma**2 / n is the variance
    explained = sigma ** 2 / (r * r).sum()
    error = identity_error(fit, n, sums, turn)
    k = len(sigma)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                dev = _centred(_matrix(part.column(1), d), n, sums)
                w = dev.astype(np.float64) / n @ turn
                m = part.num_rows
                cols = [part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)), pa.array(_squares(dev), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)
