"""Tall-skinny QR of a weighted design."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows of one step, and triangles joined by one task
ROWS, FAN = 4096, 32


def _joined(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Triangle of stacked triangles, and their added sums (flat vectors)."""
    r = np.linalg.qr(np.vstack([p[:k * k].reshape(k, k) for p in parts]), mode="r")
    return np.concatenate([r.ravel(), np.sum([p[k * k:] for p in parts], axis=0)])


def reduced(df: DataFrame, columns: list[Column], weight: Column, extra: list[Column], tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangle of the QR decomposition of √weight · columns, and the sums of
    ``extra``, in one pass.

    Every task reduces its Arrow batches, block after block, to one triangle;
    these meet in levels of ``FAN`` until the driver joins the last ``FAN``. The
    sign of a row of the triangle is free. Without rows it is zero."""
    k, m = len(columns), len(extra)
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate([*columns, F.sqrt(weight), *extra])])

    def run(batches):
        r, sums = np.zeros((k, k)), np.zeros(m)
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            sums += x[:, k + 1:].sum(axis=0)
            x = x[:, :k] * x[:, k:k + 1]
            for i in range(0, len(x), ROWS):
                block = np.vstack([r, x[i:i + ROWS]])
                r = np.linalg.qr(block, mode="r")
        out = np.concatenate([r.ravel(), sums])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.tobytes()], pa.binary())],
                                         names=["i", "v"])

    def join(key, rows):
        parts = [np.frombuffer(v) for v in rows.sort_by("i").column("v").to_pylist()]
        return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([_joined(parts, k).tobytes()], pa.binary())})

    parts = named.mapInArrow(run, "i long, v binary")
    while tasks > FAN:
        parts = parts.withColumn("g", F.floor(F.col("i") / FAN).cast("long")).groupBy("g").applyInArrow(join, "i long, v binary")
        tasks = -(-tasks // FAN)
    got = [np.frombuffer(r.v) for r in sorted(parts.collect(), key=lambda r: r.i)]
    v = _joined(got, k) if got else np.zeros(k * k + m)
    return v[:k * k].reshape(k, k), v[k * k:]
