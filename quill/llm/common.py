"""Helpers shared by the training-data operators: scratch tables in the shared
folder, crc folds, deterministic range bounds, free column names."""
from __future__ import annotations

import atexit
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table  # noqa: F401

_ROOTS: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; the application's
    scratch folder goes when its Python driver ends."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; a context that has already stopped keeps it."""
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage
    cut, and readable after the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing will read again."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/llm-" in f:
            _remove(df.sparkSession, f)


def fold(column: str, n: int = 5) -> Column:
    """crc32 of the value as text, modulo n (NULL counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or with underscores until no column has that name (any case)."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def range_bounds(keys: DataFrame, column: str, n: int, per_range: int = 64) -> np.ndarray:
    """At most n-1 cut points of a long column, the same for the same rows.

    Of the distinct non-null keys those with the ``n * per_range`` smallest
    hashes are taken (the driver gets 8 bytes each) and cut evenly."""
    if n < 2:
        return np.zeros(0, np.int64)
    k = keys.select(F.col(column).cast("long").alias("k")).where("k IS NOT NULL")
    got = (k.select("k", F.xxhash64("k").alias("h")).distinct()
           .orderBy("h", "k").limit(n * per_range).select("k").toPandas()["k"].to_numpy(np.int64))
    got.sort()
    if not len(got):
        return np.zeros(0, np.int64)
    return np.unique(got[(np.arange(1, n) * len(got)) // n])


def range_of(bounds: np.ndarray):
    """Column function: the number of bounds at or below the key, NULL first."""
    @F.pandas_udf("int")
    def which(key: pd.Series) -> pd.Series:
        has = key.notna().to_numpy()
        out = np.zeros(len(key), np.int32)
        out[has] = np.searchsorted(bounds, key[has].to_numpy(np.int64), side="right")
        return pd.Series(out)
    return which


def slices(batch, column: int, size: int = 1 << 20):
    """The rows of an Arrow batch in runs whose texts have about ``size`` bytes
    together (or one text), so that few texts are Python objects at a time."""
    import pyarrow.compute as pc
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy() + 64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, before + size, "right")) - at)
        yield batch.slice(at, n)
        at += n


def binary_list(column) -> list:
    """Arrow text column as a list of bytes (None for NULL), without decoding."""
    import pyarrow as pa
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
