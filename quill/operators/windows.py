"""Order-dependent operators.

Skew rule: a key may hold a third of all rows, so nothing here uses a window
partitioned by a data key over raw rows. First-row picks are aggregates
(``min_by``, combined map-side); consecutive indexes come from a
range-partitioned sort plus per-partition offsets (``dense_index``).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import cut_lineage
from .common import input_bytes, measured_broadcast

#: bytes that one sort task of ``dense_index`` should get
SORT_BYTES = 128 << 20


def _as_cols(cols) -> list:
    if cols is None:
        return []
    if isinstance(cols, (str, Column)):
        return [cols]
    return list(cols)


def _sort_key(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dense_index(df: DataFrame, order_cols, partition_cols=(), index_col: str = "row_idx",
                start: int = 0, num_partitions: int | None = None) -> DataFrame:
    """Consecutive 0-based (``start``-based) index in ``order_cols`` order,
    restarted per ``partition_cols`` group — ``row_number() - 1`` without a
    single-task window.

    1. range-partition on (group, order) — a hot group spans many partitions;
    2. sort within partitions, tag partition id and position; checkpoint once so
       the two passes below see the same placement (and survive lost executors);
    3. per (partition, group): row count and first position (ungrouped: one row
       per partition), broadcast when its counted size allows;
    4. offsets = running count over earlier partitions of the same group;
    5. index = offset + position − first position.

    The number of ranges follows the input's size (``SORT_BYTES`` each).
    """
    spark = df.sparkSession
    order = [_sort_key(c) for c in _as_cols(order_cols)]
    parts = [c for c in _as_cols(partition_cols)]
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    nparts = num_partitions or (usual if size is None else
                                max(-(-size // SORT_BYTES), min(usual, spark.sparkContext.defaultParallelism)))
    keys = [F.col(c) for c in parts] + order
    srt = (df.repartitionByRange(nparts, *keys).sortWithinPartitions(*keys)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    srt = cut_lineage(srt)
    stats = srt.groupBy("_pid", *parts).agg(F.count(F.lit(1)).alias("_cnt"),
                                            F.min("_mid").alias("_first"))
    w = Window.partitionBy(*parts).orderBy("_pid") if parts else Window.orderBy("_pid")
    stats = stats.withColumn("_off", F.sum("_cnt").over(w) - F.col("_cnt"))
    s = stats.select(F.col("_pid").alias("_spid"), *[F.col(c).alias(f"_s_{c}") for c in parts],
                     "_off", "_first")
    cond = F.col("_pid") == F.col("_spid")
    for c in parts:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    out = srt.join(measured_broadcast(s), cond, "inner")
    out = out.withColumn(index_col, (F.col("_off") + F.col("_mid") - F.col("_first") + start).cast("long"))
    return out.drop("_pid", "_mid", "_spid", "_off", "_first", *[f"_s_{c}" for c in parts])


def with_row_id(df: DataFrame, order_cols, col: str = "row_id", start: int = 0) -> DataFrame:
    """A5: stable sequential row id in an explicit order."""
    return dense_index(df, order_cols, index_col=col, start=start)


def dedup_first(df: DataFrame, key, order_cols) -> DataFrame:
    """Keep the first row per key in ``order_cols`` order.

    ``min_by(row, (order, row))`` is a partial aggregate: a key holding a third
    of the rows is reduced map-side, never gathered in one task. The row itself
    closes the order so ties resolve deterministically.
    """
    keys = _as_cols(key)
    order = _as_cols(order_cols)
    payload = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in payload])
    ordk = F.struct(*[_sort_key(c) for c in order], row)
    agg = df.groupBy(*keys).agg(F.min_by(row, ordk).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in payload]).select(*df.columns)


def dedup_prefer_nonnull(df: DataFrame, key, col: str, order_cols) -> DataFrame:
    """One row per key, preferring rows where ``col`` is not NULL, then the
    first in order (the intent of the reference's comment, §2.17 #7)."""
    order = [F.col(col).isNull()] + [_sort_key(c) for c in _as_cols(order_cols)]
    return dedup_first(df, key, order)


def rank_by(df: DataFrame, order: list, n: int | None = None, col: str = "rank") -> DataFrame:
    """Rank rows by a total order and keep the best ``n`` (1-based rank).

    With ``n`` the input is first cut by a TakeOrdered (per-partition top-n,
    then a bounded merge); the rank window then sees at most ``n`` rows.
    Without ``n`` the rank is a distributed ``dense_index``.
    """
    if n is None:
        return dense_index(df, order, index_col=col, start=1)
    top = df.orderBy(*order).limit(n)
    return top.withColumn(col, F.row_number().over(Window.orderBy(*order)).cast("long"))


def running_total(df: DataFrame, group_cols, order_col: str, value_col: str, out: str = "before",
                  num_partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value_col`` over the rows before each in ``order_col``
    order, per group, without a window over a whole group: rows are sorted over
    ranges, sums of the ranges are added up, and a window runs within each."""
    g = _as_cols(group_cols)
    size = input_bytes(df)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = num_partitions or (usual if size is None else max(1, -(-size // SORT_BYTES)))
    cut = cut_lineage(df.repartitionByRange(n, *g, order_col).withColumn("_r", F.spark_partition_id()))
    sums = cut.groupBy(*g, "_r").agg(F.sum(value_col).alias("_k"))
    earlier = Window.partitionBy(*g).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*g, "_r", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_from"))
    inner = Window.partitionBy(*g, "_r").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.withColumn("_in", F.coalesce(F.sum(value_col).over(inner), F.lit(0))).join(measured_broadcast(sums), [*g, "_r"])
            .withColumn(out, F.col("_from") + F.col("_in")).drop("_r", "_from", "_in"))


#: positions of a block of ``acf``
BLOCK = 1 << 16


def lag_products(own: np.ndarray, before: np.ndarray, max_lag: int) -> np.ndarray:
    """Σ own[t]·x[t−k] for k = 0..max_lag over a block and the ``max_lag`` values
    before it: one correlation by the fast Fourier transform (overlap-save)."""
    x = np.concatenate([before, own])
    n = 1 << max(1, (len(x) + max_lag).bit_length())
    y = np.zeros(n)
    y[len(before):len(x)] = own
    return np.fft.irfft(np.fft.rfft(y) * np.conj(np.fft.rfft(x, n)), n)[:max_lag + 1]


def acf(df: DataFrame, group_cols, index_col: str, value_col: str, max_lag: int) -> DataFrame:
    """Autocorrelation per group for lags 0..max_lag.

    ``index_col`` is a consecutive integer position inside the group (an
    iteration number, or ``dense_index`` output). Each series is cut into
    blocks of positions; only the ``max_lag`` rows before a block are copied to
    it, and all its lags come from one transform (``lag_products``), whose sums
    are added up by group. The plan has the same size for any number of lags, and
    no task holds a whole group. Positions that are not there count as no pair; a
    series of equal values has autocorrelation NULL.
    acf_k = Σ_t (x_t − m)(x_{t+k} − m) / Σ_t (x_t − m)².
    """
    g = _as_cols(group_cols)
    block = max(BLOCK, 4 * max_lag)
    base = df.select(*g, F.col(index_col).cast("long").alias("_t"), F.col(value_col).cast("double").alias("_x"))
    stats = base.groupBy(*g).agg(F.avg("_x").alias("_m"))
    same = None
    for c in g:
        e = F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        same = e if same is None else same & e
    stats = stats.select(*[F.col(c).alias(f"_s_{c}") for c in g], "_m")
    cen = base.join(measured_broadcast(stats), same if g else F.lit(True), "inner").select(
        *g, "_t", (F.col("_x") - F.col("_m")).alias("_d"))
    own = F.floor(F.col("_t") / block).cast("long")
    after = F.floor((F.col("_t") + max_lag) / block).cast("long")  # the block that needs this row as a predecessor
    cut = cen.select(*g, "_t", "_d", F.explode(F.array_distinct(F.array(own, after))).alias("_b"))

    def sums(key, rows):
        first = key[-1].as_py() * block  # of this block
        t = rows.column("_t").to_numpy() - first + max_lag
        x, there = np.zeros(max_lag + block), np.zeros(max_lag + block)
        d = rows.column("_d")
        known = d.is_valid().to_numpy()
        x[t[known]], there[t[known]] = d.to_numpy()[known], 1.0
        last = int(t.max()) + 1
        num = lag_products(x[max_lag:last], x[:max_lag], max_lag)
        pairs = np.rint(lag_products(there[max_lag:last], there[:max_lag], max_lag))
        lag = np.flatnonzero(pairs)
        cols = [pa.array([k.as_py()] * len(lag), k.type) for k in key[:-1]]
        return pa.table([*cols, pa.array(lag, pa.int64()), pa.array(num[lag])], names=[*names, "lag", "num"])

    names = [f"_g{i}" for i in range(len(g))]
    types = [cut.schema[cut.columns[i]].dataType for i in range(len(g))]
    schema = StructType([*[StructField(n, t) for n, t in zip(names, types, strict=True)], StructField("lag", LongType()), StructField("num", DoubleType())])
    total = cut.groupBy(*g, "_b").applyInArrow(sums, schema).groupBy(*names, "lag").agg(F.sum("num").alias("num"))
    lag0 = total.where("lag = 0").select(*[F.col(n).alias(f"{n}_") for n in names], F.col("num").alias("den"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return total.join(lag0, same).select(*[F.col(n).alias(c) for n, c in zip(names, cut.columns, strict=False)], "lag",
                                         F.when(F.col("den") > 0, F.col("num") / F.col("den")).alias("acf"))
