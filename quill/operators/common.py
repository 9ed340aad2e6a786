"""Shared helpers: checked broadcast, null-safe join conditions, column lists."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup side is broadcast only when the optimizer's size estimate of its
# plan is under this bound; above it the join stays a shuffle join and AQE may
# still switch strategy from runtime statistics.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # pragma: no cover - non-classic sessions
        return None


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables a plan reads (a join's own estimate multiplies its
    sides); None if one of them has no known size."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Exception:  # pragma: no cover - non-classic sessions
        return None
    return None if any(s >= 1 << 60 for s in sizes) else sum(sizes)


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind a size check (estimate from the optimized plan)."""
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def measured_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint by the real number of rows. The optimizer takes an
    aggregate to be as large as its input, so a small result over a large table
    is checkpointed and counted instead."""
    from ..session import cut_lineage
    kept = cut_lineage(df)
    width = 8 + sum(32 if t in ("string", "binary") else 16 for _, t in df.dtypes)
    return F.broadcast(kept) if kept.count() * width <= max_bytes else kept


def feature_columns(df: DataFrame, minus=()) -> list[str]:
    """Column-name set difference, schema order kept."""
    drop = set(minus)
    return [c for c in df.columns if c not in drop]


def numeric_columns(df: DataFrame) -> list[str]:
    num = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")
    return [n for n, t in df.dtypes if t.startswith(num)]
