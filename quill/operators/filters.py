"""Row filters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast


def drop_containing(df: DataFrame, col: str, tokens) -> DataFrame:
    """Drop rows whose text contains any token (literal match, not regex).
    NULL text is kept (pandas ``~contains`` keeps NaN rows)."""
    hit = None
    for t in tokens:
        h = F.contains(F.col(col), F.lit(t))
        hit = h if hit is None else (hit | h)
    return df.where(~F.coalesce(hit, F.lit(False)))


def drop_matching(df: DataFrame, col: str, rx: str) -> DataFrame:
    """Drop rows whose text matches the regex; NULL kept."""
    return df.where(~F.coalesce(F.col(col).rlike(rx), F.lit(False)))


def drop_equal(df: DataFrame, col: str, value) -> DataFrame:
    """Pandas ``df[df[c] != v]`` — NULL rows are kept."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def keys_where(df: DataFrame, col: str, value, key: str) -> DataFrame:
    """The keys of rows where ``col == value``."""
    return df.where(F.col(col) == F.lit(value)).select(key)


def drop_in(df: DataFrame, col: str, values) -> DataFrame:
    """C4: anti-membership. A Python list becomes ``NOT IN``; a DataFrame of
    values (any length) becomes a left-anti join, broadcast only if small."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias("_v")).distinct()
        return df.join(sized_broadcast(v), F.col(col) == F.col("_v"), "left_anti")
    return df.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def keep_in(df: DataFrame, col: str, values) -> DataFrame:
    """C4: membership."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias("_v")).distinct()
        return df.join(sized_broadcast(v), F.col(col) == F.col("_v"), "left_semi")
    return df.where(F.col(col).isin(list(values)))


def drop_null(df: DataFrame, cols) -> DataFrame:
    """Drop rows NULL in any of the columns (a plain predicate, §2.17 #10)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.dropna(subset=cols)


def null_keys(df: DataFrame, col: str, key: str) -> DataFrame:
    """Keys of rows where ``col`` is NULL."""
    return df.where(F.col(col).isNull()).select(key)


def count_where(df: DataFrame, cond: Column, name: str = "n") -> DataFrame:
    """Count of rows meeting a condition (one pass, no filter-then-count job)."""
    return df.agg(F.count_if(cond).cast("long").alias(name))


def drop_first(df: DataFrame, order_cols) -> DataFrame:
    """Drop exactly the first row of an explicit ascending order (NULL
    first; ties: the smallest remaining columns in schema order). One aggregate
    finds that row and how often it occurs; a filter drops it, and its other
    copies, if any, are put back. Nothing is sorted."""
    order_cols = [order_cols] if isinstance(order_cols, (str, Column)) else list(order_cols)
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = df.agg(F.min(F.struct(F.struct(*keys).alias("k"), row.alias("r"))).alias("f")).select("f.r").first()
    if first is None or first["r"] is None:
        return df
    schema = df.select(row.alias("r")).schema
    one = df.sparkSession.createDataFrame([(first["r"],)], schema)
    is_first = None
    for c in df.columns:
        e = F.col(f"`{c}`").eqNullSafe(F.col("_r")[c])
        is_first = e if is_first is None else is_first & e
    one = F.broadcast(one.withColumnRenamed("r", "_r"))  # a single row
    copies = df.join(one, is_first, "left_semi").count()
    rest = df.join(one, is_first, "left_anti")
    if copies > 1:
        back = one.select("_r.*", F.explode(F.sequence(F.lit(2), F.lit(copies))).alias("_copy")).drop("_copy")
        rest = rest.unionByName(back)
    return rest


def rules_for(rules: DataFrame, text: str, col: str = "consequent") -> DataFrame:
    """Rules whose consequent items contain the text."""
    return rules.where(F.exists(F.col(col), lambda x: F.contains(x, F.lit(text))))
