"""Joins. Lookup sides are broadcast only behind a
size check; otherwise Catalyst plans a sort-merge join and AQE may re-plan
(and split skewed partitions) at run time."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast


def match_on_metrics(left: DataFrame, right: DataFrame, keys: list[str],
                     how: str = "left", salt_buckets: int | None = None) -> DataFrame:
    """Left equi-join on several (possibly NULL) columns, NULL matching
    NULL as in pandas ``merge``; many-to-many fan-out is kept. With
    ``salt_buckets`` the left rows of a hot key are spread over that many tasks
    and the right side is repeated for each; use it where the right side has
    one row per key."""
    if salt_buckets is None:
        r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
        cond = None
        for k in keys:
            e = left[k].eqNullSafe(r[f"_r_{k}"])
            cond = e if cond is None else cond & e
        return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})  # one text without NULL
    r = right.withColumn("_key", key).drop(*keys)
    return salted_join(left.withColumn("_key", key), r, ["_key"], how, buckets=salt_buckets).drop("_key")


def attach(df: DataFrame, result: DataFrame, key, how: str = "left") -> DataFrame:
    """Left join of a per-row result back by its key."""
    return df.join(result, on=key, how=how)


def lookup(df: DataFrame, dim: DataFrame, key, how: str = "left") -> DataFrame:
    """Left lookup join; the dimension is broadcast if it is small."""
    return df.join(sized_broadcast(dim), on=key, how=how)


def check_overrides(overrides: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """J4 guard: keys listed twice and chains (a value that is itself a key)."""
    dup = overrides.groupBy(key).count().where("count > 1").select(F.col(key).alias("problem"),
                                                                   F.lit("duplicate key").alias("kind"))
    chain = overrides.alias("a").join(overrides.alias("b"), F.col(f"a.{value}") == F.col(f"b.{key}"),
                                      "left_semi").select(F.col(key).alias("problem"),
                                                          F.lit("chain").alias("kind"))
    return dup.unionByName(chain)


def apply_overrides(df: DataFrame, col: str, overrides: DataFrame, key_col: str | None = None,
                    key: str = "key", value: str = "value") -> DataFrame:
    """Where ``key_col`` (default ``col``) is listed, replace ``col`` by the
    mapped value — one left join + ``coalesce`` instead of a row loop."""
    key_col = key_col or col
    o = overrides.select(F.col(key).alias("_ok"), F.col(value).alias("_ov"))
    out = df.join(sized_broadcast(o), F.col(key_col) == F.col("_ok"), "left")
    return out.withColumn(col, F.when(F.col("_ok").isNotNull(), F.col("_ov")).otherwise(F.col(col))).drop(
        "_ok", "_ov")


def first_word(c) -> "F.Column":
    return F.lower(F.get(F.split(F.trim(F.col(c) if isinstance(c, str) else c), r"\s+"), 0))


def gender_of(df: DataFrame, name_col: str, names: DataFrame, out: str = "gender",
              name_key: str = "first_name", gender_key: str = "gender") -> DataFrame:
    """First word of the name, lower-cased, looked up in a name→gender
    dictionary; NULL when unknown."""
    d = names.select(F.lower(F.col(name_key)).alias("_fn"), F.col(gender_key).alias(out))
    d = d.groupBy("_fn").agg(F.min(out).alias(out))  # a name listed twice: the first value in order
    return df.join(sized_broadcast(d), first_word(name_col) == F.col("_fn"), "left").drop("_fn")


def backfill(df: DataFrame, extracted: DataFrame, key, cols: list[str]) -> DataFrame:
    """Fill NULLs in ``cols`` from a second extraction keyed by ``key``."""
    keys = [key] if isinstance(key, str) else list(key)
    e = extracted.select(*keys, *[F.col(c).alias(f"_bf_{c}") for c in cols])
    out = df.join(e, on=keys, how="left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_bf_{c}")))
    return out.drop(*[f"_bf_{c}" for c in cols])


def cooccurrence(df: DataFrame, arr_col: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each requested (a, b): rows holding a, rows holding b, rows
    holding both — one scan, no pair enumeration."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ha = F.array_contains(F.col(arr_col), a)
        hb = F.array_contains(F.col(arr_col), b)
        aggs += [F.count_if(ha).alias(f"a{i}"), F.count_if(hb).alias(f"b{i}"),
                 F.count_if(ha & hb).alias(f"ab{i}")]
    r = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("tag_a"), F.lit(b).alias("tag_b"),
                     F.col(f"a{i}").cast("long").alias("n_a"), F.col(f"b{i}").cast("long").alias("n_b"),
                     F.col(f"ab{i}").cast("long").alias("n_both")) for i, (a, b) in enumerate(pairs)]
    return r.select(F.inline(F.array(*rows)))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", buckets: int = 16,
                salt_col: str = "_salt") -> DataFrame:
    """Equi-join that splits hot keys explicitly: each big-side row gets a salt
    in [0, buckets) from a hash of its own columns (deterministic across
    retries), the small side is repeated once per salt, and the join runs on
    (keys, salt). One hot key is thus spread over ``buckets`` tasks. Use when
    the small side is too large to broadcast but small enough to replicate."""
    b = big.withColumn(salt_col, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(buckets)))
    s = small.withColumn(salt_col, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return b.join(s, [*on, salt_col], how).drop(salt_col)
