"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records uniformly into buckets small enough for a task's
memory, by a seeded hash of the record and, of equal records, the copy's
number; the number of buckets follows the bytes. Which rows may be equal is told
by counting their digests; only these are grouped (by all their columns), counted
and dealt out again, all others go to their bucket at once. Pass 2 puts each bucket's records into a fixed order and
permutes them by a Fisher-Yates shuffle (``shuffle(array, seed)``); the buckets
one after the other are the corpus in random order. Cutting that order into
equal runs gives the shards, so their row counts differ by one at most.
``write_shards`` writes every bucket's part of a shard from the task that shuffled
it, without a further exchange; ``read_shards`` reads the folders back.

``repartitionById`` makes bucket b partition b, and the shuffle's generator is
seeded by seed + partition, so a recomputed task gives the same order: the
result depends on rows, seed and bucket size, not on files or executors.

Defined results: NULL text has no bytes and counts like empty text; equal
rows keep their multiplicity and spread over the buckets; a record larger
than ``bucket_bytes`` is one record of its bucket, which a task holds beside
the others of that bucket; an empty table gives an empty result; the record is returned as one struct column, so no
column name can clash.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import BROADCAST_MAX_BYTES, measured_broadcast

#: a record's bytes beside its text
ROW_BYTES = 8


def record_size(text_col: str = "text"):
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + ROW_BYTES


def _inexact(kind) -> bool:
    """Whether grouping by such a column may change its values (-0.0)."""
    return any(x in kind.simpleString() for x in ("float", "double"))


def external_shuffle(df: DataFrame, shards: int, key: str = "doc_id", text_col: str = "text",
                     seed: int = 42, bucket_bytes: int = 16 << 20) -> DataFrame:
    """(shard int, slot long, bucket int, record struct): slot is the record's
    place in its shard, from 0 without gaps."""
    total = df.agg(F.count("*").alias("n"), F.sum(record_size(text_col)).alias("b")).first()
    n, buckets = total["n"], max(1, -(-(total["b"] or 0) // bucket_bytes))
    if buckets >= 1 << 31:
        raise ValueError("too many buckets: raise bucket_bytes")
    # rows of equal digests become one row per value with their number, then as many numbered rows again
    plain = df.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(df.columns)])
    keys = [F.col(c) for c in plain.columns]
    exact = [(c.cast("string") if _inexact(f.dataType) else c).alias(f"__g{i}") for i, (c, f) in enumerate(zip(keys, df.schema, strict=True))]
    values = [F.first(c).alias(f"__v{i}") for i, (c, f) in enumerate(zip(keys, df.schema, strict=True)) if _inexact(f.dataType)]
    place = {c: i for i, c in enumerate(df.columns)}
    names = [f"__g{i}" for i in range(len(keys))]
    hashable = [c.cast("string") if "map<" in f.dataType.simpleString() else c for c, f in zip(keys, df.schema, strict=True)]
    digest = [F.xxhash64(F.lit(i), *hashable).alias(f"__d{i}") for i in range(2)]
    marked = plain.select("*", *digest)
    more = measured_broadcast(plain.select(*digest).groupBy("__d0", "__d1").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    again = marked.join(more, ["__d0", "__d1"], "left_semi").groupBy(*exact).agg(F.count("*").alias("__n"), *values)
    again = again.select(*names, *[f"__v{i}" for i, f in enumerate(df.schema) if _inexact(f.dataType)],
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__copy"))
    once = marked.join(more, ["__d0", "__d1"], "left_anti").select(
        *exact, *[c.alias(f"__v{i}") for i, (c, f) in enumerate(zip(keys, df.schema, strict=True)) if _inexact(f.dataType)],
        F.lit(1).cast("long").alias("__copy"))
    single = once.unionByName(again)
    own = [F.col(f"__v{i}" if _inexact(f.dataType) else f"__g{i}") for i, f in enumerate(df.schema)]
    of_key, of_text = own[place[key]], own[place[text_col]]
    whole = [F.col(f"__g{i}").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"__g{i}") for i, f in enumerate(df.schema)]
    bucket = F.pmod(F.xxhash64(F.lit(seed), of_key, of_text, *whole, F.col("__copy")), F.lit(buckets)).cast("int")
    scattered = single.select(bucket.alias("bucket"), of_key.alias("key"),
                              F.xxhash64(F.coalesce(of_text, F.lit("")), *whole, F.col("__copy")).alias("h"),
                              F.struct(*[c.alias(n) for c, n in zip(own, df.columns, strict=True)]).alias("record"))
    # records in order of (key, text hash); the record itself need not be orderable
    item = F.struct("key", "h", "record")
    order = lambda a, b: F.when(a["key"].eqNullSafe(b["key"]), F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)) \
        .when(a["key"].isNull() | (a["key"] < b["key"]), -1).otherwise(1)
    mixed = (scattered.repartitionById(buckets, F.col("bucket")).groupBy("bucket")
             .agg(F.array_sort(F.collect_list(item), order).alias("items"))
             .select("bucket", F.posexplode(F.shuffle("items", F.lit(seed))).alias("pos", "item")))
    # a row per bucket: running sums within 1,024 buckets, then over those
    before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scattered.groupBy("bucket").count().withColumn("group", F.floor(F.col("bucket") / 1024))
    outer = counts.groupBy("group").agg(F.sum("count").alias("count")).select("group", before(Window.orderBy("group")).alias("outside"))
    starts = counts.withColumn("inside", before(Window.partitionBy("group").orderBy("bucket"))).join(outer, "group").select(
        "bucket", (F.col("inside") + F.col("outside")).alias("start"))
    starts = F.broadcast(starts) if buckets * 32 <= BROADCAST_MAX_BYTES else starts
    at = (F.col("start") + F.col("pos")).cast("long")
    # shard s takes the places from ceil(s n / shards) on
    shard = F.expr(f"(at * {shards}L) div {max(n, 1)}L")
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return (mixed.join(starts, "bucket").withColumn("at", at).withColumn("shard", shard)
            .select(F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot"), "bucket",
                    F.col("item.record").alias("record")))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder shard=s per shard; a file holds the run of slots that a bucket
    gave the shard, in order."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of ``write_shards`` with the given schema."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
