import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quill.llm import sharding


def test_query_law_and_rows(spark, sf, llm_queries, doc_texts):
    rows = llm_queries.op2_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in doc_texts.items()}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def places(df, **kw):
    s = sharding.external_shuffle(df, 5, bucket_bytes=20000, **kw)
    return s.select("shard", "slot", "bucket", "record.doc_id").orderBy("shard", "slot").collect()


def test_order_depends_on_rows_and_seed_only(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    a = places(df)
    assert a == places(df.repartition(7, "n_chars")) != places(df, seed=1)
    assert len({r.bucket for r in a}) > 5
    ids = [r.doc_id for r in a]
    near = sum(abs(x - y) == 1 for x, y in zip(ids, ids[1:], strict=False))
    assert near < 12  # neighbours before are hardly neighbours after


def test_every_place_is_equally_likely(spark):
    df = spark.range(4).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    first = Counter()
    for seed in range(60):
        got = sharding.external_shuffle(df, 1, seed=seed, bucket_bytes=1 << 20).where("slot = 0").first()
        first[got.record.doc_id] += 1
    assert all(4 <= first[i] <= 28 for i in range(4))


def test_odd_rows_and_files(spark, odd_docs, no_docs, tmp_path):
    s = sharding.external_shuffle(odd_docs, 24)
    assert s.count() == odd_docs.count()
    assert s.select("record.*").exceptAll(odd_docs).count() == 0
    assert sharding.external_shuffle(no_docs, 24).count() == 0
    named = sharding.external_shuffle(odd_docs.drop("shard"), 3)
    sharding.write_shards(named, str(tmp_path / "shards"))
    back = sharding.read_shards(spark, str(tmp_path / "shards"), named.schema)
    key = lambda rows: sorted(map(repr, rows))
    assert back.columns == named.columns and key(back.collect()) == key(named.collect())
    wide = odd_docs.selectExpr("*", "map('a', 1.5D) AS m", "doc_id AS bucket", "text AS __d0", "1 AS __g0", "2 AS __copy")
    got = sharding.external_shuffle(wide, 3)
    assert Counter(str(r.record) for r in got.collect()) == Counter(str(r) for r in wide.collect())


def test_a_record_larger_than_a_bucket(spark):
    df = spark.createDataFrame([(i, "x" * (50_000 if i == 3 else 10)) for i in range(40)], "doc_id long, text string")
    got = sharding.external_shuffle(df, 4, bucket_bytes=1000).collect()
    assert sorted(r.record.doc_id for r in got) == list(range(40)) and Counter(r.shard for r in got) == {s: 10 for s in range(4)}


@pytest.mark.parametrize("text", ["", "word " * 10])
def test_no_python_in_the_plan(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    plan = sharding.external_shuffle(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_repeated_rows_spread_over_the_buckets(spark):
    """A third of the rows are equal, another has NULL ids and texts."""
    i = F.col("id")
    df = spark.range(6000).select(F.when(i % 3 == 0, 7).when(i % 3 == 1, i + 10).alias("doc_id"),
                                  F.when(i % 3 == 0, "again " * 5).when(i % 3 == 1, F.concat(F.lit("own "), i)).alias("text"),
                                  F.when(i % 3 == 2, -0.0).otherwise(0.0).alias("x"))
    s = sharding.external_shuffle(df, 4, bucket_bytes=8000)
    rows = s.collect()
    sizes = Counter(r.bucket for r in rows)
    assert len(rows) == 6000 and len(sizes) > 10 and max(sizes.values()) < 2 * 6000 / len(sizes)
    assert Counter((*r.record[:2], str(r.record.x)) for r in rows) == Counter((*r[:2], str(r.x)) for r in df.collect())
    key = lambda rows: sorted((r.shard, r.slot, r.bucket, str(r.record)) for r in rows)
    assert key(rows) == key(sharding.external_shuffle(df.repartition(5), 4, bucket_bytes=8000).collect())
