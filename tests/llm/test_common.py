import numpy as np
from pyspark.sql import functions as F

from quill.llm import common


def test_bounds_depend_on_the_keys_alone(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    a = common.range_bounds(df, "k", 8)
    b = common.range_bounds(df.union(df.limit(100)).repartition(5), "k", 8)
    assert (a == b).all() and len(a) == 7
    n = [r["count"] for r in df.groupBy(common.range_of(a)("k").alias("r")).count().collect()]
    assert len(n) == 8 and max(n) < 2.5 * min(n)


def test_ranges_of_nulls_and_few_keys(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (5,)], "k long")
    bounds = common.range_bounds(df, "k", 100)
    got = df.select("k", common.range_of(bounds)("k").alias("r")).collect()
    assert all(r.r == 0 for r in got if r.k is None) and len({r.r for r in got if r.k == 1}) == 1
    assert len(common.range_bounds(df.where("k IS NULL"), "k", 5)) == 0 and common.range_bounds(df, "k", 1).dtype == np.int64


def test_written_and_dropped(spark):
    t = common.written(spark.range(5), "t")
    assert t.count() == 5 and t.inputFiles()
    common.dropped(t)
    assert common.free_name(spark.range(1), "ID") == "ID_"
