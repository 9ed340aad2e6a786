"""Sources and sinks."""
from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_report(spark: SparkSession, path: str, skip_rows: int = 6, max_rows: int | None = None,
                schema: StructType | str | None = None, positions: bool = False) -> DataFrame:
    """A1: an analytics export — ``skip_rows`` preamble lines, a header line,
    then all data rows, or the first ``max_rows`` of each file.

    Lines are read as text with their file, the first byte of their split and
    their place in it; lines are counted per split, and running sums over a file's
    splits number them. So the body is neither sorted nor shuffled: a table of one
    row per split meets it. Every file must have the same header: files that differ
    raise. Rows are parsed by the CSV reader, so quoting follows the CSV rules (a
    report row holds no newline). File order is not forced on the result: with
    ``positions`` the columns ``_file`` and ``_ln`` say where a row was.
    """
    from ..operators.common import measured_broadcast
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_pos"))
    splits = lines.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    idx = lines.join(measured_broadcast(splits), ["_file", "_at"]).select(
        "value", "_file", (F.col("_before") + F.col("_pos") - F.col("_first")).alias("_ln"))
    headers = idx.where(F.col("_ln") == skip_rows).groupBy("value").agg(F.min("_file").alias("_file")).limit(2).collect()
    if not headers:
        raise ValueError(f"{path}: fewer than {skip_rows + 1} lines")
    if len(headers) > 1:
        raise ValueError(f"headers differ: {headers[0]['_file']} and {headers[1]['_file']}")
    body = idx.where(F.col("_ln") > skip_rows)
    if max_rows is not None:
        body = body.where(F.col("_ln") <= skip_rows + max_rows)
    names = next(iter(csv.reader([headers[0]["value"]])))
    if schema is None:
        ddl = ", ".join(f"`{n}` string" for n in names)
    elif isinstance(schema, str):
        ddl = schema
    else:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = body.select("_file", "_ln", F.from_csv(F.col("value"), ddl).alias("_r"))  # JVM-side
    return parsed.select(*(["_file", "_ln"] if positions else []), "_r.*")


def read_stage(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A2: a staged table. CSV is read by header with a declared schema and
    ``multiLine`` (article text holds newlines); Parquet is the default."""
    if fmt == "csv":
        r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        if schema is not None:
            r = r.schema(schema)
        return r.csv(path)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None) -> None:
    """A3: write a stage table (Parquet by default, CSV with header on request)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A4: article pages ``(page_id, url, html)``; fetching is not built."""
    return spark.read.parquet(path).select("page_id", "url", "html")
