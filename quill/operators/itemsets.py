"""Frequent item sets of bounded length, level by level.

Transactions become bitsets of their frequent items, equal ones counted once. For each length up to ``max_len`` the driver joins the
frequent sets of the length before on their common prefix and drops what has an
infrequent subset; the candidates go out in broadcasts of at most
``BROADCAST_BYTES`` (several in turn when there are more), every task counts
them by ANDing item bitmaps over its rows, and one shuffle adds the counts up.
No set longer than ``max_len`` is ever made or counted.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_path

BROADCAST_BYTES = 16 << 20
#: rows whose bitmaps a task holds at once, and bytes of one AND of them: both stay in a core's cache
ROWS, AND_BYTES = 1 << 17, 1 << 20
#: frequent single items; with support s there are at most (items per row) / s
MAX_ITEMS = 1 << 15


@dataclass
class Level:
    """Sets of one length: rows of item numbers, their counts, and how many
    candidates were counted in how many passes over the transactions."""
    sets: np.ndarray
    counts: np.ndarray
    candidates: int
    passes: int


@dataclass
class Mined:
    names: list[str]
    n: int
    levels: list[Level] = field(default_factory=list)

    def frame(self, spark) -> DataFrame:
        """(items, count): items in ascending order."""
        names = pa.array(self.names, pa.string())
        parts = []
        for lv in self.levels:
            k = lv.sets.shape[1]
            flat = names.take(pa.array(lv.sets.ravel().astype(np.int64)))
            offsets = pa.array(np.arange(len(lv.sets) + 1, dtype=np.int32) * k)
            parts.append(pa.table({"items": pa.ListArray.from_arrays(offsets, flat), "count": pa.array(lv.counts, pa.int64())}))
        if not parts:
            return spark.createDataFrame([], "items array<string>, count long")
        return spark.createDataFrame(pa.concat_tables(parts))


def candidates(sets: np.ndarray) -> np.ndarray:
    """Sets one longer whose subsets are all in ``sets`` (sorted rows, sorted):
    two sets that differ in their last item alone are joined."""
    m, k = sets.shape
    if m < 2:
        return np.zeros((0, k + 1), sets.dtype)
    new = np.r_[True, (sets[1:, :-1] != sets[:-1, :-1]).any(axis=1)] if k > 1 else np.r_[True, np.zeros(m - 1, bool)]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, m])
    partners = np.repeat(first + size, size) - np.arange(m) - 1  # later sets of the same prefix
    left = np.repeat(np.arange(m), partners)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners)
    out = np.column_stack([sets[left], sets[right, -1]])
    for drop in range(k - 1):  # the joined two are known to be frequent
        if not len(out):
            break
        out = out[_known(np.delete(out, drop, axis=1), sets)]
    return out


def _known(rows: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Which rows are among ``sets``."""
    view = lambda x: np.ascontiguousarray(x.astype(">u4")).view(f"V{4 * x.shape[1]}").ravel()
    return np.isin(view(rows), view(sets))


def _bitmaps(bits: np.ndarray, weights: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Per binary digit of the weights: its value, and for each item the packed
    rows whose weight has that digit."""
    out = []
    for digit in range(int(weights.max()).bit_length() if len(weights) else 0):
        rows = bits[(weights >> digit) & 1 == 1]
        if len(rows):
            items = np.unpackbits(rows, axis=1, bitorder="little").T
            room = -(-len(rows) // 64) * 64
            items = np.pad(items, ((0, 0), (0, room - len(rows))))
            out.append((1 << digit, np.ascontiguousarray(np.packbits(items, axis=1, bitorder="little")).view(np.uint64)))
    return out


def count_sets(maps: list[tuple[int, np.ndarray]], cand: np.ndarray) -> np.ndarray:
    """Weighted number of rows that hold each candidate; a prefix shared by
    neighbours is ANDed once."""
    total = np.zeros(len(cand), np.int64)
    for value, items in maps:
        step = max(1, AND_BYTES // (8 * items.shape[1]))
        for i in range(0, len(cand), step):
            c = cand[i:i + step]
            new = np.r_[True, (c[1:, :-1] != c[:-1, :-1]).any(axis=1)]
            head = c[new]
            rows = items[head[:, 0]]
            for j in range(1, c.shape[1] - 1):
                rows &= items[head[:, j]]
            rows = rows[np.cumsum(new) - 1] & items[c[:, -1]]
            total[i:i + step] += value * np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
    return total


def _pass(coded: DataFrame, cand: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the candidates that reach ``least``."""
    sc = coded.sparkSession.sparkContext
    shared = sc.broadcast(cand)

    def run(batches):
        sets, total = shared.value, None
        held, size = [], 0

        def flush():
            bits = np.concatenate([b for b, _ in held])
            return count_sets(_bitmaps(bits, np.concatenate([w for _, w in held])), sets)

        for b in batches:
            if b.num_rows:
                raw = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                held.append((raw, b.column("w").to_numpy()))
                size += b.num_rows
            if size >= ROWS:
                total, held, size = flush() + (0 if total is None else total), [], 0
        if held:
            total = flush() + (0 if total is None else total)
        if total is not None:
            at = np.flatnonzero(total)
            for i in range(0, len(at), 1 << 16):
                some = at[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["i", "n"])

    got = (coded.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
           .toArrow().sort_by("i"))
    shared.unpersist()
    return got.column("i").to_numpy(), got.column("n").to_numpy()


def _singles(batches):
    """Rows that hold each item, of bitsets and their weights: (i, n)."""
    for b in batches:
        if b.num_rows:
            bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            n = b.column("w").to_numpy() @ np.unpackbits(bits, axis=1, bitorder="little").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["i", "n"])


def frequent_sets(tx: DataFrame, items_col: str = "items", min_support: float = 0.1, max_len: int = 10) -> Mined:
    """All item sets of up to ``max_len`` items held by ``min_support`` of the
    rows. Items repeated in a row and NULL items do not count; a row without
    items is a row. A row count of zero has no sets."""
    spark = tx.sparkSession
    rows = tx.select(F.col(items_col).cast("array<string>").alias("items"))
    path = stage_path(spark, "transactions")
    rows.write.parquet(f"{path}/items")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/items")
    n = rows.count()
    if not n or max_len < 1:
        return Mined([], n)
    least = max(1, math.ceil(round(min_support * n, 6)))
    ones = rows.select(F.explode("items").alias("item")).where(F.col("item").isNotNull()).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = sorted((r.item, r.n) for r in ones.limit(MAX_ITEMS + 1).collect())
    if len(found) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} frequent items")
    out = Mined([x for x, _ in found], n)
    if not found:
        return out
    width = -(-len(found) // 8)
    names = out.names

    def encode(batches):
        known = pa.array(names, pa.string())
        for b in batches:
            lists = b.column("items")
            code = pc.index_in(lists.flatten().cast(pa.string()), value_set=known)
            has = code.is_valid().to_numpy(zero_copy_only=False)
            bits = np.zeros((b.num_rows, width * 8), np.uint8)
            bits[pc.list_parent_indices(lists).to_numpy()[has], code.drop_null().to_numpy()] = 1
            packed = np.packbits(bits, axis=1, bitorder="little")
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * width
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(packed)])],
                                             names=["bits"])

    coded = rows.mapInArrow(encode, "bits binary").groupBy("bits").agg(F.count(F.lit(1)).alias("w"))
    coded.write.parquet(f"{path}/coded")
    coded = spark.read.schema(coded.schema).parquet(f"{path}/coded")
    # items repeated in a row were counted each time: their rows are counted on the bitsets
    ones = coded.mapInArrow(_singles, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow().sort_by("i")
    if not ones.num_rows:
        return out
    out.levels.append(Level(ones.column("i").to_numpy().astype(np.uint32)[:, None], ones.column("n").to_numpy().astype(np.int64), len(found), 1))
    while len(out.levels) < max_len and len(out.levels[-1].sets) > 1:
        cand = candidates(out.levels[-1].sets)
        if not len(cand):
            break
        step = max(1, BROADCAST_BYTES // (4 * cand.shape[1]))
        kept, counts = [], []
        for i in range(0, len(cand), step):
            at, c = _pass(coded, cand[i:i + step], least)
            kept.append(cand[i:i + step][at])
            counts.append(c)
        out.levels.append(Level(np.concatenate(kept), np.concatenate(counts), len(cand), -(-len(cand) // step)))
        if not len(out.levels[-1].sets):
            out.levels.pop()
            break
    return out
