"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word
shingles. Two fingerprints link when they differ in at most ``radius`` bits.

Search: the 64 bits are cut into ``radius`` blocks. If two fingerprints differ
at all, hiding a block that holds a differing bit leaves at most ``radius - 1``
differences among the visible bits, so balls of half of that around both meet:
for every hidden block each distinct fingerprint emits all variants of its
visible bits within ``(radius - 1 + 1) // 2`` flips (radius 3: one flip; 3
blocks, 132 variants). The variants are shuffled; fingerprints that share one
are verified on all 64 bits. Whole-word balls of radius 2 would need 2,081
variants each, over ten times the input.

Copies collapse to one fingerprint before anything is emitted. Within one
variant the linked fingerprints become a spanning forest, not all pairs, which
keeps every connection; the components come from alternating large-star and
small-star rounds on those edges.

Defined results: NULL and empty texts have fingerprint zero and link like any
other; equal texts share a fingerprint; a NULL doc_id never names a component
unless all its members are NULL; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_list, dropped, slices, written

SEED = 42
#: shingles whose bits are unpacked at once (64 bytes each)
_CHUNK = 65536
#: variants that one task emits
VARIANTS = 2_000_000


def text_fingerprint(text: bytes | None, shingle: int = 3) -> bytes:
    """The 8 bytes (big-endian) of a text's fingerprint."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and blanks x20 x09-x0D only
    if not words:
        return bytes(8)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    digest = xxhash.xxh64_digest
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.add.reduce(np.unpackbits(hashes[i:i + _CHUNK], axis=1), axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp long): one row per input row."""
    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 2)):
            raw = b"".join([text_fingerprint(t, shingle) for t in binary_list(b.column(2))])
            fp = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)],
                                             names=["doc_id", "text_hash", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"),
                        F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, text_hash long, fp long"))


def text_hash(text_col: str):
    """64-bit hash of the text, NULL as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ball_masks(radius: int) -> list[tuple[int, int]]:
    """(and, xor) for every variant a fingerprint emits. The hidden block holds
    the block's number, so variants of different blocks never meet."""
    if radius < 1:
        return [(-1, 0)]
    blocks, flips, masks = max(2, radius), radius // 2, []
    edges = [64 * i // blocks for i in range(blocks + 1)]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        keep = ((1 << 64) - 1) ^ (((1 << (hi - lo)) - 1) << lo)
        seen = [b for b in range(64) if not lo <= b < hi]
        for k in range(flips + 1):
            for bits in combinations(seen, k):
                masks.append((_signed(keep), _signed(sum(1 << b for b in bits) | (i << lo))))
    return masks


def spanning_edges(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph 'at most radius bits apart'."""
    left, queue, edges = members[1:], [members[0]], []
    while left.size:
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        v = queue.pop()
        near = np.bitwise_count(left ^ v) <= radius
        if near.any():
            found = left[near]
            edges.extend((int(v), int(x)) for x in found)
            queue.extend(found)
            left = left[~near]
    return edges


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct edges (a, b) of forests that connect what links, from distinct
    fingerprints (column ``fp``)."""
    def forest(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            yield from forest_of(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
        yield from forest_of(key, fp)

    def forest_of(key, fp):
        if len(key) < 2:
            return
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        two = start[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        pairs = [np.stack([fp[near], fp[near + 1]], 1)]
        for s, n in zip(start[size > 2], size[size > 2], strict=True):
            if e := spanning_edges(fp[s:s + n], radius):
                pairs.append(np.array(e, np.uint64))
        e = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        if len(e):
            yield pa.RecordBatch.from_arrays(
                [pa.array(e[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

    ball = F.array(*[F.struct(F.lit(a).cast("long").alias("keep"), F.lit(x).cast("long").alias("flip"))
                     for a, x in ball_masks(radius)])
    tasks = -(-fps.count() * len(ball_masks(radius)) // VARIANTS)  # the balls are much larger than what emits them
    v = (fps.select("fp").repartition(max(1, tasks), "fp").select("fp", F.explode(ball).alias("m"))
         .select(F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("key"), "fp"))
    return (v.repartition("key").sortWithinPartitions("key")
            .mapInArrow(forest, "a long, b long").distinct())


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating
    large-star and small-star rounds until the edge set stays the same."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), "edges")
    mark = None
    while True:
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark or not got[0]:
            break
        mark = tuple(got)
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.*").where("u <> v").distinct(), "edges")
        dropped(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())


def near_groups(docs: DataFrame, radius: int = 3, shingle: int = 3,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): one row per input row.
    ``root`` is the smallest fingerprint of the component, ``component_id`` the
    smallest doc_id in it."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = star_components(links(reps.select("fp"), radius))
    named = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(low, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_per_group(docs: DataFrame, radius: int = 3, shingle: int = 3,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns as they are: of each
    component the row with the smallest doc_id (NULL last; of rows with one id
    that with the smallest text hash; of rows equal in both any one)."""
    groups = near_groups(docs, radius, shingle, id_col, text_col)
    none, number = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))  # keys without NULL: one exchange of the texts
    keep = groups.groupBy("root").agg(F.min(F.struct(none.alias("__none"), number.alias("__id"), F.col("text_hash").alias("__hash")))
                                      .alias("k")).select("k.*")
    key = ["__none", "__id", "__hash"]
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("__hash"),
                      F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    row = row.select(none.alias("__none"), number.alias("__id"), "__hash", "__row")
    once = Window.partitionBy(*key).orderBy(*key)
    return (row.join(keep, key, "left_semi").withColumn("__n", F.row_number().over(once))
            .where("__n = 1").select("__row.*"))
