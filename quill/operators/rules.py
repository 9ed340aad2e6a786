"""Association rules.

Mining goes level by level up to the length bound (``itemsets``); rules come
from joins of the frequent sets with the counts of their subsets. The redundancy
prune replaces the reference's dense n×n subset matrix by an inverted index:
every item set is posted under its rarest item, a rule looks only at the
postings of its own items, and containment is verified on packed bitsets.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import sum_by_base
from .common import measured_broadcast
from .filters import rules_for  # noqa: F401  (C8)
from .itemsets import frequent_sets
from .windows import rank_by

SEP = "\u0001"
#: probes of one item that a task of the prune should get
PROBES = 50_000


def mine_rules(tx: DataFrame, items_col: str = "items", min_support: float = 0.1,
               min_confidence: float = 0.5, max_len: int = 10,
               empty_antecedent: bool = True) -> DataFrame:
    """Rules X → y with support, confidence, lift and count.

    ``max_len`` bounds |X ∪ {y}| (arules ``maxlen``): no longer set is counted.
    ``empty_antecedent`` adds {} → y for items whose support reaches
    ``min_confidence`` (arules' default ``minlen = 1``). Antecedents are sorted.
    """
    mined = frequent_sets(tx, items_col, min_support, max_len)
    return rules_of(mined.frame(tx.sparkSession), mined.n, min_confidence, empty_antecedent)


def rules_of(sets: DataFrame, n: int, min_confidence: float = 0.5, empty_antecedent: bool = True) -> DataFrame:
    """Rules of the frequent sets (items sorted, count) of ``n`` transactions."""
    each = sets.where(F.size("items") > 1).select("items", "count", F.explode("items").alias("consequent")) \
        .withColumn("antecedent", F.filter("items", lambda x: x != F.col("consequent")))
    sides = sets.select(F.col("items").alias("antecedent"), F.col("count").alias("_a"))
    ones = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("count").alias("_y"))
    total = F.lit(float(n))
    r = (each.join(sides, "antecedent").join(measured_broadcast(ones), "consequent")
         .withColumn("confidence", F.col("count") / F.col("_a")).where(F.col("confidence") >= min_confidence)
         .select("antecedent", "consequent", (F.col("count") / total).alias("support"), "confidence",
                 (F.col("confidence") / (F.col("_y") / total)).alias("lift"), "count"))
    if empty_antecedent:
        r = r.unionByName(ones.withColumn("support", F.col("_y") / total).where(F.col("support") >= min_confidence).select(
            F.array().cast("array<string>").alias("antecedent"), "consequent", "support", F.col("support").alias("confidence"),
            F.lit(1.0).alias("lift"), F.col("_y").alias("count")))
    return r


def rule_order(prefix: str = ""):
    """Total order for ranking: lift, confidence, support (desc), then text."""
    return [F.desc(f"{prefix}lift"), F.desc(f"{prefix}confidence"), F.desc(f"{prefix}support"),
            F.asc(F.array_join(F.col(f"{prefix}antecedent"), SEP)), F.asc(f"{prefix}consequent")]


def rank_rules(rules: DataFrame, n: int | None = None) -> DataFrame:
    """All rules, or the best ``n``, by lift with a full tie-break, ``rank`` 1-based."""
    return rank_by(rules, rule_order(), n=n, col="rank")


def _items(r: DataFrame) -> DataFrame:
    return r.withColumn("_items", F.array_sort(F.array_union("antecedent", F.array("consequent"))))


def prune_redundant(rules: DataFrame, n: int | None = None, ranked: bool = False) -> DataFrame:
    """M15 (+J8): among all rules, or the top ``n`` by lift, drop rule j when a
    higher-ranked rule i has items(i) ⊆ items(j) (equal sets included)."""
    top = rules if ranked else rank_rules(rules, n)
    return top.join(redundant(_items(top).select(F.col("rank").cast("long").alias("rank"), "_items")), "rank", "left_anti")


def probes_of(sets: DataFrame) -> tuple[DataFrame, int]:
    """The rows the prune shuffles for (rank, _items): each different set once as
    a posting under its rarest item, each rule once per item as a probe; and the
    number of items. (item, salt, probe, rank, bits)"""
    freq = sets.select(F.explode("_items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    names = [(r.item, r.n) for r in freq.orderBy("n", "item").collect()]  # rarest first; items of frequent sets
    width = -(-len(names) // 64)
    salts = {i: max(1, -(-c // PROBES)) for i, (_, c) in enumerate(names)}

    def code(batches):
        number = {x: i for i, (x, _) in enumerate(names)}
        for b in batches:
            rows = [sorted(number[x] for x in row) for row in b.column("_items").to_pylist()]
            bits = np.zeros((len(rows), width * 64), np.uint8)
            for i, row in enumerate(rows):
                bits[i, row] = 1
            packed = np.packbits(bits, axis=1, bitorder="little") if len(rows) else bits
            yield pa.RecordBatch.from_arrays([b.column("rank"), pa.array(rows, pa.list_(pa.int32())),
                                              pa.array([p.tobytes() for p in packed], pa.binary())], names=["rank", "codes", "bits"])

    coded = sets.mapInArrow(code, "rank long, codes array<int>, bits binary")
    best = coded.groupBy("bits").agg(F.min("rank").alias("rank"), F.first("codes").alias("codes"))
    many = F.create_map(*[F.lit(x) for kv in salts.items() if kv[1] > 1 for x in kv]) if max(salts.values(), default=1) > 1 else None
    copies = F.coalesce(many[F.col("item")], F.lit(1)) if many is not None else F.lit(1)
    postings = best.select(F.col("codes")[0].alias("item"), "rank", "bits") \
        .select("item", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.lit(False).alias("probe"), "rank", "bits")
    probes = coded.select(F.explode("codes").alias("item"), "rank", "bits") \
        .select("item", F.pmod(F.hash("rank"), copies).cast("int").alias("salt"), F.lit(True).alias("probe"), "rank", "bits")
    return postings.unionByName(probes), len(names)


def redundant(sets: DataFrame) -> DataFrame:
    """Ranks of the sets (rank, _items) that hold a better-ranked set."""
    rows, _ = probes_of(sets)

    def check(key, group):
        words = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(group.num_rows, -1)
        rank, probe = group.column("rank").to_numpy(), group.column("probe").to_numpy()
        order = np.argsort(rank, kind="stable")
        words, rank, probe = words[order], rank[order], probe[order]
        held, at = words[probe], rank[probe]
        gone = np.zeros(len(at), bool)
        minimal = np.zeros((0, words.shape[1]), np.uint64)
        for r, w in zip(rank[~probe], words[~probe], strict=True):
            if len(minimal) and ((minimal & w) == minimal).all(axis=1).any():
                continue  # a better posting covers all that this one does
            minimal = np.vstack([minimal, w])
            after = np.searchsorted(at, r, "right")
            gone[after:] |= ((held[after:] & w) == w).all(axis=1)
        return pa.table({"rank": pa.array(at[gone], pa.int64())})

    return rows.groupBy("item", "salt").applyInArrow(check, "rank long").distinct()


def antecedent_freq(rules: DataFrame, min_count: int = 10) -> DataFrame:
    """How often each item appears in antecedents; ``important`` when the
    count exceeds ``min_count``."""
    f = rules.select(F.explode("antecedent").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return f.withColumn("important", F.col("n") > min_count)


def antecedent_base_freq(rules: DataFrame) -> DataFrame:
    """M16 (G13): antecedent counts rolled up to the base variable."""
    return sum_by_base(antecedent_freq(rules), "item", "n")


def response_rules(rules: DataFrame, text: str) -> DataFrame:
    """Rules whose consequent mentions ``text`` (partial match), best lift first."""
    r = rules.where(F.contains(F.col("consequent"), F.lit(text)))
    return r.orderBy(*rule_order())
