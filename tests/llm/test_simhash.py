from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quill.llm import simhash


def brute_print(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """{id: smallest id} by union of all pairs at most 3 bits apart."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_query_against_all_pairs(spark, sf, llm_queries, doc_texts):
    got = {r.doc_id: r for r in llm_queries.op9_simhash(spark, sf).collect()}
    prints = {i: brute_print(t) for i, t in doc_texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)


def test_links_keep_every_connection(spark):
    """Random balls and chains: the edges connect exactly what lies within 3 bits."""
    rng = np.random.default_rng(7)
    prints, base = [], rng.integers(0, 2**63, 12, dtype=np.int64)
    for b in base:
        x = int(b)
        for _ in range(25):
            prints.append(x)
            x ^= sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 6), replace=False))
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.star_components(simhash.links(df)).collect()}
    want = brute_components({p: p for p in prints})
    assert {p: roots.get(p, p) for p in prints} == want
    assert max(Counter(want.values()).values()) > 3


def test_odd_rows(spark, odd_docs, no_docs):
    groups = simhash.near_groups(odd_docs)
    assert groups.count() == odd_docs.count()
    zero = groups.where("fp = 0").select("component_id").distinct().collect()
    assert [r[0] for r in zero] == [0]
    kept = simhash.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == groups.select("root").distinct().count()
    assert kept.where(F.col("text") == "one two three").count() <= 1
    assert kept.where("doc_id = 6").count() == 1  # one row of the two equal ones
    assert simhash.near_groups(no_docs).count() == 0 and simhash.one_per_group(no_docs).count() == 0
