import hashlib
import random

import numpy as np
import pytest

from quill.llm import winnow


def brute(text, k, w):
    if not text:
        return []
    code = np.array([ord(c) for c in text], np.uint64)
    k = min(k, len(text))
    h = [int(winnow.gram_hashes(code[i:i + k], k)[0]) for i in range(len(text) - k + 1)]
    out = []
    for i in range(max(1, len(h) - w + 1)):
        win = h[i:i + w]
        p = i + max(j for j, x in enumerate(win) if x == min(win))
        if not out or out[-1] != (h[p], p):
            out.append((h[p], p))
    return out


def as_list(f):
    return [(int(a), int(b)) for a, b in f]


@pytest.mark.parametrize(("k", "w"), [(5, 4), (8, 10), (3, 1), (30, 100)])
def test_against_brute_force(monkeypatch, k, w):
    monkeypatch.setattr(winnow, "BLOCK", 500)
    rnd = random.Random(k)
    texts = [None, "", "a", "ab" * 50, "abcdefgh" * 30, "x" * 700, "é🙂" * 400]
    texts += ["".join(rnd.choice("abc ") for _ in range(n)) for n in (3, 7, 8, 9, 20, 300, 499, 500, 501, 1200, 2600)]
    for t, f in zip(texts, winnow.fingerprint(texts, k, w), strict=True):
        assert as_list(f) == brute(t, k, w)


def test_match_guarantee():
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared = word(winnow.W + winnow.K - 1)
    for _ in range(20):
        a, b = (set(f["h"].tolist()) for f in winnow.fingerprint([word(300) + shared + word(99), word(17) + shared + word(400)]))
        assert a & b


def test_query_against_brute_force(spark, sf, llm_queries, doc_texts):
    rows = {r.doc_id: r for r in llm_queries.op3_winnowing(spark, sf).collect()}
    ids = sorted(doc_texts)
    assert sorted(rows) == ids
    prints = dict(zip(ids, winnow.fingerprint([doc_texts[i] for i in ids]), strict=True))
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, u, r = doc_texts[i] or "", doc_texts[j] or "", rows[i]
        q = len(t) // 4
        changed = t[:len(t) - q] + u[:q]
        new = winnow.fingerprint([changed])[0]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == prints[i].tobytes().hex() and r.edited_fingerprint == new.tobytes().hex()
        a, b, c = (set(f["h"].tolist()) for f in (prints[i], new, prints[j]))
        assert r.near_edited == winnow.likeness(a, b) and r.near_next == winnow.likeness(a, c)
    for i in ids[:40]:
        assert as_list(prints[i]) == brute(doc_texts[i], winnow.K, winnow.W)


def test_ranges_do_not_change_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    get = lambda d, n: sorted(map(tuple, winnow.edited_neighbours(d, range_bytes=n).collect()))
    assert get(docs, 1 << 30) == get(docs.repartition(9), 20000)


def test_odd_rows(spark, odd_docs, no_docs):
    for size in (1 << 20, 50):
        rows = winnow.edited_neighbours(odd_docs, range_bytes=size).collect()
        assert len(rows) == odd_docs.count()
        empty = [r for r in rows if r.n_chars == 0]
        assert empty and all(r.fingerprint == "" and r.near_edited == 1 for r in empty)
    assert winnow.edited_neighbours(no_docs).count() == 0
    one = winnow.edited_neighbours(odd_docs.where("doc_id = 8")).first()
    assert one.near_next == 1 and one.n_chars == 5000


def test_short_texts_stay_near_their_edited_form():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    texts = [word(n) for n in range(60, 301) for _ in range(3)]
    changed = [winnow.edited(t, word(300)) for t in texts]
    for t, a, b in zip(texts, winnow.fingerprint(texts), winnow.fingerprint(changed), strict=True):
        assert winnow.likeness(set(a["h"].tolist()), set(b["h"].tolist())) > 0, len(t)
