import re
from collections import Counter

import numpy as np
import pytest

from quill.llm import collocations as co

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """Counter of (lang, words) and words per language, straight from the texts."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, lo=2, hi=3, min_count=10, percent=50, top=2000):
    f, n = counted(rows)
    cand = {k: a for k, a in f.items() if lo <= len(k[1]) <= hi and a >= min_count}
    out = {}
    for (lang, w), a in cand.items():
        if any(100 * b >= percent * a for (g, v), b in cand.items()
               if g == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))):
            continue
        cut = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), f[lang, w[:cut[1]]], f[lang, w[cut[1]:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, n[lang], -s)
                  for lang, x in out.items() for i, (s, a, p, left, r) in enumerate(sorted(x)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_against_sql_and_brute_force(spark, sf, llm_queries, duck):
    got = rows_of(llm_queries.QUERIES["op11_collocations"](spark, sf))
    assert got and got == sorted(duck.execute(llm_queries.ORACLES["op11_collocations"]).fetchall())
    rows = duck.execute("select lang, text from documents").fetchall()
    f, n = counted(rows)
    for lang, _, phrase, a, left, r, total, score in got:
        w = tuple(phrase.split(" "))
        assert f[lang, w] == a and n[lang] == total
        assert (score, left, r) == min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                       for k in range(1, len(w)))[0:1] + (left, r)


SMALL = [("en", "New York. new york, NEW  york! san francisco bay\tarea new york"), (None, "new york new york"),
         ("de", "der der der der; der der\nder der"), ("en", "a b c d a b c d a b c d"), ("en", None), ("en", ""), ("fr", " ., \t"),
         ("en", "é ü é ü é ü"), ("en", " x y  x y")]


@pytest.mark.parametrize(("lo", "hi", "least", "percent", "top"), [(2, 3, 2, 50, 2000), (2, 4, 1, 80, 5), (3, 4, 2, 100, 3)])
def test_small_against_brute_force(spark, lo, hi, least, percent, top):
    rows = SMALL + SMALL[:4] * 2
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert rows_of(co.collocations(df, lo, hi, least, percent, top)) == brute(rows, lo, hi, least, percent, top)


def test_all_phrases_are_cut_from_their_texts(spark):
    df = spark.createDataFrame(SMALL * 2, "lang string, text string").repartition(2)
    f, _ = counted(SMALL * 2)
    assert rows_of(co.phrases(df, 4, 2)) == sorted((g, len(w), " ".join(w), a) for (g, w), a in f.items() if len(w) > 1 and a >= 2)


def test_collisions_lead_to_another_base(spark):
    rows = [("en", "a b. b a. c d e. e d c. a b c. c a b")] * 4  # with base 1 a sum does not know its order
    df = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, min_count=2)
    assert rows_of(co.collocations(df, min_count=2, bases=(1, *co.BASES))) == want
    with pytest.raises(ArithmeticError, match="collide"):
        co.collocations(df, min_count=2, bases=(1,))


def test_documents_of_equal_hash_are_told_apart(spark, monkeypatch):
    """With a single bit of a document's hash every pointer leads to half of them."""
    monkeypatch.setattr(co, "DOC_BITS", 1)
    rows = SMALL * 3
    runs, d, base = co.counted_phrases(spark.createDataFrame(rows, "lang string, text string"), 3, 2, "text", "lang")
    f, _ = counted(rows)
    got = co._cut_out(runs.where("k > 1"), d, base).collect()
    assert sorted((r.lang, r.phrase) for r in got) == sorted((g, " ".join(w)) for (g, w), a in f.items() if 1 < len(w) < 4 and a >= 2)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert rows_of(co.collocations(odd_docs, min_count=2)) == brute(rows, min_count=2)
    clash = odd_docs.selectExpr("*", "1 AS k", "2 AS key", "3 AS a", "4 AS place", "'x' AS phrase", "5 AS doc")
    assert rows_of(co.collocations(clash, min_count=2)) == brute(rows, min_count=2)
    assert co.collocations(no_docs).count() == 0


def test_blocks_do_not_change_words():
    rnd = np.random.default_rng(2)
    text = "".join(rnd.choice(list("ab Cd.\t\né "), 6000)).encode() + b"x" * 3000 + b" y z. " + b"w" * 500

    def words(block):
        old, co.BLOCK = co.BLOCK, block
        try:
            g = co.Group(True)
            for t in (text, b"one two", b"", text[:70], b"three"):
                g.add(("en", 0), t)
            h, doc, length, piece, start = g.close()
            code = np.concatenate(g.code).tobytes()
        finally:
            co.BLOCK = old
        pieces = np.cumsum(np.r_[0, np.diff(piece) != 0])
        return [(int(a), int(b), int(p), code[s:s + n]) for a, b, n, p, s in zip(h, doc, length, pieces, start, strict=True)]

    want = words(1 << 20)
    assert [w[3] for w in want[:3]] == re.findall(rb"[^\x20\x09.,;:!?\x0a-\x0d]+", text.lower())[:3]
    for block in (64, 97, 1000, 8000):
        assert words(block) == want


def test_words_of_one_hash_are_told_apart():
    g = co.Group(True)
    g.add(("en", 0), b"aa bb aa cc bb d")
    h, _, length, _, start = g.close()
    second = co._second_hashes(g, np.zeros_like(h), np.arange(6), start, length)
    assert len(set(second.tolist())) == 4 and second[0] == second[2] and second[1] == second[4]


def test_filter_passes_all_its_keys(spark):
    keys = np.random.default_rng(0).integers(0, 1 << co.BUCKET_BITS, 5000).astype(np.uint64)
    df = spark.createDataFrame([(int(k.view(np.int64)),) for k in keys], "key long")
    bitmap, bits = co._filter_of(df)
    assert co._passes(keys, bitmap, bits).all()
    other = np.random.default_rng(1).integers(0, 1 << co.BUCKET_BITS, 5000).astype(np.uint64)
    assert co._passes(other, bitmap, bits).mean() < 0.1
