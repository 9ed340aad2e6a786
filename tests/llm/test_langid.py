import unicodedata  # noqa: F401
import zlib

import numpy as np

from quill.llm import langid


def test_held_out_accuracy(spark, sf, llm_queries, duck):
    got = {r.doc_id: r for r in llm_queries.op8_language_id(spark, sf).collect()}
    rows = duck.execute("select doc_id, text, lang from documents").fetchall()
    assert len(got) == len(rows)
    hit = n = 0
    for i, text, lang in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und" and r.score == 0
        elif r.held_out and lang:
            n, hit = n + 1, hit + (r.lang_pred == lang)
    assert n > 20 and hit / n > 0.95


def test_blocks_do_not_change_counts():
    """The same n-grams whether a text fits a block or is cut into many."""
    text = "Ab cé, déf! 12 gh " * 50
    def bag(size):
        c = np.zeros((1 << 12) + 1, np.int64)
        for _, code, start, head in langid.blocks([text, None, "", "x"], size):
            for g in langid.grams(code, start, head, 12):
                c += np.bincount(g, minlength=len(c))
        return c[:-1]
    assert (bag(1 << 20) == bag(37)).all() and (bag(1 << 20) == bag(5)).all()
    low = text.lower()
    want = sum(any(x.isalpha() for x in low[i:i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1)) + 1
    assert bag(1 << 20).sum() == want


def test_scores_are_naive_bayes(spark):
    rows = [("aab", "x"), ("abb", "x"), ("bcc", "y"), ("zzz", None)]
    m = langid.train(spark.createDataFrame(rows, "text string, lang string"), bits=16, smooth=0.5)
    assert m.langs == ["x", "y"]
    def tokens(t):
        return [int(v) for _, c, s, h in langid.blocks([t]) for g in langid.grams(c, s, h, 16) for v in g if v < 1 << 16]
    want = []
    for lang in m.langs:
        train = [v for t, y in rows if y == lang for v in tokens(t)]
        p = [(train.count(v) + 0.5) / (len(train) + 0.5 * 65536) for v in tokens("abc")]
        want.append(np.log(p).sum() + np.log(sum(y == lang for _, y in rows) / 3))
    lang, score = m.predict(["abc"])
    best = int(np.argmax(want))
    assert lang == [m.langs[best]] and abs(score[0] - np.exp(want[best]) / np.exp(want).sum()) < 1e-5


def test_odd_rows(spark, odd_docs, no_docs):
    m = langid.train(odd_docs)
    out = langid.predict(odd_docs, m)
    assert out.columns == [*odd_docs.columns, "lang_pred_", "score_"]
    got = {r.text: r.lang_pred_ for r in out.collect()}
    assert got[None] == got[""] == got["1234 5678 !!"] == "und" and got["One TWO three"] == "en"
    none = langid.train(no_docs)
    assert none.langs == [] and {r.lang_pred_ for r in langid.predict(odd_docs, none).collect()} == {"und"}
    assert langid.predict(no_docs, m).count() == 0
