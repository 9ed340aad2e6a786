import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quill.llm import gru, lm


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)] + [lm.END]


def base_of(rows, train):
    """{id: (n_tokens, n_known, N, base)} by the contract's formula."""
    c = Counter(t for i, text in rows if i in train for t in tokens_of(text))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, text in rows:
        ts = tokens_of(text)
        out[i] = (len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
    return out


def test_query_base_and_held_out_gain(spark, sf, llm_queries, doc_texts):
    got = {r.doc_id: r for r in llm_queries.op1_lm_scoring(spark, sf).collect()}
    held = {i for i in doc_texts if zlib.crc32(str(i).encode()) % 5 == 1}
    want = base_of(list(doc_texts.items()), set(doc_texts) - held)
    assert set(got) == set(want)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def slow_score(model, text):
    """The model's base-10 log probability of a text, one token after the other."""
    v, h = model.vocab.value, model.shape.hidden
    p = {k: a.astype(np.float64) for k, a in model.shape.views(model.weights).items()}
    rare = {bytes(r.token): r.n for r in model.counts.collect()}
    at = {t: i for i, t in enumerate(v.tokens)}
    s, total = np.zeros(h), 0.0
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for t in tokens_of(text):
        i = at.get(t)
        x, c, w = v.xcw[i] if i is not None else (*v.ending(t), -1)
        total += soft(s @ p["wc"] + p["bc"])[c] / math.log(10)
        if w >= 0:
            total += soft(s @ p["wh"][c] + p["bh"][c])[w] / math.log(10)
        else:
            total += math.log10(((v.counts[i] if i is not None else rare.get(t, 0)) + 0.5) / model.sums[c])
        a, g = p["wx"][x], s @ p["u"]
        z, r = (1 / (1 + np.exp(-(a[k * h:(k + 1) * h] + g[k * h:(k + 1) * h]))) for k in (0, 1))
        new = np.tanh(a[2 * h:] + r * g[2 * h:])
        s = new + z * (s - new)
    return total


def test_scores_step_by_step_with_a_small_vocabulary(spark, sf, monkeypatch):
    """Rare tokens come by the join; long texts in pieces; state is carried on."""
    monkeypatch.setattr(lm, "BLOCK", 1500)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    model = lm.train(docs.where("doc_id >= 10"), known=1500, max_epochs=1)
    assert model.counts.count() > 100
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in sorted(texts)[:14]:
        assert abs(got[i].score - slow_score(model, texts[i])) < 1e-4 * max(1, abs(got[i].score)), i
    want = base_of(list(texts.items()), {i for i in texts if i >= 10})
    assert all(abs(got[i].base_score - b[3]) < 1e-6 * max(1, abs(b[3])) and got[i].n_known == b[1] for i, b in want.items())


def test_training_reads_what_scoring_reads(monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 700)
    rng = np.random.default_rng(4)
    tokens = [lm.END] + sorted({bytes(rng.integers(97, 101, rng.integers(1, 8), dtype=np.uint8)) for _ in range(1500)})
    v = lm.Vocabulary(tokens, np.arange(len(tokens), 0, -1))
    texts = [None, "", "  a B\tunknown zzzz abca \n" * 9, b" ".join(tokens[1:]).decode() + "\x0bnew \u00e9\u00e9\u2003x", " ", "a"]
    column = pa.array(["skipped", *texts])[1:]
    out, ends, ids, odd, unknown = v.read(column)
    assert all((a == b).all() for a, b in zip(np.split(out, ends[:-1] + 1), v.texts(column), strict=True))
    want = [tokens_of(t) for t in texts]
    assert np.diff(np.r_[-1, ends]).tolist() == [len(w) for w in want]
    assert [tokens[i] if i >= 0 else None for i in ids] == [w if w in tokens else None for t in want for w in t]
    assert odd.to_pylist() == [w for t in want for w in t if w not in tokens]
    assert unknown.tolist() == [sum(w not in tokens for w in t) for t in want]
    for row, w in zip(out, (w for t in want for w in t), strict=True):
        assert tuple(row[:3]) == (tuple(v.xcw[tokens.index(w)]) if w in tokens else (*v.ending(w), -1))


def test_probabilities_sum_to_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    m = lm.train(docs, max_epochs=1)
    v, p = m.vocab.value, m.shape.views(m.weights)
    s = np.random.default_rng(0).normal(0, 0.5, m.shape.hidden)
    e = np.exp((s @ p["wc"] + p["bc"]).astype(np.float64))
    of_class = e / e.sum()
    tail = v.w < 0
    inside = np.bincount(v.c[tail], (v.counts[tail] + 0.5) / m.sums[v.c[tail]], minlength=m.shape.classes)[lm.HEADS:]
    unseen = 0.5 / m.sums[lm.HEADS:]
    assert np.allclose(inside + unseen, 1)
    assert abs(of_class.sum() - 1) < 1e-9


def small_documents(rng, sizes):
    """Documents of a small network, and its shape and weights."""
    shape = gru.Shape(9, 4, 6, 3, 5)
    docs = []
    for k, n in enumerate(sizes):
        d = np.zeros((n, 6), np.int32)
        d[:, gru.X], d[:, gru.C], d[:, gru.DOC] = rng.integers(0, 9, n), rng.integers(0, 6, n), k
        d[:, gru.W] = np.where(d[:, gru.C] < 3, rng.integers(0, 5, n), -1)
        d[0, gru.FIRST] = d[-1, gru.LAST] = 1
        docs.append(d)
    return docs, shape, shape.initial(np.ones(6), np.ones((3, 5)))


def test_gradient_against_differences(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    rng = np.random.default_rng(1)
    docs, shape, flat = small_documents(rng, [7, 13, 11, 9])
    lane, token, live = next(gru.windows(docs, 2, 20))
    assert live.sum() == 40 - (~live).sum() and token[live][:, gru.FIRST].sum() == 4
    total = lambda w: gru.Net(shape, w, 2).score(lane, token, live)[1].sum()
    g, logp = gru.Net(shape, flat, 2).gradient(lane, token, live)
    n = int(live.sum())
    for i in rng.integers(0, len(flat), 80):
        e = np.zeros(len(flat))
        e[i] = 1e-5
        assert abs(-(total(flat + e) - total(flat - e)) / 2e-5 / n - g[i]) < 1e-6
    assert abs(total(flat) - logp) < 1e-6


def test_pieces_of_rows_and_weights_change_nothing(monkeypatch):
    docs, shape, flat = small_documents(np.random.default_rng(4), [7, 13, 11, 9])
    lane, token, live = next(gru.windows(docs, 2, 20))

    def learned(rows, piece):
        monkeypatch.setattr(gru, "ROWS", rows)
        monkeypatch.setattr(gru, "PIECE", piece)
        mine, adam = flat.copy(), gru.Adam(len(flat), 0.01)
        for _ in range(3):
            g, logp = gru.Net(shape, mine, 2).gradient(lane, token, live)
            adam.step(mine, g)
        return mine, logp
    (one, a), (many, b) = learned(1 << 20, 1 << 20), learned(3, 5)
    assert np.allclose(one, many, atol=1e-5) and abs(a - b) < 1e-3
    assert not np.allclose(one, flat, atol=1e-3)


def test_training_holds_no_logits_of_all_tokens(monkeypatch):
    """Logits of at most ``ROWS`` tokens, and words' of twice as many, exist at a time."""
    monkeypatch.setattr(gru, "ROWS", 8)
    docs, shape, flat = small_documents(np.random.default_rng(5), [90, 70, 80, 60])
    lane, token, live = next(gru.windows(docs, 4, 60))
    net = gru.Net(shape, flat, 4)
    g, _ = net.gradient(lane, token, live)
    assert net.kept["classes"].size <= 8 * shape.classes
    assert net.kept["words"].size <= max(16, max(np.bincount(token[live][:, gru.C]))) * shape.words
    assert np.isfinite(g).all() and (g != 0).any()


def test_large_logits_and_a_second_window(monkeypatch):
    """Logits beyond the range of exponentials, ragged lanes and buffers used again
    give what a new network gives in double precision."""
    docs, shape, flat = small_documents(np.random.default_rng(6), [41, 7, 13, 30])
    flat *= 40
    shape.views(flat)["bc"][:] += 200
    both = list(gru.windows(docs, 3, 9))
    net, used = gru.Net(shape, flat, 3), []
    for w in both:
        t, logp = net.score(*w)
        used.append((t.copy(), logp.copy()))
    monkeypatch.setattr(gru, "F32", np.float64)
    exact = gru.Net(shape, flat.astype(np.float64), 3)
    for w, (t, logp) in zip(both, used, strict=True):
        want_t, want = exact.score(*w)
        assert (t == want_t).all() and np.isfinite(logp).all() and np.allclose(logp, want, rtol=1e-3, atol=1e-2)
    assert len(both) > 2 and not all(w[2].all() for w in both)


@pytest.mark.parametrize(("count", "steps"), [(1, 3), (4, 7), (64, 16)])
def test_lanes_do_not_change_scores(count, steps):
    rng = np.random.default_rng(2)
    docs, shape, flat = small_documents(rng, rng.integers(1, 60, 12))
    def by_doc(items, lanes, steps):
        out, seen, net = Counter(), 0, gru.Net(shape, flat, lanes)
        for lane, token, live in gru.windows(items, lanes, steps):
            t, logp = net.score(lane, token, live)
            seen += len(t)
            for d, x in zip(t[:, gru.DOC], logp, strict=True):
                out[int(d)] += float(x)
        assert seen == sum(map(len, items))
        return out
    got = by_doc(docs, count, steps)
    for k, d in enumerate(docs):
        assert abs(got[k] - by_doc([d], 1, 5)[k]) < 1e-3


def test_learning_lowers_the_loss():
    rng = np.random.default_rng(3)
    docs, shape, flat = small_documents(rng, [200] * 20)
    for d in docs:
        d[:, gru.X] = d[:, gru.C] = np.arange(200) % 2  # a class follows the other
        d[:, gru.W] = 0
    adam = gru.Adam(len(flat), 0.02)
    first = gru.fit(flat, shape, iter(docs), adam, lanes=4, steps=8, most=64)
    for _ in range(5):
        last = gru.fit(flat, shape, iter(docs), adam, lanes=4, steps=8, most=64)
    assert first[1] == last[1] == 4000 and last[0] > 0.2 * first[0]


def test_means_add_up_in_levels(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30").repartition(7)
    m = lm.train(docs, max_epochs=1)
    args = (docs, "text", m.vocab, m.shape, m.weights, 0.001)
    whole = lm.trained(*args)
    monkeypatch.setattr(lm, "FAN", 2)
    assert np.allclose(whole, lm.trained(*args), atol=1e-5)


def test_odd_rows(spark, odd_docs, no_docs):
    model = lm.train(odd_docs, max_epochs=1)
    rows = lm.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].n_tokens == by[1][0].n_tokens == 1 and by[0][0].score == by[1][0].score
    assert len(by[6]) == 2 and len(by[None]) == 2
    assert abs(by[6][0].score - by[12][0].score) < 1e-6  # equal texts
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    bare = lm.train(no_docs)
    assert (bare.tokens, bare.distinct) == (0, 0)
    rows = lm.score(odd_docs, bare).where(F.col("n_known") == 0).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) for r in rows)
    assert lm.score(no_docs, model).count() == 0


def test_words_beyond_the_first_512_are_predicted_one_by_one():
    tokens = [lm.END] + [f"w{i:05d}x".encode() for i in range(20000)]
    v = lm.Vocabulary(tokens, np.arange(len(tokens), 0, -1))
    assert (v.w[:8192] >= 0).all() and (v.w[8192:] == -1).all() and len(lm.ROUNDS) == 3
    assert len(set(v.xcw[:8192, 0].tolist())) == 8192  # own input ids
    assert len(set(map(tuple, v.xcw[:8192, 1:].tolist()))) == 8192  # own places in their classes
    (read,) = v.texts(pa.array([tokens[5000].decode()]))
    assert tuple(read[0, :3]) == tuple(v.xcw[5000])


def test_epochs_do_not_depend_on_the_size(spark, sf, monkeypatch):
    calls = []
    monkeypatch.setattr(lm, "trained", lambda docs, text_col, vocab, shape, flat, rate: calls.append(rate) or flat)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lm.train(docs.where("doc_id < 5"))
    small, calls[:] = list(calls), []
    monkeypatch.setattr(lm, "most_frequent", lambda counts, known: ([lm.END], np.array([1])))
    big = docs.crossJoin(spark.range(80)).select("doc_id", "text")  # over 4 million words
    assert lm.train(big).tokens > 4_000_000
    assert calls == small and len(calls) == 2 * len(lm.ROUNDS)
