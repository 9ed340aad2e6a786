import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from quill.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TRUE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids_of(text):
    return np.frombuffer(bpe.codec(PATH, PATTERN).encode([text])[0], "<u4").tolist()


def test_query_against_tiktoken(spark, sf, llm_queries, doc_texts):
    got = {r.doc_id: r for r in llm_queries.op6_bpe(spark, sf).collect()}
    assert set(got) == set(doc_texts)
    for i, t in doc_texts.items():
        ids = TRUE.encode_ordinary(t or "")
        r = got[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_hard_pieces():
    random.seed(3)
    odd = ["a" * 3000, "ab" * 2000 + "abc" * 700, "🙂" * 500, "\n\n  x  \t", "", " ", "我们" * 900, "I'll we've",
           "<|endoftext|>", "x" * bpe.LONG, "x" * (bpe.LONG + 1)]
    odd += ["".join(random.choice("étionßabc") for _ in range(n)) for n in (1, 2, 7, 8, 9, 33, 600, 1500, 4000)]
    for t in odd:
        assert ids_of(t) == TRUE.encode_ordinary(t), t[:40]
        c = bpe.codec(PATH, PATTERN)
        assert c.decode(c.encode([t])[0]) == t.encode()


def test_heap_and_matrix_agree():
    c = bpe.codec(PATH, PATTERN)
    random.seed(5)
    for n in (2, 5, 40, 300):
        p = "".join(random.choice("theand ") for _ in range(n)).encode()
        assert c.merge([p])[0].tolist() == c.merge_long(p).tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    both = bpe.decode(bpe.encode(odd_docs, PATH, PATTERN, name="score"), PATH, PATTERN, ids_col="score_")
    assert both.columns == [*odd_docs.columns, "score_", "bytes"]
    for r in both.collect():
        assert bytes(r.bytes).decode() == (r.text or "")
    assert bpe.encode(no_docs, PATH, PATTERN).count() == 0
    assert bpe.round_trip(odd_docs, PATH, PATTERN).count() == odd_docs.count()
