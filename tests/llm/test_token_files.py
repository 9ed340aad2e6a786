import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quill.llm import pfor, tokenfile
from quill.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def plain(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 63, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50000, 1 << 32])
@pytest.mark.parametrize("share", [0.5, 0.9, 1.0])
def test_blocks(n, top, share):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    if n > 60:
        ids[rng.integers(0, n, 7)] = (1 << 32) - 1  # outliers
    blocks = pfor.encode(ids, share)
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1][:len(blocks)]
    data = np.frombuffer(b"".join(blocks), np.uint8)
    assert (pfor.decode(data, starts) == ids).all()
    if share == 1.0:
        assert all(np.frombuffer(b[:9], pfor.HEAD)["exceptions"][0] == 0 for b in blocks)


def test_outliers_do_not_widen_a_block():
    ids = np.full(512, 1000, np.uint32) + np.arange(512, dtype=np.uint32) % 16
    ids[[3, 77]] = 1 << 31
    (block,) = pfor.encode(ids)
    head = np.frombuffer(block[:9], pfor.HEAD)[0]
    assert (head["low"], head["width"], head["exceptions"]) == (1000, 4, 2) and len(block) == 9 + 256 + 2 * 6


def test_encoder_equals_the_library(tok):
    rnd = random.Random(1)
    signs = [" ", " ", " ", "a", "b", "'s", "\n", "é", "1", ".", "\t", "\x1c", "\x85", "　", "\xa0", "Z", "🙂", "​", "word"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(6000)]
    texts += ["", " ", "  ", "x" * 5000, "I'll  x <|endoftext|> y", "a " * 3000]
    enc = tokenfile.Encoder(PATH)
    for _ in range(2):
        ids, count = enc.encode(texts)
        want = [plain(tok, t) for t in texts]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert enc.encode([])[0].tolist() == [] and enc.encode(["", ""])[1].tolist() == [0, 0]


def test_words_are_looked_up_once_a_slice(tok):
    enc, asked = tokenfile.Encoder(PATH), []
    inner, enc._numbers = enc._numbers, lambda cuts: (asked.append(len(cuts)), inner(cuts))[1]
    texts = pa.array([None, "one two two  one\ntwo", "two one " * 500, "\n two", ""]).slice(1)
    ids, count = enc.encode(texts)
    want = [plain(tok, t) for t in texts.to_pylist()]
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert sum(asked) < 20  # of 1,009 words
    got = enc.encode(pa.array(["two", None, "one"]))
    assert got[1].tolist() == [len(plain(tok, "two")), 0, len(plain(tok, "one"))]


def test_memory_is_bounded(tok, monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 50)
    enc = tokenfile.Encoder(PATH)
    for i in range(0, 300, 20):
        texts = [f"word{j} other{j}x again" for j in range(i, i + 20)]
        assert enc.encode(texts)[0].tolist() == [k for t in texts for k in plain(tok, t)]
        assert len(enc.number) <= 50 + 100


def expected(tok, rows, end=0):
    """Rows in the order of the files: id (None first), then any order."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(tok, text) + [end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_against_the_library(spark, sf, llm_queries, doc_texts, tok):
    got = sorted(tuple(r) for r in llm_queries.QUERIES["op13_token_files"](spark, sf).collect())
    assert got == sorted(expected(tok, doc_texts.items()))


def test_ranges_and_files_do_not_change_rows(spark, sf, doc_texts, tok):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    got = sorted(tuple(r) for r in tokenfile.round_trip(docs, PATH, range_bytes=20000, file_bytes=3000).collect())
    assert got == sorted(expected(tok, doc_texts.items()))


def test_odd_rows(spark, odd_docs, no_docs, tok):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    clash = odd_docs.selectExpr("*", "1 AS id", "2 AS h", "3 AS nth", "4 AS part", "5 AS ids", "6 AS start")
    for size in (1 << 20, 100):
        got = tokenfile.round_trip(clash, PATH, with_ids=True, range_bytes=size).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == \
            sorted((i is None, i or 0, n, c) for i, _, n, c in expected(tok, rows))
        ordered = sorted(got, key=lambda r: r.start)  # starts have no gap and follow the ids
        assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:i]) for i in range(len(ordered))]
        ids = [r.doc_id for r in ordered]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    assert tokenfile.round_trip(no_docs, PATH).count() == 0


def test_many_equal_rows_spread_over_files(spark):
    docs = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same text again' AS text").repartition(6)
    folder = scratch_path(spark, "tokens")
    files = tokenfile.write_tokens(docs, folder, PATH, range_bytes=6000).collect()
    assert len(files) >= 6 and max(f.docs for f in files) < 1500 and sum(f.docs for f in files) == 3000
    starts = sorted(r.start for r in tokenfile.read_tokens(spark, folder, False).collect())
    assert starts == list(range(0, 3000 * 5, 5))


def test_reading_parts_of_a_file(spark, sf, doc_texts, tok):
    folder = scratch_path(spark, "tokens")
    files = tokenfile.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), folder, PATH).collect()
    fs, base = tokenfile._store(folder)
    every = np.concatenate([np.array(plain(tok, doc_texts[i]) + [0], np.uint32) for i in sorted(doc_texts)])
    first = min(files, key=lambda f: (f.part, f.roll))
    f = tokenfile.Reader(fs, f"{base}/{first.file}")
    assert f.tokens == first.tokens
    for a, b in ((0, 1), (511, 513), (700, 700), (100, 5000), (f.tokens - 3, f.tokens), (0, f.tokens)):
        assert f.tokens_between(a, b).tolist() == every[a:b].tolist()
    ids = sorted(doc_texts)
    assert f.document(3).tolist() == plain(tok, doc_texts[ids[3]]) + [0] and f.ids[3] == ids[3]


def test_damaged_files_are_found(spark):
    folder = scratch_path(spark, "tokens")
    docs = spark.createDataFrame([(i, "some words " * 50) for i in range(9)], "doc_id long, text string")
    name = tokenfile.write_tokens(docs, folder, PATH).first().file
    path = f"{folder.removeprefix('file:')}/{name}"
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="differs from its manifest"):
        tokenfile.read_tokens(spark, folder).collect()
