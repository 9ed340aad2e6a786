from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from quill.llm import bpe, mixing, simhash
from tests.llm.test_simhash import brute_components, brute_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What every stage returned, read again like the next one's input."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_all_but_the_last_return_documents(spark, sf, stages):
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "simhash_dedup", "mix_sources", "bpe_encode"]
    for n in names[:-1]:
        assert stages[n].columns == COLUMNS
    sizes = [spark.read.parquet(f"{sf}/documents.parquet").count(), *[stages[n].count() for n in names]]
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[-1] == sizes[-2] > 0  # mixing may repeat documents


def test_language_stage_keeps_all_that_has_letters(stages, doc_texts):
    kept = {r.doc_id for r in stages["language_id"].collect()}
    assert kept == {i for i, t in doc_texts.items() if any(c.isalpha() for c in t or "")}


def test_one_of_each_group_stays(stages):
    texts = {r.doc_id: r.text for r in stages["language_id"].collect()}
    root = brute_components({i: brute_print(t) for i, t in texts.items()})
    assert {r.doc_id for r in stages["simhash_dedup"].collect()} == set(root.values())


def test_mixing_follows_its_draws(spark, stages):
    docs = stages["simhash_dedup"].select("doc_id", "source", "lang", mixing.topic().alias("topic"), mixing.token_count().alias("n_tokens"))
    c = mixing.calibrated(docs, ["source", "lang", "topic"]).select("row.*", "ratio", "draw", "copies").collect()
    want = {r.doc_id: int(r.ratio) + (r.draw < r.ratio - int(r.ratio)) for r in c}
    assert Counter(r.doc_id for r in stages["mix_sources"].collect()) == Counter(want) and {r.doc_id: r.copies for r in c} == want
    total = sum(r.n_tokens for r in c)
    assert abs(sum(r.n_tokens * r.ratio for r in c) - total) < 1e-6 * total


def test_predicted_languages_reach_the_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    true = {r.doc_id: r.lang for r in docs.collect()}
    told = P.language_id(spark, some, sf).collect()
    filled = [r for r in told if r.doc_id % 4 == 0]
    assert filled and all(r.lang for r in told) and all(r.lang == true[r.doc_id] for r in told if r.doc_id % 4)
    assert sum(r.lang == true[r.doc_id] for r in filled) >= 0.9 * len(filled)


def test_tokens_decode(stages):
    true = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.read_ranks(public_tokenizers.path(P.TOKENIZER)))
    texts = {r.doc_id: r.text for r in stages["mix_sources"].collect()}
    for r in stages["bpe_encode"].collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.decodes and r.n_tokens == len(ids) and ids == true.encode_ordinary(texts[r.doc_id])


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    docs = odd_docs.select(*COLUMNS, F.lit(1).alias("__row"), F.col("score"), F.lit("x").alias("text_hash"))
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        assert out.count() <= (docs.count() if name != "mix_sources" else 10 * docs.count())  # small sources come several times
        assert stage(spark, docs.where("1 = 0"), "").count() == 0
        if name != "bpe_encode":
            assert out.columns == docs.columns
    told = P.language_id(spark, docs, "").collect()
    assert {r.text for r in told if r.text} >= {"one two", "One TWO three"} and not any(r.text in (None, "", "1234 5678 !!") for r in told)
    assert simhash.one_per_group(docs).count() < docs.count()


def test_run_is_the_stages(spark, sf, stages):
    got = sorted(map(tuple, P.run(spark, sf).select("doc_id", "n_tokens").collect()))
    assert got == sorted(map(tuple, stages["bpe_encode"].select("doc_id", "n_tokens").collect()))
