"""The registered queries of the training-data operators: thin digests of what
the operators return, under their contracts."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import ship_package
from . import ann, bpe, collocations, langid, licenses, lm, mixing, sharding, simhash, tokenfile, warc, whitening, winnow
from .common import fold, scratch_path, table


def op1_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, lm.train(docs.where(fold("doc_id") != 1)))
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_sharding(spark, sf_dir):
    shuffled, path = sharding.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24), scratch_path(spark, "shards")
    sharding.write_shards(shuffled, path)
    s = sharding.read_shards(spark, path, shuffled.schema)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return s.select(F.col("record.doc_id").alias("doc_id"),
                    (F.octet_length(text).cast("long") + sharding.ROW_BYTES).alias("size"),
                    F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                    "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket")


def op3_winnowing(spark, sf_dir):
    return winnow.edited_neighbours(table(spark, sf_dir, "documents"))


def op4_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_warc(spark, sf_dir):
    back = warc.round_trip(table(spark, sf_dir, "pages"), bodies=False, revisit_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


#: documents have no path: a tree of source, language and thousand; every 100th
#: document lies at its source's root, every other 10th in its language's folder
DOC_PATH = ("concat_ws('/', coalesce(source, '_'), "
            "CASE WHEN doc_id % 100 <> 0 THEN coalesce(lang, '_') END, "
            "CASE WHEN doc_id % 10 <> 0 THEN CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS {text}) END, CAST(doc_id AS {text}))")


def op7_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.expr(DOC_PATH.format(text="STRING")).alias("path"))
    return licenses.scan(docs).select(
        "row.doc_id", "row.path", "own_license", F.round("own_cosine", 6).alias("own_cosine"), "is_file",
        "inherited_license", "inherited_from", "license")


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold("doc_id") != 0))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op9_simhash(spark, sf_dir):
    g = simhash.near_groups(table(spark, sf_dir, "documents"), radius=3, shingle=3)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", mixing.topic().alias("topic"), mixing.token_count().alias("n_tokens"))
    return mixing.calibrated(docs, ["source", "lang", "topic"]).select(
        "row.*", F.round("prob", 6).alias("prob"), F.round("ratio", 6).alias("ratio"), F.round("draw", 9).alias("draw"), "copies", "kept")


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), lo=2, hi=3, min_count=10,
                                     inside_percent=50, top=2000)


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_token_files(spark, sf_dir):
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_winnowing": op3_winnowing,
    "op4_nearest": op4_nearest,
    "op5_warc": op5_warc,
    "op6_bpe": op6_bpe,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_token_files": op13_token_files,
}



def _shipped(query):
    """The query on a session whose workers have the package."""
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)
    run.__name__ = query.__name__
    return run


QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}

ORACLES: dict[str, str] = {
    "op7_license_scan": licenses.oracle(DOC_PATH.format(text="VARCHAR")),
    "op10_mixing": mixing.oracle(),
    "op11_collocations": collocations.oracle(),
}
