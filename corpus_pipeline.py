"""A training-data pipeline over ``documents``: each stage calls one operator
of ``quill.llm`` on everything its predecessor kept.

NULL in any column and repeated rows pass like others, except that a document
without text has no language and goes; of equal and nearly equal documents that
with the smallest id stays (of rows with that id, one); an empty table gives an
empty result; further columns are handed on."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import bpe, langid, mixing, simhash
from quill.llm.common import fold, table, written
from quill.session import ship_package

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: a document goes when its language has a smaller posterior probability
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; NULL texts, texts without a letter
    and undecided ones go. Learns from four fifths of the labelled rows. Documents
    without a language get the one told, which the mixing then goes by."""
    model = langid.train(docs.where(fold("doc_id") != 0))
    told = langid.predict(docs, model, names=("__lang", "__score"))
    lang, score = told.columns[-2:]
    return told.where((F.col(lang) != langid.UND) & (F.col(score) >= LEAST_SCORE)).select(
        *[F.coalesce("lang", F.col(lang)).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return simhash.one_per_group(docs, radius=3, shingle=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to flattened shares of source, language and topic; those
    of cells that are short of their target come more than once."""
    return mixing.mix(docs, power=0.8, budget_share=1.0, seed=42)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, check="decodes", keep_text=False)
    return ids.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decodes")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_bytes),
]

#: naive Bayes, SimHash and byte pairs are beyond SQL: tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
