"""Lexicon emotion scoring.

Tokens are exploded JVM-side, pre-aggregated to (document, word, n) so a
frequent word costs one row per document, then joined to the lexicon (broadcast
when its size is checked small, else a shuffle join that AQE splits when one
word is hot), and pivoted with explicit emotion values in one aggregate.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast
from .joins import salted_join

# Emotion columns in the reference's order (8 emotions, 2 valences).
EMOTIONS = ["anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust",
            "negative", "positive"]
TOKEN_SPLIT = r"[^\p{L}']+"
# sentence end: ., ! or ? followed by white space; the boundary is marked
# with \u0001 and split there (no look-behind, so RE2 oracles can mirror it)
_MARK = "\u0001"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens (letters and apostrophes), empty pieces dropped."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda x: x != "")


def split_sentences(text: Column) -> Column:
    """Sentences — split after ., ! or ? followed by white space; empty
    pieces dropped, punctuation kept (unlike Spark's ``sentences``)."""
    marked = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"([.!?])\s+", "$1" + _MARK)
    return F.filter(F.split(marked, _MARK), lambda x: x != "")


def md5_lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Test lexicon derived from the corpus: each distinct token gets the
    emotion indexed by the first hex digit of md5(token) (0-9), a-f → none."""
    w = docs.select(F.explode(tokens(F.col(text_col))).alias("word")).distinct()
    d = F.substring(F.md5("word"), 1, 1)
    em = F.array(*[F.lit(e) for e in EMOTIONS])
    return w.where(d.rlike("^[0-9]$")).select(
        "word", F.get(em, d.cast("int")).alias("emotion"))


def lexicon_join(toks: DataFrame, lexicon: DataFrame, keys: list[str], value: str, salt_buckets: int = 16) -> DataFrame:
    """(keys…, word, value) ⋈ lexicon(word, emotion) → (keys…, emotion, value).

    A lexicon whose size is checked small is broadcast and meets the raw
    tokens. A large one is joined by shuffle: tokens are first summed to one
    row per (keys, word), and the join is salted, so a word that stands in a
    third of all documents is spread over many tasks."""
    lx = lexicon.select("word", "emotion").distinct()
    small = sized_broadcast(lx)
    if small is not lx:
        hits = toks.join(small, "word", "inner")
    else:
        sums = toks.groupBy(*keys, "word").agg(F.sum(value).alias(value))
        hits = salted_join(sums, lx, ["word"], "inner", buckets=salt_buckets)
    return hits.select(*keys, "emotion", value)


def emotion_counts(df: DataFrame, key, text_col: str, lexicon: DataFrame, suffix: str = "",
                   emotions=EMOTIONS) -> DataFrame:
    """Per row of ``df``: the number of lexicon words of each emotion in
    ``text_col`` (repeats counted). Summing per sentence and then per document
    equals counting over the document, so no sentence split is needed. Rows
    with NULL text or no match get 0 in every column."""
    keys = [key] if isinstance(key, str) else list(key)
    stacked = df.select(*keys, F.lit(suffix).alias("field"), F.col(text_col).alias("text"))
    return score_long(df.select(*keys), stacked, keys, [suffix], lexicon, emotions)


def emotion_rates(df: DataFrame, key, text_col: str, lexicon: DataFrame, suffix: str = "",
                  emotions=EMOTIONS) -> DataFrame:
    """Per sentence, emotion words ÷ words of the sentence, summed per
    (document, emotion); 0 fill (G6 + G7). The sum over sentences of k/words is
    the sum over hits of 1/words, so one aggregate on the hits is enough."""
    keys = [key] if isinstance(key, str) else list(key)
    sent = df.select(*keys, F.explode(split_sentences(F.col(text_col))).alias("s")).select(*keys, tokens(F.col("s")).alias("w"))
    toks = sent.where(F.size("w") > 0).select(*keys, (F.lit(1.0) / F.size("w")).alias("r"), F.explode("w").alias("word"))
    hits = lexicon_join(toks, lexicon, keys, "r")
    rates = hits.select(*keys, F.concat("emotion", F.lit(suffix)).alias("fe"), "r")
    names = [f"{e}{suffix}" for e in emotions]
    return _wide_sums(df.select(*keys), rates, keys, names, "fe", "r", 0.0)


def score_all(df: DataFrame, key, text_cols: dict[str, str] | list[str], lexicon: DataFrame,
              emotions=EMOTIONS) -> DataFrame:
    """T5: score several text columns at once. The columns are stacked as
    (key, field, text) and scored in one pass with a pivot on field×emotion —
    one shuffle instead of one per column. ``text_cols`` maps column →
    suffix (default: ``_<column>``)."""
    keys = [key] if isinstance(key, str) else list(key)
    if not isinstance(text_cols, dict):
        text_cols = {c: f"_{c}" for c in text_cols}
    stacked = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(sfx).alias("field"), F.col(c).alias("text")) for c, sfx in text_cols.items()])))
    return score_long(df.select(*keys), stacked, keys, list(text_cols.values()), lexicon, emotions)


def score_long(base: DataFrame, stacked: DataFrame, keys: list[str], fields: list[str],
               lexicon: DataFrame, emotions=EMOTIONS, salt_buckets: int = 16) -> DataFrame:
    """T5 core on long input (key…, field, text): one row per key with a
    ``{emotion}{field}`` column per pair, 0 where nothing matched."""
    toks = stacked.select(*keys, "field", F.explode(tokens(F.col("text"))).alias("word")).withColumn("n", F.lit(1).cast("long"))
    hits = lexicon_join(toks, lexicon, [*keys, "field"], "n", salt_buckets)
    hits = hits.select(*keys, F.concat("emotion", "field").alias("fe"), F.col("n").cast("long").alias("n"))
    names = [f"{e}{f}" for f in fields for e in emotions]
    return _wide_sums(base, hits, keys, names, "fe", "n", 0)


def _wide_sums(base: DataFrame, hits: DataFrame, keys: list[str], names: list[str], name_col: str,
               value_col: str, zero) -> DataFrame:
    """One row per key of ``base`` with a column per name: the sum of matching
    values, ``zero`` when none. Keys without hits come from a zero row per key
    unioned in, so the whole thing is one partial+final aggregate (one
    shuffle) — no pivot pass and no join back to the base table."""
    fill = base.select(*keys, F.lit(None).cast("string").alias(name_col),
                       F.lit(zero).cast(hits.schema[value_col].dataType).alias(value_col))
    allrows = hits.select(*keys, name_col, value_col).unionByName(fill)
    aggs = [F.coalesce(F.sum(F.when(F.col(name_col) == F.lit(n), F.col(value_col))), F.lit(zero)).alias(n)
            for n in names]
    return allrows.groupBy(*keys).agg(*aggs)
