"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased; runs of anything but letters act as one separator per
character. Every 1-, 2- and 3-gram that holds a letter is hashed into
``2 ** bits`` buckets. Training counts (language, bucket) over all labelled
rows are summed by Spark; the matrix of smoothed log probabilities has
``2 ** bits`` rows and one column per language, at most ``max_langs``, which
bounds the broadcast. Scoring is a gather and a segmented sum per block of
texts in numpy.

Defined results: NULL text or text without a letter is ``und`` with score 0;
so is every text if there is no labelled row. Equal scores go to the first
language in sorted order. Whole texts are read, in blocks of bounded size.
"""
from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, written

UND = "und"
_BLOCK = 1 << 16  # characters scored at once


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def blocks(texts: list, size: int = _BLOCK):
    """(text numbers, code points, start of each text) of lower-cased texts.
    A text longer than a block comes in pieces that overlap by two characters;
    of these only n-grams that end in the new part count (see ``grams``)."""
    ids, parts, heads, total = [], [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        t = t.lower()
        for at in range(0, len(t), size):
            piece = t[max(at - 2, 0):at + size]
            ids.append(i), parts.append(piece), heads.append(min(at, 2))
            total += len(piece)
            if total >= size:
                yield _block(ids, parts, heads)
                ids, parts, heads, total = [], [], [], 0
    if ids:
        yield _block(ids, parts, heads)


def _block(ids, parts, heads):
    sizes = np.array([len(p) for p in parts])
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.array(ids), code, np.r_[0, np.cumsum(sizes)[:-1]], np.array(heads)


def grams(code: np.ndarray, start: np.ndarray, head: np.ndarray, bits: int):
    """For n = 1, 2, 3: the bucket of the n-gram that ends at each character;
    ``2 ** bits`` where there is none."""
    none, shift = np.int32(1 << bits), np.uint32(32 - bits)
    is_letter = letters()[code]
    c = np.where(is_letter, code + np.uint32(1), np.uint32(1))
    place = np.arange(len(code)) - np.repeat(start, np.diff(np.r_[start, len(code)]))
    fresh = place >= np.repeat(head, np.diff(np.r_[start, len(code)]))
    h, any_letter = np.zeros_like(c), np.zeros(len(c), bool)
    for n in range(3):
        back = np.zeros_like(c)
        back[n:] = c[:len(c) - n]
        h = h * np.uint32(0x9E3779B1) + (back ^ np.uint32(0x85EBCA6B * (n + 1) & 0xFFFFFFFF))
        any_letter[n:] |= is_letter[:len(c) - n]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield np.where(any_letter & fresh & (place >= n), (mixed >> shift).astype(np.int32), none)


class Model:
    """Languages in sorted order and the (2 ** bits + 1, languages) matrix of
    log probabilities; its last row, for places without an n-gram, is zero."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray, bits: int):
        self.langs, self.prior, self.logp, self.bits = langs, prior, logp, bits

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.langs)
        total, seen = np.zeros((n, k)), np.zeros(n, bool)
        if k:
            for ids, code, start, head in blocks(texts):
                seen[ids] |= np.logical_or.reduceat(letters()[code], start)
                for b in grams(code, start, head, self.bits):
                    np.add.at(total, ids, np.add.reduceat(self.logp[b], start, axis=0, dtype=np.float64))
        total += self.prior
        out, score = [UND] * n, np.zeros(n)
        if k:
            best = total.argmax(1)
            top = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
            for i in np.flatnonzero(seen):
                out[i], score[i] = self.langs[best[i]], top[i]
        return out, score


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 16,
          smooth: float = 0.5, max_langs: int = 256) -> Model:
    """Counts over all labelled rows (NULL languages are left out)."""
    def count(batches):
        acc: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in (part for whole in batches for part in slices(whole, 0)):
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for ids, code, start, head in blocks(texts):
                size = np.diff(np.r_[start, len(code)])
                lang = langs[ids]
                for one in set(lang):
                    mine = np.repeat(lang == one, size)
                    a = acc.setdefault(one, np.zeros((1 << bits) + 1, np.int64))
                    for g in grams(code, start, head, bits):
                        a += np.bincount(g[mine], minlength=len(a))
            for one in langs:
                rows[one] = rows.get(one, 0) + 1
            if len(rows) > max_langs:
                raise ValueError(f"more than max_langs={max_langs} languages")
        for one, k in rows.items():
            a = acc.get(one, np.zeros(1, np.int64))
            at = np.flatnonzero(a[:1 << bits])
            yield pa.RecordBatch.from_arrays(
                [pa.array([one] * (len(at) + 1)), pa.array(np.r_[-1, at].astype(np.int32)),
                 pa.array(np.r_[k, a[at]].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL")
    counts = written(rows.mapInArrow(count, "lang string, bucket int, n long")
                     .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    langs = [r[0] for r in counts.select("lang").distinct().limit(max_langs + 1).collect()]
    if len(langs) > max_langs:
        raise ValueError(f"more than max_langs={max_langs} languages")
    langs.sort()
    got = counts.toPandas()  # at most max_langs * 2 ** bits rows
    full = np.zeros(((1 << bits) + 1, len(langs)))
    docs = np.zeros(len(langs))
    col = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    row, n = got["bucket"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    docs[col[row < 0]] = n[row < 0]
    full[row[row >= 0], col[row >= 0]] = n[row >= 0]
    logp = np.log((full + smooth) / (full[:-1].sum(0) + smooth * (1 << bits)))
    logp[-1] = 0
    return Model(langs, np.log(docs / max(docs.sum(), 1)) if langs else docs, logp.astype(np.float32), bits)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns: the language and its posterior
    probability. Names that ``docs`` already has get underscores."""
    lang, score = (free_name(docs, n) for n in names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for b in slices(whole, at):
                p, s = shared.value.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.string()), pa.array(s)],
                                                 names=[*b.schema.names, lang, score])

    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)
