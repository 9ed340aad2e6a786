"""Phrase collocations by Rabin-Karp fingerprints.

A text, lower-cased in A-Z, is split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words ``[^\\x20\\x09]+``. Prefix polynomials modulo 2**64 over the
bytes give every word's hash (mixed with its language), prefix polynomials over
those every phrase's fingerprint. Fingerprints of parts follow by subtraction,
so phrases are counted, cut, scored and dropped without their text.

1. Count pass: every task adds up 40 bits of the fingerprints of all runs of one
   and two words, a shuffle sums them. Collisions only make a sum larger.
2. The frequent ones set bits in a filter of at most 32 MB. A longer run can be
   frequent only if all its pairs of words are.
3. Pointer pass: runs that pass the filter are counted by their whole fingerprint,
   with that of the run less its last word (for single words: XXH3 of the word)
   and a pointer to a document that holds it (32 bits of its hash). Tasks take
   64 MB of text, so that most repetitions meet before the shuffle. Words of equal
   hash are compared byte by byte within a task. A fingerprint that comes with two
   different second values is a collision: everything is then counted anew with
   another base, so counts are exact.
4. Phrases that can be among the first ones, ties included, are cut from the texts
   they point to, and their fingerprints worked out anew from what is found there;
   a document of equal hash that does not hold the phrase is passed over.

``min_count`` is the one threshold; all documents are covered.

Rows: NULL texts have no words, a NULL language is ``und``, repeated rows count
each time, an empty table gives no rows. Texts of any length are worked through
in blocks cut at separators (a single longer word makes its block longer); runs
across blocks count. Other columns are not read, so their names cannot clash.
"""
from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import BROADCAST_MAX_BYTES, measured_broadcast
from .common import binary_list, slices, written

UND = "und"
BLOCK = 1 << 19  # bytes hashed at once
GROUP = 2 << 20  # bytes whose phrases are added up in a task
FILTER_BITS = 28  # at most 2**28 bits, 32 MB
BUCKET_BITS = 40  # of a fingerprint in the count pass
TASK_BYTES = 64 << 20  # text of a task of the pointer pass, at least
LANG_BITS, DOC_BITS = 27, 32  # of the hashes of language and document that a row carries
_BASE = 0x9E3779B97F4A7C15  # odd base of the polynomials over bytes
#: odd bases of the polynomials over words, tried in turn
BASES = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_U = np.uint64

_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?") + list(range(0x0A, 0x0E))] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


@functools.lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    one = lambda b: np.cumprod(np.r_[_U(1), np.full(n - 1, b, _U)], dtype=_U)
    return one(base), one(pow(base, -1, 1 << 64))


def _room(n: int) -> int:
    return 1 << max(10, (n - 1).bit_length())


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Polynomial sums of every prefix (one more than values)."""
    power = _powers(base, _room(len(values) + 1))[0][:len(values)]
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power, out=out[1:])
    return out


def stretches(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of the values from ``start`` to ``end``, the same wherever they lie."""
    return (prefix[end] - prefix[start]) * _powers(base, _room(len(prefix)))[1][start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def words_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of lower-cased bytes: starts, ends and hashes of its words, and
    the number of piece ends before each."""
    kind = _KIND[code]
    inside = np.r_[False, kind == 0, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    h = stretches(prefix_sums(code.astype(_U) + _U(1), _BASE), start, end, _BASE)
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    return start, end, mixed(h + (end - start).astype(_U) * _U(BASES[0])), piece


def _cuts(data: np.ndarray, size: int) -> list[int]:
    """Ends of blocks of about ``size`` bytes that end where no word goes on."""
    out, at = [], 0
    while len(data) - at > size:
        stop = at + size
        back = np.flatnonzero(_KIND[data[at:stop]])
        if len(back):
            stop = at + int(back[-1]) + 1
        else:
            while stop < len(data) and _KIND[data[stop]] == 0:
                stop += 1
        out.append(stop)
        at = stop
    return out + [len(data)]


class Group:
    """Words of many texts one after another: their hashes, where they lie, and
    the number of their piece (never shared by two texts)."""

    def __init__(self, keep_bytes: bool = False):
        self.keep = keep_bytes
        self.parts: list[tuple] = []
        self.code: list[np.ndarray] = []
        self.size = self.pieces = self.bytes = 0
        self.docs: list[tuple] = []  # (language, row reference) by number
        self.open: list[tuple[int, bytes]] = []  # short texts waiting for their block
        self.waiting = 0

    def add(self, doc: tuple, data: bytes) -> None:
        self.docs.append(doc)
        if len(data) > BLOCK:
            self._flush()
            raw = np.frombuffer(data, np.uint8)
            at = 0
            for stop in _cuts(raw, BLOCK):
                self._block(raw[at:stop], np.array([len(self.docs) - 1]), np.array([0]))
                self.size += stop - at
                at = stop
            self.pieces += 1
            return
        self.open.append((len(self.docs) - 1, data))
        self.waiting += len(data) + 1
        self.size += len(data)
        if self.waiting > BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.open:
            n = np.array([len(d) + 1 for _, d in self.open])
            raw = np.frombuffer(b"\n".join(d for _, d in self.open) + b"\n", np.uint8)
            self._block(raw, np.array([i for i, _ in self.open]), np.cumsum(n) - n)
            self.open, self.waiting = [], 0

    def _block(self, raw, doc, first) -> None:
        code = _LOWER[raw]
        start, end, h, piece = words_of(code)
        of = np.searchsorted(first, start, "right") - 1
        self.parts.append((h, doc[of].astype(np.int32), (end - start).astype(np.int32), piece + self.pieces,
                           start + (self.bytes if self.keep else 0)))
        self.pieces += int((_KIND[code] == 2).sum())
        if self.keep:
            self.code.append(code)
            self.bytes += len(code)

    def close(self) -> tuple[np.ndarray, ...]:
        """Hash, document, length, piece and place in the kept bytes of every word."""
        self._flush()
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (_U, np.int32, np.int32, np.int64, np.int64))
        return tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))


def fingerprints(h: np.ndarray, piece: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``k`` words inside a piece, and their
    fingerprints: of words h0, h1, ... the sum h0 + h1 * base + ..."""
    at = np.arange(max(0, len(h) - k + 1))
    at = at[piece[at] == piece[at + k - 1]]
    return at, stretches(prefix_sums(h, base), at, at + k, base)


def buckets(key: np.ndarray, k: int) -> np.ndarray:
    """What the count pass and the filter see of a fingerprint."""
    return mixed(key + _U(k * 0x632BE59BD9B4E019 % (1 << 64))) >> _U(64 - BUCKET_BITS)


def _groups(batches, keep: bool):
    """Groups of whole texts of the rows (seed of the language, document, text),
    closed as soon as they pass GROUP bytes."""
    g = Group(keep)
    for batch in batches:
        for part in slices(batch, 2):
            for seed, ref, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binary_list(part.column(2)), strict=True):
                g.add((seed, ref), data)
                if g.size > GROUP:
                    yield g
                    g = Group(keep)
    if g.docs:
        yield g


def _in_language(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return mixed(h + seeds.astype(np.int64).view(_U))


def _bits(bucket: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each bucket in a filter of 2**bits."""
    return np.stack([(bucket * _U(_BASE)) >> _U(64 - bits), (bucket * _U(BASES[1])) >> _U(64 - bits)])


def _passes(bucket: np.ndarray, filter_: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(bucket), bool)
    for at in _bits(bucket, bits):
        ok &= (filter_[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
    return ok


def _counted(docs: DataFrame, min_count: int, base: int) -> DataFrame:
    """Buckets of one and two words with summed counts of at least ``min_count``."""
    def run(batches):
        for g in _groups(batches, False):
            h, doc, _, piece, _ = g.close()
            h = _in_language(h, np.array([s for s, _ in g.docs], np.int64)[doc])
            for k in (1, 2):
                key, n = np.unique(buckets(fingerprints(h, piece, k, base)[1], k), return_counts=True)
                for i in range(0, len(key), 1 << 15):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i:i + (1 << 15)].view(np.int64)), pa.array(n[i:i + (1 << 15)])],
                                                     names=["key", "n"])

    rows = docs.mapInArrow(run, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _filter_of(keys: DataFrame) -> tuple[np.ndarray, int]:
    """Filter of the buckets: an eighth of the bits set at most, unless that would
    pass 32 MB. Tasks make its pages of 8 KB, the driver joins them."""
    n = keys.count()
    bits = min(FILTER_BITS, max(16, (16 * n).bit_length()))

    def pages(batches):
        for b in batches:
            at = np.unique(_bits(b.column(0).to_numpy().view(_U), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> _U(16)).astype(np.int64)), pa.array((at & _U(0xFFFF)).astype(np.int32))],
                                             names=["page", "bit"])

    def joined(key, rows):
        page = np.zeros(1 << 16, bool)
        page[rows.column("bit").to_numpy()] = True
        return pa.table({"page": [key[0].as_py()], "bits": pa.array([np.packbits(page, bitorder="little").tobytes()], pa.binary())})

    got = (keys.select("key").mapInArrow(pages, "page long, bit int").groupBy("page")
           .applyInArrow(joined, "page long, bits binary").collect())
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in got:
        out[r.page << 13:(r.page + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return out, bits


def _second_hashes(g: Group, h, at, start, length) -> np.ndarray:
    """XXH3 of the words numbered ``at``, worked out once per different word;
    words of equal hash are compared byte by byte."""
    code = np.concatenate(g.code)
    _, first, of = np.unique(h[at], return_index=True, return_inverse=True)
    one, two, size = start[at], start[at][first[of]], length[at]
    same = size == size[first[of]]
    for i in range(0, len(at), 1 << 16):
        j = np.flatnonzero(same[i:i + (1 << 16)]) + i
        if len(j):
            n = size[j]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ok = code[np.repeat(one[j], n) + step] == code[np.repeat(two[j], n) + step]
            same[j] = np.logical_and.reduceat(ok, np.cumsum(n) - n)
    whole = code.tobytes()
    hashed = lambda i: xxhash.xxh3_64_intdigest(whole[one[i]:one[i] + size[i]])
    out = np.array([hashed(i) for i in first.tolist()], _U)[of]
    for i in np.flatnonzero(~same).tolist():  # another word of the same hash
        out[i] = hashed(i)
    return out


_ROW = "key long, first long, meta long, n long"


def _meta(seeds: np.ndarray, k: int, refs) -> np.ndarray:
    """Language, number of words and document in one number."""
    lang = seeds.astype(np.int64).view(_U) >> _U(64 - LANG_BITS)
    return ((lang << _U(36)) | _U(k << 32) | refs).view(np.int64)


def _pointed(docs: DataFrame, filter_: tuple[np.ndarray, int], hi: int, base: int) -> DataFrame:
    """(key, first, meta, a, pointer, clash) of the runs that pass the filter; k = 0:
    the number of words of a language. ``clash``: one key came with several."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def batches_of(key, first, meta, n):
        for i in range(0, len(key), 1 << 15):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[i:i + (1 << 15)]).view(np.int64))
                                              for x in (key, first, meta, n)], names=[c.split()[0] for c in _ROW.split(", ")])

    def run(batches):
        bitmap, bits = shared.value
        for g in _groups(batches, True):
            h, doc, length, piece, start = g.close()
            if not len(h):
                continue
            seeds = np.array([s for s, _ in g.docs], np.int64)
            langs, code = np.unique(seeds, return_inverse=True)
            n_words = np.bincount(code[doc], minlength=len(langs)).astype(np.int64)
            yield from batches_of(langs, np.zeros(len(langs), np.int64), _meta(langs, 0, _U(0)), n_words)
            refs = np.array([r for _, r in g.docs], np.int64).view(_U) >> _U(64 - DOC_BITS)
            plain, h = h, _in_language(h, seeds[doc])
            gap = before = None
            for k in range(1, hi + 1):
                at, key = fingerprints(h, piece, k, base)
                if k <= 2:
                    ok = _passes(buckets(key, k), bitmap, bits)
                    if k == 2:
                        gap = np.ones(len(h) + 1, np.int64)
                        gap[at[ok]] = 0
                        gap = np.r_[0, np.cumsum(gap)]
                else:  # all its pairs of words are frequent
                    ok = gap[at + k - 1] == gap[at]
                at, key = at[ok], key[ok]
                if not len(at):
                    break
                before = prefix_sums(h, base) if before is None else before
                first = _second_hashes(g, plain, at, start, length) if k == 1 else stretches(before, at, at + k - 1, base)
                to = refs[doc[at]] if k > 1 else np.zeros(len(at), _U)  # single words are not cut out
                order = np.lexsort((to, first, key))
                at, key, first, to = at[order], key[order], first[order], to[order]
                new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (first[1:] != first[:-1])])
                n = np.diff(np.r_[new, len(at)])
                yield from batches_of(key[new], first[new], _meta(seeds[doc[at[new]]], k, to[new]), n)

    sums = docs.mapInArrow(run, _ROW).groupBy("key").agg(
        F.sum("n").alias("a"), F.min("first").alias("first"), F.max("first").alias("_f"), F.min("meta").alias("meta"), F.max("meta").alias("_m"))
    kind = lambda c: F.shiftrightunsigned(c, 32)
    return sums.select("key", "first", "meta", "a", ((F.col("first") != F.col("_f")) | (kind("meta") != kind("_m"))).alias("clash"))


def _inverse(base: int, n: int) -> int:
    return pow(pow(base, -1, 1 << 64), n, 1 << 64)


def part_key(prefix: list, i: int, j: int, base: int) -> np.ndarray:
    """Fingerprint of the words i to j of a phrase from those of its prefixes."""
    return prefix[j] if i == 0 else (prefix[j] - prefix[i]) * _U(_inverse(base, i))


def counted_phrases(docs: DataFrame, hi: int, min_count: int, text_col: str, lang_col: str,
                    bases=BASES) -> tuple[DataFrame, DataFrame, int]:
    """Frequent runs (key, first, code, k, a, ref) of up to ``hi`` words, the texts
    that they lie in (seed, doc, text, lang), and the base without collisions that
    they were counted with."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    for i, base in enumerate(bases):
        lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UND))
        d = docs.select(lang.alias("lang"), F.xxhash64(lang, F.lit(i)).alias("seed"), F.col(text_col).cast("string").alias("text"))
        d = d.where(F.octet_length("text") > 0).select("seed", F.xxhash64("lang", "text").alias("doc"), "text", "lang")
        langs = written(d.select("seed").distinct().withColumn("code", F.shiftrightunsigned("seed", 64 - LANG_BITS)), "phrase-langs")
        if langs.count() != langs.select("code").distinct().count():
            continue  # two languages of one code
        keys = written(_counted(d, min_count, base), "phrase-keys")
        sums = written(_pointed(d.coalesce(max(1, -(-size // TASK_BYTES))), _filter_of(keys), hi, base).withColumn(
            "k", F.shiftrightunsigned("meta", 32).bitwiseAND(15).cast("int")).where((F.col("a") >= min_count) | (F.col("k") == 0) | F.col("clash")),
            "phrase-sums")
        if sums.where("clash").isEmpty():
            return sums.select("key", "first", F.shiftrightunsigned("meta", 36).alias("code"), "k", "a",
                               F.col("meta").bitwiseAND((1 << 32) - 1).alias("ref")), d, base
    raise ArithmeticError("fingerprints collide under every base")


def _with_prefixes(runs: DataFrame, hi: int) -> DataFrame:
    """Runs of two and more words with the fingerprints of all their prefixes."""
    level = runs.where("k = 2").select("key", "code", "k", "a", "ref", F.array("first", "key").alias("prefixes"))
    every = level
    for k in range(3, hi + 1):
        shorter = level.select(F.col("key").alias("first"), "prefixes")
        level = (runs.where(F.col("k") == k).join(shorter, "first")
                 .select("key", "code", "k", "a", "ref", F.concat("prefixes", F.array("key")).alias("prefixes")))
        every = every.union(level)
    return every


def _parts(cand: DataFrame, lo: int, base: int) -> DataFrame:
    """Per candidate its cuts (cut, left, right) and, with cut = 0, the shorter
    candidates inside it (left)."""
    def run(batches):
        for b in batches:
            ks = b.column("k").to_numpy()
            lists = b.column("prefixes")
            for k in np.unique(ks).tolist():
                of = np.flatnonzero(ks == k)
                p = lists.take(pa.array(of)).flatten().to_numpy().view(_U).reshape(-1, k)
                prefix = [None] + [np.ascontiguousarray(p[:, j]) for j in range(k)]
                key, a = (b.column(c).take(pa.array(of)) for c in ("key", "a"))
                rows = [(j, part_key(prefix, 0, j, base), part_key(prefix, j, k, base)) for j in range(1, k)]
                rows += [(0, part_key(prefix, i, i + n, base), None) for n in range(lo, k) for i in range(k - n + 1)]
                for cut, left, right in rows:
                    yield pa.RecordBatch.from_arrays(
                        [key, a, pa.array(np.full(len(of), cut, np.int32)), pa.array(left.view(np.int64)),
                         pa.array(left.view(np.int64)) if right is None else pa.array(right.view(np.int64))],
                        names=["key", "a", "cut", "left", "right"])

    return cand.select("key", "k", "a", "prefixes").mapInArrow(run, "key long, a long, cut int, left long, right long")


def _cut_out(wanted: DataFrame, docs: DataFrame, base: int) -> DataFrame:
    """(key, lang, phrase) of the wanted runs (key, k, ref): the documents of that
    hash are hashed again, and what has the fingerprint is read off."""
    to = written(wanted.select("ref", "key", "k"), "phrase-pointers")
    each = to.groupBy("ref").agg(F.collect_list("key").alias("keys"), F.collect_set("k").alias("ks"))  # no more than a text holds
    small = to.count() * 24 <= BROADCAST_MAX_BYTES
    held = docs.withColumn("ref", F.shiftrightunsigned("doc", 64 - DOC_BITS)).join(F.broadcast(each) if small else each, "ref")

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                keys, langs, found = [], [], []
                cols = (part.column(c).to_pylist() for c in ("seed", "keys", "ks", "lang"))
                for seed, want, ks, lang, data in zip(*cols, binary_list(part.column("text")), strict=True):
                    g = Group(True)
                    g.add((seed, 0), data)
                    h, _, length, piece, start = g.close()
                    whole = b"".join(c.tobytes() for c in g.code)
                    h = _in_language(h, np.full(len(h), seed, np.int64))
                    for k in ks:
                        at, key = fingerprints(h, piece, k, base)
                        key, first = np.unique(key.view(np.int64), return_index=True)
                        hit = np.flatnonzero(np.isin(key, want))
                        keys += key[hit].tolist()
                        langs += [lang] * len(hit)
                        found += [b" ".join(whole[start[j]:start[j] + length[j]] for j in range(i, i + k)).decode("utf-8", "replace")
                                  for i in at[first[hit]].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(found, pa.string())],
                                                 names=["key", "lang", "phrase"])

    return held.select("seed", "text", "keys", "ks", "lang").mapInArrow(run, "key long, lang string, phrase string").distinct()


def phrases(docs: DataFrame, hi: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang", bases=BASES) -> DataFrame:
    """(lang, k, phrase, a) of all phrases of 2 to ``hi`` words that occur
    ``min_count`` times in their language."""
    runs, d, base = counted_phrases(docs, hi, min_count, text_col, lang_col, bases)
    runs = runs.where("k > 1")
    return _cut_out(runs, d, base).join(runs, "key").select("lang", "k", "phrase", "a")


def collocations(docs: DataFrame, lo: int = 2, hi: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000,
                 text_col: str = "text", lang_col: str = "lang", bases=BASES) -> DataFrame:
    """Each language's ``top`` phrases by score.

    A candidate is a phrase of ``lo`` to ``hi`` words with a >= ``min_count``
    occurrences. Cut after k words it scores floor(10**6 * a * a / (l * r)), l
    and r the counts of both parts; the lowest cut counts, ties go to the
    smallest k. Candidates inside a longer one of at least ``inside_percent``
    percent of their count are dropped. Arithmetic is exact up to counts of 10**15."""
    if not 2 <= lo <= hi <= 15 or min_count < 1:
        raise ValueError("2 <= lo <= hi <= 15 and min_count >= 1")
    runs, d, base = counted_phrases(docs, hi, min_count, text_col, lang_col, bases)
    cand = _with_prefixes(runs, hi).where(F.col("k") >= lo)
    parts = written(_parts(cand, lo, base), "phrase-parts")
    side = lambda key, value: runs.where("k > 0").select(F.col("key").alias(key), F.col("a").alias(value))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    scored = (parts.where("cut > 0").join(side("left", "l"), "left").join(side("right", "r"), "right")
              .withColumn("top_part", F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a")))
              .withColumn("parts", wide("l") * wide("r")).withColumn("score", F.expr("top_part div parts")))
    best = scored.groupBy("key").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("key", "b.*")
    longest = parts.where("cut = 0").groupBy(F.col("left").alias("key")).agg(F.max("a").alias("longer"))
    kept = (runs.where(F.col("k") >= lo).join(best, "key").join(longest, "key", "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))))
    order = [F.desc("score"), F.desc("a")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)))  # a language may hold most of them
    some = salted.withColumn("rank", F.rank().over(Window.partitionBy("code", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.rank().over(Window.partitionBy("code").orderBy(*order))).where(F.col("rank") <= top)
    first = written(first.select("key", "code", "k", "a", "l", "r", "score", "ref"), "phrase-first")
    named = first.join(_cut_out(first.select("key", "k", "ref"), d, base), "key")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase")))) \
        .where(F.col("rank") <= top)
    total = runs.where("k = 0").select("code", F.col("a").alias("n"))
    return ranked.join(measured_broadcast(total), "code").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The query's rows in SQL, by lists of words and joins on text."""
    return r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT lang, text, row_number() OVER () AS doc FROM documents)),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
 grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k))),
 f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
 n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
 cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS p FROM f WHERE k >= 2 AND a >= 10),
 cuts AS (SELECT c.*, u.cut, array_to_string(p[1:u.cut], ' ') AS fst, array_to_string(p[u.cut + 1:], ' ') AS rest
          FROM cand c, (VALUES (1), (2)) AS u(cut) WHERE u.cut < c.k),
 scored AS (SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r,
              CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.fst JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 inner_ AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(p[1:2], ' ') AS phrase FROM cand WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(p[2:3], ' ') FROM cand WHERE k = 3) GROUP BY ALL),
 kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000"""
