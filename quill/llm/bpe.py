"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut by the tokenizer's pattern. Pieces not met before in the worker
are grouped by length (8, 16, 32, ... bytes); each group is one padded matrix
of token ids. In every round each row looks up the ranks of its neighbouring
pairs in a hash table, merges its leftmost pair of minimum rank and is
compacted by one column; rows without a pair leave the matrix. Pieces beyond
``LONG`` bytes, where a matrix of one row would be quadratic, take the same
merges in the same order from a heap.

The ids of met pieces are kept in a cache of bounded size per worker.

Defined results: NULL text has the ids of empty text: none; whole texts are
encoded, of any length; columns other than the text pass through.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, slices

LONG = 1024  # bytes of a piece
CACHE = 300_000  # pieces
_ROWS_BYTES = 1 << 19  # matrix cells at once
_NONE = np.int32(2**31 - 1)


@functools.lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Open-addressing hash table (left id, right id) -> rank of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(len(key) * 4 + 1))))
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        rank, slot, self.probes = np.array(rank, np.int32), self._slot(key), 0
        while len(key):  # all keys without a slot try their next one
            self.probes += 1
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]] = key[free]  # of keys that want the same slot the last has it
            won = self.keys[slot] == key
            self.ranks[slot[won]] = rank[won]
            key, rank, slot = key[~won], rank[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; ``_NONE`` where there is none (an id of -1 has none)."""
        key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        key[(left < 0) | (right < 0)] = np.uint64(2**64 - 2)
        slot = self._slot(key)
        out, kept = np.full(len(key), _NONE, np.int32), self.keys[slot]
        hit = kept == key
        out[hit] = self.ranks[slot[hit]]
        open_ = np.flatnonzero(~hit & (kept != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            kept = self.keys[slot[open_]]
            hit = kept == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (kept != np.uint64(2**64 - 1))]
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = {i: t for t, i in ranks.items()}
        self.met: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece (of at least two bytes)."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                by_width.setdefault(1 << max(3, (len(p) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            step = max(1, _ROWS_BYTES // width)
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                for i, ids in zip(part, self._rounds([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _rounds(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], -1).astype(np.int32)
        rank = self.pairs.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        row, done = np.arange(n), [None] * n
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            stay = best != _NONE
            for i in np.flatnonzero(~stay):
                done[row[i]] = ids[i][ids[i] >= 0]
            row, ids, rank, at, best = row[stay], ids[stay], rank[stay], at[stay], best[stay]
            if not len(row):
                break
            every, w = np.arange(len(row)), ids.shape[1]
            ids[every, at] = best
            keep = np.arange(w) != (at + 1)[:, None]
            ids = ids[keep].reshape(len(row), w - 1)
            if w == 2:
                for i, r in enumerate(row):
                    done[r] = ids[i]
                break
            # the pair that was merged goes; its neighbours on both sides have a new rank
            rank = rank[np.arange(w - 1) != at[:, None]].reshape(len(row), w - 2)
            for j in (at - 1, at):
                ok = (j >= 0) & (j < w - 2)
                r, c = every[ok], j[ok]
                rank[r, c] = self.pairs.look(ids[r, c], ids[r, c + 1])
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges (minimum rank, leftmost first) from a heap."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        text = {i: t for i, t in enumerate(bytes([b]) for b in piece)}

        def rank(i):
            j = after[i]
            return self.ranks.get(text[i] + text[j]) if j < len(ids) else None
        first = self.pairs.look(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(first[i]), i) for i in np.flatnonzero(first != _NONE)]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            text[i], ids[i], ids[j], after[i] = text[i] + text.pop(j), r, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, texts: list) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.met) > CACHE:
            self.met.clear()
        fresh = [p for p in set().union(*cut) if p not in self.met]
        hard, hard_bytes = [], []
        for p in fresh:
            b = p.encode()
            whole = self.ranks.get(b)
            if whole is None:
                hard.append(p), hard_bytes.append(b)
            else:
                self.met[p] = whole.to_bytes(4, "little")
        for p, ids in zip(hard, self.merge(hard_bytes), strict=True):
            self.met[p] = ids.astype("<u4").tobytes()
        return [b"".join([self.met[p] for p in c]) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


#: bytes of text worked on at once
_SLICE = 1 << 19


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "ids",
           check: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with its ids as one more column: binary, 4 bytes an id. With
    ``check`` a column of that name tells whether the ids decode to the text;
    without ``keep_text`` the text stays behind. Names that ``docs`` already
    has get underscores."""
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    fields = [docs.schema.fields[i] for i in kept] + [T.StructField(free_name(docs, name), T.BinaryType())]
    if check:
        fields.append(T.StructField(free_name(docs, check), T.BooleanType()))
    names = [f.name for f in fields]

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for b in slices(whole, at, _SLICE):
                texts = b.column(at).to_pylist()
                ids = c.encode(texts)
                cols = [*(b.column(i) for i in kept), pa.array(ids, pa.binary())]
                if check:
                    cols.append(pa.array([c.decode(x) == (t or "").encode() for x, t in zip(ids, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(cols, names=names)
        c.met.clear()  # an idle worker holds no cache

    return docs.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", name: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes of its ids as one more column."""
    name, at = free_name(encoded, name), encoded.columns.index(ids_col)

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for b in slices(whole, at, _SLICE):
                got = [None if x is None else c.decode(x) for x in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, name])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass: ids and
    decoded bytes stay in the worker, digests leave it."""
    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for b in slices(whole, 1, _SLICE):
                ids = c.encode(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                     pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.met.clear()  # an idle worker holds no cache

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
