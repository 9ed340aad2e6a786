"""Token ids of documents in binary files of patched frame-of-reference blocks.

Documents are range-partitioned by ascending id (NULL ids first; equal ids by
text, equal rows by where they were read, so that none fills a range alone),
sorted within their range, encoded and written there. A file holds the blocks
(``pfor``), an index of their first bytes, and the documents' ids and last
tokens, so a run of tokens or a document is read from its own blocks only:

    blocks | first byte of each block | end of each document | its id | NULL flags
    | trailer: tokens, blocks, documents, first byte of the index, magic

Files end with a document once they pass ``file_bytes``. They get temporary
names first and are renamed when closed; the manifest row (file, range, tokens,
bytes, checksum) shows only when Spark commits the manifest, so files of lost
attempts are never read, and a repeated attempt writes the same bytes. First
tokens of the files are running sums over the manifest.

Encoding uses the tokenizers library. A text is cut before each single space
between two characters that are no white space: no token of a byte-level
pattern spans such a cut. Equal cuts are encoded once per worker and looked up
afterwards (a bounded number is remembered; the ids are the same either way).

Rows: NULL and empty texts have the end id alone; texts of any length are one
document of one file; repeated rows are repeated documents; an empty table
gives no files. Only id and text are read, so other names cannot clash.
"""
from __future__ import annotations

import functools
import itertools
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from .common import scratch_path, slices
from .warc import _store

MAGIC = b"QPF1"
TRAILER = struct.Struct("<QQQQ4s")
RUN = pfor.SIZE << 9  # numbers packed at once
REMEMBERED = 800_000  # cuts a worker keeps at most
SLICE = 4 << 20  # bytes of text encoded at once
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Numbered(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """The tokenizer with a memory of the cuts it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        spaced = [i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.startswith("\u0120")]
        self.opens = np.zeros(self.tok.get_vocab_size() + 1, bool)  # tokens that begin with a space
        self.opens[spaced] = True
        self.forget()

    def forget(self) -> None:
        self.number = _Numbered()  # "x" stands for " x", ("x",) for a cut that starts its text
        self.size = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 16, np.int64)
        self.edge = np.zeros(1 << 16, bool)  # white space at either end: no cut beside it
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of words without a space, all encoded as one
        text: a token that begins with a space begins the next word."""
        ids = np.array(self._ids([" " + " ".join(words)])[0], np.uint32)
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(words) or at[0]:
            raise ValueError("the tokenizer joins words")
        return ids, np.diff(np.r_[at, len(ids)])

    def _numbers(self, cuts) -> np.ndarray:
        """A number for each cut; new ones are encoded. Plain words go thousands
        at a time, cuts with white space and those that start a text one by one."""
        at = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, cuts), np.int64, len(cuts))
        n = len(self.number) - at
        if not n:
            return number
        new = list(itertools.islice(reversed(self.number), n))[::-1]
        while at + n > len(self.size):
            self.size, self.first, self.edge = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.first, self.edge))
        plain = np.array([type(c) is str and c.strip() == c != "" and " " not in c for c in new])
        for kind in (True, False):
            part = np.flatnonzero(plain == kind)
            for some in np.split(part, range(4096, len(part), 4096)):
                if kind and len(some):
                    ids, size = self._joined([new[j] for j in some.tolist()])
                else:
                    got = self._ids([c[0] if type(c) is tuple else " " + c for c in (new[j] for j in some.tolist())])
                    size = np.fromiter(map(len, got), np.int64, len(got))
                    ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum()))
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[self.used:self.used + len(ids)] = ids
                self.size[at + some], self.first[at + some] = size, self.used + np.cumsum(size) - size
                self.used += len(ids)
        other = np.flatnonzero(~plain)
        text = [c[0] if type(c) is tuple else c for c in (new[j] for j in other.tolist())]
        self.edge[at + other] = [c.strip() != c or not c for c in text]
        return number

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text (list or
        Arrow column, NULL: empty). Arrow splits the texts and finds the distinct
        words; only these become Python objects and are looked up."""
        if len(self.number) > REMEMBERED:
            self.forget()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lists = pc.split_pattern(pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, ""), " ")
        at = lists.offsets.to_numpy()
        start = at[:-1] - at[0]
        words = lists.flatten().dictionary_encode()
        distinct, place = words.dictionary.to_pylist(), words.indices.to_numpy()
        known = self._numbers(distinct)
        number, edge = known[place], self.edge[known][place]
        cut = np.ones(len(place), bool)  # a cut begins here
        cut[1:] = ~(edge[1:] | edge[:-1])
        cut[start] = True
        begin = np.flatnonzero(cut)
        length = np.diff(np.r_[begin, len(place)])
        number = number[begin]
        opens = np.zeros(len(place), bool)
        opens[start] = True
        own = np.flatnonzero((length > 1) | opens[begin])
        if len(own):
            joined = (" ".join([distinct[k] for k in place[a:a + n].tolist()])
                      for a, n in zip(begin[own].tolist(), length[own].tolist(), strict=True))
            number[own] = self._numbers([(c,) if o else c for c, o in zip(joined, opens[begin[own]].tolist(), strict=True)])
        size = self.size[number].astype(np.int64)
        stop = np.cumsum(size)
        src = np.repeat(self.first[number] - (stop - size), size) + np.arange(int(stop[-1]))
        last = np.searchsorted(begin, np.r_[start[1:], len(place)]) - 1
        return self.ids[src], np.diff(np.r_[0, stop[last]])


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Writer:
    """One file, under a temporary name until it is closed."""

    def __init__(self, fs, base: str, name: str, share: float):
        self.fs, self.base, self.name, self.share = fs, base, name, share
        self.temporary = f"{base}/.{name}.{uuid.uuid4().hex}.tmp"
        self.out = fs.open_output_stream(self.temporary, compression=None)
        self.bytes = self.crc = self.tokens = self.kept = 0
        self.waiting: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.ends, self.docs = [], []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.bytes += len(data)

    def add(self, doc, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.kept += len(ids)
        self.tokens += len(ids)
        self.docs.append(doc)
        self.ends.append(self.tokens)
        if self.kept >= RUN:
            self._blocks(self.kept // pfor.SIZE * pfor.SIZE)

    def _blocks(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for i in range(0, n, RUN):
            blocks = pfor.encode(ids[i:min(n, i + RUN)], self.share)
            size = np.array([len(b) for b in blocks], np.int64)
            self.starts.append(self.bytes + np.cumsum(size) - size)
            self._put(b"".join(blocks))
        self.waiting, self.kept = [ids[n:]], len(ids) - n

    def close(self) -> dict:
        self._blocks(self.kept)
        starts = np.concatenate(self.starts) if self.starts else np.zeros(0, np.int64)
        index = self.bytes
        none = np.array([d is None for d in self.docs], bool)
        self._put(b"".join((starts.astype("<u8").tobytes(), np.array(self.ends, "<u8").tobytes(),
                            np.array([d or 0 for d in self.docs], "<i8").tobytes(), np.packbits(none).tobytes())))
        self._put(TRAILER.pack(self.tokens, len(starts), len(self.docs), index, MAGIC))
        self.out.close()
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        return {"file": self.name, "docs": len(self.docs), "tokens": self.tokens, "bytes": self.bytes, "crc": self.crc}


class Reader:
    """Random access to one file through its index."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.tokens, blocks, docs, self.index, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        raw = self.file.read_at(size - TRAILER.size - self.index, self.index)
        self.starts = np.frombuffer(raw, "<u8", blocks).astype(np.int64)
        self.ends = np.frombuffer(raw, "<u8", docs, 8 * blocks).astype(np.int64)
        self.ids = np.frombuffer(raw, "<i8", docs, 8 * (blocks + docs))
        self.none = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * (blocks + 2 * docs)), count=docs).astype(bool)

    def close(self) -> None:
        self.file.close()

    def tokens_between(self, a: int, b: int) -> np.ndarray:
        """Tokens ``a`` to ``b`` of the file; only their blocks are read."""
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // pfor.SIZE, -(-b // pfor.SIZE)
        at, stop = self.starts[i], self.starts[j] if j < len(self.starts) else self.index
        data = np.frombuffer(self.file.read_at(int(stop - at), int(at)), np.uint8)
        return pfor.decode(data, self.starts[i:j] - at)[a - i * pfor.SIZE:b - i * pfor.SIZE]

    def document(self, n: int) -> np.ndarray:
        return self.tokens_between(int(self.ends[n - 1]) if n else 0, int(self.ends[n]))

    def documents(self, most: int = RUN):
        """(first document, their ids, ends within these) of runs of documents."""
        n, at = 0, 0
        while n < len(self.ends):
            m = max(n + 1, int(np.searchsorted(self.ends, at + most, "right")))
            stop = int(self.ends[m - 1])
            yield n, m, self.tokens_between(at, stop), self.ends[n:m] - at
            n, at = m, stop


def _checksum(fs, path: str) -> int:
    crc = 0
    with fs.open_input_stream(path, compression=None) as f:
        while data := f.read(1 << 20):
            crc = zlib.crc32(data, crc)
    return crc


_MANIFEST = "part int, roll int, file string, docs long, tokens long, bytes long, crc long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text",
                 range_bytes: int = 16 << 20, file_bytes: int = 32 << 20, share: float = pfor.SHARE) -> DataFrame:
    """Encode and write all documents; the manifest, also kept as
    ``folder/manifest``. ``end_id`` ends each document (None: nothing does)."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["id", "h", "text"]
    ranged = (d.withColumn("h", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
              .repartitionByRange(max(1, -(-total // range_bytes)), "id", "h", "nth").drop("nth")
              .sortWithinPartitions(*order).select("id", "text"))
    last = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        out, roll = None, 0
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                ids, count = enc.encode(some.column(1))
                at = 0
                for doc, n in zip(some.column(0).to_pylist(), count.tolist(), strict=True):
                    out = out or Writer(fs, base, f"tokens-{part:07d}-{roll:05d}.pfor", share)
                    out.add(doc, np.concatenate([ids[at:at + n], last]))
                    at += n
                    if out.bytes >= file_bytes:
                        yield pa.RecordBatch.from_pylist([{"part": part, "roll": roll, **out.close()}], schema=arrow)
                        out, roll = None, roll + 1
        if out:
            yield pa.RecordBatch.from_pylist([{"part": part, "roll": roll, **out.close()}], schema=arrow)

    arrow = pa.schema([("part", pa.int32()), ("roll", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()),
                       ("bytes", pa.int64()), ("crc", pa.int64())])
    manifest = ranged.mapInArrow(run, _MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def file_starts(manifest: DataFrame, fan: int = 1024) -> DataFrame:
    """The manifest with the number of tokens before each file: running sums
    within ``fan`` ranges at a time, then over those (a row per ``fan`` ranges)."""
    m = manifest.withColumn("group", F.floor(F.col("part") / fan).cast("int"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = m.withColumn("inside", before(Window.partitionBy("group").orderBy("part", "roll")))
    groups = m.groupBy("group").agg(F.sum("tokens").alias("tokens")).select("group", before(Window.orderBy("group")).alias("outside"))
    return inner.join(groups, "group").select(*manifest.columns, (F.col("inside") + F.col("outside")).alias("start"))


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files in the manifest: id, tokens before it
    over all files, number of tokens, their crc32 and (``with_ids``) the ids as
    little-endian unsigned 32-bit integers. File checksums are verified."""
    listed = file_starts(spark.read.parquet(f"{folder}/manifest"))
    parts = listed.agg(F.max("part")).first()[0]

    def run(batches):
        fs, base = _store(folder)
        for b in batches:
            for x in b.to_pylist():
                path = f"{base}/{x['file']}"
                if _checksum(fs, path) != x["crc"]:
                    raise ValueError(f"{x['file']} differs from its manifest")
                f = Reader(fs, path)
                for i, j, ids, ends in f.documents():
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cut = np.r_[0, ends * 4].tolist()
                    texts = [raw[p:q] for p, q in zip(cut, cut[1:], strict=False)]
                    first = np.r_[0, ends[:-1]] + (x["start"] + (int(f.ends[i - 1]) if i else 0))
                    cols = [pa.array(f.ids[i:j], pa.int64(), mask=f.none[i:j]), pa.array(first.astype(np.int64)),
                            pa.array(np.diff(np.r_[0, ends]).astype(np.int64)), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([bytes(t) for t in texts], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                f.close()

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return (listed.repartitionById((parts or 0) + 1, F.col("part"))  # the files of a range are one task's
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids))


def round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False, **kw) -> DataFrame:
    """Write to a new folder in the shared folder and read back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer, **kw)
    return read_tokens(docs.sparkSession, folder, with_ids)
