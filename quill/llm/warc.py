"""Deterministic sharded WARC writer and its reader.

Records are sorted by (page id, URL, payload digest) over ranges of page ids
whose bounds depend on the ids alone. Each range is written in order into
gzip members, one per record, and rolls to a new file when the compressed size
reaches the limit. Headers and digests are regenerated from the payload;
nothing depends on clock, host or attempt, so equal input gives equal files.

A file is written under a temporary name and then renamed. Its manifest row
(name, records, bytes, SHA-256) becomes visible only when Spark commits the
manifest table, so files of lost or repeated attempts are never read: a
repeated attempt writes the same bytes under the same final name.

Records with equal payloads of at least ``revisit_bytes`` bytes: those with
the largest page id are responses, all others revisit it. Defined results:
NULL html is an empty payload; a NULL page id is smaller than any other; a
NULL URL leaves the header out; control characters in a URL are escaped;
repeated rows are repeated records; an empty table gives an empty archive.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import range_bounds, range_of, scratch_path

DATE = "1970-01-01T00:00:00Z"  # pages carry no date
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder (a bare path or any URI that pyarrow knows)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}|{digest}')}>"


def _clean(url: str) -> str:
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in url.encode())


def record(page_id, url, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One uncompressed WARC record; a revisit keeps the HTTP header alone."""
    digest = sha1_32(payload)
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
             .encode() + (b"" if is_revisit else payload))
    head = [f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{sha1_32(block)}", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def revisits(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(page_id, digest, keep) of the rows of (page_id, url, payload) that
    revisit another page; only digests are shuffled."""
    light = pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")) \
        .where(F.col("size") >= revisit_bytes)
    copied = (light.groupBy("digest", "size").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
              .where("n > 1 AND keep IS NOT NULL").drop("n"))
    return (light.join(copied, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("keep")))
            .select("page_id", "digest", "keep").distinct())


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   revisit_bytes: int = 0, range_bytes: int = 16 << 20, file_bytes: int = 4 << 20) -> DataFrame:
    """Write the archives; the manifest (file, records, bytes, sha256), also
    kept as ``folder/manifest``. Pages and their revisits go to their range in
    one shuffle; within a page id the revisits come first."""
    total = pages.agg(F.sum(F.octet_length(body_col))).first()[0] or 0
    bounds = range_bounds(pages, id_col, -(-total // range_bytes))
    which = range_of(bounds)
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    known = revisits(p, revisit_bytes).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                                              F.lit(None).cast("binary").alias("payload"), "digest", "keep")
    rows = known.union(p.select("page_id", F.lit(1), "url", "payload", F.sha1("payload"), F.lit(None).cast("long")))

    def run(batches):
        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        at, roll, out, page, keeps = None, 0, None, None, {}
        for b in batches:
            for r, i, kind, u, body, digest, keep in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (r, i) != page:
                    page, keeps = (r, i), {}
                if kind == 0:
                    keeps[digest] = keep
                    continue
                if out and (r != at or out.bytes >= file_bytes):
                    yield out.close()
                    out, roll = None, roll + 1
                if r != at:
                    at, roll = r, 0
                out = out or _File(fs, base, f"pages-{r:07d}-{roll:05d}.warc.gz")
                to = keeps.get(digest)
                out.add(member(record(i, u, body, to, to is not None)))
        if out:
            yield out.close()

    manifest = (rows.withColumn("r", which("page_id")).repartitionById(len(bounds) + 1, F.col("r"))
                .sortWithinPartitions("r", "page_id", "kind", "url", "digest")
                .select("r", "page_id", "kind", "url", "payload", "digest", "keep")
                .mapInArrow(run, "file string, records long, bytes long, sha256 string"))
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


class _File:
    """A file under a temporary name until it is closed."""

    def __init__(self, fs, base: str, name: str):
        self.fs, self.base, self.name = fs, base, name
        self.temporary = f"{base}/.{name}.{uuid.uuid4().hex}.tmp"
        self.out = fs.open_output_stream(self.temporary, compression=None)
        self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()

    def add(self, data: bytes):
        self.out.write(data)
        self.sha.update(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1

    def close(self):
        self.out.close()
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        return pa.RecordBatch.from_pylist([{"file": self.name, "records": self.records, "bytes": self.bytes,
                                            "sha256": self.sha.hexdigest()}])


def members(stream, size: int = 1 << 20):
    """The uncompressed gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(size)
    while data:
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        data = data or stream.read(size)
    if parts:
        raise ValueError("truncated gzip member")


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of a record; wrong digests raise."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(warc["Content-Length"])]
    if warc["WARC-Block-Digest"] != f"sha1:{sha1_32(block)}":
        raise ValueError(f"block digest of {warc['WARC-Record-ID']}")
    http, _, body = block.partition(b"\r\n\r\n")
    if warc["WARC-Type"] == "response" and warc["WARC-Payload-Digest"] != f"sha1:{sha1_32(body)}":
        raise ValueError(f"payload digest of {warc['WARC-Record-ID']}")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def read_archives(spark: SparkSession, folder: str, bodies: bool = True) -> DataFrame:
    """One row per record of the files in the manifest; every digest, record
    count and file checksum is verified. ``payload`` is NULL for revisits, and
    left out without ``bodies``."""
    listed = spark.read.parquet(f"{folder}/manifest").select("file", "records", "sha256")

    def run(batches):
        fs, base = _store(folder)
        for b in batches:
            for x in b.to_pylist():
                with fs.open_input_stream(f"{base}/{x['file']}", compression=None) as raw:
                    stream, rows, n, size = _Summed(raw), [], 0, 0
                    for data in members(stream):
                        warc, http, body = parse(data)
                        number = lambda key, w=warc: int(w[key]) if key in w else None
                        row = {"page_id": number("X-Page-ID"), "url": warc.get("WARC-Target-URI"),
                               "payload_bytes": int(http["Content-Length"]), "payload_digest": warc["WARC-Payload-Digest"][5:],
                               "record_type": warc["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")}
                        if bodies:
                            row["payload"] = body if warc["WARC-Type"] == "response" else None
                        rows.append(row)
                        n, size = n + 1, size + len(body)
                        if size > 1 << 22 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                if (n, stream.sha.hexdigest()) != (x["records"], x["sha256"]):
                    raise ValueError(f"{x['file']} differs from its manifest")

    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("record_type", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.binary())] if bodies else []))
    return listed.repartition(max(1, listed.count()), "file").mapInArrow(  # a file is more work than its row shows
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
             + ", payload binary" * bodies)


class _Summed:
    """A stream that keeps the checksum of what was read."""

    def __init__(self, raw):
        self.raw, self.sha = raw, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.raw.read(size)
        self.sha.update(data)
        return data


def round_trip(pages: DataFrame, bodies: bool = True, **kw) -> DataFrame:
    """Write to a new folder in the shared folder and read back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder, **kw)
    return read_archives(pages.sparkSession, folder, bodies)
