import base64
import gzip
import hashlib
import pathlib

import pytest

from quill.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows):
    """[(page_id, bytes, digest, type, refers_to)] by the contract."""
    keep = {}
    for i, _, h in rows:
        keep.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in keep[h or ""] if x is not None]
        same = not ids or i == max(ids)
        out.append((i, len(b), digest(b), "response" if same else "revisit", None if same else max(ids)))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark, sf, llm_queries, duck):
    rows = duck.execute("select page_id, url, html from pages").fetchall()
    got = llm_queries.op5_warc(spark, sf).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=repr) == brute(rows)


PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://a/9", "<p>one</p>"), (3, None, None), (4, "u", ""),
         (5, "http://a/b c\r\nX: y", "é" * 3000), (None, "n", "<p>one</p>"), (6, "x", "WARC/1.1\r\n\r\n"), (7, "y", "x" * 200000), (9, "http://a/9", "<p>one</p>"),
         (None, None, "alone"), (None, None, "alone")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 5, "mine") for p in PAGES], "page_id long, url string, html string, r int, digest string")


def test_odd_rows(spark, pages):
    back = warc.round_trip(pages, range_bytes=1000, file_bytes=300).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in names) for r in back), key=repr) == brute(PAGES)
    bodies = sorted(bytes(r.payload).decode() for r in back if r.payload is not None)
    assert bodies == sorted(h or "" for (i, _, h), w in zip(sorted(PAGES, key=repr), brute(PAGES), strict=True) if w[3] == "response" and i == w[0])
    assert warc.round_trip(pages.where("1 = 0")).count() == 0


def test_threshold_for_revisits(spark, pages):
    kinds = {r.page_id: r.record_type for r in warc.round_trip(pages, revisit_bytes=11).collect()}
    assert set(kinds.values()) == {"response"}


def test_files_are_deterministic_and_roll(spark, pages, tmp_path):
    sums = []
    for n, df in enumerate((pages, pages.repartition(5))):
        folder = str(tmp_path / str(n))
        m = warc.write_archives(df, folder, range_bytes=1000, file_bytes=300)
        sums.append(sorted(map(tuple, m.collect())))
        names = {p.name for p in pathlib.Path(folder).glob("*.gz")}
        assert names == {x[0] for x in sums[-1]} and not list(pathlib.Path(folder).glob(".*.tmp"))
    assert sums[0] == sums[1] and len(sums[0]) > 3
    first = gzip.decompress((tmp_path / "0" / sums[0][0][0]).read_bytes())
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_damage_is_found(spark, pages, tmp_path):
    folder = str(tmp_path / "w")
    warc.write_archives(pages, folder)
    f = next(pathlib.Path(folder).glob("*.gz"))
    data = gzip.decompress(f.read_bytes()).replace(b"<p>one", b"<p>two")
    f.write_bytes(warc.member(data))
    with pytest.raises(Exception, match="digest|manifest"):
        warc.read_archives(spark, folder).collect()
