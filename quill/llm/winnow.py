"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling polynomial hash (modulo 2**64,
from prefix sums, then mixed). In every window of ``w`` neighbouring k-grams
the smallest hash is chosen, the rightmost one of equals, and kept with its
position. So any match of at least ``w + k - 1`` code points between two texts
shares a chosen hash, and no match under ``k`` does.

Short texts: a text with fewer than ``w`` k-grams is one window; one shorter
than ``k`` is one gram; NULL and empty texts have no grams. Likeness is the
share of common hashes among all hashes of two texts; two texts without grams
are alike (1). Texts are hashed in blocks of bounded size, whatever their length.

``edited_neighbours`` puts each text beside the next one in ascending order of
id (NULL ids first, equal ids by text; after the last: the first). Ranges of
ids are dealt to tasks, the first row of each range also to the range before
it, so nothing is sorted in one task and every text crosses the network once.
"""
from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_bounds, range_of

K, W = 30, 16  # a match of 45 code points, three quarters of 60, shares a gram
BLOCK = 1 << 19  # code points hashed at once
_BASE = 0x9E3779B97F4A7C15
_DTYPE = np.dtype([("h", ">u8"), ("p", ">u4")])


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    one = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64)
    return one(_BASE), one(pow(_BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def gram_hashes(code: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-gram that starts at each place of one array of code points."""
    up, down = _powers(1 << max(21, int(len(code)).bit_length()))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code + np.uint64(1)) * up[:len(code)], out=total[1:])
    return _mixed((total[k:] - total[:-k]) * down[:len(code) - k + 1])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w values the place of its minimum, rightmost of equals."""
    v, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < w:
        step = min(span, w - span)  # the last two spans may overlap
        right = v[step:] <= v[:-step]
        v, at = np.where(right, v[step:], v[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return at


def _block(texts: list[str], k: int, w: int) -> list[np.ndarray]:
    """Fingerprints of texts of at least one character, hashed together."""
    n = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(n) - n
    grams = np.maximum(n - k + 1, 1)
    room = np.maximum(grams, w)  # short texts are padded on the left to one window
    begin = np.cumsum(room) - room
    h = np.full(int(room.sum()), np.iinfo(np.uint64).max)
    full = np.flatnonzero(n >= k)
    if len(full):
        every = gram_hashes(code, k)
        skip = np.repeat(start[full] - (np.cumsum(grams[full]) - grams[full]), grams[full])
        src = np.arange(int(grams[full].sum())) + skip
        to = np.arange(len(src)) + np.repeat(begin[full] + room[full] - grams[full] - (np.cumsum(grams[full]) - grams[full]), grams[full])
        h[to] = every[src]
    for i in np.flatnonzero(n < k):
        h[begin[i] + room[i] - 1] = gram_hashes(code[start[i]:start[i] + n[i]], int(n[i]))[0]
    at = window_minima(h, w)
    text = np.repeat(np.arange(len(texts)), room)
    ok = (np.arange(len(at)) - begin[text[:len(at)]]) <= (room - w)[text[:len(at)]]
    at = at[ok]
    at = at[np.r_[True, at[1:] != at[:-1]]]
    owner = text[at]
    out = np.empty(len(at), _DTYPE)
    out["h"], out["p"] = h[at], at - (begin + room - grams)[owner]
    return np.split(out, np.searchsorted(owner, np.arange(1, len(texts))))


def fingerprint(texts: list, k: int = K, w: int = W) -> list[np.ndarray]:
    """For each text its chosen hashes ``h`` and their positions ``p``."""
    out: list = [np.empty(0, _DTYPE)] * len(texts)
    part, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > BLOCK:
            out[i] = _long(t, k, w)
            continue
        if part and size + len(t) > BLOCK:
            _fill(out, texts, part, k, w)
            part, size = [], 0
        part.append(i)
        size += len(t) + w
    if part:
        _fill(out, texts, part, k, w)
    return out


def _fill(out, texts, part, k, w):
    for i, f in zip(part, _block([texts[i] for i in part], k, w), strict=True):
        out[i] = f


def _long(text: str, k: int, w: int) -> np.ndarray:
    """A long text in pieces that share their last w + k - 2 characters."""
    found = []
    for a in range(0, len(text) - (w + k - 2), BLOCK):
        f = _block([text[a:a + BLOCK + w + k - 2]], k, w)[0].copy()
        f["p"] += a
        found.append(f)
    f = np.concatenate(found)
    return f[np.r_[True, f["p"][1:] != f["p"][:-1]]]


def likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(text: str, after: str) -> str:
    """The last quarter replaced by the first as many code points of ``after``."""
    q = len(text) // 4
    return text[:len(text) - q] + after[:q]


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W,
                      range_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text
    (hexadecimal, 16 digits of hash and 8 of position per gram), and likeness
    of its fingerprint to the edited one's and to the next document's."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = range_bounds(d, "id", -(-total // range_bytes))
    which = range_of(bounds)
    low = d.select("id").groupBy(which("id").alias("r")).agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("none"))
    first = sorted((r.r, None if r.none else r.id) for r in low.collect())  # a row per range
    before = {i: first[n - 1][0] for n, (_, i) in enumerate(first)}  # id of a first row -> the range before

    @F.pandas_udf("array<struct<r:int,copy:int>>")
    def route(ids):
        import pandas as pd
        has = ids.notna().to_numpy()
        r = np.zeros(len(ids), np.int32)
        r[has] = np.searchsorted(bounds, ids[has].to_numpy(np.int64), side="right")
        out = []
        for i, ok, x in zip(ids, has, r, strict=True):
            to = [{"r": int(x), "copy": 0}]
            if (key := int(i) if ok else None) in before:
                to.append({"r": before[key], "copy": 1})
            out.append(to)
        return pd.Series(out)

    def run(batches):
        held, at = [], None  # rows of one range, in order; the last waits for its successor
        for b in batches:
            for r, copy, i, t in zip(*(b.column(n).to_pylist() for n in ("r", "copy", "id", "text")), strict=True):
                if r != at:
                    held, at, closed, size = [], r, False, 0
                if closed:
                    continue  # more copies of the row that came first
                held.append((i, t or ""))
                size += len(t or "")
                closed = bool(copy)
                if closed or size > BLOCK:
                    if len(held) > 1:
                        yield _rows(held, k, w)
                    held, size = held[-1:], len(held[-1][1])

    return (d.withColumn("to", F.explode(route("id"))).select("to.r", "to.copy", "id", "text")
            .repartitionById(len(bounds) + 1, F.col("r")).sortWithinPartitions("r", "copy", "id", "text").mapInArrow(run, _SCHEMA))


def _rows(held: list, k: int, w: int):
    """Result rows of all but the last of consecutive (id, text)."""
    texts = [t for _, t in held]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    prints = fingerprint(texts + changed, k, w)
    own, new = prints[:len(texts)], prints[len(texts):]
    sets = [set(f["h"].tolist()) for f in own]
    cols = [
        pa.array([i for i, _ in held[:-1]], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array([f.tobytes().hex() for f in own[:-1]]),
        pa.array([f.tobytes().hex() for f in new]),
        pa.array([likeness(a, set(f["h"].tolist())) for a, f in zip(sets, new, strict=False)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(sets, sets[1:], strict=False)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _SCHEMA.split(", ")])
