"""Patched frame-of-reference blocks of unsigned 32-bit integers, in numpy.

A block holds up to ``SIZE`` numbers: its minimum, the width that takes all but
a share of the differences from it, these differences packed at that width, and
an exception list (positions and high bits) for the outliers. All blocks of a
run that share a width are packed and unpacked together.
"""
from __future__ import annotations

import numpy as np

SIZE = 512
SHARE = 0.9  # of a block's differences that the width must take
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u2"), ("exceptions", "<u2")])
_U = np.uint64


def _lanes(x: np.ndarray) -> np.ndarray:
    """Rows of SIZE numbers as 64 lanes, one column per 64 numbers."""
    return np.ascontiguousarray(x.reshape(-1, 64).T)


def pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of SIZE numbers below 2**width as rows of ``SIZE * width / 64`` words."""
    lane = _lanes(rows.astype(_U))
    out = np.zeros((width, lane.shape[1]), _U)
    for j in range(64 if width else 0):
        at, shift = divmod(j * width, 64)
        out[at] |= lane[j] << _U(shift)
        if shift + width > 64:
            out[at + 1] |= lane[j] >> _U(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(rows), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """What ``pack`` packed."""
    if not width:
        return np.zeros((len(words), SIZE), np.uint32)
    lane = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lane.shape[1]), np.uint32)
    mask = _U((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        v = lane[at] >> _U(shift)
        if shift + width > 64:
            v |= lane[at + 1] << _U(64 - shift)
        out[j] = (v & mask).astype(np.uint32)
    return np.ascontiguousarray(out.T).reshape(len(words), SIZE)


def encode(ids: np.ndarray, share: float = SHARE) -> list[bytes]:
    """The blocks of an array; all but the last hold SIZE numbers."""
    n = len(ids)
    if not n:
        return []
    m = -(-n // SIZE)
    rows = np.full(m * SIZE, ids[(m - 1) * SIZE:].min(), np.uint32)
    rows[:n] = ids
    rows = rows.reshape(m, SIZE)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    rank = max(0, int(np.ceil(share * SIZE)) - 1)
    width = np.frexp(np.partition(rows, rank, axis=1)[:, rank].astype(np.float64))[1]
    high = (rows.astype(_U) >> width.astype(_U)[:, None]).astype(np.uint32)
    row, col = np.nonzero(high)
    count = np.bincount(row, minlength=m)
    stop = np.cumsum(count)
    head = np.zeros(m, HEAD)
    head["low"], head["width"], head["n"], head["exceptions"] = low, width, SIZE, count
    head["n"][-1] = n - (m - 1) * SIZE
    position, bits = col.astype("<u2"), high[row, col].astype("<u4")
    out: list = [None] * m
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        packed = pack(rows[of] & np.uint32((1 << int(w)) - 1), int(w)).astype("<u8")
        for i, p in zip(of.tolist(), packed, strict=True):
            a, b = stop[i] - count[i], stop[i]
            out[i] = b"".join((head[i].tobytes(), p.tobytes(), position[a:b].tobytes(), bits[a:b].tobytes()))
    return out


def decode(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers of the blocks that start at ``starts`` in an array of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    starts = starts.astype(np.int64)
    head = np.ascontiguousarray(data[starts[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).ravel()
    width, count = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    rows = np.empty((len(starts), SIZE), np.uint32)
    body = starts + HEAD.itemsize
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        words = np.ascontiguousarray(data[body[of][:, None] + np.arange(SIZE * w // 8)]).view("<u8") if w else np.zeros((len(of), 0), _U)
        rows[of] = unpack(words, w)
    if count.any():
        of = np.repeat(np.arange(len(starts)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        tail = (body + SIZE // 8 * width)[of]
        two = np.ascontiguousarray(data[(tail + 2 * nth)[:, None] + np.arange(2)]).view("<u2").ravel()
        four = np.ascontiguousarray(data[(tail + 2 * count[of] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
        rows[of, two] |= (four.astype(_U) << width[of].astype(_U)).astype(np.uint32)
    rows += head["low"][:, None]
    if (head["n"][:-1] == SIZE).all():
        return rows.ravel()[:(len(starts) - 1) * SIZE + int(head["n"][-1])]
    return rows[np.arange(SIZE) < head["n"][:, None]]
