"""Suffixes compared by prefix hashes: common extensions by binary search, and
a merge sort that needs a logarithmic number of steps per comparison."""
from __future__ import annotations

import numpy as np

from eventlens.llm.common import byte_codes

_CODES = np.append(np.uint64(0), byte_codes(91))  # code 0 is "no byte here"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row of byte codes (0 to 256):
    column k holds the hash of the first k codes."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + _CODES[rows[:, k]]
    return out


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """Polynomial hash of each whole row."""
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            out = out * _BASE + _CODES[rows[:, k]]
    return out


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of rows ``a`` and ``b``, by binary
    search over their prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), prefix.shape[1] - 1)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) >> 1
        same = prefix[a, mid] == prefix[b, mid]
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def _less(rows: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
    at = common_extension(prefix, a, b)
    end = at == rows.shape[1]
    at = np.minimum(at, rows.shape[1] - 1)
    return np.where(end, or_equal, rows[a, at] < rows[b, at])


def sort_suffixes(rows: np.ndarray, prefix: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the rows by suffix inside their groups. ``start`` and ``size``
    give each row's group (groups lie together). Bottom-up merge sort: each
    row finds its rank in the neighbouring run by binary search."""
    order = np.arange(len(rows))
    width = 1
    while len(rows) and width < int(size.max()):
        place = np.flatnonzero(size > width)
        offset = place - start[place]
        run = offset // width
        other = start[place] + (run ^ 1) * width
        length = np.clip(start[place] + size[place] - other, 0, width)
        lo, hi = np.zeros(len(place), np.int64), length.copy()
        odd = (run & 1) == 1
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) >> 1
            # a row of the right run goes after equal rows of the left one
            before = _less(rows, prefix, order[other[todo] + mid], order[place[todo]], odd[todo])
            lo[todo] = np.where(before, mid + 1, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid)
        target = start[place] + (run & ~1) * width + (offset - run * width) + lo
        merged = order.copy()
        merged[target] = order[place]
        order = merged
        width *= 2
    return order


def verified_extensions(rows: np.ndarray, prefix: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray | None:
    """Common prefix of each row of ``order`` with the one before it in its
    group (0 for the first). The hashes' answer is verified on the codes
    themselves; None if a hash collision shows."""
    out = np.zeros(len(order), np.int64)
    later = np.flatnonzero(np.arange(len(order)) > start)
    a, b = order[later - 1], order[later]
    out[later] = common_extension(prefix, a, b)
    differs = rows[a] != rows[b]
    real = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    if (real != out[later]).any():
        return None
    at = np.minimum(real, rows.shape[1] - 1)
    if ((rows[a, at] > rows[b, at]) & (real < rows.shape[1])).any():
        return None
    return out
