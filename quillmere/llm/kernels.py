"""Vectorised text kernels over Arrow string buffers.

A *word* is a maximal run of ASCII letters, digits or bytes above 127, after Unicode
lower-casing.  The hash of a byte span is a polynomial in the span's bytes modulo 2**64,
taken from one prefix sum for all spans of a window, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = U(0xD6E8FEB86659FD93)
WINDOW = 1 << 20

_cls = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _cls[_c] = 1
WORD_CLASS = _cls
#: As WORD_CLASS, with visible symbols as a second kind of token.
TOKEN_CLASS = np.where((_cls == 0) & (np.arange(256) > 32) & (np.arange(256) != 127), 2, _cls).astype(np.uint8)
LINE_CLASS = (np.arange(256) != 10).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """One contiguous large_string array, lower-cased on demand; nulls stay nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.utf8_lower(column) if lower else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offsets has one entry more than there are rows."""
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def by_bytes(off: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(data: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the maximal runs of one non-zero kind within each row.

    ``first[r] : first[r + 1]`` are the runs of row r; positions are absolute in ``data``.
    """
    lo, hi = int(off[0]), int(off[-1])
    kind = kinds[data[lo:hi]]
    cut = np.empty(hi - lo + 1, bool)
    cut[0] = cut[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
    cut[off - lo] = True
    at = np.flatnonzero(cut)
    begin, end = at[:-1], at[1:]
    keep = kind[begin] != 0 if len(kind) else np.zeros(len(begin), bool)
    begin, end = begin[keep] + lo, end[keep] + lo
    return begin, end, np.searchsorted(begin, off)


def powers(n: int, held: dict) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n of them, kept in ``held``."""
    if held.get("n", 0) < n:
        n = max(n, WINDOW + 1)
        up, down = np.full(n, BASE, U), np.full(n, BASE_INVERSE, U)
        up[0] = down[0] = 1
        held.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return held["up"], held["down"]


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, held: dict) -> np.ndarray:
    """64-bit hashes of the byte spans, whatever their position; begin and end ascend."""
    out = np.empty(len(begin), U)
    i = 0
    while i < len(begin):
        base = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, base + WINDOW, "right")))
        n = int(end[j - 1]) - base
        up, down = powers(n + 1, held)
        prefix = np.zeros(n + 1, U)
        np.cumsum((data[base : base + n].astype(U) + U(1)) * up[:n], out=prefix[1:])
        b, e = begin[i:j] - base, end[i:j] - base
        out[i:j] = (prefix[e] - prefix[b]) * down[b]
        i = j
    return mix(out)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; entry i starts at word i.  Rows are the caller's matter."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = words[:n].copy()
    for t in range(1, k):
        h = h * STEP + words[t : t + n]
    return mix(h)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each run, from the ``first`` of ``spans``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
