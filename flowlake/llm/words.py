"""Words and word hashes of whole Arrow text columns with NumPy, no loop per word.

UTF-8 bytes are enough: every separator used here is ASCII, and all bytes of
a non-ASCII character are 0x80 or above, so byte classes split texts exactly
as the code-point classes of the contracts do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z, non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: [^\x20\x09-\x0D]
SOLID = np.ones(256, dtype=bool)
SOLID[0x09:0x0E] = SOLID[0x20] = False

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_pow = np.ones(1, dtype=np.uint64)
STEP = 1 << 20


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _P)]).astype(np.uint64))
    return _pow


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed 64-bit permutation that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slices(col: pa.Array, limit: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a text column with about ``limit`` bytes at most (one
    longer row stands alone): first row, bytes, offsets of the rows in them.
    A null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


def spans(low: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row where its words begin
    in those arrays (one more entry than rows)."""
    w = kind[low]
    before = np.empty(len(w), dtype=bool)
    after = np.empty(len(w), dtype=bool)
    if len(w):
        before[0], before[1:], after[-1], after[:-1] = False, w[:-1], False, w[1:]
        cut = offs[(offs > 0) & (offs < len(w))]
        before[cut], after[cut - 1] = False, False
    s, e = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return s, e, np.searchsorted(s, offs)


def hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (a polynomial in its bytes, then mixed)."""
    out = np.empty(len(s), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + STEP, side="right")))
            n = e[i:j] - s[i:j]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            within = np.arange(int(n.sum())) - np.repeat(first, n)
            b = low[within + np.repeat(s[i:j], n)].astype(np.uint64) + np.uint64(1)
            out[i:j] = np.add.reduceat(b * _powers(int(n.max()))[within], first)
            i = j
    return mix(out)


def shingles(h: np.ndarray, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes (63 bits) of the runs of ``n`` words of one text;
    a shorter text is one run."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - k + 1, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            acc = mix(acc * _P + h[i: len(h) - k + 1 + i])
    return np.unique((acc >> np.uint64(1)).astype(np.int64))
