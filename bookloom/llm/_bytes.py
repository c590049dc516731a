"""Vectorised work on the UTF-8 bytes of many texts at once.

An Arrow string column already is one run of bytes with offsets, so words,
lines and shingles of a whole batch are found with a few numpy passes and no
loop over characters.  Long runs are worked in segments so that the temporary
arrays stay small whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked at once; temporary arrays take ~60 x that.
SEGMENT = 1 << 19


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit pseudo-random numbers."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _splitmix(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept between calls."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        kept = _powers[base] = np.multiply.accumulate(x)
    return kept[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null as empty) and len + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def blocks(offsets: np.ndarray, most: int = SEGMENT):
    """Ranges (i, j) of texts of at most ``most`` bytes together, or one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Bytes that are no part of a word: 0x20 and 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def runs(b: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside ``gap``, none across texts; and the runs' offsets by text."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~gap[b]
    first = np.empty(len(b), bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(b)]
    first[edges] = True
    starts = np.flatnonzero(first & solid)
    last = np.empty(len(b), bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    inner = edges[edges > 0]
    last[inner - 1] = True
    ends = np.flatnonzero(last & solid) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(b: np.ndarray, fold: bool, table: np.ndarray | None = None) -> np.ndarray:
    """Running sums from which any substring's hash follows (see span_hash); a ``table`` of byte values gives hashes of its own."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((table if table is not None else _FOLDED if fold else _BYTE)[b] * _power(_BASE, len(b)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes give equal hashes wherever they are."""
    inverse = _power(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(b: np.ndarray, offsets: np.ndarray, fold: bool = True, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the words' offsets by text."""
    starts, ends, by_text = runs(b, offsets, gap)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # segments end between words, so a long text needs no long arrays
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = span_hash(prefix(b[lo:hi], fold), starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out, by_text
