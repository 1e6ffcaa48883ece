"""Vectorised work on batches of UTF-8 texts: words, span hashes, n-gram hashes.

A batch is a byte array with document offsets. Texts are handled whole, in slices of documents of at
most ``SLICE`` bytes together (a longer document is a slice of its own), so that tables of powers
stay small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TABLE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C13
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB], np.uint64)


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, made longer when asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all of them; one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets; a null text is empty."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = SLICE):
    """Ranges of documents of at most ``most`` bytes, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and document of every word; no word crosses documents."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[n] = True
    space = SPACE[data]
    start = ~space
    end = start.copy()
    start[1:] &= space[:-1] | cut[1:n]
    end[:-1] &= space[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix(data: np.ndarray) -> np.ndarray:
    """P with hash(data[i:j]) = (P[j] - P[i]) * BASE**-i modulo 2**64."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[: len(data)], out=out[1:])
    return out


def spans(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal spans have equal hashes wherever they stand."""
    _, down = _powers(len(p))
    return mix((p[ends] - p[starts]) * down[starts])


def rolling(p: np.ndarray, length: int) -> np.ndarray:
    """``spans`` of all spans of one length."""
    _, down = _powers(len(p))
    return mix((p[length:] - p[: len(p) - length]) * down[: len(p) - length])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word after lower-casing A-Z; offsets begin at 0."""
    data = LOWER[data]
    starts, ends, doc = words(data, offsets)
    return spans(prefix(data), starts, ends), doc


def shingle_sets(column, width: int):
    """For each document its distinct hashed shingles of ``width`` words, sorted; with fewer words the
    whole sequence is one shingle, without words there is none."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        own = offsets[i : j + 1] - offsets[i]
        h, doc = word_hashes(data[offsets[i] : offsets[j]], own)
        at = np.searchsorted(doc, np.arange(j - i + 1))
        full = np.zeros(0, np.uint64)
        if len(h) >= width:
            full = sum((h[k : len(h) - width + 1 + k] * _ODD[k % 8] + np.uint64(k) for k in range(width)), np.zeros(len(h) - width + 1, np.uint64))
            full = mix(full)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                yield mix(np.array([sum(int(x) * int(_ODD[k % 8]) + k for k, x in enumerate(h[a:b])) + (b - a) * 0x51ED270B % 2**64 & (2**64 - 1)], dtype=object).astype(np.uint64))
            else:
                yield np.zeros(0, np.uint64)
