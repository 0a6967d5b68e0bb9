"""Vectorised words and word shingles of whole texts, for Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit polynomials over a fixed
random byte table, finished by a bit mixer, so that equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at once; a longer word is hashed in one piece of its own length.
PIECE = 1 << 20
#: Text bytes per group of documents that is worked on at once; a longer document is a group of its own.
GROUP_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_Q = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: LOWER with ASCII punctuation as white space.
BARE = LOWER.copy()
BARE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0x20
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > PIECE:
        return tuple(np.multiply.accumulate(np.concatenate(([U(1)], np.full(n, U(x))))) for x in (_P, _P_INV))
    if not _powers:
        for k, x in (("up", _P), ("down", _P_INV)):
            _powers[k] = np.multiply.accumulate(np.concatenate(([U(1)], np.full(PIECE, U(x)))))
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls as empty), and the n+1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of words before it (n+1 values)."""
    n = len(raw)
    gap = np.ones(n + 1, bool)
    gap[1:] = SPACE[raw]
    word = ~gap[1:]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word & (gap[:n] | cut[:n]))
    after = np.ones(n, bool)
    if n:
        after[:-1] = gap[2:]
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word."""
    out, k, total = np.empty(len(starts), np.uint64), 0, len(starts)
    while k < total:
        a = starts[k]
        j = max(k + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        piece = raw[a : ends[j - 1]]
        up, down = _power(len(piece))
        c = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_TABLE[piece] * up[: len(piece)], out=c[1:])
        s, e = starts[k:j] - a, ends[k:j] - a
        out[k:j] = mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * _Q[63])
        k = j
    return out


def grams(h: np.ndarray, word_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows row by row, and the n+1 offsets of the rows in them; no window crosses rows."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(len(word_at), np.int64)
    s = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        s += h[j : j + len(s)] * _Q[j]
    count = np.maximum(np.diff(word_at) - n + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(count)))
    if len(count) == 1:
        return mix(s), offsets
    at = np.arange(offsets[-1]) + np.repeat(word_at[:-1] - offsets[:-1], count)
    return mix(s[at]), offsets


def shingles(h: np.ndarray, word_at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As grams(), but a row of 1 to n-1 words has its whole sequence as its one shingle."""
    g, off = grams(h, word_at, n)
    words = np.diff(word_at)
    short = np.flatnonzero((words > 0) & (words < n))
    if not len(short):
        return g, off
    whole = np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        has = words[short] > j
        whole[has] += h[word_at[short[has]] + j] * _Q[j]
    whole = mix(whole + words[short].astype(np.uint64) * _Q[62])
    return np.insert(g, off[short], whole), off + np.concatenate(([0], np.cumsum((words > 0) & (words < n))))


def groups(offsets: np.ndarray, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def placed(column: pa.Array, table: np.ndarray = LOWER, size: int = GROUP_BYTES) -> Iterator[tuple]:
    """As hashed(), and the words' starts, ends and the rows' offsets in the bytes of the group."""
    raw, off = text_bytes(column)
    for a, b in groups(off, size):
        part, own = table[raw[off[a] : off[b]]], off[a : b + 1] - off[a]
        starts, ends, at = spans(part, own)
        yield a, b, word_hashes(part, starts, ends), at, starts, ends, own


def hashed(column: pa.Array, table: np.ndarray = LOWER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of rows: first row, row after the last, word hashes, word offsets (bytes mapped by ``table``: A-Z lower-cased)."""
    for a, b, h, at, *_ in placed(column, table):
        yield a, b, h, at
