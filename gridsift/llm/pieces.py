"""Whole texts cut into pieces whose token ids do not depend on their surroundings, and a bounded table of pieces' ids.

Words and white space of byte-level BPE never merge across a word's end, so a text's ids are those of its pieces in
order: a word with the one space before it, the rest of the white space before a word, and one punctuation mark that
ends a word after a letter or digit. Cutting, lookup and joining work on arrays of a group of texts; only pieces that
the table does not hold are given to ``learn``. A piece of up to 16 bytes is its own exact key (its first and last 8
bytes and its length), a longer one is looked up by its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import SPACE, groups, text_bytes

U = np.uint64
#: Pieces that a table holds, and bytes of ids; when either is exceeded, those used since the last time stay (a cost bound, never a change of results).
ENTRIES, POOL_BYTES = 1 << 19, 64 << 20
#: Pieces that are looked up at once, and bytes of text that are cut at once (a longer document in several parts).
SLICE, PART_BYTES = 1 << 17, 1 << 20

_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: First bytes of the white space beyond ASCII (a fixed value: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_WIDE_CODES = np.sort(np.array([int.from_bytes(c.encode(), "little") for c in _WIDE], np.int64))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_TAIL = 255
_EMPTY = np.int32(-1)


def white_space(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to Unicode white space."""
    gap = SPACE[raw]
    lead = np.flatnonzero(_LEAD[raw])
    if len(lead):
        wide = np.concatenate((raw, np.zeros(2, np.uint8))).astype(np.int64)
        for size, first in ((2, lead[raw[lead] == 0xC2]), (3, lead[raw[lead] != 0xC2])):
            code = sum(wide[first + k] << (8 * k) for k in range(size))
            at = first[_WIDE_CODES[np.minimum(np.searchsorted(_WIDE_CODES, code), len(_WIDE_CODES) - 1)] == code]
            for k in range(size):
                gap[at + k] = True
    return gap


def cut(raw: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of texts raw[own[i]:own[i+1]], which cover all bytes, and which of them are white space before a word without a space of its own."""
    n = len(raw)
    gap = np.ones(n + 1, bool)
    gap[1:] = white_space(raw)
    edge = np.zeros(n + 1, bool)
    edge[own] = True
    word = ~gap[1:]
    starts = np.flatnonzero(word & (gap[:n] | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = gap[2:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    spaced = (starts > 0) & ~edge[starts]
    spaced[spaced] = raw[starts[spaced] - 1] == 0x20
    first = edge[:n].copy()
    first[ends[ends < n]] = True
    first[starts[~spaced]] = True
    first[starts[spaced] - 1] = True
    marked = _MARK[raw[ends - 1]] & (ends - starts > 1)
    marked[marked] = _ALNUM[raw[ends[marked] - 2]]
    first[ends[marked] - 1] = True
    at = np.flatnonzero(first)
    before = np.zeros(n + 1, bool)
    before[starts[~spaced]] = True
    end = np.append(at[1:], n)
    return at, gap[1:][at] & before[end] & ~edge[end]


class PieceTable:
    """Pieces of texts with their ids. ``learn`` maps new pieces (and whether each is white space that leaves its last character to itself) to all their ids and the counts of each."""

    def __init__(self, learn: Callable[[list[str], list[bool]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], np.ndarray], special: list[str], entries: int = 0):
        self.learn, self.whole, self.special = learn, whole, special
        self.entries = entries or ENTRIES
        self.mask = U((1 << int(2 * self.entries - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        n = self.entries
        self.slots = np.full(int(self.mask) + 1, _EMPTY)
        self.low, self.high, self.tag = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        self.off, self.count, self.used = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        self.pool, self.n, self.filled, self.long = np.zeros(1 << 16, np.uint32), 0, 0, {}

    def _hash(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
        h = low * U(0x9E3779B97F4A7C15) + high * U(0xC2B2AE3D27D4EB4F) + tag.astype(np.uint64) * U(0x165667B19E3779F9)
        h ^= h >> U(32)
        h *= U(0xFF51AFD7ED558CCD)
        return h ^ (h >> U(29))

    def _find(self, h: np.ndarray, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        at = h & self.mask
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high) | (self.tag[out] != tag)))
        while len(todo):
            at[todo] = (at[todo] + U(1)) & self.mask
            e = self.slots[at[todo]]
            out[todo] = e
            todo = todo[(e >= 0) & ((self.low[e] != low[todo]) | (self.high[e] != high[todo]) | (self.tag[e] != tag[todo]))]
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        at = h & self.mask
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]
            rest = self.slots[at] != entry
            at, entry = (at[rest] + U(1)) & self.mask, entry[rest]

    def _add(self, ids: np.ndarray, count: np.ndarray, low, high, tag) -> np.ndarray:
        """New entries for pieces of ``count`` ids each."""
        k = len(count)
        entry = np.arange(self.n, self.n + k)
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.filled], np.zeros(max(len(ids), self.filled) + len(ids), np.uint32)))
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.low[entry], self.high[entry], self.tag[entry] = low, high, tag
        self.off[entry], self.count[entry], self.used[entry] = self.filled + np.cumsum(count) - count, count, True
        self.n, self.filled = self.n + k, self.filled + len(ids)
        return entry

    def _make_room(self, new: int) -> None:
        """Before ``new`` entries: if they do not fit, only short pieces used since the last time stay, or none if these are many."""
        if self.n + new <= self.entries and self.filled * 4 <= POOL_BYTES:
            return
        stay = np.flatnonzero(self.used[: self.n] & (self.tag[: self.n] != _TAIL))
        count, off = self.count[stay], self.off[stay]
        low, high, tag, pool = self.low[stay], self.high[stay], self.tag[stay], self.pool
        self.clear()
        if len(stay) + new <= self.entries and len(stay) <= self.entries // 2 and count.sum() * 8 <= POOL_BYTES:
            ids = pool[np.arange(count.sum()) + np.repeat(off - (np.cumsum(count) - count), count)]
            self._place(self._hash(low, high, tag), self._add(ids, count, low, high, tag))
            self.used[:] = False

    def _entries(self, raw: np.ndarray, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, last_alone: np.ndarray) -> np.ndarray:
        """The entry of each of at most SLICE pieces, after learning what is new."""
        size = ends - starts
        window = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1)).view(np.uint64)[:, 0]
        low = window[starts] & _KEEP[np.minimum(size, 8)]
        high = np.where(size > 8, window[np.maximum(ends - 8, 0)], U(0))
        tag = (np.minimum(size, 17) + 32 * last_alone).astype(np.uint8)
        short = np.flatnonzero(size <= 16)
        tail = np.flatnonzero(size > 16)
        self._make_room(0)
        out = np.empty(len(starts), np.int64)
        h = self._hash(low, high, tag)
        text = lambda i: raw[starts[i] : ends[i]].tobytes().decode()
        while True:
            out[short] = self._find(h[short], low[short], high[short], tag[short])
            keys = [(raw[starts[i] : ends[i]].tobytes(), bool(last_alone[i])) for i in tail]
            out[tail] = [self.long.get(k, -1) for k in keys]
            missing = short[out[short] < 0]
            new = missing[np.unique(h[missing], return_index=True)[1]]
            new_keys = list(dict.fromkeys(k for k, e in zip(keys, out[tail], strict=True) if e < 0))
            if not len(new) and not new_keys:
                self.used[out] = True
                return out
            if self.n + len(new) + len(new_keys) > self.entries:
                self._make_room(len(new) + len(new_keys))
                continue
            pieces = [*map(text, new), *(k.decode() for k, _ in new_keys)]
            ids, count = self.learn(pieces, [*last_alone[new].tolist(), *(x for _, x in new_keys)])
            k = len(new)
            zero = np.zeros(len(new_keys), np.uint64)
            entry = self._add(ids, count, np.append(low[new], zero), np.append(high[new], zero), np.append(tag[new], np.full(len(new_keys), _TAIL, np.uint8)))
            self._place(h[new], entry[:k])
            self.long.update(zip(new_keys, entry[k:].tolist(), strict=True))

    def _ids(self, raw: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts raw[own[i]:own[i+1]], and the n+1 offsets of the texts in them."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(own), np.int64)
        starts, last_alone = cut(raw, own)
        ends = np.append(starts[1:], len(raw))
        padded = np.concatenate((raw, np.zeros(8, np.uint8)))
        ids, counts = [], []
        for i in range(0, len(starts), SLICE):
            e = self._entries(raw, padded, starts[i : i + SLICE], ends[i : i + SLICE], last_alone[i : i + SLICE])
            count = self.count[e]
            counts.append(count)
            ids.append(self.pool[np.arange(count.sum()) + np.repeat(self.off[e] - (np.cumsum(count) - count), count)])
        upto = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return np.concatenate(ids), upto[np.searchsorted(starts, own)]

    def text_ids(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self._ids(raw, np.array([0, len(raw)]))[0] if len(raw) else np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For groups of rows: first row, row after the last, all ids, and the offsets of the rows in them. Nulls are as empty texts; a text with a special string goes to ``whole``."""
        raw, off = text_bytes(column)
        special = np.zeros(len(column), bool)
        for s in self.special:
            special |= pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)
        for a, b in groups(off, PART_BYTES):
            own = off[a : b + 1] - off[a]
            part = raw[off[a] : off[b]]
            if b - a == 1 and own[1] > 2 * PART_BYTES:
                found = [self._ids(part[x:y], np.array([0, y - x]))[0] for x, y in _parts(part)]
                ids = np.concatenate(found)
                to = np.array([0, len(ids)])
            else:
                ids, to = self._ids(part, own)
            if special[a:b].any():
                rows = [self.whole(column[i].as_py()) if special[i] else ids[to[i - a] : to[i - a + 1]] for i in range(a, b)]
                ids, to = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
            yield a, b, ids, to


def _parts(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PART_BYTES of one long text, each ending where an ASCII word does."""
    a, n = 0, len(raw)
    while a < n:
        b = a + PART_BYTES
        while b < n:
            part = raw[b - 1 : b + 65536]
            end = np.flatnonzero(SPACE[part[1:]] & ~SPACE[part[:-1]] & (part[:-1] < 0x80))
            if len(end):
                b += int(end[0])
                break
            b += 65535
        yield a, min(b, n)
        a = b


def binary(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows of ids as little-endian unsigned 32-bit integers."""
    data = np.ascontiguousarray(ids, "<u4")
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * 4).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
