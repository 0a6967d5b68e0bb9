"""Byte-level BPE as a deterministic automaton over token arcs.

The automaton starts as one state with a loop for each byte. Each merge (u, v) -> w then applies a merge
gadget: the state that u leads to is copied without its v arc, u leads to the copy, and an arc w to the
state that v leads to is added wherever u can be read. A state is kept as the state it was copied from plus
its missing arcs, so a copy costs O(1). Its accepted paths are exactly the correct tokenizations.

Pre-split words are run through its tables side by side: a byte table (trie) finds the arcs that match at each place,
and of those that end at a place exactly one leaves the state reached before it, by the table of missing arcs. The
path is read back from the end. A long word's segments are run side by side too, each from a guess some way before it;
a guess counts once all arcs that can reach into the segment are those of the segment before, else it is run again from
there. Ids are kept by piece of text (see ``pieces``), so only new pieces are run.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import PieceTable, binary
from .session import trimmed

#: The published pre-tokenization pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60
#: Words of at most LONG bytes that are run side by side, and the longest that still is, among fewer.
WORDS, LONG, SEGMENT = 1 << 15, 64, 384
#: A longer word is cut into segments of SEGMENT bytes, so many of which are run side by side, each from WARM bytes before it.
SEGMENTS, WARM = 512, 128


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: printable Latin-1 for itself, others from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges; encode() maps the bytes of one pre-split word to token ids."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """labels: id -> bytes; merges: (left id, right id, merged id) by priority."""
        self.labels, self.missing = labels, {t: {} for t in labels}
        self.left, self.right, self.born = {}, {}, dict.fromkeys(labels, -1)
        for k, (u, v, w) in enumerate(merges):
            if w in self.left or not self._arc(u, v):
                continue
            self.missing[u][v] = k
            self.left[w], self.right[w], self.born[w] = u, v, k
        self._compile()

    def _compile(self) -> None:
        """The tables: bytes to arcs, missing arcs, and how arcs and states were made."""
        edges, token_at = {}, [-1]
        for t, label in self.labels.items():
            if len(label) > 1 and t not in self.left:
                continue
            node = 0
            for b in label:
                key = node << 8 | b
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(token_at)
                    token_at.append(-1)
                node = nxt
            token_at[node] = t
        self.token_at = np.array(token_at, np.int32)
        self.edges = Lookup(edges)
        self.gone = Lookup({u << 32 | v: k for u, vs in self.missing.items() for v, k in vs.items()})
        n = max(self.labels) + 1
        self.made = {name: np.full(n, none, np.int32) for name, none in (("left", -1), ("right", -1), ("born", -1))}
        for name, table in self.made.items():
            own = getattr(self, name)
            table[list(own)] = list(own.values())
        self.has_gone = np.zeros(n, bool)
        self.has_gone[[u for u, vs in self.missing.items() if vs]] = True
        self.length = np.zeros(n, np.int64)
        self.length[list(self.labels)] = [len(x) for x in self.labels.values()]
        self.reach = int(self.length.max())

    def _arc(self, t: int, w: int) -> bool:
        """Whether the state that t leads to has an arc w."""
        r, before = t, NEVER
        while True:
            gone = self.missing[r]
            if gone:
                e, upto = w, NEVER
                while True:
                    k = gone.get(e)
                    if k is not None and k < before and k <= upto:
                        return False
                    if e not in self.left:
                        break
                    upto, e = self.born[e], self.left[e]
            if r not in self.right:
                return True
            before, r = self.born[r], self.right[r]

    def _arcs(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """As _arc(), for many states and arcs at once."""
        left, right, born = self.made["left"], self.made["right"], self.made["born"]
        ok = np.ones(len(t), bool)
        live, r, before = np.arange(len(t)), t.astype(np.int64), np.full(len(t), np.iinfo(np.int32).max, np.int32)
        while len(live):
            some = np.flatnonzero(self.has_gone[r])
            e, upto = w[live[some]].astype(np.int64), np.full(len(some), np.iinfo(np.int32).max, np.int32)
            while len(some):
                k = self.gone.get((r[some] << 32 | e).astype(np.uint64))
                stop = (k >= 0) & (k < before[some]) & (k <= upto)
                ok[live[some[stop]]] = False
                on = ~stop & (left[e] >= 0)
                some, e = some[on], e[on]
                upto, e = born[e], left[e].astype(np.int64)
            on = ok[live] & (right[r] >= 0)
            live, r = live[on], r[on]
            before, r = born[r], right[r].astype(np.int64)
        return ok

    def matches(self, raw: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and tokens of all arcs that match within words; ``last`` is each byte's distance from its word's end."""
        at = np.arange(len(raw))
        node = np.zeros(len(raw), np.int64)
        starts, tokens, k = [], [], 0
        while len(at):
            node = self.edges.get((node << 8 | raw[at + k]).astype(np.uint64)).astype(np.int64)
            on = node >= 0
            at, node = at[on], node[on]
            t = self.token_at[node]
            found = t >= 0
            starts.append(at[found])
            tokens.append(t[found])
            on = last[at] > k + 1
            at, node, k = at[on], node[on], k + 1
        return np.concatenate(starts), np.concatenate(tokens)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pre-split words, and how many each word has."""
        size, n, found = np.array([len(w) for w in words], np.int64), np.zeros(len(words), np.int64), []
        for least, most, batch in ((0, LONG, WORDS), (LONG, SEGMENT, SEGMENTS)):
            of = np.flatnonzero((size > least) & (size <= most))
            for i in range(0, len(of), batch):
                part = of[i : i + batch]
                ids, n[part] = self._encode([words[w] for w in part])
                found.append((part, ids))
        if len(found) == 1 and n.all():  # all words side by side
            return found[0][1], n
        for w in np.flatnonzero(size > SEGMENT):
            ids = self._encode_long(words[w])
            n[w] = len(ids)
            found.append((np.array([w]), ids))
        out, start = np.empty(int(n.sum()), np.uint32), np.cumsum(n) - n
        for part, ids in found:
            k = n[part]
            out[np.repeat(start[part] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        return out, n

    def _reached(self, words: list[bytes], over: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The one arc by which each place after a byte is reached (0: before the first word), and the words' sizes and starts.

        With ``over``, a place in each word, also how far before it arcs start that end after it.
        """
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), np.uint8)
        left = np.repeat(first + size, size) - np.arange(len(raw))
        place = np.arange(len(raw)) - np.repeat(first, size)
        start, token = self.matches(raw, left)
        end = start + self.length[token]
        arc = np.full(len(raw) + 1, -1, np.int64)
        step = place[start] + end - start
        far = None
        if over is not None:
            of = np.repeat(np.arange(len(words), dtype=np.int32), size)[start]
            cross = np.flatnonzero((place[start] < over[of]) & (step > over[of]))
            far = np.zeros(len(words), np.int64)
            np.maximum.at(far, of[cross], over[of[cross]] - place[start[cross]])
            del of, cross
        order = np.argsort(step, kind="stable")
        start, token, end = start[order], token[order], end[order]
        cuts = np.searchsorted(step[order], np.arange(1, int(size.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, t = start[a:b], token[a:b]
            ok = place[s] == 0
            rest = np.flatnonzero(~ok)
            ok[rest] = self._arcs(arc[s[rest]], t[rest])
            arc[end[a:b][ok]] = t[ok]
            if b == len(start):
                break
        return arc, size, first, far

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        arc, size, first, _ = self._reached(words)
        at, word, n = first + size, np.flatnonzero(size > 0), np.zeros(len(words), np.int64)
        at = at[word]
        back = []
        while len(word):
            # a place between two words is reached by the arc of the word before it
            t = arc[at]
            back.append((word, t))
            n[word] += 1
            at = at - self.length[t]
            on = at > first[word]
            at, word = at[on], word[on]
        out = np.empty(int(n.sum()), np.uint32)
        stop = np.cumsum(n) - 1
        for k, (word, t) in enumerate(back):
            out[stop[word] - k] = t
        return out, n

    def _encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word; besides 4 bytes for each of its bytes, memory is that of SEGMENTS segments."""
        n, allowed = len(word), {}
        arc = np.full(n + 1, -1, np.int32)
        for a in range(0, n, SEGMENT * SEGMENTS):
            starts = np.arange(a, min(n, a + SEGMENT * SEGMENTS), SEGMENT)
            before = np.minimum(starts, WARM)
            parts = [word[s - k : s + SEGMENT] for s, k in zip(starts.tolist(), before.tolist(), strict=True)]
            got, _, first, far = self._reached(parts, before)
            for s, k, f, part, r in zip(starts.tolist(), before.tolist(), first.tolist(), parts, far.tolist(), strict=True):
                own = got[f + 1 : f + len(part) + 1]  # of the places after each byte of the part
                r = max(r, 1)
                if s and (r >= k or (own[k - r : k] != arc[s - r + 1 : s + 1]).any()):
                    self._go_on(word, arc, s, min(n, s + SEGMENT), allowed)
                else:
                    arc[s + 1 : s + len(part) - k + 1] = own[k:]
        view, lengths, ids, at = memoryview(arc), self.length.tolist(), [], n
        while at:
            t = view[at]
            ids.append(t)
            at -= lengths[t]
        return np.array(ids[::-1], np.uint32)

    def _go_on(self, word: bytes, arc: np.ndarray, a: int, b: int, allowed: dict[int, bool]) -> None:
        """The arcs of the places after ``a`` up to ``b``, place by place from those before; ``allowed`` is a memory of a bounded size."""
        low = max(0, a - self.reach)
        raw = np.frombuffer(word[low:b], np.uint8)
        start, token = self.matches(raw, len(raw) - np.arange(len(raw)))
        start, end = start + low, start + low + self.length[token]
        order = np.flatnonzero(end > a)
        order = order[np.argsort(end[order], kind="stable")]
        view = memoryview(arc)
        if len(allowed) > 200_000:
            allowed.clear()
        for s, t, e in zip(start[order].tolist(), token[order].tolist(), end[order].tolist(), strict=True):
            if view[e] >= 0:
                continue
            if s:
                pair = view[s] << 32 | t
                ok = allowed.get(pair)
                if ok is None:
                    ok = allowed[pair] = self._arc(view[s], t)
                if not ok:
                    continue
            view[e] = t


class Lookup:
    """A fixed table of 64-bit keys and values of at least 0, for many lookups at once (-1: not there)."""

    def __init__(self, table: dict[int, int]):
        keys, values = np.array(list(table), np.uint64), np.array(list(table.values()), np.int32)
        bits = max(4, int(3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        at = self._at(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.values[at[todo]] < 0]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            todo = todo[(self.keys[at[todo]] != keys[todo]) | (self.values[at[todo]] < 0)]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        out = self.values[at]
        todo = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            out[todo] = self.values[at[todo]]
            todo = todo[(self.keys[at[todo]] != keys[todo]) & (out[todo] >= 0)]
        return out


class Codec:
    """A vocabulary file's automaton, special strings and labels, and a table of pieces with their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_alphabet()
        labels = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items()}
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton(labels, [(ids[a], ids[b], ids[a + b]) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.labels = [b""] * (1 + max([*labels, *self.special.values()]))
        for i, b in labels.items():
            self.labels[i] = b
        for s, i in self.special.items():
            self.labels[i] = s.encode()
        self.pieces = PieceTable(self._learn, self._with_special, list(self.special))

    def _words(self, piece: str, last_alone: bool) -> list[str]:
        """The pre-split words of a piece."""
        bare = piece[1:] if piece[0] == " " else piece
        if bare.isascii() and bare.isalpha():
            return [piece]
        if last_alone:
            return [x for x in (piece[:-1], piece[-1]) if x]
        return self.words(piece)

    def _learn(self, pieces: list[str], last_alone: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        words = list(map(self._words, pieces, last_alone))
        ids, n = self.automaton.encode([w.encode() for ws in words for w in ws])
        upto = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(upto[np.concatenate(([0], np.cumsum([len(ws) for ws in words])))])

    def _with_special(self, text: str) -> np.ndarray:
        """Ids of a text in which special strings get their own."""
        return np.concatenate([np.array([self.special[p]], np.uint32) if p in self.special else self.pieces.text_ids(p) for p in self.cut.split(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return np.concatenate([x for _, _, x, _ in self.pieces.encode(pa.array([text]))]).astype("<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The arcs' labels in order, as UTF-8 (broken sequences become U+FFFD)."""
        return b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _mapped(df: DataFrame, new: dict[str, T.DataType], rows) -> DataFrame:
    """``df`` with the ``new`` columns that ``rows`` makes of each batch: ranges of its rows with their values. Existing columns so named are replaced."""
    df = df.drop(*[c for c in new if c in df.columns])
    kept = df.columns

    def run(batches):
        for batch in batches:
            for a, b, values in rows(batch, kept):
                yield pa.RecordBatch.from_arrays([*(col.slice(a, b - a) for col in batch.columns), *values], [*kept, *new])

    return df.mapInArrow(trimmed(run), T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in new.items())]))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids``, the token ids of the whole text as little-endian unsigned 32-bit integers, to each row.

    ``vocabulary`` is the path of a byte-level BPE file, readable on every executor. A null or empty text has no
    ids (an empty value); repeated rows are kept; other columns pass through; an existing column named as ``ids``
    is replaced. No shuffle; a task holds one small batch at a time.
    """

    def rows(batch, kept):
        for a, b, x, off in codec(vocabulary).pieces.encode(batch.column(kept.index(text))):
            yield a, b, [binary(x, off)]

    return _mapped(df, {ids: T.BinaryType()}, rows)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Append ``decoded``, the text that the arcs' labels of ``ids`` spell; null or empty ids give an empty text.

    Special ids give their own strings. Other columns pass through; an existing column named as ``decoded`` is replaced.
    """

    def rows(batch, kept):
        c = codec(vocabulary)
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            yield a, a + part.num_rows, [pa.array([c.decode(x) if x else "" for x in part.column(kept.index(ids)).to_pylist()], pa.string())]

    return _mapped(df, {decoded: T.StringType()}, rows)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode(), then decode() of its ids, in one pass: one Python worker a task in place of two."""

    def rows(batch, kept):
        c = codec(vocabulary)
        for a, b, x, off in c.pieces.encode(batch.column(kept.index(text))):
            coded = binary(x, off)
            yield a, b, [coded, pa.array([c.decode(v) if v else "" for v in coded.to_pylist()], pa.string())]

    return _mapped(df, {ids: T.BinaryType(), decoded: T.StringType()}, rows)
