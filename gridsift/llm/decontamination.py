"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are lower-cased and punctuation counts as white space. A seed is a window of ``SEED`` words of a test item
(of all its words, if it has fewer). Every seed counts, however many documents hold it. Around seeds that lie on
nearby diagonals, the whole item is aligned with the document's words (match +2, mismatch and gap -1); score is the
best local score over that of a full match. Windows are not aligned if they hold fewer of the item's words than any
score of the threshold needs, so common language costs little and no passage is lost.

Test items are worked on in blocks of at most ``BLOCK_WORDS`` words, whatever their number; each block is read, sent
to the tasks, used in one pass over the documents without a shuffle of texts, and dropped before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import staged, trimmed
from .words import BARE, grams, hashed, placed

SEED = 3
BLOCK_WORDS = 2_000_000
THRESHOLD = 0.4
#: Most seed hits (item, place) that are held at once; a document with more is worked on alone.
HITS = 1 << 20
#: Most windows, and most cells of one item word's row over them, that are aligned at once.
WINDOWS, CELLS = 256, 1 << 20
#: A wider window is aligned in pieces of this width (or six items), which overlap by more than any alignment of a positive score spans.
PIECE = 1 << 18
_BIG = 1 << 32
_FILTER = 22


class Items:
    """A block of test items: their words and, for each seed length, sorted seed hashes with their uses."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.words = ids, []
        for _, _, h, at in hashed(pa.array([t or "" for t in texts], pa.string()), BARE):
            self.words += [h[at[k] : at[k + 1]] for k in range(len(at) - 1)]
        uses: dict[int, list] = {}
        for i, w in enumerate(self.words):
            if len(w):
                n = min(SEED, len(w))
                g, _ = grams(w, np.array([0, len(w)]), n)
                uses.setdefault(n, []).append((g, np.full(len(g), i), np.arange(len(g))))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.seeds = {}
        for n, found in uses.items():
            g, item, k = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(g, kind="stable")
            self.seeds[n] = (g[order], item[order], k[order])

    def found(self, g: np.ndarray, n: int) -> np.ndarray:
        """Positions in ``g`` of windows that are seeds."""
        if n not in self._filters:
            bits = np.zeros(1 << _FILTER, bool)
            bits[self.seeds[n][0] >> np.uint64(64 - _FILTER)] = True
            self._filters[n] = bits
        at = np.flatnonzero(self._filters[n][g >> np.uint64(64 - _FILTER)])
        table = self.seeds[n][0]
        if not len(table):
            return at[:0]
        x = np.minimum(np.searchsorted(table, g[at]), len(table) - 1)
        return at[table[x] == g[at]]

    @property
    def _filters(self) -> dict:
        return self.__dict__.setdefault("_own_filters", {})

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_own_filters"}


def align(item: np.ndarray, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of an item's words with each window: score, first word, word after the last.

    A cell's value is its score times 2**32, less its alignment's start, so that maxima carry the starts along.
    """
    width = max(map(len, windows))
    table = np.zeros((len(windows), width), np.uint64)
    inside = np.zeros((len(windows), width), bool)
    for k, w in enumerate(windows):
        table[k, : len(w)], inside[k, : len(w)] = w, True
    j = np.arange(width + 1, dtype=np.int64)
    fresh, slope = (_BIG - 1 - j)[None, :], (j * _BIG)[None, :]
    row = np.repeat(fresh, len(windows), 0)
    best, end = row[:, 0].copy(), np.zeros(len(windows), np.int64)
    for word in item:
        step = np.where(inside & (table == word), 2 * _BIG, -_BIG)
        new = np.maximum(fresh, row - _BIG)
        np.maximum(new[:, 1:], row[:, :-1] + step, out=new[:, 1:])
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        at = row.argmax(1)
        top = row[np.arange(len(row)), at]
        more = (top >> 32) > (best >> 32)
        best[more], end[more] = top[more], at[more]
    return best >> 32, _BIG - 1 - (best & (_BIG - 1)), end


def _slices(doc: np.ndarray, reps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of places, sorted by document, with at most ``HITS`` hits or one document each."""
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(doc) != 0)), len(doc))
    total = np.concatenate(([0], np.cumsum(reps)))[cuts]
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(total, total[a] + HITS, "right")) - 1)
        yield int(cuts[a]), int(cuts[b])
        a = b


def _chunks(width: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of windows, sorted by width, that are aligned at once."""
    a = 0
    while a < len(width):
        cells = width[a : a + WINDOWS] * np.arange(1, len(width[a : a + WINDOWS]) + 1)
        b = a + max(1, int(np.searchsorted(cells, CELLS, "right")))
        yield a, b
        a = b


def _pieces(lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [lo, hi) in pieces of bounded width: each piece's window, start and end.

    An alignment of an item of ``size`` words gains at most 2 a word and loses 1 for each word between, so one of a
    positive score spans less than 3 * size words and lies within a piece.
    """
    width = max(PIECE, 6 * size)
    step = width - 3 * size
    count = np.maximum(1, -(-(hi - lo - 3 * size) // step))
    of = np.repeat(np.arange(len(lo)), count)
    start = lo[of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * step
    return of, start, np.minimum(start + width, hi[of])


def _enough(item: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float) -> np.ndarray:
    """Which windows h[lo:hi] hold so many of the item's words that a score of ``threshold`` is possible at all."""
    known, keep = np.unique(item), np.zeros(len(lo), bool)
    for a, b in _chunks(hi - lo):
        size = hi[a:b] - lo[a:b]
        start = np.cumsum(size) - size
        x = h[np.arange(size.sum()) + np.repeat(lo[a:b] - start, size)]
        same = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
        keep[a:b] = np.add.reduceat(same, start, dtype=np.int64) / len(item) >= threshold
    return keep


def _passages(items: Items, hits: np.ndarray, h: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, last word) of windows around ``hits`` (item, row, diagonal) that reach ``threshold``."""
    item, doc, diagonal = np.unique(hits, axis=1)
    size = items.sizes[item]
    new = np.ones(len(item), bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(doc) != 0) | (np.diff(diagonal) > size[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    lo = np.maximum(diagonal[first] - size[first] // 2 - 2, at[doc[first]])
    hi = np.minimum(diagonal[last] + size[first] + size[first] // 2 + 2, at[doc[first] + 1])
    edges = np.flatnonzero(np.append(True, np.diff(item[first]) != 0))
    for x, y in zip(edges, [*edges[1:], len(first)], strict=True):
        i = int(item[first[x]])
        of, start, end = _pieces(lo[x:y], hi[x:y], len(items.words[i]))
        order = np.argsort(end - start, kind="stable")
        order = order[_enough(items.words[i], h, start[order], end[order], threshold)]
        for a, b in _chunks((end - start)[order]):
            part = order[a:b]
            for p, v, s, e in zip(part, *align(items.words[i], [h[start[p] : end[p]] for p in part]), strict=True):
                v = float(v) / (2 * len(items.words[i]))
                if v >= threshold:
                    yield int(doc[first[x + of[p]]]), i, v, start[p] + s, start[p] + e - 1


def aligned(items: Items, column: pa.Array, threshold: float = THRESHOLD) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, start, end) of the rows' best passages of at least ``threshold``; start and end are byte offsets in the text."""
    out = []
    for a, _, h, at, starts, ends, own in placed(column, BARE):
        best: dict[tuple[int, int], tuple] = {}
        for n, (table, item, k) in items.seeds.items():
            g, off = grams(h, at, n)
            pos = items.found(g, n)
            if not len(pos):
                continue
            left, right = np.searchsorted(table, g[pos], "left"), np.searchsorted(table, g[pos], "right")
            doc = np.searchsorted(off, pos, "right") - 1
            word = pos - off[doc] + at[doc]
            for x, y in _slices(doc, right - left):
                lo, reps = left[x:y], (right - left)[x:y]
                use = np.repeat(lo - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
                hits = np.stack((item[use], np.repeat(doc[x:y], reps), np.repeat(word[x:y], reps) - k[use]))
                for d, i, v, s, e in _passages(items, hits, h, at, threshold):
                    if (d, i) not in best or (-v, s) < (-best[d, i][0], best[d, i][3]):
                        best[d, i] = (v, int(starts[s] - own[d]), int(ends[e] - own[d]), s)
        out += [(a + d, i, *x[:3]) for (d, i), x in best.items()]
    return out


def _blocks(benchmark: DataFrame, text: str, item_id: str) -> Iterator[Items]:
    """Items in blocks of bounded size, read part by part."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), text).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "") // 4 + 1
        if size >= BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, start_byte, end_byte: the best passage of each document and test item that reach ``threshold``.

    Null or empty texts and items never match; repeated documents and items each give their rows; other columns of
    either table are ignored. Scores do not depend on how documents are split over tasks.
    """
    spark, parts = docs.sparkSession, []
    for items in _blocks(benchmark, item_text, item_id):
        block = spark.sparkContext.broadcast(items)
        parts.append(staged(_leaks(docs, block, threshold, text, doc_id), "leaks"))
        block.destroy()
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start_byte long, end_byte long")
    return reduce(DataFrame.unionByName, parts)


def _leaks(docs: DataFrame, block, threshold: float, text: str, doc_id: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        items = block.value
        for batch in batches:
            found = aligned(items, batch.column(1), threshold)
            if found:
                row, item, score, start, end = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(score), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    ["doc_id", "item_id", "score", "start_byte", "end_byte"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), "doc_id long, item_id long, score double, start_byte long, end_byte long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a passage that reaches ``threshold``, with all their columns; no shuffle.

    With one block of items nothing is written; with more, what each block leaves is.
    """
    spark, block = docs.sparkSession, None
    for items in _blocks(benchmark, "text", "item_id"):
        if block is not None:
            docs = staged(_clean(docs, block, threshold, text), "without-leaks")
            block.destroy()
        block = spark.sparkContext.broadcast(items)
    return docs if block is None else _clean(docs, block, threshold, text)


def _clean(docs: DataFrame, block, threshold: float, text: str) -> DataFrame:
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in aligned(block.value, batch.column(place), threshold)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), T.StructType(docs.schema.fields))
