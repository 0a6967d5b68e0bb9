"""Spelling variants: words one edit apart by a variable-length gram index, and the common form that each belongs to.

1. Words are counted per task, then over all tasks.
2. A gram starts at every code point of a word and grows from two code points on while it is frequent, up to ``LONGEST``
   or the word's end mark. The dictionary of frequent grams is bounded by its threshold, so every task holds it.
3. A gram is decided by its own code points alone; one edit therefore changes only the grams that cover its place. The
   most grams over one place is the word's bound of affected grams. Of two words one edit apart, the first gram in a
   fixed order (rare ones first) that the edit leaves alone is among the first bound + 1 of either word.
4. The lists of these few grams are merged: with that gram in line, what lies left of it or what lies right of it is equal
   in both words, so words meet in lists of (gram, equal side). The other side must differ by one edit, told by deleting
   each code point, and whole words are verified. Lists of very many words are split by those deletions first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import batches_of, staged, trimmed

SHORTEST, LONGEST = 2, 5
#: Fewer grams of one length than this are frequent, however large the data.
FREQUENT = 20_000
#: A list of more words than this is split by deletions.
LIST = 4096
#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Code points of a text that are searched at once.
PIECE = 1 << 20
#: Longer parts of words have their deletions told by hashes.
SHORT = 64
_END = "\n"
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, damage: int | None = None) -> DataFrame:
    """word, n: the runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all texts (null: none) with A-Z lower-cased.

    Only words of at least ``shortest`` code points that occur ``least`` times are returned. With ``damage``, a run loses
    one code point where the CRC-32 of '<doc_id>:<run>' (a null doc_id: nothing) is a multiple of it.
    """
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % shortest)

    def pieces(text: str) -> Iterator[list[str]]:
        a = 0
        while a < len(text):
            b = a + PIECE
            if b < len(text):
                found = _OTHER.search(text, b)
                b = found.start() if found else len(text)
            yield runs.findall(text, a, b)
            a = b

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for found in pieces(text.as_py() or ""):
                    for run, k in Counter(found).items():
                        word = run.encode().lower()  # of bytes: A-Z only
                        if damage:
                            h = zlib.crc32(word, start)
                            if h % damage == 0:
                                at = h % len(run)
                                word = word.decode()
                                word = (word[:at] + word[at + 1 :]).encode()
                        total[word] += k
                if len(total) >= HELD:
                    yield rows(total)
                    total = Counter()
        if total:
            yield rows(total)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(count), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.char_length("word") >= shortest))


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The grams of ``SHORTEST`` to ``LONGEST`` code points that occur in more than 1 of ``FREQUENT`` places, with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column(0):
                t = word.as_py() + _END
                for a in range(0, len(t), PIECE):
                    for q in range(SHORTEST, LONGEST + 1):
                        total.update([t[p : p + q] for p in range(a, min(a + PIECE, len(t) - q + 1))])
                    if len(total) >= HELD:
                        yield rows(total)
                        total = Counter()
        yield rows(total)

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(total.values(), pa.int64())], ["gram", "n"])

    places = words.agg(F.sum(F.char_length("word"))).head()[0] or 0
    found = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in found.where(F.col("n") > max(1, places // FREQUENT)).collect()}  # bounded by the threshold


def grams(word: str, frequent: dict[str, int]) -> tuple[list[int], int]:
    """The end of the gram that starts at each code point of ``word``, and the most of them that one edit can affect."""
    t, n = word + _END, len(word)
    ends = []
    for p in range(n):
        e = p + SHORTEST
        while e - p < LONGEST and e <= n and t[p:e] in frequent:
            e += 1
        ends.append(e)
    affected = max(sum(e > i for e in ends[max(0, i - LONGEST + 1) : i + 1]) for i in range(n))
    return ends, affected


def signature(word: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """Start and end of the grams by whose lists a word one edit away is found: one more than an edit can affect, rare ones first."""
    ends, affected = grams(word, frequent)
    t = word + _END
    order = sorted((frequent.get(g, 0), g, p) for p, g in enumerate(t[p:e] for p, e in enumerate(ends)))
    return [(p, ends[p]) for _, _, p in order[: affected + 1]]


def _lists(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """key, side, cut, word, n: each word in the lists of its signature's grams, once with all left of it and once with all right."""
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys, sides, cuts, at = [], [], [], []
                for k, word in enumerate(part.column(0).to_pylist()):
                    for p, e in signature(word, shared.value):
                        keys += [xxhash.xxh3_64_intdigest(f"{e - p}<{word[:e]}{_END * (e > len(word))}"), xxhash.xxh3_64_intdigest(f"{e - p}>{word[p:]}")]
                        sides += [True, False]
                        cuts += [min(e, len(word)), p]
                        at += [k, k]
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sides, pa.bool_()), pa.array(cuts, pa.int32()), part.column(0).take(take), part.column(1).take(take)], ["key", "side", "cut", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, side boolean, cut int, word string, n long")


_B = np.uint64(0x9E3779B97F4A7C15)


def _deletion_hashes(rest: str) -> np.ndarray:
    """A hash of ``rest``, then one of what is left of it without each of its code points."""
    c = np.frombuffer(rest.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(c)
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, _B))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(c * power[:n])))
    later = np.concatenate(([np.uint64(0)], np.cumsum(np.where(np.arange(n) > 0, c * power[np.maximum(np.arange(n) - 1, 0)], np.uint64(0)))))
    without = sums[:n] + later[n] - later[1:] if n else sums[:0]
    return np.concatenate(([sums[n]], without))


def _deletions(rest: str, short: bool) -> list:
    if short:
        return [rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))]
    return _deletion_hashes(rest).tolist()


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    if len(a) > SHORT and a[: len(a) // 2] == b[: len(a) // 2]:
        i = len(a) // 2
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _near(words: list[str], sides: list[bool], cuts: list[int]) -> Iterator[tuple[int, int]]:
    """The pairs of one list that are one edit apart."""
    n = len(words)
    if n <= 6:
        pairs = ((i, j) for i in range(n) for j in range(i))
    else:
        rests = [w[c:] if s else w[:c] for w, s, c in zip(words, sides, cuts, strict=True)]
        short, found = max(map(len, rests)) <= SHORT, {}
        for i, r in enumerate(rests):
            for v in set(_deletions(r, short)):
                found.setdefault(v, []).append(i)
        pairs = {(i, j) for at in found.values() for k, i in enumerate(at) for j in at[:k]}
    for i, j in pairs:
        if one_edit(words[i], words[j]):
            yield i, j


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near, n_of: pairs one edit apart, both ways, of lists whose rows follow each other."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        keys = rows.column("key").to_numpy()
        cut = np.flatnonzero(np.diff(keys)) + 1
        last = int(cut[-1]) if len(cut) else 0
        yield from _pairs(rows.slice(0, last), cut[:-1] if len(cut) else cut)
        held = rows.slice(last)
    if held is not None:
        yield from _pairs(held, np.zeros(0, np.int64))


def _pairs(rows: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
    bounds = np.concatenate(([0], cut, [rows.num_rows])).astype(np.int64)
    several = np.flatnonzero(np.diff(bounds) > 1)
    if not len(several):
        return
    sides, cuts, counts = (rows.column(c).to_numpy() for c in ("side", "cut", "n"))
    a, b = [], []
    column = rows.column("word")
    for k in several:
        s, e = int(bounds[k]), int(bounds[k + 1])
        for i, j in _near(column.slice(s, e - s).to_pylist(), sides[s:e], cuts[s:e]):
            a += [s + i, s + j]
            b += [s + j, s + i]
    if a:
        yield pa.RecordBatch.from_arrays([column.take(pa.array(a)).combine_chunks(), column.take(pa.array(b)).combine_chunks(), pa.array(counts[b])], ["word", "near", "n_of"])


def _split(lists: DataFrame) -> DataFrame:
    """Rows of long lists once for each deletion in what may differ, with keys of their own."""
    names = lists.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                key, at = [], []
                for k, (own, side, cut, word) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)), strict=True)):
                    found = np.unique(_deletion_hashes(word[cut:] if side else word[:cut]) * _B + np.uint64(own % (1 << 64)))
                    key.append(found.view(np.int64))
                    at.append(np.full(len(found), k, np.int32))
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), *(part.column(c).take(take) for c in range(1, 5))], names)

    return lists.mapInArrow(run, lists.schema)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, n_of: every ordered pair of different ``words`` (word, n; staged) that one edit parts, at least once; n_of is the near word's n."""
    lists = staged(_lists(words, frequent_grams(words)), "gram-lists")
    long = lists.groupBy("key").count().where(F.col("count") > LIST).select("key")
    long = staged(long, "long-lists")
    if long.head(1):
        # fewer than the lists' rows / LIST keys
        lists = lists.join(F.broadcast(long), "key", "left_anti").unionByName(_split(lists.join(F.broadcast(long), "key", "left_semi").select(*lists.columns)))
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(trimmed(_merged, False), "word string, near string, n_of long")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n).

    near words are one edit apart; the form is the near word of largest n (ties: first in code-point order) if that is at
    least ``times`` the word's, else null; the root is where forms lead to, or the word. An empty table gives no rows.
    """
    words = staged(words.select("word", "n"), "words")
    most = words.agg(F.max("n")).head()[0] or 0
    near = near_words(words).groupBy("word").agg(F.collect_set(F.struct((-F.col("n_of")).alias("less"), "near")).alias("near"))  # bounded by a word's length and the letters
    near = near.select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    found = staged(found, "forms")
    links, reach = staged(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots"), 1
    while times**reach <= most:  # a chain of so many forms needs so frequent a word; each round doubles what is followed
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links, reach = staged(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots"), 2 * reach
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, damage: int | None = None) -> DataFrame:
    """variants() of the word_counts() of documents (doc_id, text; other columns are not read)."""
    with batches_of(docs.sparkSession, 512):
        counted = staged(word_counts(docs, shortest, least, damage), "word-counts")
    return variants(counted, times)
