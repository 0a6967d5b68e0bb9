"""Token-id files: canonical length-limited Huffman coding of ids from global counts.

Format ``gridsift-ids 1``, a folder with two Parquet tables:

* ``codes``: id, n_bits. Codes are canonical: by (n_bits, id), each one more than the last, shifted to its length.
* ``blocks``: part, block, at (ids before the block in its part), n_docs, n_ids and ``data``, one self-contained block.

A block is a header of little-endian integers (magic, number of documents, of checkpoints, CRC-32 of what follows),
then per document its id, validity, id count and payload bytes, then the checkpoints (bit offsets in the document's
payload at every ``LANE`` ids), then the payloads, each starting at a whole byte. Parts, blocks in a part and
documents in a block are in ascending doc_id order (null first). Each block is decoded on its own, and all of its
lanes side by side, by one table of 2 ** longest code entries.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .pieces import PieceTable, binary
from .session import drop_stage, stage_path, trimmed

MAGIC = 0x31534449
#: Longest code; raised where the ids in use need more.
MAX_BITS = 18
LANE = 256
#: Ids in a block, at least; a block holds whole documents.
BLOCK_IDS = 1 << 19
#: Ids in a part, about, and parts at most.
PART_IDS, MAX_PARTS = 1 << 23, 10_000


class LibraryIds:
    """Ids of pieces of text by the tokenizers library, many new pieces in one call, and the table that keeps them."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.line_end = self.whole("\n")
        self.pieces = PieceTable(self._learn, self.whole, [t.content for t in self.library.get_added_tokens_decoder().values()])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], np.uint32)

    def _learn(self, pieces: list[str], last_alone: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with a word are joined by line ends, which no piece crosses and which are one id of their own; white space is looked up alone."""
        spaces = {k: [self.whole(p[:-1]), self.whole(p[-1])] if last_alone[k] else [self.whole(p)] for k, p in enumerate(pieces) if len(self.line_end) != 1 or p.isspace()}
        words = [k for k in range(len(pieces)) if k not in spaces]
        raw = self.whole("\n".join([pieces[k] for k in words] + [""])) if words else np.zeros(0, np.uint32)
        ends = np.flatnonzero(raw == self.line_end[0]) if words else np.zeros(0, np.int64)
        if len(ends) != len(words):
            raise ValueError("a line end is not an id of its own in this vocabulary")
        count = np.zeros(len(pieces), np.int64)
        count[words] = np.diff(ends, prepend=-1) - 1
        if not spaces:
            return np.delete(raw, ends), count
        own = np.split(np.delete(raw, ends), np.cumsum(count[words])[:-1])
        out = dict(zip(words, own, strict=True)) if words else {}
        for k, parts in spaces.items():
            out[k] = np.concatenate(parts)
            count[k] = len(out[k])
        return np.concatenate([out[k] for k in range(len(pieces))]), count


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryIds(path)


_CODED = "doc_id long, tie long, ids binary, counts binary"


def tokenize(df: DataFrame, vocabulary: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, tie and ids (binary, little-endian unsigned 32-bit) of every whole text with ``end_id`` after it.

    A null text is as an empty one: the end id alone. Repeated rows stay. tie orders rows of one doc_id: the ids'
    CRC-32, then a counter. Each task adds a row of null ids whose counts says how often each id occurs (64-bit, by id).
    """

    def run(batches: Iterator[pa.RecordBatch]):
        own, total, rows = library_ids(vocabulary), np.zeros(0, np.int64), 0
        for batch in batches:
            for a, b, x, off in own.pieces.encode(batch.column(1)):
                x, off = np.insert(x, off[1:], np.uint32(end_id)), off + np.arange(len(off))
                part = np.bincount(x)
                if len(part) > len(total):
                    total, part = part.astype(np.int64), total
                total[: len(part)] += part
                ids = binary(x, off)
                data = memoryview(ids.buffers()[2])
                tie = [zlib.crc32(data[4 * off[k] : 4 * off[k + 1]]) << 16 | (rows + k) & 0xFFFF for k in range(b - a)]
                rows += b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tie, pa.int64()), ids, pa.nulls(b - a, pa.binary())], ["doc_id", "tie", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], ["doc_id", "tie", "ids", "counts"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), _CODED)


def counts(coded: DataFrame) -> DataFrame:
    """id, n: how often each id occurs, from the tasks' counts; a task that reads many of them adds them up first."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                part = np.frombuffer(x.as_py(), np.int64)
                if len(part) > len(total):
                    total, part = part.copy(), total
                total[: len(part)] += part
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    return coded.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(n: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    size = len(n)
    if size <= 1:
        return np.ones(size, np.int64)
    limit = max(limit, int(size - 1).bit_length())
    order = np.argsort(n, kind="stable")
    leaf = np.asarray(n, np.float64)[order]
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        items = np.concatenate((leaf, packages))
        rank = np.argsort(items, kind="stable")
        levels.append(rank < size)
        items = items[rank]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
    bits, need = np.zeros(size, np.int64), 2 * size - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:need].sum())
        bits[:leaves] += 1
        need = 2 * (need - leaves)
    out = np.empty(size, np.int64)
    out[order] = bits
    return out


class Codes:
    """Canonical codes of ids, for packing and unpacking."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = np.asarray(ids, np.int64)[order], np.asarray(bits, np.int64)[order]
        self.top = int(self.bits[-1]) if len(ids) else 1
        full = np.left_shift(1, self.top - self.bits)
        self.codes = (np.cumsum(full) - full) >> (self.top - self.bits)

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max(initial=0)) + 1
        code, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.ids], bits[self.ids] = self.codes.astype(np.uint64), self.bits
        return code, bits

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """For the next ``top`` bits: the id, and the length of its code."""
        reps = np.left_shift(1, self.top - self.bits)
        pad = (1 << self.top) - int(reps.sum())
        return np.concatenate((np.repeat(self.ids, reps), np.zeros(pad, np.int64))).astype(np.uint32), np.concatenate((np.repeat(self.bits, reps), np.ones(pad, np.int64))).astype(np.int64)


def pack(ids: np.ndarray, sizes: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The payload bytes of documents of ``sizes`` ids, bytes of each document, and bit offsets of all lanes in their documents."""
    b = bits[ids]
    upto = np.concatenate(([0], np.cumsum(b)))
    first = np.concatenate(([0], np.cumsum(sizes)))
    doc_bits = upto[first[1:]] - upto[first[:-1]]
    doc_bytes = (doc_bits + 7) >> 3
    base = np.concatenate(([0], np.cumsum(doc_bytes)))[:-1]
    shift = base * 8 - upto[first[:-1]]
    at = upto[:-1] + np.repeat(shift, sizes)
    window = code[ids] << (np.uint64(40) - b.astype(np.uint64) - (at & 7).astype(np.uint64))
    total = int(doc_bytes.sum())
    out = np.zeros(total + 5)
    first_byte = at >> 3
    for k in range((int(bits.max(initial=0)) + 14) >> 3):
        part = ((window >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.float64)
        out[k:] += np.bincount(first_byte, part, len(out))[: len(out) - k]
    lanes = (sizes + LANE - 1) // LANE
    which = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    return out[:total].astype(np.uint8), doc_bytes, upto[np.repeat(first[:-1], lanes) + which * LANE] - np.repeat(upto[first[:-1]], lanes)


def unpack(payload: np.ndarray, doc_bytes: np.ndarray, sizes: np.ndarray, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray], top: int) -> np.ndarray:
    """All ids of a block's documents, by stepping through all lanes at once."""
    symbol, length = table
    wide = np.concatenate((payload, np.zeros(8, np.uint8))).astype(np.uint64)
    words = np.zeros(len(payload) + 3, np.uint64)
    for k in range(5):
        words |= wide[k : k + len(words)] << np.uint64(32 - 8 * k)
    lanes = (sizes + LANE - 1) // LANE
    base = np.cumsum(doc_bytes) - doc_bytes
    pos = np.repeat(base * 8, lanes) + checkpoints
    which = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    count = np.minimum(np.repeat(sizes, lanes) - which * LANE, LANE)
    to = np.repeat(np.cumsum(sizes) - sizes, lanes) + which * LANE
    order = np.argsort(-count, kind="stable")
    pos, count, to = pos[order], count[order], to[order]
    live = np.searchsorted(-count, -np.arange(1, LANE + 1), "right")
    out = np.empty(int(sizes.sum()), np.uint32)
    mask = np.uint64((1 << top) - 1)
    for step, n in enumerate(live):
        if not n:
            break
        p = pos[:n]
        code = (words[p >> 3] >> (np.uint64(40 - top) - (p & 7).astype(np.uint64))) & mask
        out[to[:n] + step] = symbol[code]
        p += length[code]
    return out


_DOC = "doc_id long, n_ids long, part int, tie long, payload binary, lanes binary"


def part_cuts(coded: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where parts begin in (doc_id, tie) order, null first: quantiles of doc_id, and of tie within a doc_id that fills several parts."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    found = Counter(coded.select(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10 * MAX_PARTS)).head()[0] or []) if parts > 1 else {}
    cuts = [(v, -1) for v in found]
    if hot := {v: n for v, n in found.items() if n > 1}:
        share = [k / max(hot.values()) for k in range(1, max(hot.values()))]
        rows = coded.withColumn("doc_id", key).where(F.col("doc_id").isin([*hot])).groupBy("doc_id").agg(F.percentile_approx("tie", share, 10 * MAX_PARTS).alias("q"))
        cuts += [(r.doc_id, q) for r in rows.collect() for q in r.q[:: max(hot.values()) // hot[r.doc_id]]]  # at most MAX_PARTS cuts
    cuts = sorted(set(cuts))
    return np.array([d for d, _ in cuts], np.int64), np.array([t for _, t in cuts], np.int64)


def _part(doc: np.ndarray, tie: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    lo, hi = np.searchsorted(cuts[0], doc, "left"), np.searchsorted(cuts[0], doc, "right")
    out = hi.copy()
    for k in np.flatnonzero(hi - lo > 1):
        out[k] = lo[k] + np.searchsorted(cuts[1][lo[k] : hi[k]], tie[k], "right")
    return out


def _encode_documents(coded: DataFrame, codes: tuple[np.ndarray, np.ndarray], cuts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        code, bits = Codes(*codes).encoder()
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                docs, tie, ids = whole.slice(i, 128).columns
                raw = ids.cast(pa.large_binary())
                off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                sizes = np.diff(off) >> 2
                out, doc_bytes, lanes = pack(np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].view("<u4"), sizes, code, bits)
                upto = lambda n, width: pa.py_buffer((np.concatenate(([0], np.cumsum(n))) * width).astype(np.int32).tobytes())
                binary_of = lambda n, width, data: pa.Array.from_buffers(pa.binary(), len(n), [None, upto(n, width), pa.py_buffer(data)])  # noqa: B023, E731
                part = _part(docs.fill_null(-(1 << 63)).to_numpy(), tie.to_numpy(), cuts)
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(sizes), pa.array(part, pa.int32()), tie, binary_of(doc_bytes, 1, out.tobytes()), binary_of((sizes + LANE - 1) // LANE, 8, lanes.astype("<i8").tobytes())],
                    ["doc_id", "n_ids", "part", "tie", "payload", "lanes"],
                )

    return coded.select("doc_id", "tie", "ids").mapInArrow(trimmed(run), _DOC)


def _block(docs: list[tuple]) -> bytes:
    ids = np.array([d[0] if d[0] is not None else 0 for d in docs], "<i8")
    valid = np.array([d[0] is not None for d in docs], np.uint8)
    body = b"".join((ids.tobytes(), valid.tobytes(), np.array([d[1] for d in docs], "<i8").tobytes(), np.array([len(d[2]) for d in docs], "<i8").tobytes(), *(d[3] for d in docs), *(d[2] for d in docs)))
    head = np.array([MAGIC, len(docs), sum(len(d[3]) >> 3 for d in docs), zlib.crc32(body)], "<u8")
    return head.tobytes() + body


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Rows in (part, doc_id) order to blocks."""
    held, part, block, at, size = [], None, 0, 0, 0

    def flush():
        n = sum(d[1] for d in held)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (block, pa.int64()), (at, pa.int64()), (len(held), pa.int64()), (n, pa.int64()), (_block(held), pa.binary()))], ["part", "block", "at", "n_docs", "n_ids", "data"])

    for batch in batches:
        for d, n, p, payload, lanes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "part", "payload", "lanes")), strict=True):
            if held and (p != part or size >= BLOCK_IDS):
                yield flush()
                block, at, held, size = (block + 1, at + size, [], 0) if p == part else (0, 0, [], 0)
            part = p
            held.append((d, n, payload, lanes))
            size += n
    if held:
        yield flush()


def write_ids(coded: DataFrame, path: str) -> None:
    """Write a staged table of tokenize()'s rows as token-id files at ``path`` (see the format above).

    Ids are counted over all rows. Parts are cut at quantiles of (doc_id, tie) and dealt out by part, so a part's
    share is bounded however many rows one doc_id has, and blocks in it are bounded whatever the number of rows.
    """
    spark = coded.sparkSession
    found = counts(coded).orderBy("id").collect()  # one row for each id of the vocabulary at most
    ids = np.array([r.id for r in found], np.int64)
    n = np.array([r.n for r in found], np.int64)
    bits = code_lengths(n)
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, bits, strict=True)], "id long, n_bits long").coalesce(1).write.mode("overwrite").parquet(f"{path}/codes")
    docs = coded.where(F.col("ids").isNotNull())
    cuts = part_cuts(docs, min(MAX_PARTS, max(1, -(-int(n.sum()) // PART_IDS))))
    rows = _encode_documents(docs, (ids, bits), cuts)
    rows = rows.repartitionById(len(cuts[0]) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    rows.mapInArrow(_blocks, "part int, block long, at long, n_docs long, n_ids long, data binary").write.mode("overwrite").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) of token-id files.

    A block with a wrong magic or CRC-32 fails the read. Starts come from the totals of parts, one row for each.
    """
    found = spark.read.schema("id long, n_bits long").parquet(f"{path}/codes").collect()  # the vocabulary at most
    codes = np.array([r.id for r in found], np.int64), np.array([r.n_bits for r in found], np.int64)
    blocks = spark.read.schema("part int, block long, at long, n_docs long, n_ids long, data binary").parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]):
        own = Codes(*codes)
        table = own.decoder()
        for batch in batches:
            for part, at, data in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "data")), strict=True):
                magic, docs, lanes, crc = np.frombuffer(data, "<u8", 4).tolist()
                if magic != MAGIC or zlib.crc32(memoryview(data)[32:]) != crc:
                    raise ValueError("a block of token ids is damaged")
                o = 32
                doc = np.frombuffer(data, "<i8", docs, o)
                valid = np.frombuffer(data, np.uint8, docs, o := o + 8 * docs)
                sizes = np.frombuffer(data, "<i8", docs, o := o + docs)
                doc_bytes = np.frombuffer(data, "<i8", docs, o := o + 8 * docs)
                checks = np.frombuffer(data, "<i8", lanes, o := o + 8 * docs)
                ids = unpack(np.frombuffer(data, np.uint8, -1, o + 8 * lanes), doc_bytes, sizes, checks, table, own.top)
                first = np.concatenate(([0], np.cumsum(sizes)))
                raw = ids.astype("<u4").tobytes()
                for k in range(0, docs, 128):
                    m = slice(k, min(k + 128, docs))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(doc[m]), part), pa.int32()), pa.array(doc[m], pa.int64(), mask=valid[m] == 0), pa.array(at + first[:-1][m]), pa.array(sizes[m]), pa.array([raw[4 * first[j] : 4 * first[j + 1]] for j in range(m.start, m.stop)], pa.binary())],
                        ["part", "doc_id", "at", "n_tokens", "ids"],
                    )

    rows = blocks.select("part", "at", "data").mapInArrow(trimmed(run), "part int, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def round_trip(df: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> DataFrame:
    """Tokenize whole texts, write them as token-id files at ``path`` (or a new shared folder) and read them back."""
    spark = df.sparkSession
    stage = stage_path(spark, "ids")
    tokenize(df, vocabulary, end_id).write.option("compression", "zstd").parquet(stage)
    path = path or stage_path(spark, "token-files")
    write_ids(spark.read.schema(_CODED).parquet(stage), path)
    drop_stage(spark, stage)
    return read_ids(spark, path)
