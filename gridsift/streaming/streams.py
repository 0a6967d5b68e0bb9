"""Streams with keyed state: anomaly scores of images that arrive in pieces, and the folded state of an annotation log.

State is kept by key in Spark's state store, whose changes alone are written with each batch; a batch's cost follows its
own rows. A stream that is stopped or killed goes on from its checkpoint.
"""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import blocks
from ..operators.knn import bank_parts

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Settings that a stream takes over when it starts; then as before."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _start(rows: DataFrame, mode: str, path: str, checkpoint: str, every: str | None) -> StreamingQuery:
    """Write each batch's rows into a folder of its number, so that a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    with _state_store(rows.sparkSession):
        return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class _ImageScore(StatefulProcessor):
    """Counts an image's patches and keeps as many of its greatest scores as its final mean takes; each patch knows how many are expected."""

    def __init__(self, share: float, wait: int | None):
        self.share, self.wait = share, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, top array<double>, timer long")

    def _row(self, key: tuple, n: int, top: list[float], complete: bool) -> Row:
        k = max(1, int(n * self.share))
        return Row(image_id=key[0], image_score=float(np.mean(sorted(top, reverse=True)[:k])), patches=n, complete=complete)


    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, top, timer = self.seen.get() or (0, [], None)
        top, latest, expected = list(top), None, 0
        heapq.heapify(top)
        for r in rows:
            n, expected = n + 1, r.expected
            (heapq.heappush if len(top) < max(1, int(expected * self.share)) else heapq.heappushpop)(top, r.score)
            latest = r.at if latest is None or (r.at is not None and r.at > latest) else latest
        if n >= expected:
            self.seen.clear()
            if timer is not None:
                self.handle.deleteTimer(timer)
            yield self._row(key, n, top, True)
            return
        if self.wait is not None and latest is not None and latest + self.wait > (timer or 0):
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = latest + self.wait
            self.handle.registerTimer(timer)
        self.seen.update((n, top, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = self.seen.get()
        if found:
            yield self._row(key, found[0], list(found[1]), False)
        self.seen.clear()

    def close(self) -> None:
        pass


def stream_anomaly_scores(
    patches: DataFrame, bank: DataFrame, k: int, path: str, checkpoint: str, expected: int | str, share: float = 0.01, every: str | None = None, time: str | None = None, wait_seconds: int | None = None, delay: str = "10 minutes"
) -> StreamingQuery:
    """Append image_id, image_score, patches, complete to Parquet at ``path`` once ``expected`` patches of an image have come, in any batches.

    ``patches`` has image_id and embedding. ``expected`` is a number, or the name of a column with each image's own number
    of patches, for images whose grids differ or lack cells. A patch's score is the mean of its k least cosine distances to the bank, an
    image's the mean of its largest share of them. With ``time`` (an event time) and ``wait_seconds``, an image that is
    still incomplete when the watermark (behind by ``delay``) is so much past its latest patch is written with what has
    come, as not complete; otherwise it waits. A patch that comes after its image was written counts for a new one. The
    bank is taken once, when the stream starts: one of up to 64 MB is broadcast, of a larger one each task reads a part at a
    time (see knn.bank_parts()). A batch's patches are dealt out evenly before they meet it, whatever files they came in.
    The stream ends with what is there now, or with ``every`` (such as '1 minute') runs on.
    """
    size, parts = bank_parts(bank)
    if size < k:
        raise ValueError("k is more than the bank's rows")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = blocks.greatest(blocks.unit_rows(blocks.matrix(batch.column(2))), parts(), k)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.clip(1 - value, 0, 2).mean(1))], ["image_id", "at", "expected", "score"])

    timed = time is not None and wait_seconds is not None
    at = F.unix_millis(F.col(time).cast("timestamp")) if timed else F.lit(None).cast("long")
    number = (F.col(expected) if isinstance(expected, str) else F.lit(expected)).cast("long")
    rows = patches.where("embedding IS NOT NULL").select(F.col("image_id").cast("string").alias("image_id"), at.alias("at"), F.col("embedding").cast("array<double>").alias("v"), number.alias("expected"))
    scored = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(score, "image_id string, at long, expected long, score double")
    if timed:
        scored = scored.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", delay)
    processor = _ImageScore(share, 1000 * wait_seconds if timed else None)
    out = scored.groupBy("image_id").transformWithState(processor, "image_id string, image_score double, patches long, complete boolean", "Append", "EventTime" if timed else "None")
    return _start(out, "append", path, checkpoint, every)


def _place(row, order: list[str]) -> tuple:
    return tuple((row[c] is not None, row[c]) if row[c] is not None else (False, 0) for c in order)


class _Fold(StatefulProcessor):
    """Keeps each key's last operation: its row, or of a delete the place in the order, for as long as late ones may come."""

    def __init__(self, keys: list[str], rest: T.StructType, order: list[str], op: str, keep: int | None):
        self.keys, self.rest, self.order, self.op, self.keep = keys, rest, order, op, keep

    def init(self, handle) -> None:
        self.handle = handle
        gone = [f for f in self.rest.fields if f.name in self.order]
        self.at = [f.name for f in gone]
        self.last = handle.getValueState("last", self.rest)
        self.gone = handle.getValueState("gone", T.StructType([*gone, T.StructField("_until", T.LongType())]))

    def _newest(self) -> tuple | None:
        for state, names in ((self.last, self.rest.fieldNames()), (self.gone, [*self.at, "_until"])):
            if state.exists():
                return _place(dict(zip(names, state.get(), strict=True)), self.order)
        return None

    def _put(self, row) -> None:
        if row[self.op] != "delete":
            self.gone.clear()
            self.last.update(tuple(row[c] for c in self.rest.fieldNames()))
            return
        until = row["_at"] + self.keep if self.keep is not None and row["_at"] is not None else None
        self.last.clear()
        self.gone.update((*(row[c] for c in self.at), until))
        if until is not None:
            self.handle.registerTimer(until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: _place(r, self.order))
        newest = self._newest()
        if newest is None or _place(best, self.order) >= newest:
            self._put(best)
            yield Row(**dict(zip(self.keys, key, strict=True)), **{c: best[c] for c in self.rest.fieldNames()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.gone.exists() and (self.gone.get()[-1] or 0) <= expiredTimerInfo.getExpiryTimeInMs():
            self.gone.clear()
        return iter([])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._put(initialState)

    def close(self) -> None:
        pass


def _folded(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The fold as a streaming aggregate, which keeps each key's last operation, deletes too: the keys whose last one came in this batch."""
    now = F.current_timestamp()  # one for all of a batch
    last = F.max_by(F.struct(*[c for c in log.columns if c not in keys], "_came"), F.struct(*order))
    rows = log.withColumn("_came", now).groupBy(*keys).agg(last.alias("_last")).where(F.col("_last._came") == now)
    return rows.select(*keys, "_last.*").drop("_came")


def stream_annotations(
    log: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, every: str | None = None, op: str = "op", time: str | None = None, keep_seconds: int = 0, delay: str = "10 minutes", initial: DataFrame | None = None
) -> StreamingQuery:
    """Fold an upsert/delete log by key in the state store, and append each batch's changed keys to Parquet at ``path``.

    Late or repeated operations lose by ``order`` (nulls first; of equal ones the later to come wins). A deleted key leaves
    its place in the order behind. Without ``time`` and ``initial`` the fold is an aggregate, without Python in a key's way
    (checkpoints of other versions are not gone on with); these need a processor of their own. With ``time`` (an event time), operations older than the watermark (behind by ``delay``)
    are dropped, and so is the place of a delete ``keep_seconds`` after the watermark has passed it; without, it stays.
    ``initial``, a table with the log's columns and at most one row a key, is where a new stream begins.
    read_annotations_state() reads the state. ``every`` is as in stream_anomaly_scores().
    """
    if time is None and initial is None:
        return _start(_folded(log, keys, order), "update", path, checkpoint, every)
    rest = T.StructType([f for f in log.schema.fields if f.name not in keys])
    out = T.StructType([*(log.schema[k] for k in keys), *rest.fields])
    at = (F.unix_millis(F.col(time).cast("timestamp")) if time else F.lit(None).cast("long")).alias("_at")
    start = None if initial is None else initial.select(*out.fieldNames(), at).groupBy(*keys)
    rows = (log.withWatermark(time, delay) if time else log).select(*out.fieldNames(), at)
    rows = rows.groupBy(*keys).transformWithState(_Fold(keys, rest, order, op, 1000 * keep_seconds if time else None), out, "Update", "EventTime" if time else "None", start)
    return _start(rows, "update", path, checkpoint, every)


def read_annotations_state(spark: SparkSession, checkpoint: str, op: str = "op") -> DataFrame:
    """The folded state of a stream_annotations() checkpoint after its last whole batch, without deleted keys."""
    with _state_store(spark):
        if spark.read.format("state-metadata").load(checkpoint).head().operatorName == "stateStoreSave":
            state = spark.read.format("statestore").option("path", checkpoint).load()
            last = next(f.name for f in state.schema["value"].dataType if "_came" in f.dataType.fieldNames())
            rows = state.select("key.*", F.col("value")[last].alias("_last")).select("*", "_last.*").drop("_last", "_came")
            return rows.where(~F.col(op).eqNullSafe("delete"))
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load().select("key.*", "value.*")


def dedup_events(log: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Repeated operations of a stream dropped within a watermark."""
    return log.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
