"""WARC archives: pages out as response, revisit and continuation records, and back by segment reassembly.

Archives are written by Spark's text writer (a record ends as a line does: with CR LF CR LF), gzipped, so that a
lost executor's files are never committed. A block longer than ``SEGMENT_BYTES`` is cut into a first record and
continuation records, which may lie in any archive. An archive holds at most ``ARCHIVE_RECORDS`` records and so
at most about ARCHIVE_RECORDS * SEGMENT_BYTES, which bounds what a reading task holds at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import batches_of, staged

SEGMENT_BYTES = 16384
CHUNK_BYTES = 8192
ARCHIVE_RECORDS = 2000
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%X\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size expected")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk end expected")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, block: bytes, **headers) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + _END + block


def records_of(record_id: str, url: str | None, payload: bytes, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page, without their ends."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{sha1_base32(payload)}"}
    if refers_to:
        head = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [_record("revisit", record_id, head, **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{refers_to}>", Content_Type="application/http; msgtype=response")]
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record("response", record_id, block, **common, Content_Type="application/http; msgtype=response")]
    cuts = range(0, len(block), segment_bytes)
    out = [_record("response", record_id, block[:segment_bytes], **common, Content_Type="application/http; msgtype=response", WARC_Segment_Number=1)]
    for k, i in enumerate(cuts[1:], 2):
        total = len(block) if k == len(cuts) else None
        out.append(_record("continuation", f"{record_id}:{k}", block[i : i + segment_bytes], WARC_Target_URI=uri, WARC_Segment_Origin_ID=f"<{record_id}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total))
    return out


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """urn:gridsift:<page id>:<hash of the row>; rows that agree in all three share it."""
    return F.concat(F.lit("urn:gridsift:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex(F.xxhash64(page_id, url, digest))))


def write_warc(pages: DataFrame, path: str, payload: str = "html", url: str = "url", page_id: str = "page_id", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for each row of ``pages`` at ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the largest page id (then record id) is a
    response and others revisit it; shorter ones are all responses. A null payload is an empty one. Rows that agree
    in id, URL and payload share one record id. Groups of copies are found by partial maxima of digests, and joined
    without their payloads, so Spark can split a hot digest; revisits then meet the payloads by their own ids.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    digest = F.sha1(body)
    rid = record_id(F.col(page_id), F.col(url), digest)
    rows = pages.select(F.col(page_id).alias("page"), rid.alias("rid"), digest.alias("digest"), F.octet_length(body).alias("n"))
    keys = staged(rows.where(F.col("n") >= min_bytes).drop("n"), "warc-keys")
    last = keys.groupBy("digest").agg(F.max(F.struct("page", "rid")).alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("last.rid").alias("refers_to"))
    revisits = staged(keys.join(last, "digest").where("rid <> refers_to").select("rid", "refers_to").distinct(), "warc-revisits")
    whole = pages.select(rid.alias("rid"), F.col(url).alias("url"), body.alias("body")).join(revisits, "rid", "left")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("rid", "url", "body", "refers_to")]
            out = [r for row in zip(*cols, strict=True) for r in records_of(*row, segment_bytes)]
            for i in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 512], pa.binary())], ["record"])

    records = whole.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, by the records' own lengths."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            d = zlib.decompressobj(31)
            plain.append(d.decompress(data))
            data = d.unused_data
        data = b"".join(plain)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(_END, at)
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(headers["content-length"])
        if start + size > len(data):
            raise ValueError("a record is cut off")
        yield headers, data[start : start + size]
        at = start + size + 4


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and decoded payload of a recorded HTTP response."""
    head, _, body = block.partition(_END)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return headers, unchunked(body) if "chunked" in headers.get("transfer-encoding", "").lower() else body


_OUT = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, valid boolean"
_bare = lambda s: s.strip("<>") if s else None


def _row(headers: dict[str, str], block: bytes, total: int | None = None) -> tuple:
    """A row of _OUT; valid is false if the total length, the framing or the digest is wrong."""
    kind, said = headers["warc-type"], (headers.get("warc-payload-digest") or "").removeprefix("sha1:")
    fixed = (_bare(headers["warc-record-id"]), kind, headers.get("warc-target-uri"), _bare(headers.get("warc-refers-to")))
    try:
        http, payload = http_payload(block)
        if kind == "revisit":
            return (*fixed, said, int(http["content-length"]), None, True)
        digest = sha1_base32(payload)
        return (*fixed, digest, len(payload), payload, (total is None or total == len(block)) and said in ("", digest))
    except (ValueError, KeyError):
        return (*fixed, said, None, None, False)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_PIECE = "origin string, k int, total long, headers map<string,string>, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]):
    """Archives to rows of _OUT for whole records, and of _PIECE for segments; the other columns are null."""
    names = [x.split()[0] for x in (*_OUT.split(", "), *_PIECE.split(", "))]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def rows_of(whole: list, pieces: list) -> Iterator[pa.RecordBatch]:
        if whole:
            yield pa.RecordBatch.from_arrays([*_table(whole).columns, *(pa.nulls(len(whole), t) for t in kinds)], names)
        if pieces:
            blank = _table([(None,) * 8]).columns
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(pieces), c.type) for c in blank), *(pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), kinds, strict=True))], names)

    for batch in batches:
        for data in batch.column(0):
            whole, pieces = [], []
            for h, block in parse(data.as_py()):
                if h["warc-type"] not in ("response", "revisit", "continuation"):
                    continue
                if "warc-segment-number" not in h:
                    whole.append(_row(h, block))
                else:
                    first = h["warc-type"] != "continuation"
                    origin = h["warc-record-id"] if first else h["warc-segment-origin-id"]
                    total = h.get("warc-segment-total-length")
                    pieces.append((origin, int(h["warc-segment-number"]), int(total) if total else None, [*h.items()] if first else None, block))
                if len(whole) + len(pieces) >= 256:
                    yield from rows_of(whole, pieces)
                    whole, pieces = [], []
            yield from rows_of(whole, pieces)


def _joined(batches: Iterator[pa.RecordBatch]):
    """The segments of each origin (each once, with how often its first one came) to its record, as often."""
    for batch in batches:
        for parts in batch.column(0):
            parts = sorted(parts.as_py(), key=lambda p: p["k"])
            first = [p for p in parts if p["k"] == 1 and p["headers"]]
            totals = {p["total"] for p in parts if p["total"] is not None}
            complete = [p["k"] for p in parts] == list(range(1, len(parts) + 1)) and len(totals) == 1
            block = b"".join(p["block"] for p in parts)
            for p in first:
                row = _row(dict(p["headers"]), block, next(iter(totals)) if complete else -1)
                for _ in range(p["n"]):
                    yield _table([row])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit in the archives at ``path``, with its decoded payload.

    Archives are parsed once, into a staged table. Unsegmented records are decoded where they are read. Segments are
    grouped by origin, ordered by number, joined, held against the total length and decoded. Missing, surplus or
    damaged segments give valid = false; a revisit has no payload of its own (null), but its digest and length. Copies
    of a record with one id each give a row; their equal segments are counted by task before they are grouped, so many
    copies of a page are no large group. Other record types are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    with batches_of(spark, 2):  # a row is an archive
        parsed = staged(files.mapInArrow(_parsed, f"{_OUT}, {_PIECE}"), "warc-records")
    names = [x.split()[0] for x in _OUT.split(", ")]
    c = F.col
    # headers are a function of the segment's record id, number and block, but maps are no grouping keys
    segments = parsed.where("origin IS NOT NULL").groupBy("origin", "k", "total", c("headers").isNull().alias("later"), F.sha1("block").alias("digest"))
    segments = segments.agg(F.count("*").alias("n"), F.first("headers").alias("headers"), F.first("block").alias("block"))
    groups = segments.groupBy("origin").agg(F.collect_list(F.struct("k", "total", "headers", "block", "n")).alias("parts")).select("parts")
    return parsed.where("record_type IS NOT NULL").select(*names).unionByName(groups.mapInArrow(_joined, _OUT))
