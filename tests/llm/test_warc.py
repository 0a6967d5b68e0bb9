import pytest

from gridsift.llm import warc
from gridsift.llm.session import stage_path


def test_framing():
    for n in (0, 1, warc.CHUNK_BYTES, warc.CHUNK_BYTES + 1, 100_000):
        assert warc.unchunked(warc.chunked(b"x" * n)) == b"x" * n
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nabcd", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_hostile_payload_and_lost_segments():
    payload = b"WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: x\r\n\r\n" * 900
    records = warc.records_of("urn:a", "http://a b/\r\n", payload, None, 1000)
    parsed = list(warc.parse(b"".join(r + b"\r\n\r\n" for r in records)))
    assert len(parsed) == len(records) > 20
    assert warc.http_payload(b"".join(b for _, b in parsed))[1] == payload


def test_round_trip(spark):
    big = "é" * 30000
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", big), (5, "http://d/", big), (6, "u", big), (None, None, "alone"), (7, "http://e/", "7")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    path = stage_path(spark, "warc-test")
    warc.write_warc(df, path, segment_bytes=5000)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows) and all(r.valid for r in got)
    page = lambda s: s.split(":")[2]
    kinds = sorted((page(r.record_id), r.record_type, r.refers_to and page(r.refers_to), r.payload_bytes) for r in got)
    assert kinds == sorted([("1", "revisit", "2", 4), ("2", "response", None, 4), ("3", "revisit", "4", 0), ("4", "response", None, 0), ("5", "revisit", "6", 60000), ("5", "revisit", "6", 60000), ("6", "response", None, 60000), ("", "response", None, 5), ("7", "response", None, 1)])
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {"same", "", big, "alone", "7"}
    warc.write_warc(df, path, min_bytes=5)
    assert sum(r.record_type == "revisit" for r in warc.read_warc(spark, path).collect()) == 2


def test_many_repeats_of_a_long_page_and_batch_size(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(1, "http://a/", "z" * 9000)] * 60 + [(2, "http://b/", "y" * 9000)], "page_id long, url string, html string").repartition(4)
    path = stage_path(spark, "warc-repeats")
    warc.write_warc(df, path, segment_bytes=2000)
    got = warc.read_warc(spark, path)
    assert {(r.record_id.split(":")[2], r.valid, r.payload_bytes, r["count"]) for r in got.groupBy("record_id", "valid", "payload_bytes").count().collect()} == {("1", True, 9000, 60), ("2", True, 9000, 1)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_missing_segment_is_flagged(spark):
    records = warc.records_of("urn:gridsift:1:0", "http://a/", b"y" * 9000, None, 2000)
    path = stage_path(spark, "warc-broken")
    keep = [r for i, r in enumerate(records) if i != 2]
    spark.createDataFrame([(r.decode(),) for r in keep], "value string").write.option("lineSep", "\r\n\r\n").text(path)
    row = warc.read_warc(spark, path).collect()[0]
    assert not row.valid


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = stage_path(spark, "warc-empty")
    warc.write_warc(df, path)
    assert warc.read_warc(spark, path).count() == 0
