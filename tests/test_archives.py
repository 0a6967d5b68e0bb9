"""The file sink's commit and abort, and the mask archives' reader."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridsift.sources import archives, files


def below(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("set/f"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    bad = rows.withColumn("name", F.when(F.col("name") == "set/f33", F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(Exception):
        archives.write_files(bad, folder)
    assert below(folder) == []
    archives.write_files(rows, folder)
    assert sorted(p.split("/", 1)[1] for p in below(folder)) == sorted(f"set/f{i}" for i in range(40))
    with pytest.raises(Exception):
        archives.write_files(bad, folder, overwrite=True)
    assert len(below(folder)) == 40
    archives.write_files(rows.limit(3), folder, overwrite=True)
    assert len(below(folder)) == 3
    archives.write_files(rows.limit(0), folder)
    assert len(below(folder)) == 3
    with pytest.raises(Exception):
        archives.write_files(rows.limit(1).withColumn("name", F.lit("../x")), folder)
    assert not (tmp_path / "x").exists()


def test_a_task_that_outlives_its_job_leaves_no_file(tmp_path):
    row = lambda i: Row(name=f"set/{i % 2}/f{i}", content=b"x")
    writer = archives.FileSink({"path": str(tmp_path / "out")}).writer(None, False)

    def late():
        yield row(1)
        writer.abort([])
        yield from (row(i) for i in range(2, 5))

    for rows in (late(), iter([row(5)])):
        with pytest.raises(OSError):
            writer.write(rows)
        assert list((tmp_path / "out").iterdir()) == []
    writer = archives.FileSink({"path": str(tmp_path / "out")}).writer(None, False)
    writer.commit([writer.write(iter([row(1), row(2), row(3)])), writer.write(iter([]))])
    assert [p.split("/", 1)[1] for p in below(tmp_path / "out")] == ["set/0/f2", "set/1/f1", "set/1/f3"]


def test_names_come_back(spark, tmp_path):
    ids = ["a/b", "..", "x.npz", "a%2Fb", "é ü"]
    cells = spark.createDataFrame([(i, m, m, 1) for i in ids for m in (0, 1)], "image_id string, mask_id int, row int, col int")
    assert files.write_masks(cells, str(tmp_path / "m"), 3, 4) == 5
    assert all("/" not in archives.escaped(i) and archives.unescaped(archives.escaped(i)) == i for i in ids)
    got = files.read_proposals(spark, str(tmp_path / "m"))
    assert sorted({r.image_id for r in got.collect()}) == sorted(ids) and got.columns == ["image_id", "mask_id", "bbox", "height", "width", "rle"]
    assert {tuple(r.rle) for r in got.where("mask_id = 1").collect()} == {(5, 1, 6)}


def test_boxes_are_read_without_pixels(spark, tmp_path):
    out = io.BytesIO()
    np.savez(out, bboxes=np.array([[1, 2, 3, 4], [-1] * 4]), has_bbox=np.array([True, False]))  # no segmentations at all
    (tmp_path / "a.npz").write_bytes(out.getvalue())
    out = io.BytesIO()
    np.savez(out, bboxes=np.zeros((0, 4), int), has_bbox=np.zeros(0, bool))
    (tmp_path / "none.npz").write_bytes(out.getvalue())
    got = files.read_proposals(spark, str(tmp_path), ["bbox", "mask_id"]).orderBy("mask_id").collect()
    assert [(r.bbox, r.mask_id) for r in got] == [([1, 2, 3, 4], 0), (None, 1)]
    with pytest.raises(Exception):
        files.read_proposals(spark, str(tmp_path)).collect()
    assert files.read_proposals(spark, str(tmp_path / "absent"), ["mask_id"]).count() == 0


def test_union_axis(spark, tmp_path):
    m = np.random.default_rng(1).random((6, 4, 5)) < 0.2
    np.savez(tmp_path / "a_mask_good.npz", segmaps=m)
    assert files.read_union_masks(spark, str(tmp_path), axis=0).head().height == 4
    assert files.read_union_masks(spark, str(tmp_path)).head().height == 6  # the last axis is shorter
    np.savez(tmp_path / "a_mask_good.npz", segmaps=m[:5])
    with pytest.raises(Exception):
        files.read_union_masks(spark, str(tmp_path)).collect()
    assert files.read_union_masks(spark, str(tmp_path), axis=-1).head().height == 5


def test_partitions_are_sets_of_files(tmp_path, monkeypatch):
    for i in range(7):
        (tmp_path / f"{i}.npz").write_bytes(b"x" * 100)
    (tmp_path / "_temporary-1").mkdir()
    (tmp_path / "_temporary-1" / "9.npz").write_bytes(b"x")
    monkeypatch.setattr(archives, "TASK_BYTES", 250)
    assert [len(p.paths) for p in archives._MaskReader(str(tmp_path), "*.npz", []).partitions()] == [3, 3, 1]


def test_listed_files_are_those_of_sparks_reader_and_none_is_scanned(spark, tmp_path):
    root = tmp_path / "a b"
    for name in ["x.png", "a/y.PNG", "a/b/c/é ü.jpeg", "a/annotations/n.png", "_temporary-1/t.png", ".h/t.png", "_k=1/p.png", "a/_s.png", "a/.s.png", "a/z._COPYING_", "a/t.txt", *[f"many/{i}.png" for i in range(90)]]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * len(name))
    (root / "empty").mkdir()
    for folder in (str(root), f"file://{tmp_path}/many", str(root / "x.png"), f"{tmp_path}/a*/a"):
        (tmp_path / "many").mkdir(exist_ok=True)
        want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
        assert sorted(archives.list_files(spark, folder).collect()) == sorted(want.collect())
    found = files.list_images(spark, str(root))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()][:4] == ["p.png", "é ü.jpeg", "y.PNG", "0.png"] and found.count() == 94
    assert not any(f.endswith(".png") for f in found.inputFiles())
    with pytest.raises(Exception):
        files.list_images(spark, str(tmp_path / "absent"))


def test_index_rows_meet_their_vectors_without_a_shuffle(spark, sf, tmp_path):
    from gridsift.plans.projection import patches
    from gridsift.sources import gallery

    p, path = patches(spark, sf), str(tmp_path / "g")
    rows = p.select("image_id", "row", "col", "embedding").withColumn("block", F.explode(F.array(F.lit(4), F.lit(11))))
    config = gallery.config_from_features(rows, "m", "1", "s", 14, 140)
    part = lambda cond: rows.where(cond)
    gallery.write_gallery(part("image_id < '3'"), config, path, buckets=3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (300, 500):
            g = gallery.read_gallery(spark, path)
            found = g.load_embeddings(g.patches.where("row < 5"), 11)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan and g.buckets == 3
            assert found.count() == n // 2 and g.vectors.count() == 2 * n
            outside = spark.createDataFrame([("1", 2, 3)], "image_id string, row int, col int")
            assert len(g.load_embeddings(outside, 4).collect()[0].embedding) == config["embed_dim"]
            gallery.write_gallery(part("image_id >= '3'"), {}, path, append=True)
        with pytest.raises(ValueError):
            gallery.write_gallery(part("block = 4"), {}, path, append=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
