import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift.functions import blocks
from gridsift.operators import clusters, detection, features, knn, masks, metrics, pivots, scoremaps, subspace
from gridsift.operators import labels as lab
from gridsift.operators import prototypes as proto
from gridsift.plans.projection import patches
from gridsift.sources import files, gallery


def test_knn_is_the_same_in_blocks(spark, sf, monkeypatch):
    p = patches(spark, sf)
    q, b = p.where("split = 'test'").withColumnRenamed("vec_id", "query_id"), p.where("split = 'train'").withColumnRenamed("vec_id", "bank_id")
    rows = lambda d: sorted((r.query_id, r.rank, r.bank_id) for r in d.collect())
    whole = rows(knn.knn_join(q, b, 4))
    monkeypatch.setattr(pivots, "BLOCK_BYTES", 37 * 8 * 64)
    assert rows(knn.knn_join(q, b, 4, bank_bytes=0)) == whole
    assert knn.knn_join(q, b.limit(0), 4).count() == 0 and knn.knn_join(q, b.limit(2), 9).where("rank > 2").count() == 0
    with pytest.raises(ValueError):
        knn.anomaly_scores(q, b.limit(2), 3)
    with pytest.raises(ValueError):
        knn.memory_bank(p, split="none")
    assert knn.memory_bank(p, 7, "vec_id", split="train").count() == 7


def test_ranking_metrics_at_any_number_of_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(0, 30)), int(rng.random() < 0.4), "a") for _ in range(400)] + [(1.0, 1, "only"), (2.0, 1, "only")]
    df = spark.createDataFrame(rows, "score double, target int, g string")
    x = [(s, t) for s, t, g in rows if g == "a"]
    pos, neg = [s for s, t in x if t], [s for s, t in x if not t]
    auroc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    for ranges in (1, 3, 64):
        r = metrics.running_counts(metrics.score_counts(df, ["g"]), ["g"], ranges)
        assert r.where("tp + fp < t + f").count() == 0
    got = {r.g: r for r in metrics.ranking_metrics(df, ["g"]).collect()}
    assert got["a"].auroc == pytest.approx(auroc) and got["only"].auroc is None and got["only"].f1max == 1
    best = max(2 * sum(p >= c for p in pos) / (sum(p >= c for p in pos) + sum(n >= c for n in neg) + len(pos)) for c in {s for s, _ in x})
    assert got["a"].f1max == pytest.approx(best)


def test_match_metrics_without_truth_is_null(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 3, 0), ("b", 0, 0.0, 0, 2), ("c", 2, 1.5, 2, 4)], "m string, tp int, iou_sum double, n_pred int, n_gt int")
    got = {r.m: r for r in metrics.match_metrics(df, ["m"]).collect()}
    assert got["a"].precision is None and got["a"].fp == 3 and got["b"].precision == 0 and got["b"].fn == 2 and got["c"].f1 == pytest.approx(2 / 3) and got["c"].mean_iou == 0.75


def test_maps_edges(spark):
    flat = spark.createDataFrame([("a", r, c, 0.5, False) for r in range(2) for c in range(2)] + [("one", 0, 0, 1.0, True)], "k string, row int, col int, score double, truth boolean")
    assert {r.k: r.threshold for r in scoremaps.otsu_threshold(flat, ["k"]).collect()} == {"a": 0.5, "one": 1.0}
    assert all(abs(r.score) < 1e-6 for r in scoremaps.minmax_scale(flat, ["k"]).collect())
    assert scoremaps.peaks(flat, ["k"]).count() == 5
    assert {r.best_iou for r in scoremaps.threshold_sweep(flat, ["k"], 5).collect()} == {0.0}
    for f in (lambda: scoremaps.peaks(flat, ["k"], 2), lambda: scoremaps.localize_keypoint(flat, ["k"], 1, 0), lambda: scoremaps.gt_score_threshold(flat, ["k"], "x"), lambda: masks.mask_to_grid(flat, ["k"], 2, "x", "score")):
        with pytest.raises(ValueError):
            f()


def test_rle_cells_and_masks(spark):
    m = np.random.default_rng(2).random((6, 7)) < 0.4
    from gridsift.functions import blocks

    df = spark.createDataFrame([("m", 6, 7, blocks.rle_encode(m)), ("empty", 6, 7, [42]), ("full", 6, 7, [0, 42])], "k string, height int, width int, rle array<int>")
    cells = masks.rle_cells(df, ["k"])
    assert {(r.row, r.col) for r in cells.where("k = 'm'").collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(m)))) and cells.where("k = 'full'").count() == 42
    opened = {r.k: r.rle for r in masks.morph_open(df, ["k"], 2).collect()}
    assert opened["full"] == [0, 42] and opened["empty"] == [42] and opened["m"] == blocks.rle_encode(blocks.open_mask(m, 2))
    assert {r.k: r.rle for r in masks.mask_grid_share(df, ["k"], 12, 2).collect()}["full"] == [0, 4]


def test_labels_fail_on_unknown_images(spark, sf):
    p = patches(spark, sf)
    with pytest.raises(Exception, match="unknown image_id"):
        lab.labels_from_cells(p, spark.createDataFrame([("no", 0, 0, 1)], "image_id string, row int, col int, value int"), spark.createDataFrame([(1, "x")], "value int, label string")).collect()


def test_lloyd_and_exemplar_clusters(spark, sf):
    p = patches(spark, sf)
    start = p.where("vec_id < 4").select(F.col("vec_id").cast("int").alias("k"), "embedding")
    best, centres = proto.lloyd_cosine(p, start, ["vec_id"], 3)
    assert best.count() == p.count() and centres.count() == 4
    t = p.where("image_id < '2'").select(F.col("image_id").alias("exemplar_id"), F.col("vec_id").alias("pos"), "embedding")
    assert proto.exemplar_clusters(t, 5).groupBy("exemplar_id").count().where("count <> 5").count() == 0 and proto.exemplar_clusters(t.where("pos < 3"), 5).count() == 0


def test_subspace_and_classifier(spark, sf):
    p = patches(spark, sf)
    x = np.array([r.embedding for r in p.select("embedding").collect()])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean, v, var = subspace.fit_subspace(p, 3)
    value = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:3]
    assert np.allclose(mean, x.mean(0)) and np.allclose(var, value)
    left = np.array([r.embedding for r in subspace.remove_subspace(p.select("embedding"), v).collect()])
    assert np.abs(left @ v.T).max() < 1e-9
    assert subspace.remove_subspace(p.select("embedding").limit(0), v).count() == 0


def test_token_clusters(spark, sf):
    p = patches(spark, sf).where("image_id = '0'")
    one = clusters.cluster_tokens(p, ["image_id"], "single", threshold=2.0)
    assert one.select("cluster").distinct().count() == 1
    assert clusters.cluster_tokens(p, ["image_id"], "dbscan", eps=-1.0).where("cluster = -1").count() == 100
    sim = p.alias("a").join(p.alias("b"), F.col("a.vec_id") < F.col("b.vec_id")).select(F.col("a.vec_id").alias("src"), F.col("b.vec_id").alias("dst"), (F.aggregate(F.zip_with("a.embedding", "b.embedding", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) + 1).alias("weight"))
    assert clusters.spectral_tokens(sim, 3).select("cluster").distinct().count() <= 3


def test_gallery_round_trip(spark, tmp_path):
    def load():
        return lambda images: (np.ones((len(images), 2, 4)), np.arange(len(images) * 2 * 2 * 3 * 4).reshape(len(images), 2, 2, 3, 4))

    images = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "image_id string, content binary")
    f = features.extract_features(images, load, features.resolve_layers(2, 12), 1)
    config = {"model_name": "m", "version": "1", "size": "s", "patch_size": 14, "image_size": 42, "block_indices": [10, 11], "embed_dim": 4, "created_at": "2000-01-01", "schema_version": "1.0"}
    gallery.write_gallery(f, config, str(tmp_path), spark.createDataFrame([("a", ["cat"])], "image_id string, labels array<string>"), spark.createDataFrame([("a", 0, 1, ["ear", "cat"])], "image_id string, row int, col int, labels array<string>"), spark.createDataFrame([("b", "train")], "image_id string, split string"))
    g = gallery.read_gallery(spark, str(tmp_path))
    assert g.patches.count() == 12 and g.cls.count() == 4 and g.load_cls().count() == 2 and g.load_image_grid("b", 10).count() == 6
    assert {(r.row, r.col): r.labels for r in g.patches.where("image_id = 'a'").collect()}[0, 1] == ["cat", "ear"]
    assert g.load_embeddings(g.patches.where("row = 0"), 11).count() == 6 and g.block() == 11
    with pytest.raises(ValueError):
        g.block(3)
    for bad in (0, 13, [12]):
        with pytest.raises(ValueError):
            features.resolve_layers(bad, 12)


def test_mask_files(spark, tmp_path):
    d = tmp_path / "a"
    d.mkdir()
    m = np.random.default_rng(1).random((2, 4, 5)) < 0.5
    np.save(d / "one.npy", m)
    (d / "one.json").write_text(json.dumps([{"class": "x", "instance_id": i, "prompt_type": "box", "prompt_content": "{}", "image_path": "p"} for i in range(2)]))
    rows = files.read_annotations(spark, str(d)).orderBy("pos").collect()
    assert [r.instance_id for r in rows] == [0, 1] and rows[0].height == 4
    (d / "one.json").write_text("[]")
    (d / "two.json").write_text(json.dumps([{"class": "x"}]))
    with pytest.raises(Exception, match="differ"):
        files.read_annotations(spark, str(d)).collect()
    np.savez(d / "p.npz", segmentations=m, bboxes=np.array([[0, 0, 1, 1], [-1] * 4], np.int32), has_bbox=np.array([True, False]))
    got = files.read_proposals(spark, str(d)).orderBy("mask_id").collect()
    assert got[0].bbox == [0, 0, 1, 1] and got[1].bbox is None
    np.savez(d / "im_mask_good.npz", segmaps=m.transpose(1, 2, 0))
    from gridsift.functions.blocks import rle_encode

    assert files.read_union_masks(spark, str(d)).head().rle == rle_encode(m.any(0))
    (d / "annotations").mkdir()
    for n in ("x.JPG", "y.png", "z.txt", "annotations/w.png"):
        (d / n).write_bytes(b"1")
    assert [r.path.split("/")[-1] for r in files.list_images(spark, str(d)).collect()] == ["x.JPG", "y.png"]


def test_score_tables(spark, tmp_path):
    df = spark.createDataFrame([("c", "m", "i", 0.5, "nan"), ("c", "n", "i", 0.25, "x.png")], "category string, method string, image_id string, image_score double, mask_path string")
    files.write_scores(df, str(tmp_path / "s"))
    assert files.read_scores(spark, str(tmp_path / "s"), [("c", "m"), ("no", "m")]).head().mask_path is None
    files.write_metrics_csv(df, str(tmp_path / "m"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "m")).count() == 2
    files.write_results_json(df.withColumn("none", F.lit(None).cast("double")).withColumn("image_score", F.lit(0.123456)), str(tmp_path / "j"), ["category"])
    text = spark.read.text(str(tmp_path / "j")).head().value
    assert "0.1235" in text and '"none":null' in text
    j = files.read_json_records(spark.createDataFrame([('{"a": 1}',), ("{broken",), (None,)], "t string"), "t", "a int")
    assert [r.record.a for r in j.collect()] == [1]
    t = spark.createDataFrame([("test/hole/3.png",), ("train/good/1.png",)], "path string")
    rows = {r.label: r for r in files.read_labeled_folder(t, spark.createDataFrame([("gt/hole/3_mask.png",)], "path string")).collect()}
    assert rows["hole"].label_index == 1 and rows["hole"].mask_path and rows["good"].mask_path is None
    assert spark.range(1).select(files.make_image_id("id", F.lit("a/b.c.png"))).head()[0] == "0_b.c"


def test_methods_registry(spark):
    m = features.Methods()
    m.register("ok", lambda t: t.count(), lambda s, t: t.limit(s))
    m.register("bad", lambda t: 1 / 0, None)
    done, failed = m.run_all(["ok", "bad", "none"], spark.range(2), spark.range(5))
    assert done["ok"].count() == 2 and set(failed) == {"bad", "none"}
    with pytest.raises(KeyError):
        m.run("none", None, None)


def test_prototypes_in_several_rows_score_the_same(spark, sf, monkeypatch):
    p = patches(spark, sf)
    protos = p.where("image_id = '0'").select(F.col("label").alias("g"), "embedding")
    score = lambda how, group: sorted((r.vec_id, *(r[g] for g in group), round(r.score, 9)) for r in proto.score_prototypes(p, protos, ["vec_id"], how, group).collect())
    want = [score(how, group) for how in ("max", "mean") for group in ([], ["g"])]
    monkeypatch.setattr(proto, "PROTOTYPE_BYTES", 7 * 64 * 8)
    assert [score(how, group) for how in ("max", "mean") for group in ([], ["g"])] == want
    assert proto.score_prototypes(p, protos.limit(0), ["vec_id"]).count() == 0


def test_top_k_with_ties_and_dbscan_against_plain_loops():
    rng = np.random.default_rng(3)
    s, ids = rng.integers(0, 4, (40, 12)).astype(float), rng.permutation(100)[:12]
    for k in (1, 4, 11, 12, 20):
        at, value = blocks.top_k(s, k, ids)
        want = [sorted(range(12), key=lambda c: (-row[c], ids[c]))[:k] for row in s]
        assert at.tolist() == want and (value == np.take_along_axis(s, at, 1)).all()
    for _ in range(20):
        cells = np.unique(rng.integers(0, 9, (40, 2)), axis=0)
        near = np.sqrt(((cells[:, None] - cells[None]) ** 2).sum(-1)) <= 1.5
        core = near.sum(1) >= 4
        label = blocks.dbscan_cells(cells, 1.5, 4)
        for i in range(len(cells)):
            owners = [label[j] for j in np.flatnonzero(near[i] & core)]
            assert label[i] == (min(owners) if owners and not core[i] else label[i] if core[i] else -1)
            assert not core[i] or all(label[j] == label[i] for j in np.flatnonzero(near[i] & core))


def test_annotation_folders(spark, tmp_path):
    m = np.ones((1, 2, 3), bool)
    for k, name in enumerate(("a", "b")):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "one.npy", m if k else np.zeros((1, 2, 3), bool))
        (tmp_path / name / "one.json").write_text(json.dumps([{"class": name, "instance_id": k}]))
    rows = files.read_annotations(spark, str(tmp_path)).collect()
    assert sorted((r["class"], r.rle) for r in rows) == [("a", [6]), ("b", [0, 6])]
    (tmp_path / "b" / "one.json").write_text("[]")
    with pytest.raises(Exception, match="differ"):
        files.read_annotations(spark, str(tmp_path)).collect()


def test_memory_bank_ratio_and_smoothing(spark, sf):
    p = patches(spark, sf).withColumnRenamed("vec_id", "bank_id")
    assert knn.memory_bank(p, ratio=0.02, split="train").count() == 6 and knn.memory_bank(p, ratio=0.0, split="train").count() == 1
    assert knn.memory_bank(p, smoothing=True, split="train").count() == p.where("split = 'train'").count()


def test_cycle_consistency_falls_back_to_the_best(spark, sf):
    p = patches(spark, sf).where("image_id IN ('0', '1')").withColumnRenamed("vec_id", "a_id")
    same = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    views = spark.createDataFrame([("0", "v", same), ("1", "v", same), ("1", "w", [1.0, 0.0, 1e6, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "image_id string, view string, m array<double>")
    cells = p.select("image_id", F.lit("v").alias("view"), "row", "col", "embedding")
    got = clusters.cycle_consistency(p, views, cells, ["image_id"], 0.4, 2.0, 8, 64, 10)
    assert {(r.image_id, r.share, r.kept) for r in got.collect()} == {("0", 1.0, True), ("1", 0.5, True)}
    none = clusters.cycle_consistency(p, views, cells, ["image_id"], 0.4, -2.0, 8, 64, 10).where("kept").groupBy("image_id").count().collect()
    assert {(r.image_id, r["count"]) for r in none} == {("0", 20), ("1", 20)}


def test_two_stage_clusters_reject_project_and_merge(spark):
    up, side = [1.0, 0.0], [0.0, 1.0]
    cell = lambda crop, r, c, x, y, score, v: ("i", crop, r, c, x, y, score, v)
    rows = [
        cell(0, 0, 0, 5.0, 5.0, 0.9, up), cell(0, 0, 1, 15.0, 5.0, 0.8, up), cell(0, 1, 0, 5.0, 15.0, 0.1, up),  # two cells kept, one below the threshold
        cell(1, 0, 0, 15.0, 5.0, 0.9, up),  # shares a cell with the larger one
        cell(2, 3, 3, 95.0, 95.0, 0.9, side),  # another direction: rejected
        cell(3, 0, 0, 55.0, 55.0, 0.9, up), cell(3, 0, 1, 56.0, 55.0, 0.9, up),  # two crop cells, one native cell
    ]
    df = spark.createDataFrame(rows, "image_id string, cluster_id long, row int, col int, x double, y double, score double, embedding array<double>")
    got = detection.two_stage_clusters(df, spark.createDataFrame([(up,)], "embedding array<double>"), ["image_id"], 0.5, 0.5, 10, 100).collect()
    by = {}
    for r in got:
        by.setdefault(r.mask_id, set()).add((r.row, r.col))
    assert sorted(map(sorted, by.values())) == [[(0, 0), (0, 1)], [(5, 5)]]
