"""Where user functions plug in: feature extraction, mask proposals, and a registry of methods."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks

FEATURES = "image_id string, block int, row int, col int, embedding array<float>"
PROPOSALS = "image_id string, mask_id int, height int, width int, x int, y int, w int, h int, score double, rle array<int>"


def resolve_layers(layers: int | list[int], depth: int) -> list[int]:
    """An integer means the last so many blocks; a list is taken as given."""
    if isinstance(layers, int):
        if not 1 <= layers <= depth:
            raise ValueError("layers must be between 1 and the depth")
        return list(range(depth - layers, depth))
    if any(not 0 <= b < depth for b in layers):
        raise ValueError("a block is outside the model")
    return list(layers)


def extract_features(images: DataFrame, load: Callable[[], Callable], layers: list[int], max_batch: int = 16, debias: np.ndarray | None = None) -> DataFrame:
    """Rows of CLS (row and col null) and patch vectors of each block, from image rows (image_id, content).

    ``load()`` runs once in a task and gives embed(list of bytes) -> (cls (B, L, D), patches (B, L, H, W, D)), and as a third
    item, where images do not fill their grids, the cells that exist (B, H, W): others give no rows. At most ``max_batch``
    images are embedded at once. Patches lose the directions of ``debias`` (orthonormal rows), if given.
    """
    if max_batch < 1:
        raise ValueError("max_batch must be positive")

    def run(batches: Iterator[pa.RecordBatch]):
        embed = None
        for whole in batches:
            for i in range(0, whole.num_rows, max_batch):
                embed = embed or load()
                ids, content = (c.to_pylist() for c in whole.slice(i, max_batch).columns)
                cls, patches, *inside = embed(content)
                for b, image in enumerate(ids):
                    for at, block in enumerate(layers):
                        grid = np.asarray(patches[b, at], float)
                        h, w, d = grid.shape
                        flat = grid.reshape(-1, d)
                        if debias is not None:
                            flat = blocks.unit_rows(flat - (flat @ debias.T) @ debias)
                        there = np.asarray(inside[0][b], bool) if inside else np.ones((h, w), bool)
                        r, c = np.nonzero(there)
                        flat, n = flat[there.ravel()], len(r) + 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([image] * n), pa.array([block] * n, pa.int32()), pa.array([None, *r.tolist()], pa.int32()), pa.array([None, *c.tolist()], pa.int32()), pa.array([np.asarray(cls[b, at], float).tolist(), *flat.tolist()], pa.list_(pa.float32()))],
                            ["image_id", "block", "row", "col", "embedding"],
                        )

    return images.select(F.col("image_id").cast("string"), "content").mapInArrow(run, FEATURES)


def propose_masks(images: DataFrame, load: Callable[[], Callable]) -> DataFrame:
    """Proposal rows from image rows (image_id, content); ``load()`` gives propose(bytes) -> [(mask, box or None, score or None)]."""

    def run(batches: Iterator[pa.RecordBatch]):
        propose = None
        for batch in batches:
            propose = propose or load()
            for image, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for k, (mask, box, score) in enumerate(propose(content)):
                    x, y, w, h = box if box is not None else (None,) * 4
                    rows.append({"image_id": image, "mask_id": k, "height": mask.shape[0], "width": mask.shape[1], "x": x, "y": y, "w": w, "h": h, "score": score, "rle": blocks.rle_encode(mask)})
                if rows:
                    kinds = [pa.string(), *[pa.int32()] * 7, pa.float64(), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(rows[0], kinds, strict=True))))

    return images.select(F.col("image_id").cast("string"), "content").mapInArrow(run, PROPOSALS)


class Methods:
    """Named anomaly methods: name -> (fit(train) -> state, predict(state, test) -> DataFrame of image_id, image_score)."""

    def __init__(self):
        self._known: dict[str, tuple[Callable, Callable]] = {}

    def register(self, name: str, fit: Callable, predict: Callable) -> None:
        self._known[name] = (fit, predict)

    def names(self) -> list[str]:
        return sorted(self._known)

    def run(self, name: str, train: DataFrame, test: DataFrame) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"unknown method {name!r}; known: {', '.join(self.names())}")
        fit, predict = self._known[name]
        return predict(fit(train), test)

    def run_all(self, names: list[str], train: DataFrame, test: DataFrame) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """Results by name, and error messages of those that failed; one failure does not stop the others."""
        done, failed = {}, {}
        for n in names:
            try:
                done[n] = self.run(n, train, test)
            except Exception as e:
                failed[n] = str(e)
        return done, failed
