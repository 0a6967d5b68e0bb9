"""Python data sources for folders of files: a sink of whole files with commit and abort, and a reader of mask archives; listings.

register() makes both known to a session: ``gridsift_files`` writes rows (name, content), ``gridsift_masks`` reads .npz
archives of segmentations, bboxes and has_bbox.
"""

from __future__ import annotations

import fnmatch
import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import blocks
from .shared import staged

FILES = "name string, content binary"
MASKS = "image_id string, mask_id int, bbox array<int>, height int, width int, rle array<int>"
#: Bytes of files that one task reads, about.
TASK_BYTES = 64 << 20


def escaped(name: str) -> str:
    """A name as one file name: nothing in it leads to another folder."""
    found = quote(str(name), safe=" ~!@$&()+,;=")
    return found.replace(".", "%2E") if found.strip(".") == "" else found


def unescaped(name: str) -> str:
    return unquote(name)


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None


class _FileWriter(DataSourceWriter):
    """A task writes into a folder of its own below _temporary; commit moves those of the tasks that count, abort drops all.

    The driver makes _temporary, tasks never do: one that outlives its job's abort fails and leaves nothing.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _root(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs, root, f"{root}/_temporary-{self.job}"

    def begin(self) -> _FileWriter:
        fs, _, temporary = self._root()
        fs.create_dir(temporary, recursive=True)
        return self

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, _, temporary = self._root()
        folder, made = f"{temporary}/{uuid.uuid4().hex}", set()
        for row in iterator:
            parts = row.name.split("/")
            if any(p in ("", ".", "..") for p in parts):
                raise ValueError(f"not a file name: {row.name!r}")
            for i in range(len(parts)):
                inside = "/".join([folder, *parts[:i]])
                if inside not in made:
                    fs.create_dir(inside, recursive=False)
                    made.add(inside)
            with fs.open_output_stream(f"{inside}/{parts[-1]}") as f:
                f.write(row.content or b"")
        return _Written(folder if made else None)

    def commit(self, messages: list) -> None:
        fs, root, temporary = self._root()
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root)):
                if old.path.rstrip("/") != temporary.rstrip("/"):
                    fs.delete_dir(old.path) if old.type == pafs.FileType.Directory else fs.delete_file(old.path)
        for i, m in enumerate(messages):
            if m is not None and m.folder:
                fs.move(m.folder, f"{root}/part-{i:05d}-{self.job[:8]}")
        self._drop(fs, temporary)

    def abort(self, messages: list) -> None:
        fs, _, temporary = self._root()
        self._drop(fs, temporary)

    @staticmethod
    def _drop(fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.move(folder, f"{folder}-gone")  # from here on, tasks that still run find no folder
            fs.delete_dir(f"{folder}-gone")


class FileSink(DataSource):
    """Rows (name, content) as files below the path; '/' in a name makes folders. See escaped() for names from data."""

    @classmethod
    def name(cls) -> str:
        return "gridsift_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], overwrite).begin()


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _MaskReader(DataSourceReader):
    """Reads only the members of an archive that the asked columns need: boxes without pixels."""

    def __init__(self, path: str, pattern: str, columns: list[str]):
        self.path, self.pattern, self.columns = path, pattern, columns

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        out, size = [_Files([])], 0
        for f in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda f: f.path):
            inside = f.path[len(root) :]
            if f.type != pafs.FileType.File or "/_temporary-" in inside or not fnmatch.fnmatch(f.base_name, self.pattern):
                continue
            if size >= TASK_BYTES:
                out, size = [*out, _Files([])], 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        kinds = {"image_id": pa.string(), "mask_id": pa.int32(), "bbox": pa.list_(pa.int32()), "height": pa.int32(), "width": pa.int32(), "rle": pa.list_(pa.int32())}
        pixels = any(c in self.columns for c in ("height", "width", "rle"))
        for path in partition.paths:
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                load = lambda name, z=z: np.load(io.BytesIO(z.read(f"{name}.npy")), allow_pickle=False)
                has, box = load("has_bbox"), load("bboxes")
                masks = load("segmentations") if pixels else None
            n = len(has)
            if not n:
                continue
            columns = {
                "image_id": lambda n=n, path=path: [unescaped(path.rsplit("/", 1)[-1].removesuffix(".npz"))] * n, "mask_id": lambda n=n: range(n), "bbox": lambda b=box, h=has: [x.tolist() if k else None for x, k in zip(b, h, strict=True)],
                "height": lambda m=masks: [m.shape[1]] * len(m), "width": lambda m=masks: [m.shape[2]] * len(m), "rle": lambda m=masks: [blocks.rle_encode(x) for x in m],
            }
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[c]()), kinds[c]) for c in self.columns], self.columns)


class MaskArchives(DataSource):
    """Proposal rows of the .npz archives below the path; a schema of some of the columns reads only these."""

    @classmethod
    def name(cls) -> str:
        return "gridsift_masks"

    def schema(self) -> str:
        return MASKS

    def reader(self, schema) -> DataSourceReader:
        return _MaskReader(self.options["path"], self.options.get("pattern", "*.npz"), schema.fieldNames())


def register(spark: SparkSession) -> None:
    for source in (FileSink, MaskArchives):
        spark.dataSource.register(source)


def write_files(rows, path: str, overwrite: bool = False) -> None:
    """Write rows (name, content) as files below ``path``: all of them, or none if the job fails."""
    register(rows.sparkSession)
    rows.select("name", "content").write.format("gridsift_files").mode("overwrite" if overwrite else "append").save(path)


def _listed(name: str) -> bool:
    """Whether Spark's file readers see a file or folder of that name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the files below ``folder`` that Spark's file readers see, with their paths; files are not opened.

    A level of folders is listed by one job, a folder by one task that holds its names; neither the driver nor a plan holds
    any. Globs, a path of one file and file systems that Arrow does not know are left to Spark's binaryFile reader, which
    plans a task for every few files.
    """
    try:
        fs, root = pafs.FileSystem.from_uri(folder)
        known = not any(c in folder for c in "*?[{") and fs.get_file_info(root).type != pafs.FileType.File
    except pa.ArrowInvalid:
        known = False
    if not known:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    root, whole = root.rstrip("/"), folder.rstrip("/")
    prefix = "file:" if fs.type_name == "local" else whole.removesuffix(root) if whole.endswith(root) else f"{fs.type_name}://"
    if fs.get_file_info(root or "/").type == pafs.FileType.NotFound:
        raise FileNotFoundError(folder)

    def names(batches: Iterator[pa.RecordBatch]):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found = [f for f in fs.get_file_info(pafs.FileSelector(at)) if _listed(f.base_name)]
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path for f in part], pa.string()), pa.array([f.size for f in part], pa.int64()), pa.array([f.type == pafs.FileType.Directory for f in part], pa.bool_())], ["at", "length", "folder"])

    level, out = spark.createDataFrame([(root or "/",)], "at string"), None
    while out is None or not level.isEmpty():
        tasks = 1 if out is None else 4 * spark.sparkContext.defaultParallelism
        listed = staged(level.repartition(tasks).mapInArrow(names, "at string, length long, folder boolean"), "names")
        found = listed.where("NOT folder").select(F.concat(F.lit(prefix), "at").alias("path"), "length")
        level, out = listed.where("folder").select("at"), found if out is None else out.unionByName(found)
    return out
