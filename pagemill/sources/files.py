"""A Spark data source that writes one file a row, and reads such files back, or their status.

A task writes below a folder of its own name and attempt, which begins with an underscore. When all tasks are done the
driver renames each task's folder, one rename a task and not a file, and writes _SUCCESS; if the job fails it removes
them. A task that fails removes its own, and what a lost executor leaves is never renamed, so a reader that passes over
names with an underscore, as Spark's do, never meets half a result.

Reading, the driver learns only the folders below a path; tasks list them, a folder at a time, and read what they list.
Spark's own reader holds the status of every file in the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, STATUS_FORMAT = "row_files", "row_files_status"
SCHEMA, STATUS_SCHEMA = "name string, content binary", "path string, length long"
# The most rows, and about the most bytes, of a batch that a task hands on.
BATCH_ROWS, BATCH_BYTES = 5000, 8 << 20


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return pafs.FileSystem.from_uri(uri)


def _safe(name: str | None) -> str:
    """A relative name; ValueError for one that is null, empty, absolute or leads upwards."""
    parts = (name or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or "\0" in (name or ""):
        raise ValueError(f"not a relative file name: {name!r}")
    return "/".join(parts)


@dataclass
class TaskFolder(WriterCommitMessage):
    """What a task that is done reports: its folder, and how many files it has."""

    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self._path = path

    def write(self, iterator: Iterator[Row]) -> TaskFolder:
        fs, path = _file_system(self._path)
        folder, made, n = f"{path}/_task-{uuid.uuid4().hex}", set(), 0
        try:
            for name, content in iterator:
                target = f"{folder}/{_safe(name)}"
                above = target.rpartition("/")[0]
                if above not in made:
                    fs.create_dir(above, recursive=True)
                    made.add(above)
                if fs.get_file_info(target).type != pafs.FileType.NotFound:
                    raise ValueError(f"two rows of one task have the name {name!r}")
                with fs.open_output_stream(target) as out:
                    out.write(content or b"")
                n += 1
        except BaseException:
            if made:
                fs.delete_dir(folder)
            raise
        return TaskFolder(folder, n)

    def commit(self, messages: list[TaskFolder | None]) -> None:
        fs, path = _file_system(self._path)
        fs.create_dir(path, recursive=True)
        stamp = uuid.uuid4().hex[:8]
        for k, m in enumerate(x for x in messages if x is not None and x.files):
            fs.move(m.folder, f"{path}/part-{k:05d}-{stamp}")
        with fs.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[TaskFolder | None]) -> None:
        fs, _ = _file_system(self._path)
        for m in messages:
            if m is not None and m.files:
                fs.delete_dir(m.folder)


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


@dataclass
class _Folder(InputPartition):
    """A folder to list; `deep` with all below it."""

    path: str
    deep: bool


class _Reader(DataSourceReader):
    """Gives the files below a path but for hidden ones: `path, length`, or the content by the name below a task's folder, of empty ones if asked for."""

    def __init__(self, uri: str, content: bool, empty: bool = True):
        self._uri, self._content, self._empty = uri.rstrip("/"), content, empty

    def _listed(self, fs: pafs.FileSystem, path: str) -> Iterator[tuple[str, bool, int | None]]:
        """(path, whether it is a folder, length) of what a folder has; local ones are not held whole, and only files of a status are asked for it."""
        if isinstance(fs, pafs.LocalFileSystem):
            with os.scandir(path) as found:
                for e in found:
                    if not _hidden(e.name):
                        yield e.path, e.is_dir(), None
        else:
            for f in fs.get_file_info(pafs.FileSelector(path)):
                if not _hidden(f.base_name):
                    yield f.path, f.type == pafs.FileType.Directory, f.size

    def partitions(self) -> list[_Folder]:
        fs, path = _file_system(self._uri)
        return [_Folder(path, False), *[_Folder(p, True) for p, folder, _ in self._listed(fs, path) if folder]]

    def _files(self, fs: pafs.FileSystem, part: _Folder) -> Iterator[tuple[str, int]]:
        folders = [part.path]
        while folders:
            for p, folder, n in self._listed(fs, folders.pop()):
                if folder and part.deep:
                    folders.append(p)
                elif not folder:
                    yield p, os.stat(p).st_size if n is None else n

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(self._uri)
        scheme = self._uri.removesuffix(root.rstrip("/")) or "file:"
        scheme = "file:" if scheme == "file://" else scheme
        rows, held = [], 0
        for path, length in self._files(fs, partition):
            if not length and not self._empty:
                continue
            if self._content:
                with fs.open_input_stream(path) as f:
                    rows.append((path.removeprefix(partition.path + "/"), f.read()))
                held += length
            else:
                rows.append((scheme + path, length))
            if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("name", pa.string()), ("content", pa.binary())) if self._content else (("path", pa.string()), ("length", pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


class FileStatus(DataSource):
    """Reads `path, length` of the files below a path."""

    @classmethod
    def name(cls) -> str:
        return STATUS_FORMAT

    def schema(self) -> str:
        return STATUS_SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], content=False)


class RowFiles(DataSource):
    """Writes rows of `name, content`: each a file of that relative name below the path, in the folder of its task; and reads them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], content=True, empty=self.options.get("empty") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are only added; choose a new path")
        return _Writer(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Writes `name, content` (text or binary; null is an empty file), one file a row. Names are unique, ValueError if a task meets one twice."""
    files.sparkSession.dataSource.register(RowFiles)
    files.select(F.col("name").cast("string"), F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode("append").save(path)


def read_files(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """`name, content` of the files that write_files has put below a path; with `empty` those without content too, which Spark's readers pass over.

    A task reads the folder of the task that wrote it.
    """
    spark.dataSource.register(RowFiles)
    return spark.read.format(FORMAT).option("empty", empty).load(path)


def file_status(spark: SparkSession, path: str) -> DataFrame:
    """`path, length` of the files below a path, at any depth. Each folder right below it is listed by a task of its own."""
    spark.dataSource.register(FileStatus)
    return spark.read.format(STATUS_FORMAT).load(path)
