"""Folders and files that the driver and all executors see, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's URI below the session's spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) has a temporary folder made and set; a cluster's raises ValueError,
    as executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written as Parquet to a new shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark, what)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, for readers and writers inside tasks, and the path there."""
    return pafs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def create_folder(uri: str) -> None:
    """Makes the folder, and those above it."""
    fs, path = file_system(uri)
    fs.create_dir(path, recursive=True)


_KEPT: dict[str, Any] = {}


def kept(what: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between its tasks: one thing only, as Spark hands workers on from query to query."""
    if what not in _KEPT:
        release()
        _KEPT[what] = make()
    return _KEPT[what]


def release() -> None:
    """Lets go what this worker keeps, and the memory that Arrow holds ready."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to `rows`, so that what Python makes of one stays small.

    What the worker kept for tasks of another operator goes first.
    """
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def salted(name: str) -> str:
    """A file name that no other attempt at the same task gives; only names that a finished task reports are read."""
    return f"{name}-{uuid.uuid4().hex[:12]}"


def one_each(files: DataFrame, key: str = "file", most: int = 20_000) -> DataFrame:
    """A manifest dealt out so that each file is a task of its own (up to `most` tasks); a given number isn't coalesced."""
    return files.repartition(min(max(files.count(), 1), most), F.col(key))
