"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each plane compressed with zstandard.

A file is `magic, planes of block 0, planes of block 1, ..., chunk index, footer`. The chunk index, compressed too, lists
for each block its number of ids and the offset and size of each plane, and for each document its id and number of ids.
The footer is the index's offset and size and the magic again, so a reader seeks to the index, then to any block.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import create_folder, file_system, one_each, salted, shared_folder, written
from pagemill.llm.tokens import encoded, tokenizer_path

MAGIC = b"TOKPLN01"
BLOCK_IDS = 1 << 16
LEVEL = 3


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Four byte planes or 32 bit planes of unsigned 32-bit ids, lowest first."""
    if kind == "byte":
        return [(ids >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(4)]
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    """The ids again; the number of planes tells their kind."""
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=count, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Appends documents to one token-id file; holds one block of ids at a time."""

    def __init__(self, stream, kind: str = "byte", block_ids: int = BLOCK_IDS):
        self._stream, self._kind, self._block = stream, kind, block_ids
        self._squeeze = zstandard.ZstdCompressor(level=LEVEL)
        self._held: list[np.ndarray] = []
        self._n_held = 0
        self._blocks: list[list[int]] = []
        self._docs: list[tuple[int | None, int]] = []
        self._at = stream.write(MAGIC) or len(MAGIC)
        self.n_tokens = 0

    def add(self, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> None:
        self._docs += zip(doc_ids, sizes, strict=True)
        self._held.append(ids)
        self._n_held += len(ids)
        self.n_tokens += len(ids)
        if self._n_held >= self._block:
            joined = np.concatenate(self._held)
            whole = len(joined) // self._block * self._block
            for k in range(0, whole, self._block):
                self._write(joined[k : k + self._block])
            self._held, self._n_held = [joined[whole:]], len(joined) - whole

    def _write(self, ids: np.ndarray) -> None:
        entry = [len(ids)]
        for plane in to_planes(ids, self._kind):
            data = self._squeeze.compress(plane)
            self._stream.write(data)
            entry += [self._at, len(data)]
            self._at += len(data)
        self._blocks.append(entry)

    def close(self) -> None:
        if self._n_held:
            self._write(np.concatenate(self._held))
        index = self._squeeze.compress(json.dumps({"kind": self._kind, "blocks": self._blocks, "docs": self._docs}).encode())
        self._stream.write(index)
        self._stream.write(struct.pack("<QQ", self._at, len(index)) + MAGIC)


def read_index(source) -> dict:
    """A file's chunk index."""
    source.seek(source.size() - 16 - len(MAGIC))
    at, size = struct.unpack("<QQ", source.read(16))
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    source.seek(at)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(size)))


def read_documents(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in the file's order, one block in memory at a time and what a document began before it."""
    index, expand = read_index(source), zstandard.ZstdDecompressor()

    def block(entry: list[int]) -> np.ndarray:
        planes = []
        for at, size in zip(entry[1::2], entry[2::2], strict=True):
            source.seek(at)
            planes.append(expand.decompress(source.read(size)))
        return from_planes(planes, entry[0])

    blocks = iter(index["blocks"])
    held = np.empty(0, "<u4")
    for doc_id, size in index["docs"]:
        parts = []
        while size > len(held):
            parts.append(held)
            size -= len(held)
            held = block(next(blocks))
        yield doc_id, np.concatenate([*parts, held[:size]])
        held = held[size:]


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str | None = None, kind: str = "byte") -> DataFrame:
    """Writes `doc_id, text` as token-id files in ascending doc_id order and returns their manifest.

    Rows are dealt by doc_id range, so that file k+1 continues file k; a task streams one range into one file. Each text
    is closed by END_ID. A null text has only that; a null doc_id comes first; rows of equal doc_id are ordered by text.
    The manifest `(file_no, file, n_docs, n_tokens)` is a written table that names the files of finished tasks only.
    An empty table has no files.
    """
    path = tokenizer or tokenizer_path()
    create_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = stream = name = part = None
        n_docs = 0
        for batch in batches:
            for begin, ids, bounds in encoded(batch.column("text"), path):
                if writer is None:
                    name, part = salted("tokens"), batch.column("part")[0].as_py()
                    fs, where = file_system(f"{folder}/{name}")
                    stream = fs.open_output_stream(where)
                    writer = PlaneWriter(stream, kind)
                sizes = np.diff(bounds).tolist()
                writer.add(batch.column("doc_id")[begin : begin + len(sizes)].to_pylist(), sizes, ids)
                n_docs += len(sizes)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64())})

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(write, "file_no int, file string, n_docs long, n_tokens long")
    return written(files, "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of each document, read back from the files; start counts all ids before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, where = file_system(f"{folder}/{name}")
                rows: list[tuple] = []
                with fs.open_input_file(where) as source:
                    for doc_id, ids in read_documents(source):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    return one_each(placed).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, read back: one row a document."""
    folder = shared_folder(spark, "token-planes")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(manifest, folder)
