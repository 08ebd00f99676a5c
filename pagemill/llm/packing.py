"""Best-fit packing of documents into fixed-length training sequences.

Vector best fit: a bin has a capacity of tokens, of documents and of attention cost (the sum of squared piece lengths).
Pieces are taken longest first; a piece goes to the open bin that keeps every constraint and scores best, by the weighted
norm of what it would leave (`norm`, least) or by the weighted dot product of the piece with what is left (`dot`, most).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import written
from pagemill.llm.tokens import encoded, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and the weight of each dimension in the choice of a bin.

    The defaults of documents and attention follow from the tokens (a piece has one token at least, and a sum of squares
    is at most the square of the sum), so they bind only if set lower.
    """

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2


class Bins:
    """Open bins, by tokens left and then by (documents left, attention left); bins of equal state are interchangeable."""

    def __init__(self, capacity: Capacity):
        self._capacity, self._full = capacity, capacity.vector()
        self._open: dict[int, dict[tuple[int, int], list[int]]] = {}
        self._present = 0  # bit r is set if a bin has r tokens left
        self._used: list[int] = []

    def _best(self, length: int) -> tuple[int, tuple[int, int]] | None:
        (tokens, docs, attention), (wt, wd, wa) = self._full, self._capacity.weights
        by_norm, best, found = self._capacity.score == "norm", None, None
        left = self._present >> length
        base = length
        while left:
            step = (left & -left).bit_length() - 1
            room, left, base = base + step, left >> (step + 1), base + step + 1
            least = wt * ((room - length) / tokens) ** 2
            if by_norm and best is not None and least >= best:
                break  # fuller bins come first: no later one can score better
            for state in self._open[room]:
                d, a = state
                if not d or a < length * length:
                    continue
                if by_norm:
                    value = least + wd * ((d - 1) / docs) ** 2 + wa * ((a - length * length) / attention) ** 2
                else:
                    value = -(wt * room * length / tokens**2 + wd * d / docs**2 + wa * a * length**2 / attention**2)
                if best is None or value < best:
                    best, found = value, (room, state)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        if length > self._full[0] or length * length > self._full[2]:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        found = self._best(length)
        if found is None:
            number, room, (docs, attention) = len(self._used), self._full[0], self._full[1:]
            self._used.append(0)
        else:
            room, (docs, attention) = found
            same = self._open[room][found[1]]
            number = same.pop()
            if not same:
                del self._open[room][found[1]]
                if not self._open[room]:
                    del self._open[room]
                    self._present &= ~(1 << room)
        offset = self._used[number]
        self._used[number] += length
        if room > length:
            self._open.setdefault(room - length, {}).setdefault((docs - 1, attention - length * length), []).append(number)
            self._present |= 1 << (room - length)
        return number, offset


def pieces_of(docs: DataFrame, longest: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """The pieces of `doc_id, text`: a document's ids, closed by END_ID, whole or cut into pieces of `longest` ids.

    Of a cut document the first piece takes the rest of the division, so all others are full. A null text is one piece
    of one id; each of several rows of a doc_id gives its own pieces.
    """
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, ids, bounds in encoded(batch.column("text"), path):
                raw, sizes = ids.astype("<u4").tobytes(), np.diff(bounds)
                counts = -(-sizes // longest)
                owner = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = (sizes - 1) % longest + 1
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * longest)
                length = np.where(piece == 0, first[owner], longest)
                at = (bounds[owner] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner + begin)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: Capacity | None = None, pieces_a_task: int = 100_000) -> DataFrame:
    """Places each piece: adds `sequence_id` and `offset`.

    Pieces are dealt evenly to tasks of about `pieces_a_task`, each packed by itself, so a task's memory is bounded and
    what splitting costs is about one part-filled sequence a task. Sequences are numbered by task and bin.
    """
    capacity = capacity or Capacity()
    ready = written(pieces, "pieces")
    tasks = -(-ready.count() // pieces_a_task) or 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            held = pa.Table.from_batches(parts)
            held = held.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            bins, base = Bins(capacity), TaskContext.get().partitionId() << 32
            placed = [bins.place(n) for n in held["length"].to_pylist()]
            number, offset = zip(*placed, strict=True)
            held = held.append_column("sequence_id", pa.array(np.array(number, np.int64) + base)).append_column("offset", pa.array(offset, pa.int64()))
            yield from held.to_batches(max_chunksize=50_000)

    return ready.repartition(tasks).mapInArrow(place, PACKED)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 1024 tokens, packed into sequences of at most 1024."""
    return pack(pieces_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
