"""Benchmark decontamination: test phrases searched in an FM-index of each training shard.

A phrase is 13 consecutive words of an item, or a whole shorter item. A shard is a run of documents inside a task. Its
index covers the stretches of words that the phrases' vocabulary has and that are long enough for a phrase: no occurrence
can be elsewhere. Found occurrences are located, and their spans merged in each document.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.components import groups
from pagemill.llm.fm_index import FMIndex
from pagemill.llm.shared import create_folder, file_system, salted, shared_folder, small, written
from pagemill.llm.words import words_of

PHRASE = 13
SHARE = 20  # contaminated: one word in so many, or more, is hit
SHARD_WORDS = 1 << 20
BLOCK_CHARS = 4_000_000  # of benchmark text whose phrases a task holds at once
PART_CHARS = 1_000_000  # of an item's text that goes to one block; a longer one is cut
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """The phrases of a block of items as arrays, and which items have each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = PHRASE):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        rows, owners = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if words:
                codes = np.array([0] * (size - len(words)) + words, np.int32)  # a short item is one phrase, filled up in front
                rows.append(np.lib.stride_tricks.sliding_window_view(codes, size))
                owners.append(np.full(len(rows[-1]), number[item], np.int32))
        table, owner = np.concatenate(rows), np.concatenate(owners)
        order = np.lexsort((owner, *table.T[::-1]))
        table, owner = table[order], owner[order]
        first = np.concatenate([[True], (table[1:] != table[:-1]).any(axis=1)])[: len(table)]
        again = np.concatenate([[False], ~first[1:] & (owner[1:] == owner[:-1])])[: len(table)]
        self.words = table[first]
        self.lengths = (self.words > 0).sum(axis=1)
        phrase = np.cumsum(first) - 1
        self._owner, self._starts = owner[~again], np.searchsorted(phrase[~again], np.arange(len(self.words) + 1))
        self.shortest = int(self.lengths.min(initial=size))

    def items_of(self, phrase: int) -> list[str]:
        """The items that have a phrase."""
        return [self.names[k] for k in self._owner[self._starts[phrase] : self._starts[phrase + 1]]]

    def occurrences(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of each occurrence in a shard; 0 stands for a word that no phrase has and for a document's end."""
        known = np.concatenate([[False], words > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= self.shortest
        begin, size = begin[long], (end - begin)[long]
        if not len(begin) or not len(self.lengths):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.cumsum(size + 1) - size - 1
        source = np.repeat(begin - starts, size + 1) + np.arange(int((size + 1).sum()))
        symbols = words[np.minimum(source, len(words) - 1)]
        symbols[starts + size] = 0
        index = FMIndex(symbols)
        low, high = index.search(self.words, self.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(phrase))
        return phrase, source[index.locate(rows)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as spans that don't touch, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _shards(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Runs of texts as words; a shard ends with the text that fills it."""
    shard: list[list[bytes]] = []
    total = 0
    for text in texts:
        shard.append(words_of(text))
        total += len(shard[-1]) + 1
        if total >= SHARD_WORDS:
            yield shard
            shard, total = [], 0
    if shard:
        yield shard


def _search(texts: list[str | None], paths: list[str]) -> Iterator[tuple[int, set, set]]:
    """For each text (words, {span}, {item}). Each block is searched in a shard's own index of what the block's words allow."""
    for shard in _shards(texts):
        begin = np.cumsum([0] + [len(words) + 1 for words in shard])
        spans: list[set] = [set() for _ in shard]
        items: list[set] = [set() for _ in shard]
        for path in paths:
            phrases = _block(path)
            numbers = np.zeros(int(begin[-1]), np.int64)
            for at, words in zip(begin.tolist(), shard, strict=False):
                numbers[at : at + len(words)] = np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int64, len(words))
            phrase, where = phrases.occurrences(numbers)
            doc = np.searchsorted(begin, where, "right") - 1
            for p, d, w in zip(phrase.tolist(), doc.tolist(), (where - begin[doc]).tolist(), strict=True):
                spans[d].add((w, w + int(phrases.lengths[p])))
                items[d].update(phrases.items_of(p))
        yield from zip(map(len, shard), spans, items, strict=True)


_HELD: dict[str, Phrases] = {}


def _block(path: str) -> Phrases:
    """A block of phrases; a worker holds the last one that it has read, so that a single block is read once."""
    if path not in _HELD:
        _HELD.clear()
        fs, place = file_system(path)
        with fs.open_input_stream(place) as f:
            _HELD[path] = pickle.loads(f.read())
    return _HELD[path]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with long texts cut so that each phrase is whole in one part: parts share the words of a phrase but one."""
    for batch in small(batches, 200):
        names, parts = [], []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if len(text) <= PART_CHARS:
                names.append(item)
                parts.append(text)
                continue
            words, held, size, fresh = words_of(text), [], 0, 0
            for w in words:
                held.append(w.decode("utf-8", "replace"))
                size, fresh = size + len(w) + 1, fresh + 1
                if size >= PART_CHARS and len(held) >= PHRASE:
                    names.append(item)
                    parts.append(" ".join(held))
                    held, fresh = held[1 - PHRASE :], 0
                    size = sum(map(len, held))
            if fresh:
                names.append(item)
                parts.append(" ".join(held))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["item", "text"])


def write_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[str]:
    """The files, in a shared folder, of the benchmark's phrases in blocks of about `block_chars` characters.

    A task builds a block at a time, so neither it nor the driver holds a large benchmark; the driver gets a path a block.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string")).where("text is not null")
    count = int(-(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)) or 1
    folder = shared_folder(spark, "phrases")
    create_folder(folder)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["block"], least=1):
            fs, place = file_system(folder)
            name = salted(f"block-{rows['block'][0].as_py()}")
            with fs.open_output_stream(f"{place}/{name}") as f:
                f.write(pickle.dumps(Phrases(list(zip(rows["item"].to_pylist(), rows["text"].to_pylist(), strict=True))), protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    parts = items.mapInArrow(_cut, "item string, text string").withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    named = written(parts.repartition(count, "block").sortWithinPartitions("block").mapInArrow(build, "name string"), "blocks")
    return sorted(f"{folder}/{r[0]}" for r in named.collect())


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds `n_words`, `hit_spans` (merged, in words) and `hit_items` to rows with a `text`.

    Other columns stay, those of these three names are replaced. A null text has no words; null or empty items have no
    phrases; an item of a null id is named by the empty string; items of equal id are one, repeated ones too. The
    benchmark may be of any size: its phrases are files of blocks, of which a task reads one at a time for each shard.
    """
    docs = docs.drop(*[f.name for f in ADDED])
    paths = write_blocks(benchmark, block_chars)
    kept = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2000):
            if not batch.num_rows:
                continue
            counts, spans, items = zip(*_search(batch.column("text").to_pylist(), paths), strict=True)
            arrays = [
                pa.array(counts, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in merged(list(s))] for s in spans], _SPANS),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], names=[*kept, *(f.name for f in ADDED)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *ADDED]))


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds `n_hit` and `contaminated` to what find_contamination gives."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is benchmark text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_verdict(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    items = F.sha2(F.array_join("hit_items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")
