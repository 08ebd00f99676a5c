"""Importance resampling of documents towards a target: a weighted draw without replacement, by hashed word features.

A feature is a word or, with `run` 2, also a pair of consecutive words joined by a space; its bucket is its CRC-32 modulo `buckets`. The
weight of a document is the mean gain of its features: how much more frequent their buckets are in the target than in the
documents. Documents of the highest weight plus Gumbel noise, drawn from a hash of doc_id, are the sample.

Two small tables are sent to all tasks: the CRC states of the most frequent words, from which a longer run goes on
without its first word being read again, and the buckets of the most frequent pairs. Features that they don't hold take
their CRC directly, so every bucket total is exact whatever the tables hold.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import small, written
from pagemill.llm.words import words_of
from pagemill.operators.prefix import prefix_sums

RUN = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
HEAD = 1 << 16  # words, and pairs, that are sent to all tasks
LONGEST = 64  # bytes of a word in a head, so that a head has a bound; longer words take the direct way
COUNTED = 400_000  # features that a task counts at a time when heads are chosen
KNOWN = 400_000  # words outside the head that a worker remembers; memory only


class Heads(NamedTuple):
    """CRC states of frequent words, and buckets of frequent pairs."""

    words: dict[bytes, int]
    pairs: dict[tuple[bytes, bytes], int]


def frequent(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS, head: int = HEAD) -> Heads:
    """The `head` most frequent words, and pairs if runs are longer than one, over all texts.

    A task counts in bounded memory: at COUNTED features the rarer half goes. So the choice of rare members may miss a
    feature; what is chosen only saves work, and no total depends on it. A task hands on 2 x `head` rows at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter() for _ in range(min(run, 2))]
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                words = [w for w in words_of(text) if len(w) <= LONGEST]
                found[0].update(words)
                if run > 1:
                    found[1].update(map(b" ".join, zip(words, words[1:], strict=False)))
            for k, c in enumerate(found):
                if len(c) > COUNTED:
                    found[k] = Counter(dict(c.most_common(COUNTED // 2)))
        for size, c in enumerate(found, 1):
            top = c.most_common(2 * head)
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(top), pa.int32()), pa.array([x for x, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["size", "feature", "n"])

    counts = written(texts.select("text").mapInArrow(count, "size int, feature binary, n long").groupBy("size", "feature").agg(F.sum("n").alias("n")), "head")

    def top(size: int) -> list[bytes]:
        return counts.where(F.col("size") == size).orderBy(F.desc("n"), "feature").limit(head).select("feature").toArrow()["feature"].to_pylist()

    pairs = [tuple(x.split(b" ")) for x in top(2)] if run > 1 else []
    return Heads({w: zlib.crc32(w) for w in top(1)}, {(a, b): zlib.crc32(a + b" " + b) % buckets for a, b in pairs})


class Hasher:
    """Buckets of the features of a text: its words, then its pairs if runs are of two."""

    def __init__(self, heads: Heads, run: int, buckets: int):
        if run not in (1, 2):
            raise ValueError("run must be 1 or 2")
        self._heads, self._run, self._buckets = heads, run, buckets
        self._known: dict[bytes, int] = {}

    def _state(self, word: bytes) -> int:
        """Of a word outside the head."""
        state = self._known.get(word)
        if state is None:
            if len(self._known) >= KNOWN:
                self._known.clear()
            state = zlib.crc32(word)
            if len(word) <= LONGEST:
                self._known[word] = state
        return state

    def __call__(self, words: list[bytes]) -> np.ndarray:
        states = list(map(self._heads.words.get, words))
        if None in states:
            states = [self._state(w) if s is None else s for s, w in zip(states, words, strict=True)]
        found = np.array(states, np.int64) % self._buckets
        if self._run == 1:
            return found
        held = map(self._heads.pairs.get, zip(words, words[1:], strict=False))
        pairs = [zlib.crc32(b" " + w, s) % self._buckets if k is None else k for k, s, w in zip(held, states, words[1:], strict=False)]
        return np.concatenate([found, np.array(pairs, np.int64)])


def features(texts: DataFrame, heads: Heads, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """`n_words, buckets` beside the other columns of texts but `text`; buckets are unsigned 32-bit integers in a row, 16-bit if they fit."""
    sent = texts.sparkSession.sparkContext.broadcast(heads)
    kind = _kind(buckets)
    kept = [f for f in texts.schema.fields if f.name != "text"]

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(sent.value, run, buckets)
        for batch in small(batches):
            n, found = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                n.append(len(words))
                found.append(hasher(words).astype(kind).tobytes() if words else b"")
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=[*[f.name for f in kept], "n_words", "buckets"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "n_words long, buckets binary"])
    return texts.mapInArrow(run_, schema)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has; a task hands on one row a bucket, so the driver gets `buckets` rows."""
    kind = _kind(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    rows = found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of its smoothed share in the target over that in the raw documents, floored."""
    n, all_raw, all_target = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64) if n else np.zeros(0, np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """1000 times a Gumbel draw from a hash of the id, floored; an id of null is hashed as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, head: int = HEAD) -> DataFrame:
    """One row a row of `doc_id, text`: `doc_id, n_features, weight, score, rank`.

    Only those columns are read, and `text` of target. A text that is null, empty or without words has no features and
    weight 0. Of the documents with at least `least_words` words, `percent` in a hundred (floored) are drawn, those of the
    highest scores, ties to the smaller doc_id, null last; rank is null for all others. Repeated rows are documents of
    their own. Without documents there are no rows; an empty target makes all weights depend on the documents alone.
    """
    docs, target = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), target.select(F.col("text").cast("string"))
    heads = frequent(docs, run, buckets, head)
    found = written(features(docs, heads, run, buckets), "features")
    gain = docs.sparkSession.sparkContext.broadcast(gains(totals(found, buckets), totals(features(target, heads, run, buckets), buckets)))
    kind = _kind(buckets)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = gain.value
        for batch in small(batches):
            ids, sizes, weights, scores = batch.column("doc_id").to_pylist(), [], [], []
            for doc_id, x in zip(ids, batch.column("buckets"), strict=True):
                at = np.frombuffer(x.as_py(), kind)
                sizes.append(len(at))
                weights.append(int(g[at].sum()) // len(at) if len(at) else 0)
                scores.append(weights[-1] + noise(doc_id, seed))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *[pa.array(x, pa.int64()) for x in (sizes, weights, scores)]], names=["doc_id", "n_words", "n_features", "weight", "score"])

    drawn = found.where(F.col("n_words") >= least_words).count() * percent // 100
    scored = found.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long").withColumn("fit", F.col("n_words") >= least_words)
    ranked = prefix_sums(scored, [], [~F.col("fit"), -F.col("score"), F.col("doc_id").isNull(), F.col("doc_id")], {"rank": F.lit(1).cast("long")})
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
