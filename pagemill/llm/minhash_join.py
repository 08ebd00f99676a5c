"""N-gram Jaccard join of documents with themselves: MinHash banding finds candidates, full n-gram sets verify them.

Documents of equal words are one class, found by grouping. Of a class one text is signed: `BANDS` bands of `ROWS` minimum
hashes over its five-word n-grams. Classes that share a band value are candidates; a pair is looked at where its first
common band is, so once, and is a link if the Jaccard similarity of the two full sets of n-grams is at least `LEAST`.
With 20 bands of 4 a pair at the threshold is missed with a probability of (1 - 0.8^4)^20 = 0.00003, nearer ones less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.components import Local, among, connected, groups, membership, pair_units
from pagemill.llm.shared import small, written
from pagemill.llm.words import words_of

GRAM = 5
LEAST = 0.8
BANDS, ROWS = 20, 4
UNIT = 1000  # classes of a band value that are compared in one unit of work
_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U64 = np.uint64


class _Powers:
    """Powers of the base of word hashes, and of its inverse modulo 2^64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 2 * n
            cls.up = np.concatenate([[_U64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
            cls.down = np.concatenate([[_U64(1)], np.cumprod(np.full(size, _INVERSE, np.uint64))])
        return cls.up[:n], cls.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(29))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(32))


def word_hashes(joined: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text whose words are joined by single spaces."""
    octets = np.frombuffer(joined, np.uint8)
    if not len(octets):
        return np.empty(0, np.uint64)
    spaces = np.flatnonzero(octets == 32)
    begin, end = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(octets)]])
    up, down = _Powers.to(len(octets))
    sums = np.concatenate([[_U64(0)], np.cumsum((octets.astype(np.uint64) + _U64(1)) * up)])
    return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def gram_hashes(joined: bytes, size: int = GRAM) -> np.ndarray:
    """A hash of each n-gram in order; a text of fewer words, but not none, is one n-gram."""
    words = word_hashes(joined)
    if not len(words):
        return words
    n = min(size, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * _U64(0x100000001B3) + words[k : len(words) - n + k + 1]
    return _mixed(total)


def band_values(grams: np.ndarray) -> np.ndarray:
    """The values of the bands, each a hash of its number and its minimum hashes."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    small = (grams >> _U64(32)).astype(np.uint32)
    for at in range(0, len(small), 4096):
        least = np.minimum(least, (small[at : at + 4096, None] * _A + _B).min(axis=0))
    value = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        value = _mixed(value * _U64(0x100000001B3) + column)
    return value.view(np.int64)


def class_key(text: str | None) -> tuple[bytes, bytes]:
    """(the key of a text's words, the words joined)."""
    joined = b" ".join(words_of(text))
    return hashlib.md5(joined).digest(), joined


def _signed(docs: DataFrame) -> DataFrame:
    """`doc_id, key, bands`; a text without words has no bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, bands = [], []
            for text in batch.column("text").to_pylist():
                key, joined = class_key(text)
                keys.append(key)
                bands.append(band_values(gram_hashes(joined)) if joined else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*bands, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), values], names=["doc_id", "key", "bands"])

    return docs.mapInArrow(sign, "doc_id long, key binary, bands array<long>")


def _matrix(bands: pa.ChunkedArray) -> np.ndarray:
    return np.array(bands.combine_chunks().flatten()).reshape(-1, BANDS)


def _wanted(table: pa.Table) -> np.ndarray:
    """Which pairs of a unit's rows are looked at here: this is their first common band, and their chunks are the unit's two."""
    bands, band = _matrix(table["bands"]), table["band"][0].as_py()
    found = np.ones((len(bands), len(bands)), bool)
    for k in range(band):
        found &= bands[:, None, k] != bands[None, :, k]
    np.fill_diagonal(found, False)
    if table["i"][0].as_py() != table["j"][0].as_py():
        chunk = table["chunk"].to_numpy()
        found &= chunk[:, None] != chunk[None, :]
    return found


_UNIT = ["value", "i", "j"]  # the value is hashed with the band, and makes a good sort prefix
_UNIT_ROW = "band int, value long, i int, j int, chunk int, key binary, id long, bands array<long>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of units that have a pair to look at in theirs."""
    for table in groups(batches, _UNIT):
        if table.num_rows > 1:
            kept = _wanted(table).any(axis=1)
            if kept.any():
                yield from table.filter(pa.array(kept)).to_batches()


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """The similarity of each pair of sorted sets; counted over slices of the n-grams that any has, so memory is bounded."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        value = common / max(1, sizes.sum() - common)
        return np.array([[1.0, value], [value, 1.0]])
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, (1 << 22) // len(sets))
    for at in range(0, len(grams), width):
        a, b = np.searchsorted(column, [at, at + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        common += has @ has.T
    return common / np.maximum(1, sizes[:, None] + sizes[None, :] - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a unit its links there, and a class of its local group."""
    for table in groups(batches, _UNIT):
        if table.num_rows < 2:
            continue
        sets = [np.unique(gram_hashes(x)) for x in table["joined"].to_pylist()]
        linked = _wanted(table) & (jaccard(sets) >= LEAST - 1e-9)
        rows = np.flatnonzero(linked.any(axis=1))
        if len(rows):
            local, keys = Local(len(sets)), table["key"].to_pylist()
            for a in rows.tolist():
                for b in np.flatnonzero(linked[a]).tolist():
                    if local.root(a) != local.root(b):
                        local.join(a, b)
            counts = linked.sum(axis=1)[rows]
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in rows], pa.binary()), pa.array(counts, pa.int64()), pa.array([keys[local.root(k)] for k in rows.tolist()], pa.binary())], names=["key", "links", "near"])


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row a row of `doc_id, text`: `doc_id, class_id, copy_of, n_copies, n_links`.

    `copy_of` is the least doc_id with the same words, `n_copies` how many rows have them, `n_links` how many other texts
    are similar, and `class_id` the least doc_id that links and copies lead to, over any number of steps. Texts without
    words, and nulls, are copies of each other and similar to none. A null doc_id is passed over where a least is taken.
    Only the two columns are read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(_signed(docs), "signatures")
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("id", F.xxhash64("key")), "classes")
    banded = classes.where(F.size("bands") > 0).select("key", "id", "bands", F.posexplode("bands").alias("band", "value"))
    units = pair_units(banded, "value", "id", UNIT).select(*[x.split()[0] for x in _UNIT_ROW.split(", ")])
    near = written(_dealt(units).mapInArrow(_candidates, _UNIT_ROW), "candidates")
    asked = spark.sparkContext.broadcast(membership(near.select("id").distinct(), "id"))
    wanted = _asked(docs, asked)
    joined = near.hint("merge").join(wanted, "key")
    found = written(_dealt(joined.select(*near.columns, "joined")).mapInArrow(_verified, "key binary, links long, near binary"), "verified")
    counts = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    roots = connected(found.select(F.col("key").alias("a"), F.col("near").alias("b")))
    linked = classes.select("key", "copy_of").hint("merge").join(roots.withColumnRenamed("node", "key"), "key")
    least = linked.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    linked = linked.select("key", "root").hint("merge").join(least, "root").select("key", "class_id").hint("merge").join(counts, "key")
    linked = linked.select(F.col("key").alias("linked"), "class_id", "n_links")
    told = classes.select("key", "copy_of", "n_copies").hint("merge").join(linked, F.col("key") == F.col("linked"), "left")
    told = written(told.select("key", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "told")
    return signed.select("doc_id", "key").hint("merge").join(told, "key").drop("key")


def _dealt(units: DataFrame) -> DataFrame:
    return units.repartition(*_UNIT).sortWithinPartitions(*_UNIT)


def _asked(docs: DataFrame, bitmap) -> DataFrame:
    """`key, joined` of the classes that a bitmap of hashed keys has: a second pass over the texts instead of a shuffle of all.

    A class that many documents are copies of is handed on once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = dict(class_key(x) for x in batch.column("text").to_pylist())
            keys = list(found)
            ids = np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64)
            kept = np.flatnonzero(among(bitmap.value, ids)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in kept], pa.binary()), pa.array([found[keys[k]] for k in kept], pa.binary())], names=["key", "joined"])

    return docs.select("text").mapInArrow(run, "key binary, joined binary").groupBy("key").agg(F.first("joined").alias("joined"))


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
