"""Near-duplicate documents by SuperMinHash: correlated ranks, banding, verification on full sets, and union-find.

A document's set are its distinct five-word shingles. Each shingle seeds one random permutation of the `SIZE` places of a
signature; a place keeps the least (rank in a shingle's permutation, fraction) over all shingles. As the ranks of a shingle
are all different, places are negatively correlated and their estimate varies less than that of independent minima.
Ranks are met in order, level by level over all shingles at once, and once every place is taken no later level can
change one, so most texts end after the first.

A place is kept as one byte of its value, and a band is five places, so `SKETCH` bytes hold both the bands and an
estimate of similarity. Documents of equal words are one class and one sketch. Classes that share a band are candidates
where at least `PLAUSIBLE` of the places agree; a pair of similarity 0.85 agrees in fewer with a probability under 1e-9,
and shares none of the 20 bands with one of (1 - 0.85^5)^20 = 0.000008.

Candidates are verified in two rounds. First each class goes to the largest bucket that it is in, where the classes of a
chunk meet, and union-find joins those that are similar. Copies of one text mostly are one group then, and all their
other buckets hold one group only and are done. What is left, buckets in which two groups or more meet, is verified
pair by pair of chunks, and only pairs of different groups. So texts travel about once a class, and a group that holds a
third of all rows costs chunks, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.components import Local, among, connected, groups, membership
from pagemill.llm.minhash_join import gram_hashes
from pagemill.llm.shared import small, written

GRAM = 5
LEAST = 85  # of 100: a link has 100 * intersection >= LEAST * union
BANDS, ROWS = 20, 5
SIZE = BANDS * ROWS
PLAUSIBLE = 60  # places of two sketches that agree at least
UNIT = 1000  # weight of classes that are compared in one unit of work; a class of many shingles weighs more
HEAVY = 500  # shingles that add one to the weight
_SPLIT = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z lower-cased, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def class_of(text: str | None) -> tuple[bytes, bytes]:
    """(the 128-bit key of a text's words, the words joined)."""
    joined = b" ".join(words_of(text))
    return xxhash.xxh3_128_digest(joined), joined


def shingles(joined: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of joined words; fewer words than five, but not none, are one shingle."""
    return np.unique(gram_hashes(joined, GRAM))


def _draw(seeds: np.ndarray, level: int) -> np.ndarray:
    x = seeds + _U64((level + 1) * _STEP & (1 << 64) - 1)
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def signature(grams: np.ndarray, size: int = SIZE, chunk: int = 4096) -> np.ndarray:
    """The least (rank << 32 | fraction) of each of `size` places; of an empty set all bits are set."""
    least = np.full(size, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(grams), chunk):
        part = grams[at : at + chunk]
        rows, places, first = np.arange(len(part)), None, np.zeros(0, np.int64)
        for level in range(size):
            drawn = _draw(part, level)
            other = (level + (((drawn & _U64(0xFFFFFFFF)) * _U64(size - level)) >> _U64(32)).astype(np.int64)).astype(np.int64)
            if level == 0:
                place = first = other
            else:
                if places is None:  # the permutations so far: their first place and another have changed
                    places = np.tile(np.arange(size, dtype=np.int16), (len(part), 1))
                    places[rows, first] = 0
                place = places[rows, other].astype(np.int64)
                places[rows, other] = places[rows, level]
            np.minimum.at(least, place, (drawn >> _U64(32)) | _U64(level << 32))
            if int(least.max()) >> 32 <= level:
                break
    return least


def sketch(grams: np.ndarray) -> bytes:
    """One byte of each place of the signature; no bytes for an empty set."""
    return (_draw(signature(grams), 0) >> _U64(56)).astype(np.uint8).tobytes() if len(grams) else b""


def _signed(docs: DataFrame) -> DataFrame:
    """`doc_id, key, n_shingles, sketch`."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, sizes, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                key, joined = class_of(text)
                grams = shingles(joined)
                keys.append(key)
                sizes.append(len(grams))
                sketches.append(sketch(grams))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "key", "n_shingles", "sketch"])

    return docs.mapInArrow(sign, "doc_id long, key binary, n_shingles long, sketch binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sorted sets has in common; the sets are cut into slices of their elements, so memory is bounded."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    column = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    common = np.zeros((len(sets), len(sets)), np.int64)
    width = max(64, (1 << 22) // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        common += (has @ has.T).astype(np.int64)
    return common


_UNIT_KEY = ["value", "i", "j"]
_UNIT_ROW = "value long, i int, j int, across boolean, lane int, band int, key binary, sketch binary, root binary, tried long"


def _columns() -> list[str]:
    return [x.split()[0] for x in _UNIT_ROW.split(", ")]


def _wanted(table: pa.Table) -> np.ndarray:
    """Which pairs of a unit are looked at: plausible, of two groups, not tried before, and this is their first common band.

    In a unit of two lanes, only pairs across them.
    """
    sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SIZE)
    n, band, across = len(sketches), table["band"][0].as_py(), table["across"][0].as_py()
    roots = table["root"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    tried, lane = table["tried"].to_numpy(), table["lane"].to_numpy()
    found = np.zeros((n, n), bool)
    for k in range(n - 1):
        same = sketches[k + 1 :] == sketches[k]
        ok = (same.sum(axis=1) >= PLAUSIBLE) & (roots[k + 1 :] != roots[k]) & ((tried[k + 1 :] != tried[k]) | (tried[k] == 0))
        if across:
            ok &= lane[k + 1 :] != lane[k]
        if band and ok.any():
            ok &= ~same[:, : band * ROWS].reshape(len(same), band, ROWS).all(axis=2).any(axis=1)
        found[k, k + 1 :] = ok
    return found | found.T


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of units that have a pair to look at in theirs."""
    for table in groups(batches, _UNIT_KEY):
        kept = _wanted(table).any(axis=1)
        if kept.any():
            yield from table.filter(pa.array(kept)).to_batches()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a unit that join two of its groups: one less than a group has classes, whatever the number of pairs."""
    for table in groups(batches, _UNIT_KEY):
        sets = [shingles(x) for x in table["joined"].to_pylist()]
        sizes, common = np.array([len(s) for s in sets]), overlaps(sets)
        linked = np.triu(_wanted(table), 1) & (100 * common >= LEAST * (sizes[:, None] + sizes[None, :] - common))
        local, keys, found = Local(len(sets)), table["key"].to_pylist(), []
        for a, b in np.argwhere(linked).tolist():
            if local.root(a) != local.root(b):
                local.join(a, b)
                found.append((keys[a], keys[b]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """`key, joined` of the classes asked for, and of a few others: a second pass over the texts instead of a shuffle of all."""
    bitmap = docs.sparkSession.sparkContext.broadcast(membership(keys.select(F.xxhash64("key").alias("id")).distinct(), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = dict(class_of(x) for x in batch.column("text").to_pylist())
            held = list(found)
            ids = np.array([xxhash.xxh64_intdigest(k, 42) for k in held], np.uint64)
            kept = np.flatnonzero(among(bitmap.value, ids)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([held[k] for k in kept], pa.binary()), pa.array([found[held[k]] for k in kept], pa.binary())], names=["key", "joined"])

    return docs.select("text").mapInArrow(run, "key binary, joined binary").groupBy("key").agg(F.first("joined").alias("joined"))


def _links(docs: DataFrame, units: DataFrame) -> DataFrame:
    """`a, b`: links between classes of the units that suffice to join what is similar in them."""
    dealt = lambda rows: rows.repartition(*_UNIT_KEY).sortWithinPartitions(*_UNIT_KEY)
    near = written(dealt(units.select(*_columns())).mapInArrow(_candidates, _UNIT_ROW), "candidates")
    joined = near.hint("merge").join(_texts(docs, near), "key").select(*_columns(), "joined")
    return written(dealt(joined).mapInArrow(_verified, "a binary, b binary"), "links")


def _first_units(near: DataFrame, classes: DataFrame) -> DataFrame:
    """Each class in its largest bucket (of equal ones the least), in one chunk of it."""
    largest = near.groupBy("key").agg(F.max(F.struct("n", "value", "weight")).alias("x")).select("key", "x.value", "x.weight")
    chunk = F.pmod(F.xxhash64(F.lit(7), "key"), F.ceil(F.col("weight") / UNIT)).cast("int")
    return largest.hint("merge").join(classes.select("key", "sketch"), "key").select("value", chunk.alias("i"), F.lit(0).alias("j"), F.lit(False).alias("across"), F.lit(0).alias("lane"), F.lit(0).alias("band"), "key", "sketch", F.col("key").alias("root"), F.lit(0).cast("long").alias("tried"))


def _second_units(near: DataFrame, first: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """The buckets in which two groups or more meet, each once for all or, if large, cut into pairs of chunks.

    The rows of a bucket's main group don't meet each other: a chunk of them meets each chunk of the others.
    """
    known = first.select("key", F.xxhash64("value", "i").alias("tried")).hint("merge").join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = known.select("key", "tried", F.coalesce("root", "key").alias("root")).hint("merge").join(classes.select("key", "own"), "key")
    rows = written(near.select("value", "band", "key").hint("merge").join(known, "key"), "rooted")
    by_root = rows.groupBy("value", "root").agg(F.sum("own").alias("w"))
    mixed = by_root.groupBy("value").agg(F.count("*").alias("n"), F.max(F.struct("w", "root")).alias("m"), F.sum("w").alias("all"))
    mixed = written(mixed.where("n > 1").select("value", F.col("m.root").alias("main"), F.col("m.w").alias("w_main"), (F.col("all") - F.col("m.w")).alias("w_rest")), "mixed")
    rows = rows.hint("merge").join(mixed, "value").hint("merge").join(classes.select("key", "sketch"), "key")
    small_, main = F.col("w_main") + F.col("w_rest") <= UNIT, F.col("root") == F.col("main")
    chunks = lambda w: F.ceil(F.col(w) / UNIT).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), "key"), F.when(main, chunks("w_main")).otherwise(chunks("w_rest"))).cast("int")
    unit = lambda i, j, across, lane: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), across.alias("across"), lane.cast("int").alias("lane"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    of_main = F.transform(every(chunks("w_rest")), lambda j: unit(F.col("own_chunk"), j, F.lit(True), F.lit(-1)))
    of_rest = F.concat(
        F.transform(every(chunks("w_main")), lambda i: unit(i, F.col("own_chunk"), F.lit(True), F.col("own_chunk"))),
        F.transform(every(chunks("w_rest")), lambda j: unit(-1 - F.least(j, "own_chunk"), F.greatest(j, "own_chunk"), j != F.col("own_chunk"), F.col("own_chunk"))),
    )
    whole = F.array(unit(F.lit(0), F.lit(0), F.lit(False), F.lit(0)))
    return rows.withColumn("own_chunk", own).withColumn("unit", F.explode(F.when(small_, whole).when(main, of_main).otherwise(of_rest))).select("*", "unit.*").select(*_columns())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a row of `doc_id, text`: `doc_id, n_shingles, component_id, kept`.

    `component_id` is the least doc_id that links lead to over any number of steps, itself included, and `kept` says
    whether it is the row's own. Equal word sequences are linked. A text that is null, empty or has no words has no
    shingles and is linked with nothing. A null doc_id is passed over where a least is taken; a group of nulls only, has a
    null component and its rows are kept. Repeated rows are copies. Only the two columns are read, whatever else docs has.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(_signed(docs), "sketches")
    classes = signed.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("own", 1 + F.floor(F.col("n_shingles") / HEAVY)), "classes")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    banded = classes.select("key", "own", F.posexplode(bands).alias("band", "value"))
    crowded = written(banded.groupBy("value").agg(F.count("*").alias("n"), F.sum("own").alias("weight")).where("n > 1"), "crowded")
    near = written(banded.select("value", "band", "key").hint("merge").join(crowded, "value"), "near")
    first = written(_first_units(near, classes), "first")
    links = _links(docs, first)
    roots = connected(links)
    more = _links(docs, _second_units(near, first, roots, classes))
    if not more.isEmpty():
        roots = connected(links.unionByName(more))
    named = classes.select("key", "least").hint("merge").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    told = written(named.select("key", "root").hint("merge").join(lowest, "root").select("key", "component_id"), "told")
    found = signed.select("doc_id", "key", "n_shingles").hint("merge").join(told, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op13_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
