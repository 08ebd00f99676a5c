"""Removal of byte strings that occur elsewhere, by a difference-cover suffix sort that needs a depth of 200 bytes only.

A difference cover is a sample of positions such that any two equal stretches hold a sampled position at the same
distance. Here content chooses it: of each run of `DEPTH - TUPLE + 1` tuples (100 bytes each) the one of least hash is
sampled, and so is that of every 200-byte window. About 2 % of the positions are sampled, where a cover by residues modulo
3 samples 67 %, and each window start has one canonical sample at the same offset in all its occurrences.

1. Sort the samples by the name (hash) of their tuple; a window of a sample whose name is unique occurs once.
2. Recurse on names: the name of the three tuples around a sample (what its windows cover, 300 bytes at most) spans the
   whole depth, so one level settles the samples whose triple occurs twice or more: all their windows are repeated.
3. Merge the remaining suffixes: the window starts of the other triples of a repeated name are sorted within the name by
   offset and 200-byte prefix, and adjacent prefixes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.components import among, groups, membership
from pagemill.llm.minhash_join import _mixed, _Powers
from pagemill.llm.shared import small, written

DEPTH = 200
TUPLE = 100
PIECE = 1 << 19  # bytes of a text that are sampled at once; pieces overlap by less than a window
LOCAL = 2000  # triples of a name that are merged in one task; those of larger names are merged by a shuffle on windows
_U64 = np.uint64
_LOW = _U64((1 << 20) - 1)


def _prefix_sums(octets: np.ndarray) -> np.ndarray:
    up, _ = _Powers.to(len(octets) + 1)
    return np.concatenate([[_U64(0)], np.cumsum((octets.astype(np.uint64) + _U64(1)) * up[: len(octets)])])


def _hashes(sums: np.ndarray, begin: np.ndarray, size) -> np.ndarray:
    """Of the stretches from `begin` on of a given size."""
    _, down = _Powers.to(len(sums))
    return _mixed((sums[begin + size] - sums[begin]) * down[begin])


def _piece_samples(octets: np.ndarray) -> tuple[np.ndarray, ...]:
    sums = _prefix_sums(octets)
    count, width = len(octets) - TUPLE + 1, DEPTH - TUPLE + 1
    hashes = _hashes(sums, np.arange(count), TUPLE)
    ranked = (hashes & ~_LOW) | (_LOW - np.arange(count, dtype=np.uint64))  # of equal ones the last
    padded = np.full(-(-count // width) * width, ~_U64(0))
    padded[:count] = ranked
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: count - width + 1], ahead[width - 1 : count])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    at = (_LOW - (least[first] & _LOW)).astype(np.int64)
    whole = _mixed(_hashes(sums, first, last + DEPTH - first) + (at - first).astype(np.uint64) * _U64(0x9E3779B97F4A7C15))
    return at, first, last, hashes[at].view(np.int64), whole.view(np.int64)


def samples(octets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, first and last start of its windows, name of its tuple, name of its triple) of each sample of a text."""
    found = []
    for begin in range(0, max(0, len(octets) - DEPTH + 1), PIECE):
        at, first, last, name, triple = _piece_samples(octets[begin : begin + PIECE + DEPTH - 1])
        found.append((at + begin, first + begin, last + begin, name, triple))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sampled(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    for k, text in enumerate(batch.column("text").to_pylist()):
        if text and len(text) * 4 >= DEPTH:
            octets = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            if len(octets) >= DEPTH:
                yield k, octets, samples(octets)


def _names(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names = [s[3] for _, _, s in _sampled(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *names]))], names=["name"])

    return docs.select("text").mapInArrow(run, "name long")


def _repeated(docs: DataFrame, bitmap) -> DataFrame:
    """The samples whose name a bitmap of repeated names has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows, columns = [], []
            for k, _, found in _sampled(batch):
                kept = among(bitmap.value, found[3])
                if kept.any():
                    rows.append(np.full(int(kept.sum()), k))
                    columns.append([x[kept] for x in found])
            if rows:
                taken = pa.array(np.concatenate(rows))
                arrays = [batch.column("doc_id").take(taken), batch.column("text_id").take(taken), *(pa.array(np.concatenate(x)) for x in zip(*columns, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_id", "at", "first", "last", "name", "triple"])

    return docs.select("doc_id", "text_id", "text").mapInArrow(run, "doc_id long, text_id long, at long, first long, last long, name long, triple long")


def _contexts(docs: DataFrame, bitmap) -> DataFrame:
    """`name, triple, before, octets` of the triples that a bitmap has: `before` bytes of them are ahead of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows: dict[int, tuple] = {}
            for _, octets, (at, first, last, name, triple) in _sampled(batch):
                for k in np.flatnonzero(among(bitmap.value, triple)).tolist():
                    if triple[k] not in rows:
                        rows[triple[k]] = (name[k], triple[k], at[k] - first[k], octets[first[k] : last[k] + DEPTH].tobytes())
            if rows:
                name, triple, before, octets = zip(*rows.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(triple, pa.int64()), pa.array(before, pa.int32()), pa.array(octets, pa.binary())], names=["name", "triple", "before", "octets"])

    found = docs.select("text").mapInArrow(run, "name long, triple long, before int, octets binary")
    return found.groupBy("triple").agg(F.first("name").alias("name"), F.first("before").alias("before"), F.first("octets").alias("octets"))


def _windows(before: int, octets: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offset of the sample in each window of a triple, hash of the window's 200 bytes)."""
    sums = _prefix_sums(np.frombuffer(octets, np.uint8))
    begin = np.arange(len(octets) - DEPTH + 1)
    return before - begin, _mixed(_hashes(sums, begin, DEPTH) + (before - begin).astype(np.uint64))


def _spans(offsets: np.ndarray) -> list[dict[str, int]]:
    """Runs of sample offsets, as where their windows begin, from the sample's position."""
    starts = np.sort(-offsets)
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [{"a": int(x[0]), "b": int(x[-1])} for x in np.split(starts, cut)]


_RUNS = "triple long, runs array<struct<a: int, b: int>>"
_RUNS_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each triple that another triple of the name has: sorted, with equal neighbours."""
    for table in groups(batches, ["name"]):
        if table.num_rows < 2:
            continue
        parts = [_windows(a, b) for a, b in zip(table["before"].to_pylist(), table["octets"].to_pylist(), strict=True)]
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        offset, window = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        hit = np.zeros(len(window), bool)
        hit[order] = np.append(same, False) | np.append(False, same)
        rows = np.unique(owner[hit]).tolist()
        if rows:
            triples = table["triple"].to_numpy()
            runs = [_spans(offset[hit & (owner == k)]) for k in rows]
            yield pa.RecordBatch.from_arrays([pa.array(triples[rows]), pa.array(runs, _RUNS_ARROW)], names=["triple", "runs"])


def _merged_by_shuffle(contexts: DataFrame) -> DataFrame:
    """The same for names of very many triples: the windows themselves are the rows, and meet by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for triple, before, octets in zip(*(batch.column(c).to_pylist() for c in ("triple", "before", "octets")), strict=True):
                offset, window = _windows(before, octets)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(offset), triple)), pa.array(offset), pa.array(window.view(np.int64))], names=["triple", "offset", "window"])

    rows = written(contexts.mapInArrow(run, "triple long, offset long, window long"), "windows")
    repeated = written(rows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "repeated-windows")
    hits = rows.hint("merge").join(repeated, "window").groupBy("triple").agg(F.sort_array(F.collect_list((-F.col("offset")).cast("int"))).alias("starts"))
    return hits.select("triple", F.transform("starts", lambda s: F.struct(s.alias("a"), s.alias("b"))).alias("runs"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """`doc_id, text_id, spans`: byte spans [a, b) of a text that 200-byte strings which also start elsewhere cover.

    `docs` has `doc_id, text_id, text`; spans may overlap. Texts without any have no row.
    """
    context = docs.sparkSession.sparkContext
    names = written(_names(docs).groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "repeated-names")
    found = written(_repeated(docs, context.broadcast(membership(names, "name"))), "samples")
    triples = written(found.groupBy("name", "triple").agg(F.count("*").alias("n")), "triples")
    several = written(triples.groupBy("name").agg(F.count("*").alias("m")).where("m > 1"), "names-to-merge")
    open_ = triples.hint("merge").join(several, "name")
    bitmap = context.broadcast(membership(open_.select("triple"), "triple"))
    contexts = written(_contexts(docs, bitmap).hint("merge").join(several.select("name", "m"), "name"), "contexts")
    local = contexts.where(F.col("m") <= LOCAL).select("name", "triple", "before", "octets")
    runs = local.repartition("name").sortWithinPartitions("name").mapInArrow(_merged, _RUNS)
    runs = runs.unionByName(_merged_by_shuffle(contexts.where(F.col("m") > LOCAL)))
    whole = triples.where("n > 1").select("triple", F.lit(None).cast("array<struct<a: int, b: int>>").alias("runs"))
    # a triple that occurs twice is repeated whole, whatever its windows
    told = runs.hint("merge").join(whole.select("triple"), "triple", "left_anti").unionByName(whole)
    told = written(told, "repeated-triples")
    hit = found.select("doc_id", "text_id", "at", "first", "last", "triple").hint("merge").join(told, "triple")
    own = F.array(F.struct((F.col("first") - F.col("at")).cast("int").alias("a"), (F.col("last") - F.col("at")).cast("int").alias("b")))
    at = F.col("at")
    spans = F.transform(F.coalesce("runs", own), lambda r: F.struct((at + r["a"]).alias("a"), (at + r["b"] + DEPTH).alias("b")))
    return hit.select("doc_id", "text_id", spans.alias("spans")).groupBy("doc_id", "text_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_KEPT = "doc_id long, n_bytes long, spans array<struct<a: long, b: long>>, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, spans, kept` of each row of `doc_id, text`: the maximal removed runs, and the bytes that stay.

    Only these two columns are read. A null text is empty; texts under 200 bytes stay whole; rows of equal doc_id and
    text are occurrences of their own, so such a text of 200 bytes or more is removed from each.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    spans = written(repeated_spans(docs), "spans").select(F.col("doc_id").alias("own_id"), F.col("text_id").alias("own_text"), "spans")
    joined = docs.hint("merge").join(spans, F.col("text_id").eqNullSafe(F.col("own_text")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in small(batches):
            sizes, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                octets = text.encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(octets)]
                sizes.append(len(octets))
                removed.append([{"a": a, "b": b} for a, b in runs])
                kept.append(b"".join(octets[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(cut, _KEPT)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 200-byte strings leave of every document."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
