"""Histograms, thresholds and the registry of temporary files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256


def histogram(df: DataFrame, value: str, group: str, low: float, high: float) -> DataFrame:
    """`group, counts`: the dense histogram of a numeric column in 256 bins from low to high, one array a group.

    Values are counted by bin before groups are put together, so a task sees 256 rows of a group at most.
    """
    at = F.floor((F.col(value) - low) / (high - low) * BINS).cast("int")
    binned = df.where(F.col(value).isNotNull()).groupBy(group, F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"))
    held = binned.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return held.select(group, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0))).alias("counts"))


def otsu_threshold(df: DataFrame, value: str, group: str, low: float, high: float, parity: bool = False) -> DataFrame:
    """`group, threshold`: the bin that parts two classes with the most variance between them; the first of equals.

    With `parity`, the class above has the bin itself in its sum but not in its weight, as in the original program.
    """
    counts = F.col("counts")
    found = histogram(df, value, group, low, high).withColumns({"total": F.aggregate(counts, F.lit(0).cast("double"), lambda a, n: a + n), "moment": F.aggregate(F.transform(counts, lambda n, k: n.cast("double") * k), F.lit(0.0), lambda a, x: a + x)})
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("m"), F.lit(-1.0).alias("best"), F.lit(0).alias("at"))
    steps = F.transform(counts, lambda n, k: F.struct(n.cast("double").alias("n"), k.alias("k")))

    def step(a: Column, x: Column) -> Column:
        w, m = a["w"] + x["n"], a["m"] + x["n"] * x["k"]
        above = F.col("total") - w
        rest = F.col("moment") - (a["m"] if parity else m)
        between = F.when((w > 0) & (above > 0), w * above * F.pow(m / w - rest / above, F.lit(2.0))).otherwise(-1.0)
        better = between > a["best"]
        return F.struct(w.alias("w"), m.alias("m"), F.when(better, between).otherwise(a["best"]).alias("best"), F.when(better, x["k"]).otherwise(a["at"]).alias("at"))

    return found.select(group, F.aggregate(steps, start, step, lambda a: a["at"]).alias("threshold"))


def histogram_variance(df: DataFrame, value: str, group: str, low: float, high: float, most: float = 10000.0) -> DataFrame:
    """`group, variance, flat`: the population variance of the 256 counts, and whether it is under a bound."""
    counts = F.col("counts")
    mean = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n) / BINS
    found = histogram(df, value, group, low, high).withColumn("mean", mean)
    variance = F.aggregate(counts, F.lit(0.0), lambda a, n: a + F.pow(n - F.col("mean"), F.lit(2.0))) / BINS
    return found.select(group, variance.alias("variance")).withColumn("flat", F.col("variance") < most)


def is_expired(now: Column) -> Column:
    """Whether a registry row `created, cleanup_after` (seconds) is past its time."""
    return now - F.col("created") > F.col("cleanup_after")


def registry_status(registry: DataFrame, now: Column) -> DataFrame:
    """For each file type its files, how many may be cleaned up, and MB."""
    return registry.groupBy("file_type").agg(F.count("*").alias("n_files"), F.count_if(is_expired(now)).alias("n_ready"), F.sum("size_mb").alias("size_mb"))


def temp_files_for(registry: DataFrame, originals: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """The registry's files of given originals that are past their time, or all with `force`."""
    found = registry.join(originals.select("original").distinct(), "original", "left_semi")
    return found if force else found.where(is_expired(now))


def glob_pattern(glob: str) -> str:
    """A regular expression for a file glob."""
    out = {"*": "[^/]*", "?": "[^/]"}
    return "(?:^|/)" + "".join(out.get(c, "\\" + c if c in r"\.+^$()[]{}|" else c) for c in glob) + "$"


def temp_files_matching(registry: DataFrame, glob: str, file_type: str | None = None) -> DataFrame:
    found = registry.where(F.col("path").rlike(glob_pattern(glob)))
    return found if file_type is None else found.where(F.col("file_type") == file_type)


def upload_cache_hits(uploads: DataFrame, ttl_s: int = 43_200) -> DataFrame:
    """`content_hash, ts, hit`: an upload is a hit within `ttl_s` seconds of the last one of its hash that was none.

    The uploads of a hash pass one task in order, a batch at a time, and only the time of the last miss is held. From a
    miss the next one is found by a search, so that hits in between cost nothing. Rows without a time are left out; a
    null hash is a hash of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ttl, key, last = ttl_s * 1_000_000, "", None
        for batch in batches:
            if not batch.num_rows:
                continue
            ts = batch.column("ts").cast(pa.int64()).to_numpy()
            codes = pc.dictionary_encode(batch.column("content_hash"), null_encoding="encode")
            group = codes.indices.to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            hit = np.ones(batch.num_rows, bool)
            for at, end in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows], strict=True):
                own = codes.dictionary[group[at]].as_py()
                if at or own != key:
                    key, last = own, None
                place = at if last is None else at + int(np.searchsorted(ts[at:end], last + ttl))
                while place < end:
                    hit[place], last = False, int(ts[place])
                    place += int(np.searchsorted(ts[place:end], last + ttl))
            yield pa.RecordBatch.from_arrays([batch.column("content_hash"), batch.column("ts"), pa.array(hit)], names=["content_hash", "ts", "hit"])

    dealt = uploads.select(F.col("content_hash").cast("string"), F.col("ts").cast("timestamp")).where("ts is not null")
    return dealt.repartition("content_hash").sortWithinPartitions("content_hash", "ts").mapInArrow(run, "content_hash string, ts timestamp, hit boolean")


def parts_to_original(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Parts with the columns of their original file."""
    return parts.join(files.withColumnRenamed("file_id", "original_file"), "original_file")
