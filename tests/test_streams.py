"""Rules with state, by themselves and on streams of mixed order."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import numeric
from pagemill.streaming import runs, streams

SECOND = 1_000_000


def test_a_registration_in_time_renews(spark):
    step = streams._Registry().step
    assert step(("p",), None, [(0, 10, "a"), (5 * SECOND, 10, "b")], 8 * SECOND) == ([], (15 * SECOND, "b"), 15 * SECOND)
    assert step(("p",), (15 * SECOND, "b"), [(15 * SECOND, 10, "c")], 20 * SECOND)[0] == []
    assert step(("p",), (15 * SECOND, "b"), [(16 * SECOND, 10, "c")], 30 * SECOND) == ([(15 * SECOND, "b"), (26 * SECOND, "c")], None, None)


@pytest.mark.parametrize("seed", range(3))
def test_uploads_in_pieces_are_as_in_one(spark, seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(2000) * SECOND,) for _ in range(200))
    whole = streams._Uploads(60).step(("h",), None, rows, 10**12)[0]
    held, out, at = None, [], 0
    while at < len(rows):
        n = rng.randint(1, 20)
        got, held, _ = streams._Uploads(60).step(("h",), held, rows[at : at + n], rows[min(at + n, len(rows)) - 1][0])
        out, at = out + got, at + n
    assert out == whole


def test_streams_of_mixed_order(spark):
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at"))
    rows = [(1, "p", 0, 100), (0, "p", 50, 100), (1, "p", 400, 10), (0, "q", 10, 20), (2, "q", 25, 500), (2, "q", 30, 20), (2, "r", 900, 1)]
    events = spark.createDataFrame(rows, "batch int, path string, at long, cleanup_after int").withColumn("ts", start).withColumn("file_type", F.lit("pdf"))
    with runs.state_store(spark):
        stream = runs.in_batches(events.select("batch", "path", "file_type", "ts", "cleanup_after"), "batch", "ts", {"path": "drain", "file_type": "", "cleanup_after": 0})
        found = runs.run_to_end(streams.expire_registry(stream, "1 day")).where("path <> 'drain'")
    assert sorted((r.path, r.at) for r in found.select("path", (F.unix_timestamp("expired_at") - 1_700_000_000).alias("at")).collect()) == [("p", 150), ("p", 410), ("q", 50), ("r", 901)]


def test_many_uploads_of_one_hash(spark):
    n, ttl = 1_000_000, 7
    rows = spark.range(n).select(F.lit("h").alias("content_hash"), F.timestamp_seconds("id").alias("ts"))
    found = numeric.upload_cache_hits(rows.unionByName(spark.createDataFrame([(None, None), (None, 5.0), ("i", 5.0)], "content_hash string, s double").select("content_hash", F.timestamp_seconds("s").alias("ts"))), ttl)
    got = {r.content_hash: (r.n, r.hits) for r in found.groupBy("content_hash").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).collect()}
    assert got == {"h": (n, n - -(-n // ttl)), None: (1, 0), "i": (1, 0)}


def test_batches_are_read_by_several_tasks_and_state_is_by_group(spark):
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    events = spark.range(3000).select((F.col("id") % 2).alias("batch"), F.concat(F.lit("h"), F.col("id") % 700).alias("content_hash"), ts.alias("ts"))
    with runs.state_store(spark):
        stream = runs.in_batches(events, "batch", "ts", {"content_hash": "drain"})
        written = max(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/batches-*/in"), key=os.path.getmtime)
        assert len(glob.glob(f"{written}/*.parquet")) == 2 * runs.FILES + 1
        deduped = streams.dedup_uploads(stream, 1000, "1 day")
        found = runs.run_to_end(deduped).where("content_hash <> 'drain'")
    assert found.count() == 3000 and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    want = numeric.upload_cache_hits(events.select("content_hash", "ts"), 1000)
    assert found.exceptAll(want).isEmpty()
