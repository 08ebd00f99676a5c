"""Streams over the given tables, run to their end and read back as tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.plans import views as V
from pagemill.sources.shared import shared_folder
from pagemill.streaming import streams


def _opened(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # as a pattern, the path may be one file or a folder of files
    return spark.readStream.schema(V.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything a stream gives for what its sources hold now, written to the shared folder and read back."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out-{number}")
        last[0] = f"{folder}/out-{number}"

    last = [""]
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_to_end(streams.score_stream(_opened(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "total_words", F.round("score", 6).alias("score"))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _opened(spark, sf_dir, "events")
    runs = V.runs_of(e)
    found = run_to_end(streams.throughput_stream(runs, "1 day"), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "bucket", "n_runs", "n_failed", "pages", F.round("pages_per_s", 6).alias("pages_per_s"))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that state of any kind needs, and as many of its partitions as the cluster has cores, while a stream runs.

    Each micro-batch starts a worker for every partition, however few rows it has.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Into how many files a micro-batch is written, so that as many tasks read it.
FILES = 24


def in_batches(rows: DataFrame, batch: str, ts: str, drain: dict) -> DataFrame:
    """A stream of a table, about a micro-batch for each value of `batch` in order, and then one row whose time passes all others.

    `drain` has that row's other values; its time is a year after the last. Without it the rows of the last `delay` would
    wait for ever. The table is dealt by batch once; then each batch is read by itself and written as FILES files, by so
    many tasks. Of a batch with fewer rows than files, the next one's files make up the number. Rows without a batch are
    left out.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "batches")
    kept = rows.drop(batch)
    rows.where(F.col(batch).isNotNull()).write.partitionBy(batch).parquet(f"{folder}/dealt")
    dealt = spark.read.schema(rows.schema).parquet(f"{folder}/dealt")
    numbers = [r[0] for r in dealt.select(batch).distinct().orderBy(batch).collect()]
    for n in numbers:
        dealt.where(F.col(batch) == n).select(*kept.columns).repartition(FILES).write.mode("append").parquet(f"{folder}/in")
    last = rows.agg((F.max(ts) + F.expr("interval 365 days")).alias(ts)).withColumns({k: F.lit(v) for k, v in drain.items()})
    last.select(*[F.col(f.name).cast(f.dataType) for f in kept.schema]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in")


def _mixed(e: DataFrame) -> DataFrame:
    """Events with a batch of ten days, from which some come one or two batches late."""
    day = F.floor(F.unix_micros("ts") / (10 * 86_400_000_000))
    return e.withColumn("batch", day + F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 3).otherwise(0))


def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    r = _mixed(e).select("batch", F.concat(F.lit("tmp/"), F.col("user_id").cast("string"), F.col("event_type")).alias("path"), F.col("event_type").alias("file_type"), "ts", F.when(F.col("event_id") % 2 == 0, 86_400).otherwise(7200).alias("cleanup_after"))
    with state_store(spark):
        found = run_to_end(streams.expire_registry(in_batches(r, "batch", "ts", {"path": "drain", "file_type": "", "cleanup_after": 0}), delay="40 days"))
    return found.where("path <> 'drain'").select("path", "file_type", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    u = _mixed(e).select("batch", F.md5(F.concat_ws("|", F.col("user_id"), F.col("event_type"))).alias("content_hash"), "ts")
    with state_store(spark):
        found = run_to_end(streams.dedup_uploads(in_batches(u, "batch", "ts", {"content_hash": "drain"}), delay="40 days"))
    return found.where("content_hash <> 'drain'").groupBy("content_hash").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hits"))
