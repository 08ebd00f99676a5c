"""Tables that the queries derive from the given ones, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows for work that is heavy on the CPU: dealt out anew where their scan has fewer tasks than the cluster has cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of 1/100 MB a character and 12 characters a page."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"))
    return d.select(F.col("doc_id").alias("file_id"), (F.col("n_chars") / 100.0).alias("size_mb"), F.greatest(F.lit(1), F.floor(F.col("n_chars") / 12)).cast("int").alias("total_pages"), F.col("source").alias("batch_id"))


def big_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as large files."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("file_id"), (F.col("o_totalprice") / 100.0).alias("size_mb"), (F.col("o_orderkey") % 3000 + 1).cast("int").alias("total_pages"), F.col("o_orderpriority").alias("batch_id"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processing runs."""
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(e: DataFrame) -> DataFrame:
    k = F.col("event_id")
    message = F.when(k % 7 == 0, "HTTP 429 Too Many Requests").when(k % 11 == 0, "error 3310: file could not be fetched from URL").when(F.col("event_type") == "error", "boom")
    return e.select(k.alias("run_id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("original_file"), F.col("value").alias("size_mb"), (k % 50).alias("pages"), (k % 3).cast("double").alias("upload_s"), (k % 5).cast("double").alias("process_s"), (k % 2).cast("double").alias("save_s"), (k % 9 + 1).cast("double").alias("total_s"), message.alias("error"), F.col("ts").cast("timestamp").alias("ts"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of pages."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_idx"), F.col("text").alias("markdown"), F.length("text").alias("size"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with recognition errors put in by doc_id."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.replace("text", F.lit(" the "), F.lit(" rn ¦the  "))).when(k == 1, F.replace("text", F.lit("in "), F.lit("in-\n"))).when(k == 2, F.replace("text", F.lit(", "), F.lit(" ,"))).otherwise(F.concat("text", F.lit(" l0O5 -- 1/2 <= '' `` ARTICULO 2do")))
    return spread(d).select("doc_id", "lang", text.alias("text"))


def legal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines with the marks of a law put in by line number."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n = F.col("line_no") % 7
    first = F.concat(F.lit("Artículo "), (F.floor(F.col("line_no") / 7) + 1).cast("string"), F.lit(".- "), F.col("line"))
    marked = F.when(n == 0, first).when(n == 2, F.concat(F.lit("II. "), F.col("line"))).when(n == 3, F.concat(F.lit("a) "), F.col("line"))).when(n == 5, F.lit("Párrafo adicionado DOF 01-02-2020")).otherwise(F.col("line"))
    return lines.select("doc_id", "line_no", marked.alias("line"))


FILES_SQL = "files AS (SELECT doc_id AS file_id, n_chars / CAST(100 AS DOUBLE) AS size_mb, CAST(greatest(1, n_chars // 12) AS INTEGER) AS total_pages, source AS batch_id FROM documents)"
BIG_FILES_SQL = "files AS (SELECT o_orderkey AS file_id, o_totalprice / CAST(100 AS DOUBLE) AS size_mb, CAST(o_orderkey % 3000 + 1 AS INTEGER) AS total_pages, o_orderpriority AS batch_id FROM orders)"
RUNS_SQL = """runs AS (SELECT event_id AS run_id, 'f' || CAST(user_id AS VARCHAR) AS original_file, value AS size_mb, event_id % 50 AS pages,
    CAST(event_id % 3 AS DOUBLE) AS upload_s, CAST(event_id % 5 AS DOUBLE) AS process_s, CAST(event_id % 2 AS DOUBLE) AS save_s, CAST(event_id % 9 + 1 AS DOUBLE) AS total_s,
    CASE WHEN event_id % 7 = 0 THEN 'HTTP 429 Too Many Requests' WHEN event_id % 11 = 0 THEN 'error 3310: file could not be fetched from URL' WHEN event_type = 'error' THEN 'boom' END AS error, ts FROM events)"""
PAGES_SQL = "doc_pages AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_idx, text AS markdown, length(text) AS size FROM conversations)"
