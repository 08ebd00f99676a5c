"""Order, offsets and summaries of batches of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.prefix import prefix_sums
from pagemill.plans.planning import Limits, expand_parts, optimal_plan, with_split_needs

# What names number their volume by, and words of service errors.
NUMBERED = [r"vol(?:umen)?[_\s]*(\d+)", r"tomo[_\s]*(\d+)", r"parte[_\s]*(\d+)", r"(\d+)"]
RATE_LIMIT = "429|rate limit|too many requests"
URL_FETCH = "3310|could not be fetched from url"


def order_key(name: Column) -> Column:
    """A struct to order file names by: those with a number first, by volume, tome, part or any number, then by name."""
    low = F.lower(F.regexp_extract(name, r"([^/\\]*)$", 1))
    number = F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in NUMBERED]).cast("decimal(38,0)")
    return F.struct(number.isNull().cast("int").alias("unnumbered"), number.alias("number"), F.when(number.isNull(), low).alias("name"))


def natural_order(files: DataFrame, batch: str, name: str, tie: str) -> DataFrame:
    """Adds `place`, from 1: a file's place in its batch by its name, of equal names by `tie`. No task reads a whole batch."""
    return prefix_sums(files, [batch], [order_key(F.col(name)), F.col(tie)], {"place": F.lit(1).cast("long")})


def page_offsets(files: DataFrame, batch: str, order: str, pages: str = "total_pages") -> DataFrame:
    """Adds `page_offset`: the pages of a batch's files before this one; unknown pages count 0. No task reads a whole batch."""
    own = F.coalesce(F.col(pages), F.lit(0)).cast("long")
    return prefix_sums(files, [batch], [F.col(order)], {"page_offset": own}).withColumn("page_offset", F.col("page_offset") - own)


def processing_plan(files: DataFrame, batch: str, order: str, limits: Limits = Limits()) -> DataFrame:
    """A row an operation, direct or a part: page range and MB. Only files that have a plan advance the offset."""
    planned = with_split_needs(files, limits).withColumn("plan", optimal_plan(limits))
    planned = planned.withColumn("counted", F.when(F.col("plan").isNotNull(), F.col("total_pages")))
    planned = page_offsets(planned, batch, order, "counted").withColumnRenamed("page_offset", "file_offset").where("plan is not null")
    parts = expand_parts(planned, F.col("plan.num_files"))
    first = F.col("file_offset") + F.col("page_offset") + 1
    return parts.select(batch, "file_id", "part", F.when(F.col("plan.num_files") == 1, "direct").otherwise("part").alias("operation"), first.alias("first_page"), (first + F.col("n_pages") - 1).alias("last_page"), F.col("n_pages"), F.col("plan.mb_per_file").alias("mb"))


def size_bucket(size: Column, measured: Column | None = None) -> Column:
    """small under 10 MB, medium under 30, else large; a size of 0 is measured anew."""
    size = F.coalesce(F.nullif(size, F.lit(0.0)), measured) if measured is not None else size
    return F.when(size < 10, "small").when(size < 30, "medium").otherwise("large")


def traffic_light(size: Column) -> Column:
    return F.when(size <= 45, "ok").when(size <= 50, "warn").otherwise("bad")


def error_class(message: Column) -> Column:
    """rate_limit and url_fetch errors may be tried again; others, and no message, are other and none."""
    low = F.lower(message)
    return F.when(message.isNull(), "none").when(low.rlike(RATE_LIMIT), "rate_limit").when(low.rlike(URL_FETCH), "url_fetch").otherwise("other")


def global_strategy(n: Column, n_split: Column, n_high: Column, n_low: Column) -> Column:
    """What a batch as a whole is like."""
    return (
        F.when(n == 0, "no-files")
        .when(n_split == 0, "direct-processing")
        .when(n_high > n * 0.6, "image-heavy-collection")
        .when(n_low > n * 0.6, "text-heavy-collection")
        .otherwise("mixed-content-collection")
    )


def batch_summary(files: DataFrame, batch: str, limits: Limits = Limits()) -> DataFrame:
    """For each batch: files, MB, pages, parts, distinct warnings, strategy, mean density and minutes (half a minute a part)."""
    planned = with_split_needs(files, limits).withColumn("plan", optimal_plan(limits))
    found = planned.groupBy(batch).agg(
        F.count("*").alias("n_files"),
        F.sum("size_mb").alias("size_mb"),
        F.sum("total_pages").alias("total_pages"),
        F.coalesce(F.sum("plan.num_files"), F.lit(0)).alias("n_parts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("plan.warnings")))).alias("warnings"),
        F.count_if("requires_splitting").alias("n_split"),
        F.count_if(F.col("density") > 1.0).alias("n_high"),
        F.count_if(F.col("density") < 0.1).alias("n_low"),
    )
    return found.withColumns({"strategy": global_strategy(F.col("n_files"), F.col("n_split"), F.col("n_high"), F.col("n_low")), "avg_density": F.coalesce(F.try_divide("size_mb", F.col("total_pages")), F.lit(0.0)), "minutes": F.col("n_parts") * 0.5})


def batch_summary_legacy(files: DataFrame, batch: str, limits: Limits = Limits()) -> DataFrame:
    """The older summary: parts are files and what splits add, minutes two seconds a page."""
    planned = with_split_needs(files, limits).withColumn("plan", F.when(F.col("requires_splitting"), optimal_plan(limits)))
    found = planned.groupBy(batch).agg(F.count("*").alias("n_files"), F.sum("total_pages").alias("total_pages"), (F.count("*") + F.coalesce(F.sum(F.col("plan.num_files") - 1), F.lit(0))).alias("n_parts"), F.count_if("requires_splitting").alias("n_split"))
    strategy = F.when(F.col("n_split") == 0, "process_directly").when(F.col("n_split") == F.col("n_files"), "split_all").otherwise("mixed")
    return found.withColumns({"strategy": strategy, "minutes": F.col("total_pages") * 2.0 / 60.0})


def estimated_time(files: DataFrame, *groups: str) -> DataFrame:
    """For each group the estimated seconds of its files, and these as text."""
    pages = F.when(F.col("size_mb") > 0, F.greatest(F.lit(1), F.floor(F.col("size_mb") * 2))).otherwise(0)
    found = files.groupBy(*groups).agg(F.sum(pages).alias("pages"), F.count("*").alias("n_files"))
    found = found.withColumn("seconds", (F.col("pages") / 0.5 + F.col("n_files") * 2) * 1.2)
    s = F.col("seconds")
    text = F.when(s < 60, F.format_string("%.0f segundos", s)).when(s < 3600, F.format_string("%.1f minutos", s / 60)).otherwise(F.format_string("%.0fh %.0fm", s / 3600, (s % 3600) / 60))
    return found.withColumn("text", text)


def run_metrics(runs: DataFrame) -> DataFrame:
    """Adds pages and MB a second, 0 without time."""
    rate = lambda n: F.when(F.col("total_s") > 0, F.col(n) / F.col("total_s")).otherwise(0.0)
    return runs.withColumns({"pages_per_s": rate("pages"), "mb_per_s": rate("size_mb")})


def performance_summary(runs: DataFrame, *groups: str) -> DataFrame:
    """Mean times, sums and the overall speed of runs, for each group (size buckets, say)."""
    found = runs.groupBy(*groups).agg(F.count("*").alias("n_runs"), F.avg("upload_s").alias("avg_upload_s"), F.avg("process_s").alias("avg_process_s"), F.avg("save_s").alias("avg_save_s"), F.sum("pages").alias("pages"), F.sum("size_mb").alias("size_mb"), F.sum("total_s").alias("total_s"))
    return found.withColumn("pages_per_s", F.when(F.col("total_s") > 0, F.col("pages") / F.col("total_s")).otherwise(0.0))


def results_by_original(runs: DataFrame) -> DataFrame:
    """For each original file its parts, pages and failures."""
    return runs.groupBy("original_file").agg(F.count("*").alias("n_parts"), F.sum(F.when(F.col("error").isNull(), F.col("pages")).otherwise(0)).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
