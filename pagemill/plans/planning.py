"""Split planning of large files as columns: limits, needs, plans, parts. Rows are files; nothing here but explode changes their number.

A files table has `file_id, size_mb, total_pages`. The choice among plans of one file is made in an array of that row, so
planning a corpus is a projection without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import bound

# Limits of the service, safety factors, model constants.
API_MAX_MB, API_MAX_PAGES = 100.0, 1000
SIZE_FACTOR, PAGE_FACTOR = 0.96, 0.90
OVERHEAD_MB = 0.5
PART_OVERHEAD = 1.03
PAGES_PER_MB = 4


@dataclass(frozen=True)
class Limits:
    """What a part may have; the safe limits, which counts of parts are taken from, apply the factors once more."""

    max_size_mb: float = API_MAX_MB * SIZE_FACTOR
    max_pages: int = int(API_MAX_PAGES * PAGE_FACTOR)
    overhead_mb: float = OVERHEAD_MB

    @property
    def safe_size_mb(self) -> float:
        return self.max_size_mb * SIZE_FACTOR

    @property
    def safe_pages(self) -> int:
        return int(self.max_pages * PAGE_FACTOR)


PRE_DIVISION = Limits(50.0, 135)
POST_SPLIT = Limits(49.5, 1000)


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a.cast("double") / F.lit(float(b)) if not isinstance(b, Column) else a.cast("double") / b).cast("int")


def density(size: Column, pages: Column) -> Column:
    """MB a page, 0 without pages."""
    return F.when(pages > 0, size / pages).otherwise(0.0)


def density_class(value: Column) -> Column:
    return F.when(value > 1.0, "high").when(value < 0.1, "low").otherwise("normal")


def exceeded_limits(size: Column, pages: Column, limits: Limits = Limits()) -> Column:
    """The names of the limits that a file exceeds; none for a file within them."""
    return F.array_compact(F.array(F.when(size > limits.max_size_mb, F.lit("size")), F.when(pages > limits.max_pages, F.lit("pages"))))


def with_split_needs(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds density, requires_splitting, reason and the numbers of parts that size, pages and both ask for."""
    size, pages = F.col("size_mb"), F.col("total_pages")
    reason = F.when(size > limits.max_size_mb, "size").when(pages > limits.max_pages, "pages").otherwise("")
    found = files.withColumns({"density": density(size, pages), "requires_splitting": (size > limits.max_size_mb) | (pages > limits.max_pages), "reason": reason, "min_files_by_size": ceil_div(size, limits.safe_size_mb), "min_files_by_pages": ceil_div(pages, limits.safe_pages)})
    return found.withColumn("required_files", F.greatest("min_files_by_size", "min_files_by_pages"))


def split_needs_text(limits: Limits = Limits()) -> Column:
    """The reason of with_split_needs as a sentence."""
    by_size = F.format_string("Tamaño excede límite (%.1fMB > %sMB)", F.col("size_mb"), F.lit(str(limits.max_size_mb)))
    by_pages = F.format_string("Páginas exceden límite (%d > %d)", F.col("total_pages"), F.lit(limits.max_pages))
    return F.when(F.col("reason") == "size", by_size).when(F.col("reason") == "pages", by_pages).otherwise("")


def split_plan(n: Column, limits: Limits = Limits()) -> Column:
    """The plan that cuts a file of with_split_needs into n parts: a struct. A file that needn't be split has one part."""
    size, pages = F.col("size_mb"), F.col("total_pages")
    per_file, mb = ceil_div(pages, n), size / n + limits.overhead_mb
    large, long = mb > limits.safe_size_mb, per_file > limits.safe_pages
    by_size = F.when(mb > 0, F.least(F.lit(1.0), F.lit(limits.safe_size_mb) / mb)).otherwise(0.0)
    by_pages = F.when(per_file > 0, F.least(F.lit(1.0), F.lit(float(limits.safe_pages)) / per_file)).otherwise(0.0)
    balance = F.lit(1.0) - F.abs(by_size - by_pages) * 0.5
    score = by_size * 0.4 + by_pages * 0.4 + balance * 0.2 - F.greatest(F.lit(0.0), (n - 5) * F.lit(0.05))
    base = F.when(long, "page-constrained").when(large, "size-constrained").otherwise("balanced")
    kind = F.when(F.col("density") > 1.0, "high-density").when(F.col("density") < 0.1, "low-density")
    strategy = F.when(kind.isNull(), base).when(base == "balanced", kind).otherwise(F.concat_ws("-", base, kind))
    warnings = F.array_compact(F.array(F.when(large, F.lit("size")), F.when(long, F.lit("pages"))))
    whole = F.struct(F.lit(1).alias("num_files"), pages.cast("int").alias("pages_per_file"), size.alias("mb_per_file"), F.lit("no-split-required").alias("strategy"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("warnings"))
    cut = F.struct(n.cast("int").alias("num_files"), per_file.alias("pages_per_file"), mb.alias("mb_per_file"), strategy.alias("strategy"), score.alias("score"), warnings.alias("warnings"))
    return F.when(F.col("requires_splitting"), cut).otherwise(whole)


def is_optimal(plan: Column, limits: Limits = Limits()) -> Column:
    return (plan["mb_per_file"] <= limits.max_size_mb) & (plan["pages_per_file"] <= limits.max_pages) & (plan["score"] >= 0.8)


def optimal_plan(limits: Limits = Limits()) -> Column:
    """The best of the plans with the required parts, one and two more (the first of equals); null if none scores over 0."""
    plans = F.transform(F.sequence(F.col("required_files"), F.col("required_files") + 2), lambda n: split_plan(n, limits))
    ranked = F.array_max(F.transform(plans, lambda p: F.struct(p["score"].alias("score"), (-p["num_files"]).alias("order"), p.alias("plan"))))
    best = F.when(ranked["score"] > 0, ranked["plan"])
    return F.when(F.col("requires_splitting"), best).otherwise(split_plan(F.lit(1), limits))


def alternative_plans(limits: Limits = Limits()) -> Column:
    """Up to three plans by falling score: the required parts, one more, and chunks of 50 and 100 pages where those are optimal."""
    need = F.col("required_files")
    option = lambda n, k, kept: bound(split_plan(n, limits), lambda p: F.struct(p.alias("plan"), F.lit(k).alias("order"), kept(p).alias("kept")))
    plain = F.array(*[option(n, k, lambda p: F.lit(True)) for k, n in enumerate((need, need + 1))])
    fits = lambda pages: lambda p: (F.col("total_pages") > pages) & is_optimal(p, limits)
    chunks = [option(ceil_div(F.col("total_pages"), pages), k, fits(pages)) for k, pages in enumerate((50, 100), 2)]
    options = F.filter(F.concat(plain, F.array(*chunks).cast("array<struct<plan:struct<num_files:int,pages_per_file:int,mb_per_file:double,strategy:string,score:double,warnings:array<string>>,order:int,kept:boolean>>")), lambda o: o["kept"])
    ranked = F.array_sort(F.transform(options, lambda o: F.struct((-o["plan"]["score"]).alias("by"), o["order"].alias("order"), o["plan"].alias("plan"))))
    same = lambda a, b: (a["num_files"] == b["num_files"]) & (a["pages_per_file"] == b["pages_per_file"])
    distinct = bound(F.transform(ranked, lambda o: o["plan"]), lambda plans: F.filter(plans, lambda p, k: ~F.exists(F.slice(plans, F.lit(1), k), lambda q: same(p, q))))
    return F.when(F.col("requires_splitting"), F.slice(distinct, 1, 3)).otherwise(F.array(split_plan(F.lit(1), limits)))


def recommendations(limits: Limits = Limits()) -> Column:
    """The optimal plan, then the alternatives of other numbers of parts."""
    others = lambda best: F.filter(alternative_plans(limits), lambda p: best.isNull() | (p["num_files"] != best["num_files"]))
    return F.array_compact(bound(optimal_plan(limits), lambda best: F.concat(F.array(best), others(best))))


def estimated_mb(count: Column) -> Column:
    """The estimated MB of so many pages of a file."""
    return count * (F.col("size_mb") / F.col("total_pages")) * PART_OVERHEAD


def even_split(n: Column) -> Column:
    """The two sizes that n even parts of a file have, as a struct: base pages, and one more for the first `extra` parts."""
    pages = F.col("total_pages")
    return F.struct(F.floor(pages / n).cast("int").alias("base"), (pages % n).cast("int").alias("extra"))


def estimated_parts(n: Column, limits: Limits = PRE_DIVISION, pages: Column | None = None) -> Column:
    """The parts of a file: index, pages, first and last page, estimated MB, whether it exceeds the limit and into how many to cut it.

    Parts are even if their `pages` aren't given; then what is before one follows from its index, and work grows with n.
    """

    def part(k: Column, count: Column, before: Column, mb: Column) -> Column:
        over = mb > limits.max_size_mb
        return F.struct(k.alias("part"), count.alias("pages"), (before + 1).alias("first_page"), (before + count).alias("last_page"), mb.alias("mb"), over.alias("exceeds"), F.when(over, ceil_div(mb, limits.max_size_mb)).alias("resplit"))

    if pages is not None:
        return F.transform(pages, lambda count, k: part(k, count, F.aggregate(F.slice(pages, F.lit(1), k), F.lit(0), lambda a, x: a + x), estimated_mb(count)))

    def even(s: Column) -> Column:
        count = lambda k: s["base"] + F.when(k < s["extra"], 1).otherwise(0)
        return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: part(k, count(k), k * s["base"] + F.least(k, s["extra"]), estimated_mb(count(k))))

    return bound(even_split(n), even)


def pre_division(n: Column, limits: Limits = PRE_DIVISION) -> Column:
    """A summary of estimated_parts: parts, how many exceed, whether none does, the largest, and the size efficiency."""

    def summary(s: Column) -> Column:
        exceeding = lambda count, of: F.when(estimated_mb(count) > limits.max_size_mb, of).otherwise(of * 0)
        over = F.when(n.isNotNull(), F.coalesce((exceeding(s["base"] + 1, s["extra"]) + exceeding(s["base"], n.cast("int") - s["extra"])).cast("int"), F.lit(0)))
        largest = F.greatest(estimated_mb(s["base"]), estimated_mb(s["base"] + F.when(s["extra"] > 0, 1).otherwise(0)))
        efficiency = F.when(largest > 0, F.least(F.lit(1.0), F.lit(limits.max_size_mb) / largest)).otherwise(1.0)
        return F.struct(n.cast("int").alias("num_files"), over.alias("n_exceeding"), (over == 0).alias("all_within"), largest.alias("max_mb"), efficiency.alias("efficiency"))

    return bound(even_split(n), summary)


def division_recommendations(requested: Column, limits: Limits = PRE_DIVISION) -> Column:
    """Other divisions of a file of with_split_needs, the most efficient first: recommended, conservative, fast."""
    need = F.col("required_files")
    fast = F.greatest(F.lit(2), need - 1)
    option = lambda kind, n, kept: F.struct(F.lit(kind).alias("kind"), pre_division(n, limits).alias("plan"), kept.alias("kept"))
    options = [
        option("recommended", need, need != requested),
        option("conservative", need + 2, need + 2 <= 20),
        option("fast", fast, (F.col("size_mb") > 100) & (fast != need) & pre_division(fast, limits)["all_within"]),
    ]
    ranked = F.array_sort(F.transform(F.filter(F.array(*options), lambda o: o["kept"]), lambda o: F.struct((-o["plan"]["efficiency"]).alias("by"), F.when(o["kind"] == "recommended", 0).when(o["kind"] == "conservative", 1).otherwise(2).alias("order"), o["kind"].alias("kind"), o["plan"].alias("plan"))))
    return F.transform(ranked, lambda o: F.struct(o["kind"], o["plan"]))


def validated_parts(parts: DataFrame, limits: Limits = POST_SPLIT) -> DataFrame:
    """Adds flags and ranges to the actual parts `original, part, size_mb, pages`; a range goes on from the parts before it."""
    size, pages = F.col("size_mb") <= limits.max_size_mb, F.col("pages") <= limits.max_pages
    before = Window.partitionBy("original").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("pages").over(before), F.lit(0)) + 1
    resplit = F.when(~(size & pages), ceil_div(F.col("size_mb"), limits.max_size_mb))
    return parts.withColumns({"within_size": size, "within_pages": pages, "is_valid": size & pages, "exceeds_limit": ~size, "resplit": resplit, "first_page": start, "last_page": start + F.col("pages") - 1})


def validation_summary(parts: DataFrame, limits: Limits = POST_SPLIT) -> DataFrame:
    """For each original: parts, valid and invalid ones, whether all are valid, and the parts that its size asks for."""
    valid = (F.col("size_mb") <= limits.max_size_mb) & (F.col("pages") <= limits.max_pages)
    found = parts.groupBy("original").agg(F.count("*").alias("n_parts"), F.count_if(valid).alias("n_within"), F.count_if(~valid).alias("n_exceeding"), F.sum("size_mb").alias("size_mb"))
    return found.withColumns({"all_within": F.col("n_exceeding") == 0, "recommended_files": ceil_div(F.col("size_mb"), limits.max_size_mb)})


def adjusted_parts(summary: DataFrame) -> DataFrame:
    """New even parts of the originals of validation_summary that aren't all valid; pages are estimated from the size."""
    n = F.greatest("recommended_files", F.lit(1))
    cut = summary.where(~F.col("all_within")).withColumn("pages", F.floor(F.col("size_mb") * PAGES_PER_MB / n).cast("int"))
    cut = cut.select("original", "pages", (F.col("size_mb") / n).alias("size_mb"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return cut.select("original", "part", "size_mb", "pages", (F.col("part") * F.col("pages") + 1).alias("first_page"), ((F.col("part") + 1) * F.col("pages")).alias("last_page"))


def split_target(max_size_mb: float, max_pages: int, override: Column | None = None) -> Column:
    """Into how many parts a file goes; an override wins if it is not null."""
    need = F.greatest(F.coalesce(ceil_div(F.col("total_pages"), max_pages), F.lit(1)), ceil_div(F.col("size_mb"), max_size_mb), F.lit(1))
    return F.coalesce(override, need) if override is not None else need


def expand_parts(files: DataFrame, n: Column) -> DataFrame:
    """A row a part: its number, pages, page offset and number of pages. Missing pages are estimated from the size."""
    pages = F.coalesce(F.col("total_pages"), F.floor(F.col("size_mb") * PAGES_PER_MB).cast("int"))
    found = files.withColumns({"pages": pages, "n_parts": n}).withColumn("per_part", ceil_div(F.col("pages"), F.col("n_parts")))
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    start = F.col("part") * F.col("per_part")
    return found.withColumns({"page_offset": start, "n_pages": F.greatest(F.lit(0), F.least(start + F.col("per_part"), F.col("pages")) - start)})


def greedy_chunks(pages: DataFrame, max_pages: int, max_size: float) -> DataFrame:
    """`doc_id, page_idx, chunk`: a document's pages in order fill a chunk until it has max_pages, or the next would exceed max_size.

    `pages` has `doc_id, page_idx, size`. A page over the size stays alone. The fold is over one document's sizes.
    """
    held = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", F.col("size").cast("double").alias("size")))).alias("pages"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("count"), F.lit(0.0).alias("size"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        new = (a["count"] > 0) & ((a["count"] >= max_pages) | (a["size"] + p["size"] > max_size))
        chunk = a["chunk"] + F.when(new, 1).otherwise(0)
        return F.struct(chunk.alias("chunk"), F.when(new, 1).otherwise(a["count"] + 1).alias("count"), F.when(new, p["size"]).otherwise(a["size"] + p["size"]).alias("size"), F.concat(a["out"], F.array(chunk)).alias("out"))

    chunks = F.aggregate("pages", start, step, lambda a: a["out"])
    return held.select("doc_id", F.explode(F.arrays_zip(F.col("pages").alias("p"), chunks.alias("c"))).alias("x")).select("doc_id", "x.p.page_idx", F.col("x.c").alias("chunk"))


def plan_presets(limits: Limits = Limits()) -> Column:
    """Three preset divisions of a file: fast, conservative and automatic, with what each part would have."""
    pages, size = F.col("total_pages"), F.col("size_mb")

    def preset(kind: str, n: Column, most: int) -> Column:
        n = F.greatest(F.lit(1), F.least(F.lit(20), n)).cast("int")
        each = F.greatest(F.lit(10), F.least(F.lit(1000), F.least(ceil_div(pages, n), F.lit(most)))).cast("int")
        mb = size / n
        efficiency = F.when(mb > 0, F.least(F.lit(1.0), F.lit(50.0) / mb)).otherwise(1.0)
        return F.struct(F.lit(kind).alias("preset"), n.alias("num_files"), each.alias("pages_per_file"), mb.alias("mb_per_file"), efficiency.alias("efficiency"), ((mb <= limits.max_size_mb) & (each <= limits.max_pages)).alias("valid"))

    return F.array(preset("fast", F.lit(2), 900), preset("conservative", ceil_div(size, 40.0), 100), preset("auto", ceil_div(size, limits.max_size_mb * PAGE_FACTOR), 1000))


def legacy_count(max_size_mb: float = 50.0, max_pages: int = 135) -> Column:
    """Parts by nine tenths of either limit."""
    return F.greatest(ceil_div(F.col("size_mb"), max_size_mb * PAGE_FACTOR), ceil_div(F.col("total_pages"), max_pages * PAGE_FACTOR))
