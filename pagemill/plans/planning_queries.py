"""Queries of quality scoring, planning and batches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.quality import with_quality
from pagemill.functions.text import tokens
from pagemill.operators.quality import quality_by
from pagemill.plans import batches as B
from pagemill.plans import planning as P
from pagemill.plans import views as V

LIMITS = P.Limits()


def _cents(c):
    """A sum of doubles that doesn't depend on the order: of millionths as integers."""
    return F.sum(F.floor(F.col(c) * 1000000 + 0.5)) / 1000000.0


def tokens_of_documents(spark, d):
    """QLT1: how many words each document has, and which are its longest."""
    return V.table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_max(F.transform("w", lambda w: F.length(w))).alias("longest"))


def quality_score(spark, d):
    """QLT2 to QLT8: the metrics of every document."""
    found = with_quality(V.spread(V.table(spark, d, "documents").select("doc_id", "text")))
    return found.select("doc_id", "suspicious_patterns", "rare_chars_count", "mixed_alphanum_words", "total_words", "total_chars", F.size("issues").cast("long").alias("n_issues"), F.round("avg_word_length", 6).alias("avg_word_length"), F.round("score", 6).alias("score"))


def quality_by_lang(spark, d):
    """QLT10: quality rolled up by language."""
    found = quality_by(V.spread(V.table(spark, d, "documents").select("text", "lang")), "lang")
    return found.select("lang", "n_docs", "n_words", F.round("avg_score", 6).alias("avg_score"), F.round("min_score", 6).alias("min_score"), "n_with_issues", "n_low")


def quality_vs_labels(spark, d):
    """JN6: scores joined with the labels that some documents have."""
    found = with_quality(V.spread(V.table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "score")
    return found.join(V.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 6).alias("avg_score"))


def limit_checks(spark, d):
    """FIL2, FIL6: limits that files exceed, and their density."""
    f = V.files(spark, d)
    found = P.exceeded_limits(F.col("size_mb"), F.col("total_pages"))
    dense = P.density(F.col("size_mb"), F.col("total_pages"))
    return f.select("file_id", F.array_join(found, ",").alias("exceeded"), (F.size(found) == 0).alias("within"), dense.alias("density"), P.density_class(dense).alias("density_class"))


def split_needs(spark, d):
    """FIL3 over large files."""
    return P.with_split_needs(V.big_files(spark, d)).select("file_id", "density", "requires_splitting", "reason", "min_files_by_size", "min_files_by_pages", "required_files")


_PLAN = ["num_files", "pages_per_file", "mb_per_file", "strategy", "score"]


def _flat(df, plan):
    return df.select("file_id", *[F.col(f"{plan}.{c}").alias(c) for c in _PLAN])


def split_plans(spark, d):
    """PLN1, PLN2, FIL7: the plan with the required parts."""
    f = P.with_split_needs(V.big_files(spark, d)).withColumn("plan", P.split_plan(F.col("required_files")))
    return f.select("file_id", *[F.col(f"plan.{c}").alias(c) for c in _PLAN], F.array_join("plan.warnings", ",").alias("warnings"), P.is_optimal(F.col("plan")).alias("is_optimal"))


def optimal_split(spark, d):
    """PLN3: the best plan, or none."""
    return _flat(P.with_split_needs(V.big_files(spark, d)).withColumn("plan", P.optimal_plan()), "plan")


def alternative_plans(spark, d):
    """PLN4: up to three plans, ranked."""
    f = P.with_split_needs(V.big_files(spark, d)).select("file_id", F.posexplode(P.alternative_plans()).alias("rank", "plan"))
    return f.select("file_id", "rank", *[F.col(f"plan.{c}").alias(c) for c in _PLAN])


def plan_recommendations(spark, d):
    """PLN5: the best plan and other numbers of parts."""
    f = P.with_split_needs(V.files(spark, d)).select("file_id", F.posexplode(P.recommendations()).alias("rank", "plan"))
    return f.select("file_id", "rank", *[F.col(f"plan.{c}").alias(c) for c in _PLAN])


def estimated_parts(spark, d):
    """PLN6, PLN7: even parts of large files with their page ranges."""
    f = V.files(spark, d).where("size_mb > 50").withColumn("n", P.ceil_div(F.col("size_mb"), 40.0))
    return f.select("file_id", F.explode(P.estimated_parts(F.col("n"))).alias("p")).select("file_id", "p.part", "p.pages", "p.first_page", "p.last_page", "p.mb", "p.exceeds", "p.resplit")


def pre_division(spark, d):
    """PLN8: summaries of those parts."""
    return V.files(spark, d).where("size_mb > 50").withColumn("n", P.ceil_div(F.col("size_mb"), 40.0)).select("file_id", P.pre_division(F.col("n")).alias("p")).select("file_id", "p.*")


def division_recommendations(spark, d):
    """PLN9: other divisions of large files."""
    f = P.with_split_needs(V.files(spark, d), P.PRE_DIVISION).where("size_mb > 50")
    f = f.select("file_id", F.posexplode(P.division_recommendations(F.lit(3))).alias("rank", "r"))
    return f.select("file_id", "rank", F.col("r.kind"), F.col("r.plan.num_files"), F.col("r.plan.max_mb"), F.col("r.plan.efficiency"), F.col("r.plan.all_within"))


def _parts(spark, d):
    f = V.files(spark, d).where("size_mb > 30")
    return P.expand_parts(f, P.ceil_div(F.col("size_mb"), 45.0)).select(F.col("file_id").alias("original"), "part", (F.col("size_mb") / F.col("n_parts") * (1 + F.col("part") % 2 * 0.5)).alias("size_mb"), F.col("n_pages").alias("pages"))


def validated_parts(spark, d):
    """PLN10: actual parts against the limits."""
    return P.validated_parts(_parts(spark, d)).select("original", "part", "size_mb", "is_valid", "exceeds_limit", "resplit", "first_page", "last_page")


def validation_summary(spark, d):
    """PLN11: by original file."""
    return P.validation_summary(_parts(spark, d)).select("original", "n_parts", "n_within", "n_exceeding", "all_within", "recommended_files", F.round("size_mb", 6).alias("size_mb"))


def adjusted_parts(spark, d):
    """PLN12: new parts where some exceed."""
    f = P.adjusted_parts(P.validation_summary(_parts(spark, d)))
    return f.select("original", "part", F.round("size_mb", 6).alias("size_mb"), "pages", "first_page", "last_page")


def split_options(spark, d):
    """PLN13: the options of each file for a target of 49.5 MB, as a list."""
    limits = P.POST_SPLIT
    f = P.with_split_needs(V.files(spark, d), limits).withColumn("o", P.alternative_plans(limits))
    return f.select("file_id", F.col("required_files").alias("min_files"), F.coalesce(F.get("o", F.lit(0))["num_files"], F.col("required_files")).alias("recommended"), F.array_join(F.transform("o", lambda p: p["num_files"].cast("string")), ",").alias("options"))


def expanded_parts(spark, d):
    """PLN14, PLN15: a row a part, with page offset and pages."""
    f = P.expand_parts(V.big_files(spark, d), P.split_target(96.0, 900))
    return f.select("file_id", "part", "n_parts", "per_part", "page_offset", "n_pages")


def greedy_chunks(spark, d):
    """PLN16: pages of conversations filled into chunks."""
    return P.greedy_chunks(V.doc_pages(spark, d), 3, 1200).groupBy("doc_id").agg(F.max("chunk").alias("last_chunk"), F.sum("chunk").alias("sum_chunk"), F.count("*").alias("n_pages"))


def plan_presets(spark, d):
    """PLN17: preset divisions."""
    f = V.files(spark, d).select("file_id", F.explode(P.plan_presets()).alias("p"))
    return f.select("file_id", "p.*")


def global_max_pages(spark, d):
    """PLN18: the most pages a part has in any plan of several parts, by batch; 150 without such a plan."""
    f = P.with_split_needs(V.big_files(spark, d)).withColumn("plan", P.optimal_plan())
    return f.groupBy("batch_id").agg(F.coalesce(F.max(F.when(F.col("plan.num_files") > 1, F.col("plan.pages_per_file"))), F.lit(150)).alias("max_pages"))


def legacy_counts(spark, d):
    """PLN19."""
    return V.files(spark, d).select("file_id", P.legacy_count().alias("num_files"))


def natural_order(spark, d):
    """ORD1: the order of invented file names within each source."""
    f = V.table(spark, d, "documents")
    k = F.col("doc_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("Vol_"), k)).when(k % 4 == 1, F.concat(F.lit("informe tomo "), k % 17)).when(k % 4 == 2, F.concat(F.lit("x/Parte-"), k)).otherwise(F.concat(F.lit("anexo "), F.col("lang")))
    return B.natural_order(f.select("doc_id", "source", name.alias("name")), "source", "name", "doc_id").select("doc_id", "name", "place")


def page_offsets(spark, d):
    """ORD2: running page offsets in each batch."""
    return B.page_offsets(V.files(spark, d), "batch_id", "file_id").select("file_id", "batch_id", "page_offset")


def processing_plan(spark, d):
    """ORD3: operations with page ranges."""
    return B.processing_plan(V.files(spark, d), "batch_id", "file_id").select("batch_id", "file_id", "part", "operation", "first_page", "last_page", "n_pages", "mb")


def batch_summary(spark, d):
    """AGG1, AGG3, AGG4: batches summarised."""
    f = B.batch_summary(V.files(spark, d), "batch_id")
    return f.select("batch_id", "n_files", F.round("size_mb", 4).alias("size_mb"), "total_pages", F.col("n_parts").cast("long").alias("n_parts"), F.array_join("warnings", ",").alias("warnings"), "strategy", F.round("avg_density", 8).alias("avg_density"), F.col("minutes").cast("double").alias("minutes"))


def batch_summary_legacy(spark, d):
    """AGG2."""
    return B.batch_summary_legacy(V.files(spark, d), "batch_id").select("batch_id", "n_files", "total_pages", F.col("n_parts").cast("long").alias("n_parts"), "strategy", "minutes")


def run_metrics(spark, d):
    """AGG5, FIL4, FIL5, FIL8: speeds and classes of runs."""
    r = B.run_metrics(V.runs(spark, d))
    return r.select("run_id", "pages_per_s", "mb_per_s", B.size_bucket(F.col("size_mb")).alias("bucket"), B.traffic_light(F.col("size_mb")).alias("light"), B.error_class(F.col("error")).alias("error_class"))


def performance_summary(spark, d):
    """AGG6: by size bucket."""
    r = V.runs(spark, d).withColumn("bucket", B.size_bucket(F.col("size_mb")))
    return B.performance_summary(r, "bucket").select("bucket", "n_runs", F.round("avg_upload_s", 8).alias("avg_upload_s"), F.round("avg_process_s", 8).alias("avg_process_s"), "pages", "total_s", F.round("pages_per_s", 8).alias("pages_per_s"))


def estimated_time(spark, d):
    """AGG7: estimated seconds of each batch."""
    return B.estimated_time(V.files(spark, d), "batch_id").select("batch_id", F.col("pages").cast("long").alias("pages"), "n_files", F.round("seconds", 4).alias("seconds"))


def results_by_original(spark, d):
    """AGG8."""
    return B.results_by_original(V.runs(spark, d))


def file_list_status(spark, d):
    """AGG13: files and MB of each batch."""
    return V.files(spark, d).groupBy("batch_id").agg(F.count("*").alias("n_files"), _cents("size_mb").alias("size_mb"))


QUERIES = {f.__name__: f for f in (quality_score, quality_by_lang, quality_vs_labels, limit_checks, split_needs, split_plans, optimal_split, alternative_plans, plan_recommendations, estimated_parts, pre_division, division_recommendations, validated_parts, validation_summary, adjusted_parts, split_options, expanded_parts, greedy_chunks, plan_presets, global_max_pages, legacy_counts, natural_order, page_offsets, processing_plan, batch_summary, batch_summary_legacy, run_metrics, performance_summary, estimated_time, results_by_original, file_list_status)} | {"tokens": tokens_of_documents}

# ---- SQL ----

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')"
QUALITY_SQL = rf"""w AS (
    SELECT doc_id, lang, text, {_WORDS} AS w FROM documents
), m AS (
    SELECT *, len(w) AS total_words, length(text) AS total_chars,
        len(list_filter(w, lambda x: x IN ('rn', 'cl', 'vv', 'ii', 'Il', 'lI')))
            + len(regexp_extract_all(regexp_replace(text, '([a-z])', '\1\1', 'g'), '[a-z]I[a-z]')) + len(regexp_extract_all(regexp_replace(text, '([A-Z])', '\1\1', 'g'), '[A-Z]l[A-Z]')) AS suspicious_patterns,
        length(text) - length(translate(text, '¦§¢£µ¶ªº¿¡', '')) AS rare_chars_count,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}') AND regexp_matches(x, '\p{{N}}') AND NOT regexp_full_match(lower(x), '[0-9]+[a-z]{{1,3}}'))) AS mixed_alphanum_words,
        list_sum(list_transform(w, lambda x: length(x))) / CAST(len(w) AS DOUBLE) AS avg_word_length
    FROM w
), r AS (
    SELECT *, rare_chars_count / CAST(total_chars AS DOUBLE) AS rare, mixed_alphanum_words / CAST(total_words AS DOUBLE) AS mixed FROM m
), q AS (
    SELECT *, CASE WHEN total_words = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 100.0 - least(30.0, suspicious_patterns / CAST(greatest(total_words, 1) AS DOUBLE) * 100) - least(20.0, rare * 1000) - least(20.0, mixed * 50)
        - CASE WHEN avg_word_length < 3 OR avg_word_length > 10 THEN least(15.0, abs(avg_word_length - 6) * 3) ELSE 0 END - CASE WHEN total_words < 10 THEN 15 ELSE 0 END)) END AS score,
        CASE WHEN total_words = 0 THEN 1 ELSE greatest(1, CAST(suspicious_patterns > 5 AS INT) + CAST(rare_chars_count > 10 AS INT) + CAST(rare > 0.01 AS INT) + CAST(avg_word_length < 3 OR avg_word_length > 10 AS INT) + CAST(mixed > 0.1 AS INT)) END AS n_issues,
        suspicious_patterns > 5 OR rare_chars_count > 10 OR rare > 0.01 OR avg_word_length < 3 OR avg_word_length > 10 OR mixed > 0.1 OR total_words = 0 AS troubled
    FROM r
)"""


def _ceil(a: str, b: str) -> str:
    return f"CAST(ceil(CAST({a} AS DOUBLE) / {b}) AS INTEGER)"


def _needs(files: str, size: float = 96.0, pages: int = 900, safe: float = 92.16, safe_pages: int = 810) -> str:
    return f"""{files}, needs AS (
    SELECT *, CASE WHEN total_pages > 0 THEN size_mb / total_pages ELSE 0 END AS density, size_mb > {size} OR total_pages > {pages} AS requires_splitting,
        CASE WHEN size_mb > {size} THEN 'size' WHEN total_pages > {pages} THEN 'pages' ELSE '' END AS reason,
        {_ceil('size_mb', repr(safe))} AS min_files_by_size, {_ceil('total_pages', f'{safe_pages}.0')} AS min_files_by_pages FROM files
), req AS (SELECT *, greatest(min_files_by_size, min_files_by_pages) AS required_files FROM needs)"""


def _plans(source: str, safe: float = 92.16, safe_pages: int = 810) -> str:
    """Plans of the rows of a relation with `n`, as the relation `plan`."""
    return f"""p1 AS (
    SELECT *, {_ceil('total_pages', 'n')} AS ppf, size_mb / n + 0.5 AS mb FROM {source}
), p2 AS (
    SELECT *, least(CAST(1 AS DOUBLE), CAST({safe!r} AS DOUBLE) / mb) AS es, CASE WHEN ppf > 0 THEN least(CAST(1 AS DOUBLE), CAST({safe_pages} AS DOUBLE) / ppf) ELSE 0 END AS ep,
        CASE WHEN ppf > {safe_pages} THEN 'page-constrained' WHEN mb > {safe!r} THEN 'size-constrained' ELSE 'balanced' END AS base,
        CASE WHEN density > 1.0 THEN 'high-density' WHEN density < 0.1 THEN 'low-density' END AS kind FROM p1
), plan AS (
    SELECT *, CASE WHEN requires_splitting THEN n ELSE 1 END AS num_files, CASE WHEN requires_splitting THEN ppf ELSE total_pages END AS pages_per_file,
        CASE WHEN requires_splitting THEN mb ELSE size_mb END AS mb_per_file,
        CASE WHEN NOT requires_splitting THEN 'no-split-required' WHEN kind IS NULL THEN base WHEN base = 'balanced' THEN kind ELSE base || '-' || kind END AS strategy,
        CASE WHEN requires_splitting THEN es * CAST(0.4 AS DOUBLE) + ep * CAST(0.4 AS DOUBLE) + (CAST(1 AS DOUBLE) - abs(es - ep) * CAST(0.5 AS DOUBLE)) * CAST(0.2 AS DOUBLE) - greatest(CAST(0 AS DOUBLE), (n - 5) * CAST(0.05 AS DOUBLE)) ELSE CAST(1 AS DOUBLE) END AS score,
        CASE WHEN requires_splitting THEN concat_ws(',', CASE WHEN mb > {safe!r} THEN 'size' END, CASE WHEN ppf > {safe_pages} THEN 'pages' END) ELSE '' END AS warnings
    FROM p2
)"""


def _optimal(files: str, **limits) -> str:
    return f"""{_needs(files, **limits)}, cand AS (
    SELECT *, unnest(CASE WHEN requires_splitting THEN range(required_files, required_files + 3) ELSE [CAST(1 AS BIGINT)] END) AS n FROM req
), {_plans('cand', limits.get('safe', 92.16), limits.get('safe_pages', 810))}, best AS (
    SELECT * FROM plan WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, n) = 1
)"""


def _alternatives(files: str, size: float = 96.0, pages: int = 900, safe: float = 92.16, safe_pages: int = 810) -> str:
    return f"""{_needs(files, size, pages, safe, safe_pages)}, cand AS (
    SELECT *, unnest(CASE WHEN requires_splitting THEN [0, 1, 2, 3] ELSE [0] END) AS o FROM req
), chosen AS (
    SELECT *, CASE o WHEN 0 THEN CASE WHEN requires_splitting THEN required_files ELSE 1 END WHEN 1 THEN required_files + 1 WHEN 2 THEN {_ceil('total_pages', '50.0')} ELSE {_ceil('total_pages', '100.0')} END AS n FROM cand
), {_plans('chosen', safe, safe_pages)}, kept AS (
    SELECT * FROM plan WHERE o < 2 OR (total_pages > CASE o WHEN 2 THEN 50 ELSE 100 END AND mb_per_file <= {size} AND pages_per_file <= {pages} AND score >= 0.8)
), one AS (
    SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY file_id, num_files, pages_per_file ORDER BY score DESC, o) = 1
), alt AS (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, o) - 1 AS rank FROM one QUALIFY rank < 3
)"""


_COLUMNS = "CAST(num_files AS INTEGER) AS num_files, CAST(pages_per_file AS INTEGER) AS pages_per_file, mb_per_file, strategy, score"
_PARTS = f"""{V.FILES_SQL}, cut AS (
    SELECT *, {_ceil('size_mb', '45.0')} AS n_parts FROM files WHERE size_mb > 30
), split AS (
    SELECT *, unnest(range(0, n_parts)) AS part, {_ceil('total_pages', 'n_parts')} AS per_part FROM cut
), parts AS (
    SELECT file_id AS original, CAST(part AS INTEGER) AS part, size_mb / n_parts * (1 + part % 2 * CAST(0.5 AS DOUBLE)) AS size_mb, greatest(0, least(part * per_part + per_part, total_pages) - part * per_part) AS pages FROM split
)"""
_SUMMARY = f"""{_PARTS}, summary AS (
    SELECT original, count(*) AS n_parts, count(*) FILTER (size_mb <= 49.5 AND pages <= 1000) AS n_within, count(*) FILTER (NOT (size_mb <= 49.5 AND pages <= 1000)) AS n_exceeding, sum(size_mb) AS size_mb FROM parts GROUP BY original
), summed AS (SELECT *, n_exceeding = 0 AS all_within, {_ceil('size_mb', '49.5')} AS recommended_files FROM summary)"""
_EVEN = f"""{V.FILES_SQL}, even AS (
    SELECT *, {_ceil('size_mb', '40.0')} AS n FROM files WHERE size_mb > 50
), part AS (
    SELECT *, unnest(range(0, n)) AS part FROM even
), shares AS (
    SELECT *, total_pages // n + CASE WHEN part < total_pages % n THEN 1 ELSE 0 END AS pages FROM part
), sized AS (
    SELECT file_id, n, CAST(part AS INTEGER) AS part, CAST(pages AS INTEGER) AS pages, coalesce(sum(pages) OVER (PARTITION BY file_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        pages * (size_mb / total_pages) * CAST(1.03 AS DOUBLE) AS mb FROM shares
)"""


def _division(kind: str, n: str, where: str, order: int) -> str:
    return f"SELECT file_id, '{kind}' AS kind, {order} AS o, CAST({n} AS INTEGER) AS num_files, size_mb, total_pages FROM req WHERE {where}"


ORACLE_SQL = {
    "tokens": rf"SELECT doc_id, len({_WORDS}) AS n_words, CAST(list_max(list_transform({_WORDS}, lambda x: length(x))) AS INTEGER) AS longest FROM documents",
    "quality_score": f"WITH {QUALITY_SQL} SELECT doc_id, suspicious_patterns, rare_chars_count, mixed_alphanum_words, total_words, total_chars, CAST(n_issues AS BIGINT) AS n_issues, round(coalesce(avg_word_length, 0), 6) AS avg_word_length, round(CAST(score AS DOUBLE), 6) AS score FROM q",
    "quality_by_lang": f"WITH {QUALITY_SQL} SELECT lang, count(*) AS n_docs, CAST(sum(total_words) AS BIGINT) AS n_words, round(avg(score), 6) AS avg_score, round(CAST(min(score) AS DOUBLE), 6) AS min_score, count(*) FILTER (troubled) AS n_with_issues, count(*) FILTER (score < 70) AS n_low FROM q GROUP BY lang",
    "quality_vs_labels": f"WITH {QUALITY_SQL} SELECT quality, count(*) AS n_docs, round(avg(score), 6) AS avg_score FROM q JOIN labels USING (doc_id) GROUP BY quality",
    "limit_checks": f"WITH {V.FILES_SQL} SELECT file_id, concat_ws(',', CASE WHEN size_mb > 96 THEN 'size' END, CASE WHEN total_pages > 900 THEN 'pages' END) AS exceeded, NOT (size_mb > 96 OR total_pages > 900) AS within, size_mb / total_pages AS density, CASE WHEN size_mb / total_pages > 1.0 THEN 'high' WHEN size_mb / total_pages < 0.1 THEN 'low' ELSE 'normal' END AS density_class FROM files",
    "split_needs": f"WITH {_needs(V.BIG_FILES_SQL)} SELECT file_id, density, requires_splitting, reason, min_files_by_size, min_files_by_pages, required_files FROM req",
    "split_plans": f"WITH {_needs(V.BIG_FILES_SQL)}, src AS (SELECT *, required_files AS n FROM req), {_plans('src')} SELECT file_id, {_COLUMNS}, warnings, mb_per_file <= 96 AND pages_per_file <= 900 AND score >= 0.8 AS is_optimal FROM plan",
    "optimal_split": f"WITH {_optimal(V.BIG_FILES_SQL)} SELECT files.file_id, {_COLUMNS} FROM files LEFT JOIN best USING (file_id)",
    "alternative_plans": f"WITH {_alternatives(V.BIG_FILES_SQL)} SELECT file_id, CAST(rank AS INTEGER) AS rank, {_COLUMNS} FROM alt",
    "plan_recommendations": f"""WITH {_optimal(V.FILES_SQL)}, {_alternatives(V.FILES_SQL).replace(V.FILES_SQL + ', ', '').replace('needs AS', 'needs2 AS').replace('FROM needs)', 'FROM needs2)').replace('req AS', 'req2 AS').replace('FROM req', 'FROM req2').replace('cand AS', 'cand2 AS').replace('FROM cand', 'FROM cand2').replace('p1 AS', 'p3 AS').replace('FROM p1', 'FROM p3').replace('p2 AS', 'p4 AS').replace('FROM p2', 'FROM p4').replace('plan AS', 'plan2 AS').replace('FROM plan ', 'FROM plan2 ')}, everything AS (
        SELECT file_id, 0 AS g, 0 AS r, num_files, pages_per_file, mb_per_file, strategy, score FROM best
        UNION ALL SELECT a.file_id, 1, a.rank, a.num_files, a.pages_per_file, a.mb_per_file, a.strategy, a.score FROM alt a LEFT JOIN best b ON a.file_id = b.file_id WHERE b.file_id IS NULL OR a.num_files <> b.num_files
    ) SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY g, r) - 1 AS INTEGER) AS rank, {_COLUMNS} FROM everything""",
    "estimated_parts": f"WITH {_EVEN} SELECT file_id, part, pages, CAST(before + 1 AS INTEGER) AS first_page, CAST(before + pages AS INTEGER) AS last_page, mb, mb > 50 AS exceeds, CASE WHEN mb > 50 THEN {_ceil('mb', '50.0')} END AS resplit FROM sized",
    "pre_division": f"WITH {_EVEN} SELECT file_id, n AS num_files, CAST(count(*) FILTER (mb > 50) AS INTEGER) AS n_exceeding, count(*) FILTER (mb > 50) = 0 AS all_within, max(mb) AS max_mb, least(CAST(1 AS DOUBLE), CAST(50 AS DOUBLE) / max(mb)) AS efficiency FROM sized GROUP BY file_id, n",
    "division_recommendations": f"""WITH {_needs(V.FILES_SQL, 50.0, 135, 48.0, 121)}, opts AS (
        {_division('recommended', 'required_files', 'size_mb > 50 AND required_files <> 3', 0)}
        UNION ALL {_division('conservative', 'required_files + 2', 'size_mb > 50 AND required_files + 2 <= 20', 1)}
        UNION ALL {_division('fast', 'greatest(2, required_files - 1)', 'size_mb > 100 AND greatest(2, required_files - 1) <> required_files', 2)}
    ), part AS (SELECT *, unnest(range(0, num_files)) AS part FROM opts
    ), sized AS (SELECT *, (total_pages // num_files + CASE WHEN part < total_pages % num_files THEN 1 ELSE 0 END) * (size_mb / total_pages) * CAST(1.03 AS DOUBLE) AS mb FROM part
    ), summed AS (SELECT file_id, kind, o, num_files, max(mb) AS max_mb, least(CAST(1 AS DOUBLE), CAST(50 AS DOUBLE) / max(mb)) AS efficiency, count(*) FILTER (mb > 50) = 0 AS all_within FROM sized GROUP BY ALL)
    SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY efficiency DESC, o) - 1 AS INTEGER) AS rank, kind, num_files, max_mb, efficiency, all_within FROM summed WHERE kind <> 'fast' OR all_within""",
    "validated_parts": f"WITH {_PARTS}, s AS (SELECT *, size_mb <= 49.5 AND pages <= 1000 AS is_valid, coalesce(sum(pages) OVER (PARTITION BY original ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_page FROM parts) SELECT original, part, size_mb, is_valid, NOT size_mb <= 49.5 AS exceeds_limit, CASE WHEN NOT is_valid THEN {_ceil('size_mb', '49.5')} END AS resplit, CAST(first_page AS BIGINT) AS first_page, CAST(first_page + pages - 1 AS BIGINT) AS last_page FROM s",
    "validation_summary": f"WITH {_SUMMARY} SELECT original, n_parts, n_within, n_exceeding, all_within, recommended_files, round(size_mb, 6) AS size_mb FROM summed",
    "adjusted_parts": f"""WITH {_SUMMARY}, cut AS (SELECT original, greatest(recommended_files, 1) AS n, CAST(floor(size_mb * 4 / greatest(recommended_files, 1)) AS INTEGER) AS pages, size_mb / greatest(recommended_files, 1) AS size_mb FROM summed WHERE NOT all_within
    ), e AS (SELECT *, unnest(range(0, n)) AS part FROM cut) SELECT original, CAST(part AS INTEGER) AS part, round(size_mb, 6) AS size_mb, pages, CAST(part * pages + 1 AS INTEGER) AS first_page, CAST((part + 1) * pages AS INTEGER) AS last_page FROM e""".replace("split AS", "split AS").replace(", cut AS (SELECT original", ", cuts AS (SELECT original").replace("FROM cut)", "FROM cuts)"),
    "split_options": f"""WITH {_alternatives(V.FILES_SQL, 49.5, 1000, 49.5 * 0.96, 900)}
        SELECT file_id, any_value(required_files) AS min_files, CAST(min_by(num_files, rank) AS INTEGER) AS recommended, string_agg(CAST(num_files AS VARCHAR), ',' ORDER BY rank) AS options FROM alt GROUP BY file_id""",
    "expanded_parts": f"""WITH {V.BIG_FILES_SQL}, t AS (SELECT *, greatest({_ceil('total_pages', '900.0')}, {_ceil('size_mb', '96.0')}, 1) AS n_parts FROM files
    ), e AS (SELECT *, {_ceil('total_pages', 'n_parts')} AS per_part, unnest(range(0, n_parts)) AS part FROM t)
    SELECT file_id, CAST(part AS INTEGER) AS part, n_parts, per_part, CAST(part * per_part AS INTEGER) AS page_offset, CAST(greatest(0, least(part * per_part + per_part, total_pages) - part * per_part) AS INTEGER) AS n_pages FROM e""",
    "plan_presets": f"""WITH {V.FILES_SQL}, o AS (
        SELECT *, 'fast' AS preset, 2 AS raw, 900 AS most FROM files UNION ALL SELECT *, 'conservative', {_ceil('size_mb', '40.0')}, 100 FROM files UNION ALL SELECT *, 'auto', {_ceil('size_mb', '86.4')}, 1000 FROM files
    ), n AS (SELECT *, CAST(greatest(1, least(20, raw)) AS INTEGER) AS num_files FROM o
    ), e AS (SELECT *, CAST(greatest(10, least(1000, least({_ceil('total_pages', 'num_files')}, most))) AS INTEGER) AS pages_per_file, size_mb / num_files AS mb_per_file FROM n)
    SELECT file_id, preset, num_files, pages_per_file, mb_per_file, CASE WHEN mb_per_file > 0 THEN least(CAST(1 AS DOUBLE), CAST(50 AS DOUBLE) / mb_per_file) ELSE 1 END AS efficiency, mb_per_file <= 96 AND pages_per_file <= 900 AS valid FROM e""",
    "global_max_pages": f"WITH {_optimal(V.BIG_FILES_SQL)} SELECT files.batch_id, CAST(coalesce(max(CASE WHEN num_files > 1 THEN pages_per_file END), 150) AS INTEGER) AS max_pages FROM files LEFT JOIN best USING (file_id) GROUP BY files.batch_id",
    "legacy_counts": f"WITH {V.FILES_SQL} SELECT file_id, greatest({_ceil('size_mb', '45.0')}, {_ceil('total_pages', '121.5')}) AS num_files FROM files",
    "greedy_chunks": f"""WITH RECURSIVE {V.PAGES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS k FROM doc_pages
    ), f AS (SELECT doc_id, k, 0 AS chunk, 1 AS n, CAST(size AS DOUBLE) AS s FROM o WHERE k = 1
        UNION ALL SELECT o.doc_id, o.k, CASE WHEN f.n >= 3 OR f.s + o.size > 1200 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.n >= 3 OR f.s + o.size > 1200 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 3 OR f.s + o.size > 1200 THEN CAST(o.size AS DOUBLE) ELSE f.s + o.size END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
    SELECT doc_id, max(chunk) AS last_chunk, CAST(sum(chunk) AS BIGINT) AS sum_chunk, count(*) AS n_pages FROM f GROUP BY doc_id""",
    "natural_order": r"""WITH f AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN 'Vol_' || doc_id WHEN 1 THEN 'informe tomo ' || (doc_id % 17) WHEN 2 THEN 'x/Parte-' || doc_id ELSE 'anexo ' || lang END AS name FROM documents
    ), k AS (SELECT *, lower(regexp_extract(name, '([^/\\]*)$', 1)) AS low FROM f
    ), n AS (SELECT *, CAST(coalesce(nullif(regexp_extract(low, 'vol(?:umen)?[_\s]*(\d+)', 1), ''), nullif(regexp_extract(low, 'tomo[_\s]*(\d+)', 1), ''), nullif(regexp_extract(low, 'parte[_\s]*(\d+)', 1), ''), nullif(regexp_extract(low, '(\d+)', 1), '')) AS BIGINT) AS num FROM k)
    SELECT doc_id, name, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN num IS NULL THEN 1 ELSE 0 END, num NULLS FIRST, CASE WHEN num IS NULL THEN low END NULLS FIRST, doc_id) AS place FROM n""",
    "page_offsets": f"WITH {V.FILES_SQL} SELECT file_id, batch_id, CAST(coalesce(sum(total_pages) OVER (PARTITION BY batch_id ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_offset FROM files",
    "processing_plan": f"""WITH {_optimal(V.FILES_SQL)}, o AS (SELECT *, coalesce(sum(total_pages) OVER (PARTITION BY batch_id ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS file_offset FROM best
    ), e AS (SELECT *, {_ceil('total_pages', 'num_files')} AS per_part, unnest(range(0, num_files)) AS part FROM o
    ), r AS (SELECT *, file_offset + part * per_part + 1 AS first_page, greatest(0, least(part * per_part + per_part, total_pages) - part * per_part) AS n_pages FROM e)
    SELECT batch_id, file_id, CAST(part AS INTEGER) AS part, CASE WHEN num_files = 1 THEN 'direct' ELSE 'part' END AS operation, CAST(first_page AS BIGINT) AS first_page, CAST(first_page + n_pages - 1 AS BIGINT) AS last_page, CAST(n_pages AS INTEGER) AS n_pages, mb_per_file AS mb FROM r""",
    "batch_summary": f"""WITH {_optimal(V.FILES_SQL)}, j AS (SELECT r.*, b.num_files, b.warnings FROM req r LEFT JOIN best b USING (file_id)
    ), w AS (SELECT batch_id, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN coalesce(warnings, '') = '' THEN [] ELSE string_split(warnings, ',') END)))), ',') AS warnings FROM j GROUP BY batch_id
    ), a AS (SELECT batch_id, count(*) AS n_files, sum(size_mb) AS size_mb, CAST(sum(total_pages) AS BIGINT) AS total_pages, CAST(coalesce(sum(num_files), 0) AS BIGINT) AS n_parts, count(*) FILTER (requires_splitting) AS n_split, count(*) FILTER (density > 1) AS n_high, count(*) FILTER (density < 0.1) AS n_low FROM j GROUP BY batch_id)
    SELECT batch_id, n_files, round(size_mb, 4) AS size_mb, total_pages, n_parts, warnings, CASE WHEN n_split = 0 THEN 'direct-processing' WHEN n_high > n_files * 0.6 THEN 'image-heavy-collection' WHEN n_low > n_files * 0.6 THEN 'text-heavy-collection' ELSE 'mixed-content-collection' END AS strategy,
        round(size_mb / total_pages, 8) AS avg_density, CAST(n_parts * 0.5 AS DOUBLE) AS minutes FROM a JOIN w USING (batch_id)""",
    "batch_summary_legacy": f"""WITH {_optimal(V.FILES_SQL)}, j AS (SELECT r.*, CASE WHEN r.requires_splitting THEN b.num_files - 1 END AS more FROM req r LEFT JOIN best b USING (file_id))
        SELECT batch_id, count(*) AS n_files, CAST(sum(total_pages) AS BIGINT) AS total_pages, CAST(count(*) + coalesce(sum(more), 0) AS BIGINT) AS n_parts,
        CASE WHEN count(*) FILTER (requires_splitting) = 0 THEN 'process_directly' WHEN count(*) FILTER (requires_splitting) = count(*) THEN 'split_all' ELSE 'mixed' END AS strategy, CAST(sum(total_pages) AS DOUBLE) * 2 / 60 AS minutes FROM j GROUP BY batch_id""",
    "run_metrics": f"""WITH {V.RUNS_SQL} SELECT run_id, pages / total_s AS pages_per_s, size_mb / total_s AS mb_per_s, CASE WHEN size_mb < 10 THEN 'small' WHEN size_mb < 30 THEN 'medium' ELSE 'large' END AS bucket,
        CASE WHEN size_mb <= 45 THEN 'ok' WHEN size_mb <= 50 THEN 'warn' ELSE 'bad' END AS light, CASE WHEN error IS NULL THEN 'none' WHEN lower(error) LIKE '%429%' OR lower(error) LIKE '%too many requests%' THEN 'rate_limit' WHEN lower(error) LIKE '%3310%' THEN 'url_fetch' ELSE 'other' END AS error_class FROM runs""",
    "performance_summary": f"""WITH {V.RUNS_SQL} SELECT CASE WHEN size_mb < 10 THEN 'small' WHEN size_mb < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n_runs, round(avg(upload_s), 8) AS avg_upload_s, round(avg(process_s), 8) AS avg_process_s, CAST(sum(pages) AS BIGINT) AS pages, sum(total_s) AS total_s, round(sum(pages) / sum(total_s), 8) AS pages_per_s FROM runs GROUP BY 1""",
    "estimated_time": f"WITH {V.FILES_SQL}, p AS (SELECT *, CASE WHEN size_mb > 0 THEN greatest(1, floor(size_mb * 2)) ELSE 0 END AS pages FROM files) SELECT batch_id, CAST(sum(pages) AS BIGINT) AS pages, count(*) AS n_files, round((sum(pages) / CAST(0.5 AS DOUBLE) + count(*) * 2) * CAST(1.2 AS DOUBLE), 4) AS seconds FROM p GROUP BY batch_id",
    "results_by_original": f"WITH {V.RUNS_SQL} SELECT original_file, count(*) AS n_parts, CAST(sum(CASE WHEN error IS NULL THEN pages ELSE 0 END) AS BIGINT) AS pages, count(*) FILTER (error IS NOT NULL) AS n_failed FROM runs GROUP BY original_file",
    "file_list_status": f"WITH {V.FILES_SQL} SELECT batch_id, count(*) AS n_files, sum(CAST(floor(size_mb * 1000000 + 0.5) AS BIGINT)) / CAST(1000000 AS DOUBLE) AS size_mb FROM files GROUP BY batch_id",
}
