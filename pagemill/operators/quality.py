"""Quality of whole tables: comparison of two versions, and roll-ups by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.quality import quality_delta, with_quality


def compare_quality(df: DataFrame, before: str, after: str) -> DataFrame:
    """Adds score_before, score_after, improvement, improvement_pct and summary of two text columns, in one projection."""
    scored = with_quality(with_quality(df, before, "before_"), after, "after_")
    change, percent, verdict = quality_delta(F.col("before_score"), F.col("after_score"))
    columns = [*df.columns, F.col("before_score").alias("score_before"), F.col("after_score").alias("score_after"), change.alias("improvement"), percent.alias("improvement_pct"), verdict.alias("summary")]
    return scored.select(*columns)


def compare_tables(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """compare_quality of the texts of two tables that share a key; keys that only one has are left out."""
    joined = before.select(key, F.col("text").alias("before_text")).join(after.select(key, F.col("text").alias("after_text")), key)
    return compare_quality(joined, "before_text", "after_text").drop("before_text", "after_text")


def quality_by(df: DataFrame, *groups: str, text: str = "text") -> DataFrame:
    """For each group: texts, words, mean and least score, and how many texts have an issue or score under 70."""
    scored = with_quality(df.select(*groups, text), text)
    troubled = F.exists("issues", lambda x: x != "Sin problemas detectados")
    return scored.groupBy(*groups).agg(
        F.count("*").alias("n_docs"),
        F.sum("total_words").alias("n_words"),
        F.avg("score").alias("avg_score"),
        F.min("score").alias("min_score"),
        F.count_if(troubled).alias("n_with_issues"),
        F.count_if(F.col("score") < 70).alias("n_low"),
    )
