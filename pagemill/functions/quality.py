"""Quality metrics of recognised text, as columns; none needs a shuffle or Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import WORD_CHAR, count_of

# Words and letters that recognition errors leave, characters that prose hardly has, and the thresholds.
SUSPICIOUS_WORDS = ["rn", "cl", "vv", "ii", "Il", "lI"]
SUSPICIOUS_INNER = [r"(?<=[a-z])I(?=[a-z])", r"(?<=[A-Z])l(?=[A-Z])"]
RARE_CHARS = "¦§¢£µ¶ªº¿¡"
PLAIN_MIXED = r"^\d+[a-z]{1,3}$"
NO_ISSUE = "Sin problemas detectados"
EMPTY_ISSUE = "Texto vacío o inválido"

METRICS = ["suspicious_patterns", "rare_chars_count", "rare_chars_ratio", "avg_word_length", "mixed_alphanum_words", "mixed_alphanum_ratio", "total_words", "total_chars", "score", "issues"]


def suspicious_patterns(text: Column) -> Column:
    """How many suspicious words and letters a text has."""
    whole = rf"(?<!{WORD_CHAR})(?:{'|'.join(SUSPICIOUS_WORDS)})(?!{WORD_CHAR})"
    return sum((F.regexp_count(text, F.lit(p)) for p in SUSPICIOUS_INNER), F.regexp_count(text, F.lit(whole))).cast("long")


def rare_chars(text: Column) -> Column:
    """How many rare characters a text has."""
    return count_of(text, RARE_CHARS).cast("long")


def mixed_alphanum(text: Column) -> Column:
    """How many tokens mix letters and digits, but for numbers with up to three letters behind. Only tokens with a digit are listed."""
    numbered = F.regexp_extract_all(text, F.lit(rf"(?<!{WORD_CHAR})[\p{{L}}_]*+\p{{N}}{WORD_CHAR}*+"), F.lit(0))
    return F.size(F.filter(numbered, lambda w: w.rlike(r"\p{L}") & ~F.lower(w).rlike(PLAIN_MIXED))).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD_CHAR}++")).cast("long")


def average_length(text: Column, words: Column) -> Column:
    """The mean length of tokens, given their number; 0 without any."""
    return F.when(words > 0, F.length(F.regexp_replace(text, rf"[^{WORD_CHAR[1:-1]}]++", "")).cast("double") / words).otherwise(0.0)


def overall_score(suspicious: Column, rare_ratio: Column, mixed_ratio: Column, length: Column, words: Column) -> Column:
    """100 without the penalties, and within 0 and 100."""
    unusual = (length < 3) | (length > 10)
    penalties = [
        F.least(F.lit(30.0), suspicious / F.greatest(words, F.lit(1)) * 100.0),
        F.least(F.lit(20.0), rare_ratio * 1000.0),
        F.least(F.lit(20.0), mixed_ratio * 50.0),
        F.when(unusual, F.least(F.lit(15.0), F.abs(length - 6.0) * 3.0)).otherwise(0.0),
        F.when(words < 10, 15.0).otherwise(0.0),
    ]
    score = F.lit(100.0)
    for p in penalties:
        score = score - p
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def found_issues(suspicious: Column, rare: Column, rare_ratio: Column, length: Column, mixed_ratio: Column) -> Column:
    """What is wrong with a text, as sentences; one that says so if nothing is."""
    told = F.array_compact(
        F.array(
            F.when(suspicious > 5, F.format_string("Alto número de patrones sospechosos (%d)", suspicious)),
            F.when(rare > 10, F.format_string("Muchos caracteres raros encontrados (%d)", rare)),
            F.when(rare_ratio > 0.01, F.format_string("Ratio elevado de caracteres raros (%.2f%%)", rare_ratio * 100)),
            F.when(length < 3, F.format_string("Palabras muy cortas en promedio (%.1f chars)", length)),
            F.when(length > 10, F.format_string("Palabras muy largas en promedio (%.1f chars)", length)),
            F.when(mixed_ratio > 0.1, F.format_string("Muchas palabras con letras y números mezclados (%.1f%%)", mixed_ratio * 100)),
        )
    )
    return F.when(F.size(told) == 0, F.array(F.lit(NO_ISSUE))).otherwise(told)


def with_quality(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the ten metrics of a text column, at full precision; a blank text, or one without words, has zeros and one issue."""
    c = {m: f"{prefix}{m}" for m in METRICS}
    words = F.coalesce(word_count(F.col(text)), F.lit(0).cast("long"))
    df = df.withColumn(c["total_words"], words)
    own = F.col(c["total_words"])
    empty = own == 0
    count = lambda value: F.when(empty, F.lit(0).cast("long")).otherwise(value)
    df = df.withColumns(
        {
            c["suspicious_patterns"]: count(suspicious_patterns(F.col(text))),
            c["rare_chars_count"]: count(rare_chars(F.col(text))),
            c["avg_word_length"]: F.when(empty, 0.0).otherwise(average_length(F.col(text), own)),
            c["mixed_alphanum_words"]: count(mixed_alphanum(F.col(text))),
            c["total_chars"]: count(F.length(text).cast("long")),
        }
    )
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(of)), F.lit(0.0))
    df = df.withColumns({c["rare_chars_ratio"]: share(c["rare_chars_count"], c["total_chars"]), c["mixed_alphanum_ratio"]: share(c["mixed_alphanum_words"], c["total_words"])})
    v = {m: F.col(x) for m, x in c.items()}
    score = overall_score(v["suspicious_patterns"], v["rare_chars_ratio"], v["mixed_alphanum_ratio"], v["avg_word_length"], v["total_words"])
    issues = found_issues(v["suspicious_patterns"], v["rare_chars_count"], v["rare_chars_ratio"], v["avg_word_length"], v["mixed_alphanum_ratio"])
    nothing = v["total_words"] == 0
    return df.withColumns({c["score"]: F.when(nothing, 0.0).otherwise(score), c["issues"]: F.when(nothing, F.array(F.lit(EMPTY_ISSUE))).otherwise(issues)})


def quality_delta(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """(improvement, its percentage of the score before, at least 1, what it amounts to: one of four classes)."""
    change = after - before
    verdict = F.when(change > 5, "significant").when(change > 0, "slight").when(change < -5, "worse").otherwise("unchanged")
    return change, change / F.greatest(before, F.lit(1.0)) * 100.0, verdict


def delta_text(change: Column, percent: Column) -> Column:
    """The comparison as a sentence."""
    return (
        F.when(change > 5, F.format_string("✓ Mejora significativa: +%.1f puntos (%+.1f%%)", change, percent))
        .when(change > 0, F.format_string("✓ Mejora leve: +%.1f puntos (%+.1f%%)", change, percent))
        .when(change < -5, F.format_string("⚠ Empeoramiento: %.1f puntos (%.1f%%)", change, percent))
        .otherwise(F.format_string("→ Sin cambios significativos (%.1f puntos)", change))
    )
