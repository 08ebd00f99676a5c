"""Forms of rules that look at few places of a text, against the plain forms that they stand for."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagemill.functions.text import strip
from pagemill.operators import legal as L
from pagemill.operators import tables as T


def test_paragraph_rules_begin_with_what_they_replace(spark):
    guard = "".join(f"(?<!{a.replace('.', chr(92) + '.')})" for a in L.ABBREVIATIONS)
    plain = [("\r\n", "\n"), (r"[ \t]+", " "), (r"([^\n])\n(\*[^\n]+\*)", "$1\n\n$2"), (r"(\*[^\n]+\*)\n(?!\n)(?!\*)", "$1\n\n"), (rf"{guard}\.\s+([A-ZÁÉÍÓÚÑ])(?!\n\n)", ".\n\n$1"), (rf"{guard}\.([A-ZÁÉÍÓÚÑ])(?!\n\n)", ".\n\n$1"), (r"(?<!-)\n{3,}(?!-)", "\n\n")]
    assert not [p for p, _ in L.PARAGRAPH_RULES if p.startswith("(?<")]
    rng = random.Random(1)
    texts = [("".join(rng.choices(["Art", "Lic", ".", "C.P", "i.e", "A", "Ñ", "b", " ", "\t", "\n", "-", "*", "\r\n", "\n\n"], k=rng.randint(1, 60))),) for _ in range(3000)]
    want = F.col("text")
    for pattern, replacement in plain:
        want = F.regexp_replace(want, pattern, replacement)
    rows = spark.createDataFrame([*texts, (None,)], "text string").select(strip(want).alias("want"), L.format_paragraphs(F.col("text")).alias("got"))
    assert rows.where(~F.col("want").eqNullSafe(F.col("got"))).isEmpty()


def test_table_like_lines_and_islands_that_are_read_once(spark):
    rng = random.Random(2)
    texts = [(k, "\n".join(rng.choices(["| a | b |", "|--|--|", "| c | d |", "-----", "a-b", "", " ", "word", "│ e │ f │", "a | b", "\t| "], k=rng.randint(0, 14)))) for k in range(400)]
    lines = T.lines_of(spark.createDataFrame([*texts, (400, None)], "doc_id long, text string"))
    vertical, horizontal, marks = (F.length("line") - F.length(F.translate("line", c, "")) for c in (T.VERTICAL, T.HORIZONTAL, T.VERTICAL + T.HORIZONTAL + T.CORNERS + T.CROSSES))
    plain = (strip(F.col("line")) != "") & (marks >= 2) & ((vertical > 0) | ((horizontal > 0) & (marks >= 5)))
    assert lines.where(~plain.eqNullSafe(T.is_table_like(F.col("line")))).isEmpty()
    # the plan of tables reads islands that are written, and no text
    plan = T.find_tables(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan.replace("split(replace", "") and "/islands-" in T.find_tables(lines).inputFiles()[0]
