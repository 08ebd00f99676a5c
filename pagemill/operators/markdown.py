"""Repair of recognised markdown, line by line, with what must stay as it is told apart by kind."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.repair import HEADING, HTML_TABLE, line_kind, profile_rules
from pagemill.functions.text import replaced
from pagemill.operators.blocks import with_blocks
from pagemill.operators.tables import LEAST_CONFIDENCE, find_tables, optimize_table_cells, to_markdown

#: Where a table in HTML stood in its line; a noncharacter, which no rule touches, and which is dropped from texts.
HOLE = "\uffff"


def markdown_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id, line_no, line` of markdown texts, each table in HTML held out as one character; a null text has no lines."""
    held = F.regexp_replace(F.translate(F.col(text), HOLE, ""), HTML_TABLE, HOLE)
    return docs.select("doc_id", F.posexplode(F.split(held, "\n")).alias("line_no", "line"))


def repair_lines(lines: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Lines of `line, kept` with `kind` and `fixed`: texts and titles of headings repaired, all others as they are."""
    title = F.regexp_extract("line", HEADING, 2)
    typed = lines.withColumn("kind", F.when(F.coalesce("kept", F.lit(False)), "block").otherwise(line_kind(F.col("line"))))
    typed = typed.withColumn("fixed", replaced(F.when(F.col("kind") == "heading", title).when(F.col("kind") == "text", F.col("line")), rules))
    heading = F.concat(F.regexp_extract("line", HEADING, 1), F.lit(" "), F.col("fixed"))
    return typed.withColumn("fixed", F.when(F.col("kind") == "heading", heading).when(F.col("kind") == "text", F.col("fixed")).otherwise(F.col("line")))


def repair_markdown(docs: DataFrame, custom: Iterable = (), off: Iterable[str] = (), text: str = "text", detect: bool = True, blocks: bool = True, parity: bool = False, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """`doc_id, optimized, n_tables` for each row of docs, whose doc_id is unique.

    Tables drawn in the text are written as markdown with each cell repaired; the lines they took stay as empty ones
    (`detect`). Tables in HTML and images that open a line stay, and so do header and footer blocks (`blocks`; with
    `parity` their first lines only). Of headings the title is repaired, marks behind blanks or without a title stay, and
    all other lines are repaired by the rules of the profile but for the groups that are `off`, and the custom ones. A
    null text stays null, an empty one empty.
    """
    rules = profile_rules(off, custom)
    lines = markdown_lines(docs, text)
    routed = with_blocks(lines, parity) if blocks else lines.withColumn("kept", F.lit(False))
    routed = repair_lines(routed, rules)
    if detect:
        tables = optimize_table_cells(find_tables(lines, least), lambda cell: replaced(cell, rules))
        spans = tables.select("doc_id", "start", to_markdown(F.col("content"), F.col("cols")).alias("markdown"), F.explode(F.sequence("start", "end")).alias("line_no"))
        first = F.col("start") == F.col("line_no")
        spans = spans.select("doc_id", "line_no", F.when(first, F.col("markdown")).otherwise("").alias("drawn"), first.alias("opens"))
        routed = routed.hint("merge").join(spans.hint("merge"), ["doc_id", "line_no"], "left")
    else:
        routed = routed.withColumns({"drawn": F.lit(None).cast("string"), "opens": F.lit(False)})
    joined = routed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("drawn", "fixed").alias("line")))).alias("lines"), F.count_if("opens").alias("n_tables"))
    joined = joined.select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("held"), "n_tables")
    found = docs.select("doc_id", F.regexp_extract_all(F.translate(F.col(text), HOLE, ""), F.lit(f"({HTML_TABLE})"), F.lit(1)).alias("html")).hint("merge").join(joined.hint("merge"), "doc_id", "left")
    whole = F.array_join(F.zip_with(F.split("held", HOLE), "html", lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return found.select("doc_id", whole.alias("optimized"), F.coalesce("n_tables", F.lit(0).cast("long")).alias("n_tables"))
