"""Header and footer blocks of recognised pages, found by the state of lines instead of by placeholders in a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What opens a header and a footer block.
HEADER_LABEL, FOOTER_LABEL = "**Encabezado:**", "**Pie de página:**"


def with_blocks(lines: DataFrame, parity: bool = False) -> DataFrame:
    """Adds `kept` to `doc_id, line_no, line`: whether a line is part of a header or footer block.

    A header block opens at a line that begins with its label, a footer block at one that stands behind an empty line.
    Both go on to the next empty line, so a block never takes the text behind it. With `parity` a block is its first
    line only, as in the original program. A null line is an empty one.
    """
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    line, empty = F.coalesce("line", F.lit("")), F.coalesce("line", F.lit("")) == ""
    behind = (F.col("line_no") >= 2) & (F.coalesce(F.lag("line").over(by_line), F.lit("")) == "")
    opens = line.startswith(HEADER_LABEL) | (line.startswith(FOOTER_LABEL) & behind)
    if parity:
        return lines.withColumn("kept", opens)
    found = lines.withColumns({"\nopens": opens, "\nparagraph": F.sum(empty.cast("long")).over(by_line)})
    inside = Window.partitionBy("doc_id", "\nparagraph").orderBy("line_no")
    return found.withColumn("kept", ~empty & F.max("\nopens").over(inside)).drop("\nopens", "\nparagraph")
