"""Tables drawn with characters in text: finding their lines, cells and confidence, and writing them as markdown.

Lines are rows `doc_id, line_no, line`. Table-like lines make an island if at most one other line, which isn't blank,
stands between neighbours. A table is the longest tail of an island that passes: the earliest start whose lines, three or
more, parse to two rows or more with enough confidence. That is what trying each start in turn finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import count_of, split_lines, strip
from pagemill.sources.shared import written

# Characters that tables are drawn with, and the weights of confidence.
VERTICAL = "|│┃┆┇┊┋"
HORIZONTAL = "─━═-_"
CORNERS = "┌┐└┘╔╗╚╝╭╮╰╯"
CROSSES = "├┤┬┴┼╠╣╦╩╬"
DECORATION = rf"^[{HORIZONTAL.replace('-', '')}{CORNERS}{CROSSES} -]+$"
_MARKS = (VERTICAL + HORIZONTAL + CORNERS + CROSSES).replace("-", "") + "-"
_TWO_MARKS = f"[{_MARKS}][^{_MARKS}]*+[{_MARKS}]"
LEAST_CONFIDENCE = 0.6
_CELL = ""


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id, line_no, line` of a table of texts; build it once for all operators on lines."""
    return docs.select("doc_id", F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def is_table_like(line: Column) -> Column:
    """Whether a line has two table characters or more: a vertical one, or a horizontal one and five in all."""
    return line.rlike(_TWO_MARKS) & ((count_of(line, VERTICAL) > 0) | ((count_of(line, HORIZONTAL) > 0) & (count_of(line, VERTICAL + HORIZONTAL + CORNERS + CROSSES) >= 5)))


def islands(lines: DataFrame) -> DataFrame:
    """`doc_id, island, first_line, last_line, lines` of each island of three lines or more, tolerated lines between included."""
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    ahead = by_line.rowsBetween(Window.unboundedPreceding, -1)
    flagged = lines.withColumn("like", is_table_like(F.col("line")))
    flagged = flagged.withColumn("previous", F.last(F.when(F.col("like"), F.col("line_no")), ignorenulls=True).over(ahead))
    flagged = flagged.withColumn("before", F.coalesce(F.lag("line").over(by_line), F.lit("")))
    gap = F.col("line_no") - F.col("previous") - 1
    starts = F.col("like") & (F.col("previous").isNull() | (gap > 1) | ((gap == 1) & (strip(F.col("before")) == "")))
    flagged = flagged.withColumn("island", F.sum(starts.cast("long")).over(by_line))
    flagged = flagged.withColumn("until", F.max(F.when(F.col("like"), F.col("line_no"))).over(Window.partitionBy("doc_id", "island")))
    kept = flagged.where((F.col("island") > 0) & (F.col("line_no") <= F.col("until")))
    counts = F.array(*[count_of(F.col("line"), c) for c in VERTICAL])  # here once a line, as tails share lines
    found = kept.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.array_sort(F.collect_list(F.struct("line_no", "line", "like", counts.alias("counts")))).alias("lines"))
    return found.where(F.col("last_line") - F.col("first_line") >= 2)


def with_cells(lines: DataFrame, separator: str = "separator", parity: bool = False) -> DataFrame:
    """Adds to rows with a `line` its trimmed `cells`; what stands outside the outer separators, and decoration, has none.

    With `parity`, blank cells are dropped where the first part isn't equal to them, as in the original program.
    """
    lines = lines.withColumn("raw", F.split(F.replace(F.col("line"), F.col(separator), F.lit(_CELL)), _CELL))
    first = F.get("raw", F.lit(0))
    kept = F.filter("raw", lambda p: (strip(p) != "") | ((F.size("raw") > 2) & (p == first))) if parity else F.col("raw")
    lines = lines.withColumn("cells", F.transform(kept, lambda p: strip(p)))
    lines = lines.withColumn("cells", F.when(F.get("cells", F.lit(0)) == "", F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).otherwise(F.col("cells")))
    ended = (F.size("cells") > 0) & (F.get("cells", F.size("cells") - 1) == "")
    lines = lines.withColumn("cells", F.when(ended, F.slice("cells", F.lit(1), F.greatest(F.size("cells") - 1, F.lit(0)))).otherwise(F.col("cells")))
    decoration = (strip(F.col("line")) == "") | strip(F.col("line")).rlike(DECORATION)
    return lines.withColumn("cells", F.when(decoration, F.array().cast("array<string>")).otherwise(F.col("cells"))).drop("raw")


def _parsed(tails: DataFrame, least: float, parity: bool) -> DataFrame:
    """Tails of islands that pass, of their lines `doc_id, island, last_line, start, line_no, line, counts`: separator, content, confidence.

    The main separator is the vertical character that is most frequent in the tail, of equals the first of VERTICAL.
    """
    tail = Window.partitionBy("doc_id", "island", "start")
    counts = [F.struct(F.sum(F.get("counts", F.lit(k))).over(tail).alias("n"), F.lit(-k).alias("order"), F.lit(c).alias("c")) for k, c in enumerate(VERTICAL)]
    lines = tails.withColumn("best", F.array_max(F.array(*counts))).withColumns({"separator": F.col("best.c"), "marks": F.get("counts", -F.col("best.order"))}).drop("best", "counts")
    lines = with_cells(lines, parity=parity)
    rows = F.collect_list(F.when(F.size("cells") > 0, F.struct("line_no", "cells")))
    found = lines.groupBy("doc_id", "island", "last_line", "start", "separator").agg(F.array_sort(rows).alias("rows"), F.sum(F.length("line")).alias("chars"), F.sum("marks").alias("marks")).where(F.size("rows") >= 2)
    found = found.withColumn("sizes", F.transform("rows", lambda r: F.size(r["cells"])))
    usual = F.array_max(F.transform(F.array_distinct("sizes"), lambda n: F.struct(F.size(F.filter("sizes", lambda m: m == n)).alias("k"), (-n).alias("n"))))
    found = found.withColumn("usual", usual)
    share = F.when(F.col("chars") > 0, F.least(F.lit(1.0), F.col("marks") / (F.col("chars") * 0.1))).otherwise(0.0)
    structure = F.when(F.col("usual.n") <= -2, 1.0).otherwise(0.0)
    found = found.withColumn("confidence", F.least(F.lit(1.0), F.col("usual.k") / F.size("rows") * 0.4 + share * 0.3 + structure * 0.3))
    return found.where(F.col("confidence") >= least).select("doc_id", "island", "last_line", "start", "separator", F.transform("rows", lambda r: r["cells"]).alias("content"), "confidence")


def find_tables(lines: DataFrame, least: float = LEAST_CONFIDENCE, parity: bool = False) -> DataFrame:
    """`doc_id, table, start, end, rows, cols, separator, confidence, content` of each table of a lines table.

    Confidence is 0.4 of the share of rows with the usual number of cells, 0.3 of the separators (a tenth of the
    characters is enough), and 0.3 for two rows and two columns. Whole islands are tried first; only those that fail are
    tried from their later table-like lines. Islands are written, as three steps read them.
    """
    found = written(islands(lines), "islands")
    opened = lambda df, start: df.select("doc_id", "island", "last_line", start.alias("start"), F.explode("lines").alias("l")).select("doc_id", "island", "last_line", "start", "l.line_no", "l.line", "l.counts").where("line_no >= start")
    whole = _parsed(opened(found, F.col("first_line")), least, parity)
    failed = found.hint("merge").join(whole.select("doc_id", "island").hint("merge"), ["doc_id", "island"], "left_anti")
    starts = F.transform(F.filter("lines", lambda x: x["like"] & (x["line_no"] > F.col("first_line")) & (F.col("last_line") - x["line_no"] >= 2)), lambda x: x["line_no"])
    later = _parsed(opened(failed.withColumn("from", F.explode(starts)), F.col("from")), least, parity)
    first = F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("start"))
    best = whole.unionByName(later.withColumn("n", first).where("n = 1").drop("n"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return best.select("doc_id", number.alias("table"), "start", F.col("last_line").alias("end"), F.size("content").alias("rows"), F.array_max(F.transform("content", lambda r: F.size(r))).alias("cols"), "separator", "confidence", "content")


def to_markdown(content: Column, cols: Column) -> Column:
    """A table as markdown: rows padded or cut to `cols` cells, the first as header."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = F.transform(content, lambda r: row(F.slice(F.concat(r, F.array_repeat(F.lit(""), cols)), F.lit(1), cols)))
    rule = F.array(row(F.array_repeat(F.lit("---"), cols)))
    return F.when((F.size(content) == 0) | (cols < 1), "").otherwise(F.array_join(F.concat(F.slice(full, 1, 1), rule, F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0)))), "\n"))


def replace_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """`doc_id, text, n_tables`: the texts of a lines table with each found table rewritten as markdown."""
    spans = tables.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", to_markdown(F.col("content"), F.col("cols")).alias("markdown"))).alias("spans"))
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    joined = whole.hint("merge").join(spans.hint("merge"), "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))

    def line(x: Column) -> Column:
        inside = F.get(F.filter("spans", lambda s: (s["start"] <= x["line_no"]) & (x["line_no"] <= s["end"])), F.lit(0))
        return F.when(inside.isNull(), x["line"]).when(inside["start"] == x["line_no"], inside["markdown"])

    text = F.array_join(F.array_compact(F.transform("lines", line)), "\n")
    return joined.select("doc_id", text.alias("text"), F.size("spans").alias("n_tables"))


def table_cells(tables: DataFrame) -> DataFrame:
    """`doc_id, table, row, col, cell` of all tables."""
    rows = tables.select("doc_id", "table", F.posexplode("content").alias("row", "cells"))
    return rows.select("doc_id", "table", "row", F.posexplode("cells").alias("col", "cell"))


def optimize_table_cells(tables: DataFrame, repair) -> DataFrame:
    """The tables with `repair` (a function of a column) applied to each cell."""
    return tables.withColumn("content", F.transform("content", lambda r: F.transform(r, repair)))
