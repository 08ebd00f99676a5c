"""Prefix sums, blocks of headers and footers, and what is put into pages."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import repair as R
from pagemill.operators import blocks, legal, markdown, pages
from pagemill.operators.prefix import prefix_sums
from pagemill.sources import files


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_prefix_sums_of_hot_small_and_null_groups(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), k, rng.choice([None, 1, 2, -3]), "kept") for k in range(300)]
    rng.shuffle(rows)
    found = prefix_sums(spark.createDataFrame(rows, "g string, k int, v int, part string"), ["g"], [F.col("k")], {"s": F.col("v"), "n": F.lit(1)}, parts)
    sums, want = {}, set()
    for g, k, v, p in sorted(rows, key=lambda r: r[1]):
        a, n = sums.get(g, (0, 0))
        sums[g] = (a + (v or 0), n + 1)
        want.add((g, k, v, p, *sums[g]))
    assert found.columns == ["g", "k", "v", "part", "s", "n"] and {tuple(r) for r in found.collect()} == want


def test_prefix_sums_without_groups_and_without_rows(spark):
    rows = spark.range(50).withColumn("v", F.col("id") * 2)
    found = prefix_sums(rows, [], [-F.col("id")], {"place": F.lit(1)}, 4)
    assert {(r.id, r.place) for r in found.collect()} == {(k, 50 - k) for k in range(50)}
    assert prefix_sums(rows.where("id < 0"), ["v"], [F.col("id")], {"s": F.col("v")}).count() == 0


LAW = "Artículo 1.- uno\nI. primera\n\n**Pie de página:** Artículo 9\nArtículo 10 del pie\n\nArtículo 2.- dos\n**Encabezado:** Ley\n---\na) letra\n\na) otra\n**Pie de página:** en medio"


def test_blocks_end_at_an_empty_line(spark):
    lines = legal.legal_lines(spark.createDataFrame([(1, LAW)], "doc_id int, text string"))
    assert [r.line_no for r in lines.where("kept").orderBy("line_no").collect()] == [3, 4, 7, 8, 9]
    first = blocks.with_blocks(lines.drop("kept"), parity=True)
    assert [r.line_no for r in first.where("kept").orderBy("line_no").collect()] == [3, 7]


def test_blocks_are_no_law(spark):
    found = legal.with_structure(legal.legal_lines(spark.createDataFrame([(1, LAW), (2, None), (3, "")], "doc_id int, text string")))
    (counts,) = legal.structure_counts(found.where("doc_id = 1")).collect()
    assert (counts.articles, counts.fractions, counts.subsections) == (2, 1, 1)
    text = legal.rebuild_document(found.where("doc_id = 1")).first()["text"]
    assert "\n**Pie de página:** Artículo 9\nArtículo 10 del pie\n\n## Artículo 2" in text and "**Encabezado:** Ley\n---\na) letra\n\n#### a) otra" in text


MARKDOWN = "# ARTICULO  uno\n  ![ARTICULO](x--y.png) 4O2\n<table><tr>\n<td>4O2</td></tr></table> 4O2\n4O2\n | a | 4O2 |\n| b | c |\n| l0 | e |\n\n  # ARTICULO\n##\n**Encabezado:** 4O2\n4O2\n\n4O2 a"


def test_markdown_by_kinds_of_lines(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, ""), (4, "\n\n**Pie de página:** 4O2\n4O2\n\n4O2")], "doc_id int, text string")
    found = {r.doc_id: (r.optimized, r.n_tables) for r in markdown.repair_markdown(docs).collect()}
    assert found[1] == ("# ARTÍCULO uno\n  ![ARTICULO](x--y.png) 4O2\n<table><tr>\n<td>4O2</td></tr></table> 402\n402\n| a | 402 |\n| --- | --- |\n| b | c |\n| 10 | e |\n\n\n\n  # ARTICULO\n# #\n**Encabezado:** 4O2\n4O2\n\n402 a", 1)
    assert found[2] == (None, 0) and found[3] == ("", 0) and found[4] == ("\n\n**Pie de página:** 4O2\n4O2\n\n402", 0)
    by_column = {r.doc_id: r.t for r in docs.select("doc_id", R.optimize_markdown(F.col("text")).alias("t")).collect()}
    without = {r.doc_id: r.optimized for r in markdown.repair_markdown(docs, detect=False).collect()}
    assert by_column == without


def page(spark, text):
    return spark.createDataFrame([("d", 0, text, 5), ("e", 1, None, 6)], "doc_id string, page_idx int, markdown string, rank int")


def test_tables_go_to_placeholders_by_rank(spark):
    tables = spark.createDataFrame([("d", 0, 9, "<b>tbl-1.html</b>"), ("d", 0, 2, "<a>"), ("x", 0, 0, "no")], "doc_id string, page_idx int, table_pos int, content string")
    found = {r.doc_id: r for r in pages.inject_tables(page(spark, "tbl-10.html [tbl-2.html](tbl-2.html)x[tbl-10.html]tbl-300.html"), tables).collect()}
    box = '\n\n<div class="ocr-table">\n{}\n</div>\n\n'
    assert found["d"].markdown == box.format("<b>tbl-1.html</b>") + " " + box.format("<a>") + "x" + box.format("<b>tbl-1.html</b>") + "tbl-300.html"
    assert found["e"].markdown is None and found["d"].rank == 5


def test_images_by_name(spark):
    images = spark.createDataFrame([("d", 0, 0, "a", b"\x01", "png", "c $1"), ("d", 0, 1, "b", None, None, "below"), ("d", 0, 2, "a", b"\x02", "png", None), ("d", 0, 3, None, b"\x02", "png", None)], "doc_id string, page_idx int, image_pos int, image_key string, content binary, extension string, caption string")
    found = {r.doc_id: r for r in pages.embed_images(page(spark, "![a](x) ![b](y) ![c](z)"), images).collect()}
    assert found["d"].markdown == "![a](data:image/png;base64,AQ==)\n\nc $1 ![b](y)\n\nbelow ![c](z)" and found["e"].markdown is None
    exact = {r.doc_id: r for r in pages.embed_images(page(spark, "![a](x) ![a](a)"), images).collect()}
    assert exact["d"].markdown == "![a](x) ![a](data:image/png;base64,AQ==)\n\nc $1"


def test_annotations_of_any_schema(spark):
    rows = ['{"annotation": "", "bbox_annotation": {"title": "t", "chart_type": "pie", "n": {"a": [1]}}}', '{"id": "i", "structured_annotation": "{\\"summary\\": \\"s\\"}"}', '{"annotation": []}', "[1]", "no", "", None, '{"annotation": "text"}']
    images = spark.createDataFrame([("d", 0, k, t) for k, t in enumerate(rows)], "doc_id string, page_idx int, image_pos int, image string")
    found = {r.image_pos: (r.image_id, r.kind, r.description) for r in pages.annotations_of(images).collect()}
    assert found == {0: ("img_0", "pie", "t"), 1: ("i", "Imagen", "s")}


def test_files_round_trip_and_failed_tasks_leave_nothing(spark, tmp_path):
    rows = [(f"a/{k}.txt", "é" * k) for k in range(30)] + [("null", None)]
    files.write_files(spark.createDataFrame(rows, "name string, content string").repartition(3), f"file://{tmp_path}/ok")
    assert {(r.name, bytes(r.content)) for r in files.read_files(spark, f"{tmp_path}/ok").collect()} == {(n, t.encode()) for n, t in rows if t}
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "ok")) >= len(rows) + 1
    for bad in ("../x", "/x", "", "a//b"):
        with pytest.raises(Exception, match="relative file name"):
            files.write_files(spark.createDataFrame([("fine", "1"), (bad, "2")], "name string, content string").coalesce(1), f"{tmp_path}/bad")
    assert not [f for _, _, names in os.walk(tmp_path / "bad") for f in names]
    files.write_files(spark.createDataFrame([], "name string, content string"), f"{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"]


def test_files_are_listed_by_tasks(spark, tmp_path):
    rows = spark.range(40).select(F.concat_ws("/", F.col("id") % 3, F.concat("id", F.lit(".txt"))).alias("name"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("content"))
    files.write_files(rows.repartition(4), f"{tmp_path}/out")
    (tmp_path / "out" / "plain").write_text("y")
    found = {r.path: r.length for r in files.file_status(spark, f"file://{tmp_path}/out").collect()}
    assert found == {r.path: r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/out").select("path", "length").collect()} | {k: 0 for k in found if k.endswith("/0.txt")}
    assert len(found) == 41 and files.read_files(spark, f"{tmp_path}/out").count() == 40
    for df in (files.file_status(spark, f"{tmp_path}/out"), files.read_files(spark, f"{tmp_path}/out")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan" in plan and "InMemoryFileIndex" not in plan
        assert df.rdd.getNumPartitions() == 5
