"""Queries of laws with page headers, of repaired markdown, and of pages with tables, images and annotations; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import assembly as A
from pagemill.operators import legal as L
from pagemill.operators import markdown as M
from pagemill.operators import pages as P
from pagemill.plans import table_sql
from pagemill.plans import views as V
from pagemill.plans.text_queries import LIKE_SQL
from pagemill.sources import ocr as S
from pagemill.sources.files import read_files, write_files
from pagemill.sources.shared import shared_folder


def _paged_laws(spark, d):
    """Documents as laws: articles, and header and footer blocks of several lines that hold heads of articles and fractions."""
    k = lambda i: (F.floor(i / 9) + 1).cast("string")
    line = lambda x, i: (
        F.when(i % 9 == 0, F.concat(F.lit("Artículo "), k(i), F.lit(".- "), x))
        .when(i % 9 == 2, F.concat(F.lit("\n**Pie de página:** Artículo "), k(i), F.lit("\nARTÍCULO 7 de "), x, F.lit("\n")))
        .when(i % 9 == 4, F.concat(x, F.lit("\n**Encabezado:** Ley\nII. "), x, F.lit("\n\nart. 5 "), x))
        .when(i % 9 == 6, F.concat(x, F.lit("\n**Pie de página:** dentro\n## Artículo 8 "), x))
        .otherwise(x)
    )
    return V.spread(V.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def legal_protected(spark, d):
    """LEG2: lines of laws with those of header and footer blocks told apart, which hold heads of articles that don't count."""
    lines = L.with_structure(L.legal_lines(_paged_laws(spark, d)))
    return lines.select("doc_id", "line_no", "kept", "is_article", "article_seq", "section", (L.marked_line() == F.col("line")).alias("as_it_was"))


def _marked_up(spark, d):
    """Documents as recognised markdown, by line: headings, images, tables in HTML and drawn ones, header and footer blocks."""
    line = lambda x, i: (
        F.when(i % 11 == 0, F.concat(F.lit("## "), x))
        .when(i % 11 == 2, F.concat(F.lit(" ![a  b](x ,y) "), x))
        .when(i % 11 == 3, F.concat(x, F.lit("<table><tr>\n<td>a  ,b</td></TABLE> "), x))
        .when(i % 11 == 5, F.concat(F.lit("**Encabezado:** uno  ,dos\n"), x, F.lit("\n")))
        .when(i % 11 == 6, F.concat(F.lit("\n**Pie de página:** tres  ,x\n"), x, F.lit("\n")))
        .when(i % 11 == 7, F.concat(F.lit("\n | "), F.left(F.translate(x, "|", ""), F.lit(30)), F.lit(" | b  ,c |\n|---|---|\n| uno | dos  ,tres |\n\n")))
        .when(i % 11 == 8, F.concat(F.lit("  # "), x))
        .when(i % 11 == 9, F.lit("###"))
        .otherwise(x)
    )
    return V.spread(V.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def routed_markdown(spark, d):
    """CLN10, CLN11, CLN17: markdown repaired by the spacing rules only, each kind of line by its own way."""
    found = M.repair_markdown(_marked_up(spark, d), off=["punctuation", "hyphenation", "pairs", "ocr"])
    return found.select("doc_id", F.length("optimized").alias("n_chars"), F.md5("optimized").alias("digest"), "n_tables")


def optimized_markdown(spark, d):
    """CLN10, CLN11: the same documents by the whole profile."""
    found = M.repair_markdown(_marked_up(spark, d))
    return found.select("doc_id", F.length("optimized").alias("n_chars"), F.md5("optimized").alias("digest"), "n_tables")


def injected_tables(spark, d):
    """JN1: tables joined to the placeholders of pages by rank, in all four spellings; some pages have too few tables."""
    pages = V.doc_pages(spark, d)
    marked = F.concat(F.lit("[tbl-12.html](tbl-12.html) "), "markdown", F.lit(' tbl-3.html <a href="tbl-7.html">tbl-7.html</a> tbl-12.html [tbl-3.html] tbl-30.html'))
    tables = pages.select("doc_id", "page_idx", F.explode(F.slice(F.array(*map(F.lit, (5, 8, 9))), F.lit(1), F.col("page_idx") % 4)).alias("table_pos"), "markdown")
    tables = tables.select("doc_id", "page_idx", "table_pos", F.concat(F.lit("<table>tbl-7.html "), F.col("table_pos").cast("string"), F.left("markdown", F.lit(20)), F.lit("</table>")).alias("content"))
    return P.inject_tables(pages.withColumn("markdown", marked), tables).select("doc_id", "page_idx", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("digest"))


def embedded_images(spark, d):
    """JN2, IMG3: images joined to the references of pages by name, with captions; exact references go before others."""
    pages = V.doc_pages(spark, d)
    marked = F.concat(F.lit("![a](a) ![a](x/a.png) "), "markdown", F.lit(" ![b](other) ![c](c) ![d](d)"))
    rows = F.array(*[F.struct(F.lit(k).alias("image_pos"), F.lit(c).alias("image_key")) for k, c in enumerate("abca")])
    images = pages.where("page_idx % 3 <> 2").select("doc_id", "page_idx", "markdown", F.explode(rows).alias("x")).select("doc_id", "page_idx", "x.*", "markdown")
    content = F.when(F.col("image_key") != "c", F.encode(F.concat(F.col("image_pos").cast("string"), F.col("markdown")), "UTF-8"))
    caption = F.when(F.col("image_key") != "a", F.concat(F.lit("*figure*: $1 \\ "), F.col("image_key")))
    images = images.select("doc_id", "page_idx", "image_pos", "image_key", content.alias("content"), F.lit("jpg").alias("extension"), caption.alias("caption"))
    return P.embed_images(pages.withColumn("markdown", marked), images).select("doc_id", "page_idx", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("digest"))


def _captions(pages):
    """None to three captions a page, an empty one among them, as rows in an order of their own."""
    rows = F.slice(F.array(*[F.struct(F.lit(k).alias("image_pos"), F.lit(c).alias("c")) for k, c in ((1, "eins"), (2, ""), (4, "vier"))]), F.lit(1), F.col("page_idx") % 4)
    return P.page_captions(pages.select("doc_id", "page_idx", F.explode(rows).alias("x")).select("doc_id", "page_idx", "x.*"), F.col("c"))


def captioned_pages(spark, d):
    """JN3: the k-th caption of a page below its k-th image."""
    pages = V.doc_pages(spark, d).withColumn("markdown", F.concat(F.lit("![a](a)"), F.replace("markdown", F.lit("!["), F.lit("")), F.lit("![b c](d e)\n![](f)![g](g)")))
    found = pages.hint("merge").join(_captions(pages).hint("merge"), ["doc_id", "page_idx"], "left")
    text = A.attach_captions_markdown(F.col("markdown"), F.coalesce("captions", F.array().cast("array<string>")))
    return found.select("doc_id", "page_idx", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


def captioned_html(spark, d):
    """JN4: captions in figures first, then around other images; and, as the original does it, from the first caption again."""
    plain = F.translate("markdown", "<>", "")
    pages = V.doc_pages(spark, d).withColumn("markdown", F.concat(F.lit("<figure id=1><img src=a> x</figure>"), plain, F.lit("<img src=b><p><figure>\n<img src=c></figure><img src=d>")))
    found = pages.hint("merge").join(_captions(pages).hint("merge"), ["doc_id", "page_idx"], "left")
    text = lambda parity: A.attach_captions_html(F.col("markdown"), F.coalesce("captions", F.array().cast("array<string>")), parity)
    return found.select("doc_id", "page_idx", F.md5(text(False)).alias("digest"), F.md5(text(True)).alias("original"))


def any_annotations(spark, d):
    """ANN1 to ANN5: annotations in four schemas, and none, in one column of JSON; their kind, description and captions."""
    pages = V.doc_pages(spark, d)
    said = F.regexp_replace(F.left("markdown", F.lit(40)), r"[^a-zA-Z0-9 ]", "")
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    image = (
        F.when(F.col("page_idx") % 5 == 0, of('{"id": "i-', F.col("page_idx").cast("string"), '", "annotation": {"image_type": "chart", "short_description": "', said, '", "summary": "long ', said, '", "scale": 12}}'))
        .when(F.col("page_idx") % 5 == 1, of('{"annotation": {}, "bbox_annotation": {"tipo_imagen": "plano", "image_type": "no", "descripcion_breve": "', said, '"}}'))
        .when(F.col("page_idx") % 5 == 2, of('{"id": "x", "annotation": null, "structured_annotation": "{\\"diagram_type\\": \\"', said, '\\", \\"main_elements\\": [1, \\"b\\"], \\"title\\": \\"t\\"}"}'))
        .when(F.col("page_idx") % 5 == 3, of('{"annotation": {"other": {"deep": 1}}}'))
        .otherwise(of("no json ", said))
    )
    found = P.annotations_of(pages.select("doc_id", "page_idx", (F.col("page_idx") + 7).alias("image_pos"), image.alias("image")))
    return found.select("doc_id", "page_idx", "image_id", "kind", "description", "brief", "extras", "caption_markdown", "caption_html")


def written_files(spark, d):
    """SNK1, SNK2, SNK4 to SNK7: documents written as files of three formats, and their images, and read back."""
    k, stem = F.col("doc_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    docs = V.table(spark, d, "documents")
    report = F.when(k % 3 == 0, F.concat(F.lit("quality "), k.cast("string")))
    whole = docs.select(S.output_name(stem, k, k + 9, k % 2 == 1).alias("name"), S.output_title(stem).alias("title"), S.markdown_file(F.col("text"), report).alias("markdown"), F.replace("text", F.lit("a"), F.lit("A")).alias("text"), F.col("text").alias("html"), F.lit(None).cast("string").alias("json"))
    images = docs.where("doc_id % 7 = 0").select("doc_id", (k + 1).alias("page_num"), F.lit(0).alias("image_pos"), F.lit(None).cast("string").alias("image_base64"), F.lit(None).cast("string").alias("data_uri"), F.encode(F.concat(F.when(k % 2 == 0, "BM").otherwise("RIFF"), "text"), "UTF-8").alias("data"))
    folder = shared_folder(spark, "files")
    S.write_formats(whole, folder, ("md", "txt", "html"), images)
    return read_files(spark, folder, empty=True).select("name", F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


_IMAGES = '[{"id": "a", "image_base64": "data:image/png;base64,AQ==", "annotation": {"image_type": "x", "short_description": "d"}}, {"image_id": "b", "annotations": [{"summary": "s"}, {"short_description": "e"}]}]'


def _pages(spark, d):
    """Conversations as recognised pages: with a table and two images each, headers on even and footers on some pages."""
    said = F.regexp_replace("markdown", "[^a-zA-Z0-9 .,]", "")
    pages = V.doc_pages(spark, d).select("doc_id", "page_idx", (F.col("page_idx") + 1).alias("page_num"), F.concat(said, F.lit(" ![a](a) tbl-1.html ![b](b)")).alias("markdown"))
    header, footer = F.when(F.col("page_idx") % 2 == 0, "H").otherwise(""), F.when(F.col("page_idx") % 3 == 0, "F")
    return pages.withColumns({"header": header, "footer": footer, "tables": F.array(F.struct(F.lit("<t>").alias("content"))), "images": F.from_json(F.lit(_IMAGES), f"array<{S.IMAGE}>")})


def combined_documents(spark, d):
    """ASM1, ASM5, IMG1: documents with labels, tables and embedded images."""
    found = A.combined_markdown(_pages(spark, d))
    return found.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def html_bodies(spark, d):
    """ASM3: documents as they are rendered, with a rule and a heading before each page."""
    found = A.assemble_html_body(_pages(spark, d))
    return found.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def assembled_texts(spark, d):
    """ASM2, ANN1: documents as plain text, with headings of pages and descriptions of images."""
    plain = F.regexp_replace("markdown", r" !\[a\].*$", "")
    found = A.assemble_text(_pages(spark, d).withColumn("markdown", plain))
    return found.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def response_totals(spark, d):
    """ASM6: pages and images of each response."""
    held = _pages(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("markdown", F.when(F.col("page_idx") % 2 == 0, F.col("images")).alias("images"))).alias("pages"))
    return A.totals(held)


def read_file_metrics(spark, d):
    """SRC1, FIL1, FIL9: documents written as files and their status read; types, sizes and why a file is turned away."""
    k = F.col("doc_id")
    extension = F.when(k % 4 == 0, ".PDF").when(k % 4 == 1, ".jpeg").when(k % 4 == 2, ".txt").otherwise("")
    folder = shared_folder(spark, "files")
    docs = V.table(spark, d, "documents").where("text <> ''")
    write_files(docs.select(F.concat(F.lit("d"), k.cast("string"), extension).alias("name"), F.col("text").alias("content")), folder)
    pages = docs.where(k % 3 == 0).select(F.concat(F.lit("d"), k.cast("string")).alias("stem"), (k % 7 + 1).cast("int").alias("total_pages"))
    files = S.read_file_metrics(spark, folder).withColumn("name", F.regexp_extract("file_id", "([^/]+)$", 1))
    known = files.withColumn("stem", F.regexp_extract("name", r"^([^.]+)", 1)).hint("merge").join(pages.hint("merge"), "stem").select("file_id", pages["total_pages"])
    large = S.large_files(spark, folder, 2000).select(F.col("path").alias("file_id"), F.lit(True).alias("large"))
    found = S.validate_files(S.read_file_metrics(spark, folder, known), 0.001).hint("merge").join(large.hint("merge"), "file_id", "left")
    return found.select(F.regexp_extract("file_id", "([^/]+)$", 1).alias("name"), F.round("size_mb", 9).alias("size_mb"), "total_pages", "mime", "reject_reason", F.coalesce("large", F.lit(False)).alias("large"))


def read_responses(spark, d):
    """SRC2 to SRC4, FIL: responses written as JSON files, read back, and their pages, images and tables in rows."""
    pages = _pages(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_idx", "markdown", "header", "footer", "tables", "images"))).alias("pages"))
    folder = shared_folder(spark, "responses")
    text = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "pages"))
    write_files(pages.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), text.alias("content")), folder)
    exploded = S.explode_pages(S.read_responses(spark, folder), 10)
    images = S.explode_images(exploded).groupBy("doc_id").agg(F.count("*").alias("n_images"), F.sum("page_num").alias("of_pages"), F.max("image_key").alias("last_key"))
    tables = S.explode_tables(exploded).groupBy("doc_id").agg(F.count("*").alias("n_tables"), F.sum(F.length("content")).alias("table_chars"))
    whole = exploded.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("markdown")).alias("n_chars"), F.count_if(F.col("header") == "H").alias("n_headers"))
    return whole.hint("merge").join(images.hint("merge"), "doc_id").hint("merge").join(tables.hint("merge"), "doc_id")


#: A line of each kind that laws have, and what it is: article number and suffix, amendment pattern, date, fraction, subsection.
SPELLINGS = [
    ("Artículo 5o.- texto", "5o", "o", None, None, None, None),
    ("ARTICULO 12 Bis. texto", "12Bis", "Bis", None, None, None, None),
    ("## Art. 7-A. texto", "7-A", "-A", None, None, None, None),
    ("> artículo 9° Quáter texto", "9° Quáter", "° Quáter", None, None, None, None),
    ("Artículo adicionado DOF 01-02-2020", None, None, 1, "2020-02-01", None, None),
    ("**Parrafo adicionado D.O.F. 12 enero 2019", None, None, 2, "2019-01-12", None, None),
    ("Fracciòn adicionada DOF 1/3/21", None, None, 3, "2021-03-01", None, None),
    ("Inciso adicionado DOF 02.03.2004", None, None, 4, "2004-03-02", None, None),
    ("Párrafo con numerales adicionado DOF 03-04-2015", None, None, 5, "2015-04-03", None, None),
    ("PÁRRAFO CON INCISOS ADICIONADO DOF 03-04-2016", None, None, 6, "2016-04-03", None, None),
    ("Se adicionan los artículos 3 y 4, 05-06-2017", None, None, 7, "2017-06-05", None, None),
    ("Artículo reformado DOF 07-08-2018", None, None, 8, "2018-08-07", None, None),
    ("Párrafo reformado DOF 07-08-2019", None, None, 9, "2019-08-07", None, None),
    ("# Fracción reformada DOF diciembre 24, 2020", None, None, 10, "2020-12-24", None, None),
    ("Inciso reformado DOF 07-08-2021", None, None, 11, "2021-08-07", None, None),
    ("Apartado reformado DOF 07-08-2022", None, None, 12, "2022-08-07", None, None),
    ("Fracción recorrida DOF 09-10-2011", None, None, 13, "2011-10-09", None, None),
    ("Párrafo adicionado DOF. Reformado DOF 11-12-2012", None, None, 15, "2012-12-11", None, None),
    ("Última reforma publicada DOF 01-01-2013", None, None, 16, "2013-01-01", None, None),
    ("Se reforman los artículos 3 y 4, 31-02-2014", None, None, 17, None, None, None),
    ("Apartado derogado", None, None, 18, None, None, None),
    ("Derogación publicada en ley", None, None, 19, None, None, None),
    ("Se derogan varios", None, None, 20, None, None, None),
    ("(DEROGADO)", None, None, 21, None, None, None),
    ("Última reforma incorporada", None, None, 22, None, None, None),
    ("Texto vigente DOF 12 de marzo", None, None, 23, None, None, None),
    ("Fe de erratas 12", None, None, 24, None, None, None),
    ("*(DEROGADO) en cursiva*", None, None, None, None, None, None),
    ("IV. texto", None, None, None, None, "IV", None),
    ("(X) texto", None, None, None, None, "X", None),
    ("Fracción XII texto", None, None, None, None, "XII", None),
    ("IIX. texto", None, None, None, None, None, None),
    ("a) texto", None, None, None, None, None, "a"),
    ("* (b) texto", None, None, None, None, None, "b"),
    ("c.- texto", None, None, None, None, None, "c"),
    ("B) texto", None, None, None, None, None, "B"),
    ("solo texto", None, None, None, None, None, None),
]


def legal_spellings(spark, d):
    """LEG3 to LEG9: the lines of documents in all spellings, told apart."""
    lines = V.spread(V.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    spelled = F.get(F.array(*[F.lit(x[0]) for x in SPELLINGS]), F.pmod(F.col("doc_id") * 7 + F.col("line_no"), F.lit(len(SPELLINGS))).cast("int"))
    found = L.with_structure(lines.select("doc_id", "line_no", spelled.alias("line")))
    number, _, suffix = L.article_number(F.col("line"))
    own = lambda c: F.when(F.col("is_article"), c)
    return found.select("doc_id", "line_no", own(number).alias("number"), own(suffix).alias("suffix"), F.col("amendment").alias("pattern"), L.amendment_kind(F.col("amendment")).alias("kind"), F.when(F.col("amendment").isNotNull(), F.get(L.amendment_dates(F.col("line")), F.lit(0))).alias("date"), "numeral", "letter")


_FUNCTIONS = (legal_spellings, read_file_metrics, read_responses, combined_documents, html_bodies, assembled_texts, response_totals, written_files, legal_protected, routed_markdown, optimized_markdown, injected_tables, embedded_images, captioned_pages, captioned_html, any_annotations)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# ---- SQL ----

_LAWS = r"""laws AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: CASE (k - 1) % 9 WHEN 0 THEN 'Artículo ' || ((k - 1) // 9 + 1) || '.- ' || x
        WHEN 2 THEN chr(10) || '**Pie de página:** Artículo ' || ((k - 1) // 9 + 1) || chr(10) || 'ARTÍCULO 7 de ' || x || chr(10) WHEN 4 THEN x || chr(10) || '**Encabezado:** Ley' || chr(10) || 'II. ' || x || chr(10) || chr(10) || 'art. 5 ' || x
        WHEN 6 THEN x || chr(10) || '**Pie de página:** dentro' || chr(10) || '## Artículo 8 ' || x ELSE x END), chr(10)) AS text FROM documents
), clean AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?im)^\s*\d+\s+de\s+\d+\s*$', '', 'g'), '[ \t]+', ' ', 'g') AS text FROM laws
), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM clean
), opened AS (SELECT *, starts_with(line, '**Encabezado:**') OR (starts_with(line, '**Pie de página:**') AND line_no >= 2 AND lag(line) OVER w = '') AS opens, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER w AS paragraph FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), blocks AS (SELECT *, line <> '' AND bool_or(opens) OVER (PARTITION BY doc_id, paragraph ORDER BY line_no) AS kept FROM opened)"""

_MARKED_UP = rf"""docs AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: CASE (k - 1) % 11 WHEN 0 THEN '## ' || x WHEN 2 THEN ' ![a  b](x ,y) ' || x WHEN 3 THEN x || '<table><tr>' || chr(10) || '<td>a  ,b</td></TABLE> ' || x
        WHEN 5 THEN '**Encabezado:** uno  ,dos' || chr(10) || x || chr(10) WHEN 6 THEN chr(10) || '**Pie de página:** tres  ,x' || chr(10) || x || chr(10)
        WHEN 7 THEN chr(10) || ' | ' || left(replace(x, '|', ''), 30) || ' | b  ,c |' || chr(10) || '|---|---|' || chr(10) || '| uno | dos  ,tres |' || chr(10) || chr(10) WHEN 8 THEN '  # ' || x WHEN 9 THEN '###' ELSE x END), chr(10)) AS text FROM documents
), split AS (SELECT doc_id, regexp_extract_all(text, '(?is)<table\b.*?</table>') AS html, string_split(regexp_replace(text, '(?is)<table\b.*?</table>', chr(65535), 'g'), chr(10)) AS parts FROM docs
), l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM split
), lines AS (SELECT *, {LIKE_SQL} AS liked FROM l
), {table_sql.FOUND}, opened_ AS (SELECT doc_id, line_no, line, starts_with(line, '**Encabezado:**') OR (starts_with(line, '**Pie de página:**') AND line_no >= 2 AND lag(line) OVER w = '') AS opens, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER w AS paragraph FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), blocks AS (SELECT *, line <> '' AND bool_or(opens) OVER (PARTITION BY doc_id, paragraph ORDER BY line_no) AS kept FROM opened_)"""

_EMBEDDED = """' ![a](data:image/png;base64,AQ==)' || chr(10) || chr(10) || '*x*: d ' || chr(10) || chr(10) || '<div class="ocr-table">' || chr(10) || '<t>' || chr(10) || '</div>' || chr(10) || chr(10) || ' ![b](b)' || chr(10) || chr(10) || '*image*: e'"""
_KINDS = [(7, "addition"), (17, "reform"), (24, "note")]


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


_SPELLED = ", ".join(f"({k}, {', '.join(map(_value, x[1:4]))}, {_value(next((name for last, name in _KINDS if x[3] and x[3] <= last), None))}, {', '.join(map(_value, x[4:]))})" for k, x in enumerate(SPELLINGS))
_TITLE = table_sql.spaced(r"regexp_extract(line, '^(#+)\s*([^\n]+)', 2)")

ORACLE_SQL = {
    "routed_markdown": rf"""WITH {_MARKED_UP}, cells AS (SELECT * REPLACE (list_transform(content, lambda r: list_transform(r, lambda c: {table_sql.spaced('c')})) AS content) FROM found
    ), fixed AS (SELECT b.doc_id, b.line_no, c.start = b.line_no AS first, CASE WHEN c.start = b.line_no THEN {table_sql.markdown('content')} WHEN c.start IS NOT NULL THEN '' WHEN kept OR regexp_matches(line, '^\s*!\[') THEN line
        WHEN regexp_matches(line, '^#+\s*[^\n]') AND NOT regexp_matches(line, '^#$') THEN regexp_extract(line, '^(#+)\s*([^\n]+)', 1) || ' ' || {_TITLE} WHEN regexp_matches(line, '^\s*#') THEN line ELSE {table_sql.spaced('line')} END AS line
        FROM blocks b LEFT JOIN cells c ON c.doc_id = b.doc_id AND b.line_no BETWEEN c.start AND c."end"
    ), joined AS (SELECT doc_id, string_split(string_agg(line, chr(10) ORDER BY line_no), chr(65535)) AS parts, count(CASE WHEN first THEN 1 END) AS n_tables FROM fixed GROUP BY doc_id
    ), whole AS (SELECT doc_id, n_tables, array_to_string(list_transform(range(1, len(joined.parts) + 1), lambda k: joined.parts[k] || coalesce(html[k], '')), '') AS t FROM joined JOIN split USING (doc_id))
    SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest, n_tables FROM whole""",
    "legal_protected": rf"""WITH {_LAWS}, a AS (SELECT *, NOT kept AND regexp_matches(line, '(?i)^[#*>\s]*(?:art[íi]culo|art\.)\s+\d+') AS is_article FROM blocks
    ), s AS (SELECT *, CAST(sum(is_article::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS article_seq FROM a)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kept, is_article, article_seq, CASE WHEN article_seq = 0 THEN 'preamble' ELSE 'article' END AS section, true AS as_it_was FROM s""",
    "injected_tables": rf"""WITH {V.PAGES_SQL}, m AS (SELECT doc_id, page_idx, markdown, page_idx % 4 AS n, '[tbl-12.html](tbl-12.html) ' || markdown || ' tbl-3.html <a href="tbl-7.html">tbl-7.html</a> tbl-12.html [tbl-3.html] tbl-30.html' AS t FROM doc_pages
    ), w AS (SELECT *, list_transform([5, 8, 9], lambda p: chr(10) || chr(10) || '<div class="ocr-table">' || chr(10) || '<table>tbl-7.html ' || p || left(markdown, 20) || '</table>' || chr(10) || '</div>' || chr(10) || chr(10)) AS h FROM m
    ), r AS (SELECT doc_id, page_idx, CASE WHEN n >= 3 THEN h[3] ELSE '[tbl-12.html](tbl-12.html)' END || ' ' || markdown || ' ' || CASE WHEN n >= 1 THEN h[1] ELSE 'tbl-3.html' END || ' ' || CASE WHEN n >= 2 THEN h[2] ELSE '<a href="tbl-7.html">tbl-7.html</a>' END || ' ' || CASE WHEN n >= 3 THEN h[3] ELSE 'tbl-12.html' END || ' ' || CASE WHEN n >= 1 THEN h[1] ELSE '[tbl-3.html]' END || ' tbl-30.html' AS t FROM w)
    SELECT doc_id, page_idx, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM r""",
    "embedded_images": rf"""WITH {V.PAGES_SQL}, r AS (SELECT doc_id, page_idx, CASE WHEN page_idx % 3 = 2 THEN '![a](a) ![a](x/a.png) ' || markdown || ' ![b](other) ![c](c) ![d](d)' ELSE
        '![a](data:image/jpeg;base64,' || to_base64(encode('0' || markdown)) || ') ![a](x/a.png) ' || markdown || ' ![b](data:image/jpeg;base64,' || to_base64(encode('1' || markdown)) || ')' || chr(10) || chr(10) || '*figure*: $1 \ b ![c](c)' || chr(10) || chr(10) || '*figure*: $1 \ c ![d](d)' END AS t FROM doc_pages)
    SELECT doc_id, page_idx, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM r""",
    "captioned_pages": rf"""WITH {V.PAGES_SQL}, r AS (SELECT doc_id, page_idx, '![a](a)' || CASE WHEN page_idx % 4 >= 1 THEN chr(10) || chr(10) || 'eins' || chr(10) ELSE '' END || replace(markdown, '![', '') || '![b c](d e)' || chr(10) || '![](f)' || CASE WHEN page_idx % 4 >= 3 THEN chr(10) || chr(10) || 'vier' || chr(10) ELSE '' END || '![g](g)' AS t FROM doc_pages)
    SELECT doc_id, page_idx, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM r""",
    "captioned_html": rf"""WITH {V.PAGES_SQL}, p AS (SELECT doc_id, page_idx, translate(markdown, '<>', '') AS m, CASE WHEN page_idx % 4 >= 1 THEN 'eins' ELSE '' END AS c1, CASE WHEN page_idx % 4 >= 3 THEN 'vier' ELSE '' END AS c3 FROM doc_pages
    ), r AS (SELECT *, '<figure id=1><img src=a> x' || c1 || '</figure>' || m || CASE WHEN c3 = '' THEN '<img src=b>' ELSE '<figure class="ocr-image"><img src=b>' || c3 || '</figure>' END || '<p><figure>' || chr(10) || '<img src=c></figure><img src=d>' AS t,
        '<figure id=1>' || CASE WHEN c1 = '' THEN '<img src=a>' ELSE '<figure class="ocr-image"><img src=a>' || c1 || '</figure>' END || ' x' || c1 || '</figure>' || m || '<img src=b><p><figure>' || chr(10) || '<img src=c></figure>' || CASE WHEN c3 = '' THEN '<img src=d>' ELSE '<figure class="ocr-image"><img src=d>' || c3 || '</figure>' END AS o FROM p)
    SELECT doc_id, page_idx, md5(t) AS digest, md5(o) AS original FROM r""",
    "any_annotations": rf"""WITH {V.PAGES_SQL}, s AS (SELECT doc_id, page_idx, page_idx % 5 AS k, regexp_replace(left(markdown, 40), '[^a-zA-Z0-9 ]', '', 'g') AS said FROM doc_pages WHERE page_idx % 5 <> 4
    ), f AS (SELECT doc_id, page_idx, CASE k WHEN 0 THEN 'i-' || page_idx WHEN 2 THEN 'x' ELSE 'img_' || (page_idx + 7) END AS image_id, CASE k WHEN 0 THEN 'chart' WHEN 1 THEN 'plano' WHEN 2 THEN coalesce(nullif(said, ''), 'Imagen') ELSE 'Imagen' END AS kind,
        CASE k WHEN 0 THEN 'long ' || said WHEN 1 THEN said WHEN 2 THEN '[1,"b"]' ELSE '' END AS description, CASE k WHEN 0 THEN said WHEN 1 THEN said WHEN 2 THEN 't' ELSE '' END AS brief, CASE k WHEN 0 THEN 'Scale: 12' ELSE '' END AS extras FROM s)
    SELECT *, CASE WHEN description = '' THEN '' ELSE '*[' || kind || ': ' || description || ']*' END AS caption_markdown, CASE WHEN description = '' THEN '' ELSE '<figcaption class="bbox-caption"><strong class="img-type">' || kind || '</strong>: <span class="img-desc">' || description || '</span>' || CASE WHEN extras <> '' THEN '<br><small class="img-extra">' || extras || '</small>' ELSE '' END || '</figcaption>' END AS caption_html FROM f""",
    "written_files": r"""WITH n AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 1 THEN printf('doc_%d_pag%04d-%04d', doc_id, doc_id, doc_id + 9) ELSE 'doc_' || doc_id END AS name FROM documents
    ), f AS (SELECT name || '.md' AS name, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '<!-- quality ' || doc_id || ' -->' || chr(10) ELSE '' END AS t FROM n UNION ALL SELECT name || '.txt', replace(text, 'a', 'A') FROM n
        UNION ALL SELECT name || '.html', '<!DOCTYPE html>' || chr(10) || '<html lang="es">' || chr(10) || '<head><meta charset="utf-8"><title>Doc ' || doc_id || '</title></head>' || chr(10) || '<body>' || chr(10) || '<script type="application/json" id="document">{"markdown":' || replace(CAST(to_json(text) AS VARCHAR), '</', '<\/') || '}</script>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) FROM n
        UNION ALL SELECT doc_id || '/pagina' || (doc_id + 1) || '_img1.' || CASE WHEN doc_id % 2 = 0 THEN 'bmp' ELSE 'webp' END, CASE WHEN doc_id % 2 = 0 THEN 'BM' ELSE 'RIFF' END || text FROM documents WHERE doc_id % 7 = 0)
    SELECT name, strlen(t) AS n_bytes, md5(t) AS digest FROM f""",
    "combined_documents": rf"""WITH {V.PAGES_SQL}, p AS (SELECT doc_id, page_idx, regexp_replace(markdown, '[^a-zA-Z0-9 .,]', '', 'g') AS said FROM doc_pages
    ), t AS (SELECT doc_id, page_idx, CASE WHEN page_idx % 2 = 0 THEN '**Encabezado:** H' || chr(10) || chr(10) ELSE '' END || said || {_EMBEDDED} || CASE WHEN page_idx % 3 = 0 THEN chr(10) || chr(10) || '**Pie de página:** F' ELSE '' END AS t FROM p
    ), r AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page_idx, t) AS t FROM t GROUP BY doc_id) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM r""",
    "html_bodies": rf"""WITH {V.PAGES_SQL}, p AS (SELECT doc_id, page_idx, regexp_replace(markdown, '[^a-zA-Z0-9 .,]', '', 'g') AS said FROM doc_pages
    ), t AS (SELECT doc_id, page_idx, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 📄 Página ' || (page_idx + 1) || chr(10) || chr(10) || said || {_EMBEDDED} AS t FROM p
    ), r AS (SELECT doc_id, string_agg(t, '' ORDER BY page_idx, t) AS t FROM t GROUP BY doc_id) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM r""",
    "assembled_texts": rf"""WITH {V.PAGES_SQL}, p AS (SELECT doc_id, page_idx, regexp_replace(markdown, '[^a-zA-Z0-9 .,]', '', 'g') AS said FROM doc_pages
    ), t AS (SELECT doc_id, page_idx, '=== PÁGINA ' || (page_idx + 1) || ' ===' || chr(10) || chr(10) || CASE WHEN trim(said) = '' THEN '' ELSE said END || chr(10) || 'Imagen (x): d' || chr(10) || 'Imagen (image): e' || chr(10) || chr(10) AS t FROM p
    ), r AS (SELECT doc_id, string_agg(t, '' ORDER BY page_idx, t) AS t FROM t GROUP BY doc_id) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM r""",
    "response_totals": f"WITH {V.PAGES_SQL} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_pages, CAST(sum(CASE WHEN page_idx % 2 = 0 THEN 2 ELSE 0 END) AS INTEGER) AS n_images FROM doc_pages GROUP BY doc_id",
    "read_file_metrics": """WITH f AS (SELECT doc_id, 'd' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.txt' ELSE '' END AS name, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' END AS mime, strlen(text) / CAST(1048576 AS DOUBLE) AS mb, strlen(text) AS n FROM documents WHERE text <> '')
    SELECT name, round(mb, 9) AS size_mb, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 + 1 ELSE greatest(1, floor(mb * 4)) END AS INTEGER) AS total_pages, mime, CASE WHEN mime IS NULL THEN 'type' WHEN mb > 0.001 THEN 'size' END AS reject_reason, n > 2000 AS large FROM f""",
    "read_responses": rf"""WITH {V.PAGES_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS n_pages, CAST(sum(length(regexp_replace(markdown, '[^a-zA-Z0-9 .,]', '', 'g')) + 27) AS BIGINT) AS n_chars, count(*) FILTER (page_idx % 2 = 0) AS n_headers, 2 * count(*) AS n_images, CAST(count(*) * (count(*) + 1) + 20 * count(*) AS BIGINT) AS of_pages, 'b' AS last_key, count(*) AS n_tables, CAST(3 * count(*) AS BIGINT) AS table_chars FROM doc_pages GROUP BY doc_id""",
    "legal_spellings": f"""WITH s(k, number, suffix, pattern, kind, date, numeral, letter) AS (VALUES {_SPELLED}), l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, number, suffix, CAST(pattern AS INTEGER) AS pattern, kind, CAST(date AS DATE) AS date, numeral, letter FROM l JOIN s ON s.k = (doc_id * 7 + line_no) % {len(SPELLINGS)}""",
}
