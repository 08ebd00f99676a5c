"""Reading of files and of persisted recognition responses, and writing of results. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.plans.planning import PAGES_PER_MB, density
from pagemill.sources.files import file_status, read_files, write_files

ANNOTATION = "struct<image_type:string,short_description:string,summary:string,tipo_imagen:string,descripcion_breve:string,descripcion_detallada:string,diagram_type:string,chart_type:string,detailed_description:string,data_description:string,main_elements:string,title:string,scale:string,dimensions:string,technical_notes:string,trends_insights:string,x_axis_label:string,y_axis_label:string>"
IMAGE = f"struct<id:string,image_id:string,image_base64:string,data_uri:string,data:binary,annotation:{ANNOTATION},annotations:array<{ANNOTATION}>>"
PAGE = f"struct<markdown:string,header:string,footer:string,tables:array<struct<content:string>>,images:array<{IMAGE}>>"
RESPONSE = f"doc_id string, pages array<{PAGE}>"
# Types that are accepted, and the size of a large file.
MIME_BY_EXTENSION = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff"}
LARGE_BYTES = 50 * 1024 * 1024


def read_file_metrics(spark: SparkSession, path: str, pages: DataFrame | None = None) -> DataFrame:
    """`file_id, size_mb, total_pages, density` of the files below a path; only their status is read, not their content.

    `pages` may give `file_id, total_pages`; else pages are estimated from the size.
    """
    files = file_status(spark, path).select(F.col("path").alias("file_id"), (F.col("length") / (1024.0 * 1024.0)).alias("size_mb"))
    if pages is not None:
        files = files.hint("merge").join(pages.select("file_id", F.col("total_pages").cast("int").alias("known")).hint("merge"), "file_id", "left")
    else:
        files = files.withColumn("known", F.lit(None).cast("int"))
    found = files.withColumn("total_pages", F.coalesce("known", F.greatest(F.lit(1), F.floor(F.col("size_mb") * PAGES_PER_MB)).cast("int"))).drop("known")
    return found.withColumn("density", density(F.col("size_mb"), F.col("total_pages")))


def validate_files(files: DataFrame, max_size_mb: float) -> DataFrame:
    """Adds `mime` and `reject_reason` (null for valid files) to `file_id, size_mb`."""
    extension = F.lower(F.regexp_extract("file_id", r"\.([^./\\]+)$", 1))
    mime = F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair])
    found = files.withColumn("mime", F.try_element_at(mime, extension))
    reason = F.when(F.col("size_mb").isNull(), "missing").when(F.col("mime").isNull(), "type").when(F.col("size_mb") > max_size_mb, "size")
    return found.withColumn("reject_reason", reason)


def large_files(spark: SparkSession, path: str, least: int = LARGE_BYTES) -> DataFrame:
    """`path, length` of the files over a size, at any depth."""
    return file_status(spark, path).where(F.col("length") > least)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, pages` of the JSON files that write_files has put below a path, each an object or an array of such; nulls for what is no JSON."""
    found = F.from_json(F.col("content").cast("string"), T.ArrayType(T.StructType.fromDDL(RESPONSE)))
    return read_files(spark, path).select(F.explode_outer(found).alias("r")).select("r.*")


def explode_pages(responses: DataFrame, page_offset: int = 0) -> DataFrame:
    """A row a page: `doc_id, page_idx` from 0, `page_num` from 1 after the offset, and the page's fields. No page is lost."""
    pages = responses.select("doc_id", F.posexplode_outer("pages").alias("page_idx", "page"))
    return pages.select("doc_id", "page_idx", (F.col("page_idx") + 1 + page_offset).alias("page_num"), "page.*")


def explode_images(pages: DataFrame) -> DataFrame:
    """A row an image: its position, its id (`id`, else `image_id`, else img_n) and its fields."""
    images = pages.select("doc_id", "page_idx", "page_num", F.posexplode("images").alias("image_pos", "image"))
    own = F.coalesce(F.nullif("image.id", F.lit("")), F.nullif("image.image_id", F.lit("")), F.concat(F.lit("img_"), F.col("image_pos").cast("string")))
    return images.select("doc_id", "page_idx", "page_num", "image_pos", own.alias("image_key"), "image.*")


def explode_tables(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_idx", F.posexplode("tables").alias("table_pos", "table")).select("doc_id", "page_idx", "table_pos", "table.content")


def output_name(stem: Column, start: Column, end: Column, is_part: Column) -> Column:
    """A part's file name with its page range; the stem for a whole file."""
    return F.when(is_part, F.format_string("%s_pag%04d-%04d", stem, start, end)).otherwise(stem)


def output_title(stem: Column) -> Column:
    return F.initcap(F.replace(stem, F.lit("_"), F.lit(" ")))


def markdown_file(markdown: Column, report: Column | None = None) -> Column:
    """A document's markdown, with a quality report, where there is one, as a comment at the end."""
    note = F.coalesce(F.concat(F.lit("\n\n<!-- "), report, F.lit(" -->\n")), F.lit("")) if report is not None else F.lit("")
    return F.concat(F.coalesce(markdown, F.lit("")), note)


def html_file(title: Column, body: Column) -> Column:
    """A page that holds a document's markdown as JSON, to be rendered where it is shown; no tag in it can end the script."""
    safe = F.replace(F.replace(F.replace(F.coalesce(title, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    data = F.replace(F.to_json(F.struct(F.coalesce(body, F.lit("")).alias("markdown"))), F.lit("</"), F.lit("<\\/"))
    return F.concat(F.lit('<!DOCTYPE html>\n<html lang="es">\n<head><meta charset="utf-8"><title>'), safe, F.lit('</title></head>\n<body>\n<script type="application/json" id="document">'), data, F.lit("</script>\n</body>\n</html>\n"))


def write_markdown(docs: DataFrame, path: str, report: str | None = None) -> None:
    """Writes `name, markdown` as name.md, with a quality report if its column is named."""
    text = markdown_file(F.col("markdown"), F.col(report) if report else None)
    write_files(docs.select(F.concat("name", F.lit(".md")).alias("name"), text.alias("content")), path)


def write_texts(docs: DataFrame, path: str, column: str = "text") -> None:
    """Writes `name` and a text as name.txt."""
    write_files(docs.select(F.concat("name", F.lit(".txt")).alias("name"), F.col(column).alias("content")), path)


def write_html(docs: DataFrame, path: str) -> None:
    """Writes `name, title, html` as name.html."""
    write_files(docs.select(F.concat("name", F.lit(".html")).alias("name"), html_file(F.col("title"), F.col("html")).alias("content")), path)


def write_json(responses: DataFrame, path: str) -> None:
    responses.write.json(path)


def json_of(*columns: str) -> Column:
    """The columns as one JSON object, for embedding in HTML: no tag can close the script that holds it."""
    return F.replace(F.to_json(F.struct(*columns)), F.lit("</"), F.lit("<\\/"))


def image_files(images: DataFrame) -> DataFrame:
    """`name, content` of exploded images with data: {doc_id}/pagina{p}_img{i}.{ext}."""
    from pagemill.operators.assembly import image_content

    content, extension = image_content()
    name = F.format_string("%s/pagina%d_img%d.%s", F.col("doc_id").cast("string"), F.col("page_num"), F.col("image_pos") + 1, extension)
    return images.select(name.alias("name"), content.alias("content")).where("content is not null")


def write_images(images: DataFrame, path: str) -> None:
    """Writes each of exploded images that has data as a file."""
    write_files(image_files(images), path)


def write_formats(assembled: DataFrame, path: str, formats: tuple[str, ...] = ("md", "txt", "html", "json"), images: DataFrame | None = None) -> None:
    """Writes `name, title, markdown, text, html, json` in several formats, and exploded images, in one job.

    A row becomes one file for each format, so the table is computed once without being kept.
    """
    made = {"md": markdown_file(F.col("markdown")), "txt": F.col("text"), "html": html_file(F.col("title"), F.col("html")), "json": F.col("json")}
    if set(formats) - set(made):
        raise ValueError(f"no such format: {sorted(set(formats) - set(made))}")
    each = F.array(*[F.struct(F.concat("name", F.lit(f".{f}")).alias("name"), made[f].cast("string").cast("binary").alias("content")) for f in formats])
    files = assembled.select(F.explode(each).alias("x")).select("x.*")
    write_files(files if images is None else files.unionByName(image_files(images)), path)


def schema(ddl: str = RESPONSE) -> T.StructType:
    return T.StructType.fromDDL(ddl)
