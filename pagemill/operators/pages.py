"""Tables and images of pages as tables of their own, brought into the pages' text by joins.

A page's text is cut at the places where something goes, each place gets what belongs there from a join on the page and
its rank or its name, and the pieces are put together again. Nothing that is brought in is read for further places.
Tables: pages `doc_id, page_idx, markdown`; a page is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import bound
from pagemill.operators.assembly import (
    BRIEF_KEYS,
    DETAILED_KEYS,
    EXTRA_KEYS,
    TYPE_KEYS,
    annotation_description,
    annotation_extras,
    annotation_type,
    caption_html,
    caption_text,
    encode_data_uri,
)

# The four spellings of a table's placeholder, references to images, and where an annotation may be.
NAME = r"tbl-\d+\.html"
SPELLINGS = rf'\[({NAME})\]\(\1\)|<a href="({NAME})">\2</a>|\[({NAME})\]|({NAME})'
REFERENCE = r"!\[([^\]]*)\]\(([^)]+)\)"
ANNOTATION_KEYS = ["annotation", "bbox_annotation", "structured_annotation"]
_PAGE = ["doc_id", "page_idx"]


def _cut(pages: DataFrame, pattern: str) -> DataFrame:
    """`doc_id, page_idx, piece, free, mark`: texts between matches, each with the match behind it (null behind the last)."""
    free, marks = F.split("markdown", pattern), F.regexp_extract_all("markdown", F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(free.alias("free"), F.concat(marks, F.array(F.lit(None).cast("string"))).alias("mark"))
    return pages.select(*_PAGE, F.posexplode(pieces).alias("piece", "x")).select(*_PAGE, "piece", "x.free", "x.mark")


def _joined(pages: DataFrame, pieces: DataFrame, put: Column) -> DataFrame:
    """The pages with their pieces in order; a page without text stays as it is."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.concat("free", F.coalesce(put, F.col("mark"), F.lit(""))).alias("t")))), lambda x: x["t"]), "")
    whole = pieces.groupBy(*_PAGE).agg(text.alias("\nwhole"))
    return pages.hint("merge").join(whole.hint("merge"), _PAGE, "left").select(*[F.coalesce("\nwhole", "markdown").alias(c) if c == "markdown" else F.col(c) for c in pages.columns])


def inject_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages with the tables `doc_id, page_idx, table_pos, content` in place of placeholders.

    A page's distinct placeholders, by number (of equal numbers by name), take its tables in order of table_pos; what is
    left over on either side is ignored. A placeholder has four spellings; the longest that stands at a place is
    replaced. A null content is an empty table.
    """
    pieces = _cut(pages, SPELLINGS).withColumn("name", F.regexp_extract("mark", NAME, 0))
    number = F.regexp_extract("name", r"\d+", 0).cast("decimal(38,0)")
    rank = F.dense_rank().over(Window.partitionBy(*_PAGE).orderBy(F.when(F.col("mark").isNull(), 1).otherwise(0), number, "name"))
    ranked = tables.select(*_PAGE, F.row_number().over(Window.partitionBy(*_PAGE).orderBy("table_pos")).alias("rank"), F.coalesce("content", F.lit("")).alias("content"))
    placed = pieces.withColumn("rank", rank).hint("merge").join(ranked.hint("merge"), [*_PAGE, "rank"], "left")
    return _joined(pages, placed, F.when(F.col("mark").isNotNull() & F.col("content").isNotNull(), F.concat(F.lit('\n\n<div class="ocr-table">\n'), F.col("content"), F.lit("\n</div>\n\n"))))


def embed_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with references to the images `doc_id, page_idx, image_pos, image_key, content, extension, caption` as data URIs.

    An image with content takes the references that name it as text and target, or where the page has none such all of
    its text, and its caption goes below. One without content keeps its references and puts its caption below each. Of
    images of one key the first counts. Content is encoded only where a reference takes it.
    """
    first = F.row_number().over(Window.partitionBy(*_PAGE, "image_key").orderBy("image_pos"))
    own = images.where(F.col("image_key").isNotNull()).withColumn("\nn", first).where(F.col("\nn") == 1).select(*_PAGE, F.col("image_key").alias("key"), "content", "extension", F.nullif("caption", F.lit("")).alias("caption"))
    pieces = _cut(pages, REFERENCE).withColumns({"key": F.regexp_extract("mark", REFERENCE, 1), "target": F.regexp_extract("mark", REFERENCE, 2)})
    pieces = pieces.withColumn("key", F.when(F.col("mark").isNotNull(), F.col("key")))
    exact = F.max(F.col("key") == F.col("target")).over(Window.partitionBy(*_PAGE, "key"))
    placed = pieces.withColumn("exact", exact).hint("merge").join(own.hint("merge"), [*_PAGE, "key"], "left")
    below = F.coalesce(F.concat(F.lit("\n\n"), F.col("caption")), F.lit(""))
    taken = F.col("content").isNotNull() & ((F.col("key") == F.col("target")) | ~F.col("exact"))
    uri = F.concat(F.lit("!["), F.col("key"), F.lit("]("), encode_data_uri(F.col("content"), F.col("extension")), F.lit(")"), below)
    return _joined(pages, placed, F.when(taken, uri).when(F.col("content").isNull() & F.col("caption").isNotNull(), F.concat("mark", below)))


def page_captions(annotations: DataFrame, caption: Column) -> DataFrame:
    """`doc_id, page_idx, captions` of annotations `doc_id, page_idx, image_pos`, in order of image_pos: what attach_captions_* take."""
    held = annotations.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(F.struct("image_pos", caption.alias("c")))).alias("x"))
    return held.select(*_PAGE, F.transform("x", lambda x: x["c"]).alias("captions"))


def annotations_of(images: DataFrame, image: str = "image") -> DataFrame:
    """Annotations of images `doc_id, page_idx, image_pos` whose `image` is JSON of any schema.

    Adds `image_id` (its id, or img_ and its position), `annotation`, and from it kind, description, extras and captions;
    images without an annotation are left out. An annotation is the first under ANNOTATION_KEYS that isn't empty: an
    object, or a string that holds one. The fields that are known are read whatever else it has; a field that is no
    string is its JSON. Text that is no JSON is no image.
    """
    keys = dict.fromkeys([*TYPE_KEYS, *DETAILED_KEYS, *BRIEF_KEYS, *EXTRA_KEYS])
    known = "struct<" + ",".join(f"{k}:string" for k in keys) + ">"

    def held(v: Column) -> Column:
        """(id, annotation as JSON) of an image."""
        each = F.transform(F.array(*[F.try_variant_get(v, f"$.{k}", "variant") for k in ANNOTATION_KEYS]), lambda x: F.to_json(F.coalesce(F.try_parse_json(F.try_variant_get(x, "$", "string")), x)))
        full = F.filter(each, lambda x: x.startswith("{") & (x != "{}"))
        return F.struct(F.try_variant_get(v, "$.id", "string").alias("id"), F.get(full, F.lit(0)).alias("annotation"))

    told = lambda a: F.struct(annotation_type(a).alias("kind"), annotation_description(a).alias("description"), annotation_description(a, detailed=False).alias("brief"), annotation_extras(a).alias("extras"), caption_html(a).alias("caption_html"), caption_text(a).alias("caption_markdown"))
    found = images.withColumn("\nheld", bound(F.try_parse_json(image), held)).where("`\nheld`.annotation is not null")
    own = F.coalesce("\nheld.id", F.concat(F.lit("img_"), F.col("image_pos").cast("string")))
    found = found.select(*images.columns, own.alias("image_id"), F.parse_json("\nheld.annotation").alias("annotation"), bound(F.from_json("\nheld.annotation", known), told).alias("\ntold"))
    return found.select("*", "\ntold.*").drop("\ntold")
