"""Pages, tables, images and annotations put back into documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.repair import escape_case_refs, optimize_markdown, optimize_text, plain_text

# Placeholders, labels, signatures of image formats, keys of annotations by priority.
PLACEHOLDER = r"(tbl-\d+\.html)"
HEADER_LABEL, FOOTER_LABEL = "**Encabezado:** ", "**Pie de página:** "
LEGAL_DOMAINS = ("legal", "articulos")
SIGNATURES = [("FFD8", "jpg"), ("89504E47", "png"), ("474946383761", "gif"), ("474946383961", "gif"), ("424D", "bmp"), ("52494646", "webp")]
TYPE_KEYS = ["tipo_imagen", "image_type", "diagram_type", "chart_type"]
DETAILED_KEYS = ["descripcion_detallada", "summary", "detailed_description", "data_description", "main_elements"]
BRIEF_KEYS = ["descripcion_breve", "short_description", "title"]
EXTRA_KEYS = ["scale", "dimensions", "technical_notes", "trends_insights", "x_axis_label", "y_axis_label"]
IMAGE_REF = r"!\[[^\]]*\]\([^)]+\)"


# ---- tables and images in a page ----


def inject_tables(markdown: Column, tables: Column) -> Column:
    """The page with its tables in place of placeholders: the distinct placeholders by number take the tables in order.

    What is left over on either side is ignored. Each of the four spellings of a placeholder is replaced.
    """
    number = lambda p: F.regexp_extract(p, r"(\d+)", 1).cast("decimal(38,0)")
    found = F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(markdown, F.lit(PLACEHOLDER), F.lit(1))), lambda p: F.struct(number(p).alias("n"), p.alias("p"))))
    pairs = F.filter(F.arrays_zip(found.alias("f"), tables.alias("t")), lambda x: x["f"].isNotNull() & x["t"].isNotNull())

    def inject(text: Column, x: Column) -> Column:
        p, html = x["f"]["p"], F.concat(F.lit('\n\n<div class="ocr-table">\n'), F.coalesce(x["t"]["content"], F.lit("")), F.lit("\n</div>\n\n"))
        for spelled in (F.concat(F.lit("["), p, F.lit("]("), p, F.lit(")")), F.concat(F.lit('<a href="'), p, F.lit('">'), p, F.lit("</a>")), F.concat(F.lit("["), p, F.lit("]")), p):
            text = F.replace(text, spelled, html)
        return text

    return F.when(F.size(F.coalesce(tables, F.array().cast("array<struct<content:string>>"))) > 0, F.aggregate(pairs, markdown, inject)).otherwise(markdown)


def sniff_format(data: Column) -> Column:
    """The format of binary image data by its first bytes."""
    head = F.hex(F.substring(data, 1, 6))
    found = F.lit("bin")
    for signature, name in reversed(SIGNATURES):
        found = F.when(head.startswith(signature), name).otherwise(found)
    return found


def decode_data_uri(uri: Column) -> tuple[Column, Column]:
    """(binary data, extension) of a data URI; null and bin if it is none."""
    mime, data = F.regexp_extract(uri, "^data:([^;]+);base64,", 1), F.regexp_replace(uri, "^data:[^;]+;base64,", "")
    extension = F.regexp_replace(F.element_at(F.split(mime, "/"), -1), "^jpeg$", "jpg")
    ok = uri.rlike("^data:[^;]+;base64,")
    return F.when(ok, F.unbase64(data)), F.when(ok, extension).otherwise("bin")


def encode_data_uri(data: Column, extension: Column) -> Column:
    mime = F.concat(F.lit("image/"), F.when(extension == "jpg", "jpeg").otherwise(extension))
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), "[\r\n]", ""))


def image_content(image: Column | None = None) -> tuple[Column, Column]:
    """(binary data, extension) of an image: from image_base64, else data_uri, else data."""
    of = (lambda c: F.col(c)) if image is None else (lambda c: image[c])
    uri = F.coalesce(of("image_base64"), of("data_uri"))
    data, extension = decode_data_uri(uri)
    return F.coalesce(data, of("data")), F.when(uri.isNotNull(), extension).when(of("data").isNotNull(), sniff_format(of("data"))).otherwise("bin")


def embed_images(markdown: Column, images: Column) -> Column:
    """The page with references to images as data URIs, and descriptions of annotated ones below.

    `images` are structs of `key, uri, caption`. An image without data keeps its reference and gets its caption.
    """

    def embed(text: Column, x: Column) -> Column:
        k, caption = x["key"], F.coalesce(F.concat(F.lit("\n\n"), x["caption"]), F.lit(""))
        exact = F.concat(F.lit("!["), k, F.lit("]("), k, F.lit(")"))
        new = F.concat(F.lit("!["), k, F.lit("]("), x["uri"], F.lit(")"), caption)
        quoted = F.concat(F.lit(r"!\[\Q"), k, F.lit(r"\E\]\([^)]+\)"))
        safe = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        with_uri = F.when(F.contains(text, exact), F.replace(text, exact, new)).otherwise(F.regexp_replace(text, quoted, safe))
        safe_caption = F.replace(F.replace(caption, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.when(x["uri"].isNotNull(), with_uri).otherwise(F.regexp_replace(text, quoted, F.concat(F.lit("$0"), safe_caption)))

    return F.aggregate(F.coalesce(images, F.array().cast("array<struct<key:string,uri:string,caption:string>>")), markdown, embed)


def _captioned(text: Column, pattern: str, captions: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with the k-th match of a pattern rewritten by `put` with the k-th caption, where there is one."""
    free, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    told = F.transform(found, lambda m, k: F.when(F.coalesce(F.get(captions, k), F.lit("")) != "", put(m, F.get(captions, k))).otherwise(m))
    return F.when(text == "", text).otherwise(F.array_join(F.zip_with(free, F.concat(told, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""))


def attach_captions_markdown(text: Column, captions: Column) -> Column:
    return _captioned(text, IMAGE_REF, captions, lambda m, c: F.concat(m, F.lit("\n\n"), c, F.lit("\n")))


def attach_captions_html(text: Column, captions: Column, parity: bool = False) -> Column:
    """Captions in figures, then around images that stand alone, which take the captions that are left.

    With `parity` those take the captions from the first on again, and images in figures count among them.
    """
    figure = r"(?s)<figure(?:(?!</figure>).)*?<img[^>]*>(?:(?!</figure>).)*?</figure>"
    n = F.regexp_count(text, F.lit(figure))
    text = _captioned(text, figure, captions, lambda m, c: F.concat(F.regexp_replace(m, "</figure>$", ""), c, F.lit("</figure>")))
    wrapped = lambda m, c: F.concat(F.lit('<figure class="ocr-image">'), m, c, F.lit("</figure>"))
    if parity:
        return _captioned(text, "<img[^>]*>(?!</figure>)", captions, wrapped)
    rest = F.slice(captions, n + 1, F.greatest(F.size(captions) - n, F.lit(0)))
    parts = F.split(text, r"(?<=</figure>)|(?=<figure)")
    alone = lambda t: F.regexp_count(t, F.lit("<img[^>]*>"))
    inside = lambda t: t.startswith("<figure")
    seen = lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda a, t: a + F.when(inside(t), 0).otherwise(alone(t)))
    each = lambda t, k: F.when(inside(t), t).otherwise(_captioned(t, "<img[^>]*>", F.slice(rest, seen(k) + 1, F.greatest(F.size(rest) - seen(k), F.lit(0))), wrapped))
    return F.array_join(F.transform(parts, each), "")


# ---- annotations ----


def first_annotation(image: Column) -> Column:
    """An image's annotation: `annotation`, else of `annotations` the first with a short description, else the first; null without one."""
    listed = image["annotations"]
    good = F.filter(listed, lambda a: F.coalesce(a["short_description"], F.lit("")) != "")
    found = F.coalesce(image["annotation"], F.get(good, F.lit(0)), F.get(listed, F.lit(0)))
    return F.when(F.coalesce(found["short_description"], F.lit("")) != "", found)


def _first_of(annotation: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.nullif(annotation[k], F.lit("")) for k in keys])


def annotation_type(annotation: Column) -> Column:
    return F.coalesce(_first_of(annotation, TYPE_KEYS), F.lit("Imagen"))


def annotation_description(annotation: Column, detailed: bool = True) -> Column:
    keys = [*(DETAILED_KEYS if detailed else []), *BRIEF_KEYS]
    return F.coalesce(_first_of(annotation, keys), F.lit(""))


def annotation_extras(annotation: Column) -> Column:
    told = [F.when(F.coalesce(annotation[k], F.lit("")) != "", F.concat(F.lit(f"{k.replace('_', ' ').title()}: "), annotation[k])) for k in EXTRA_KEYS]
    return F.array_join(F.array_compact(F.array(*told)), " | ")


def describe_image(annotation: Column, form: str = "text", use_summary: bool = False) -> Column:
    """An annotation as text, html or markdown; empty without a description."""
    brief = F.trim(F.coalesce(annotation["short_description"], F.lit("")))
    told = F.coalesce(F.nullif(F.trim(F.coalesce(annotation["summary"], F.lit(""))), F.lit("")), brief) if use_summary else brief
    kind = F.coalesce(annotation["image_type"], F.lit("image"))
    forms = {
        "html": F.concat(F.lit("<figcaption><em>"), kind, F.lit("</em>: "), told, F.lit("</figcaption>")),
        "markdown": F.concat(F.lit("*"), kind, F.lit("*: "), told),
        "text": F.concat(F.lit("Imagen ("), kind, F.lit("): "), told),
    }
    return F.when(annotation.isNull() | (told == ""), "").otherwise(forms[form])


def caption_html(annotation: Column, detailed: bool = True) -> Column:
    kind, told, extra = annotation_type(annotation), annotation_description(annotation, detailed), annotation_extras(annotation)
    more = F.when(extra != "", F.concat(F.lit('<br><small class="img-extra">'), extra, F.lit("</small>"))).otherwise("")
    html = F.concat(F.lit('<figcaption class="bbox-caption"><strong class="img-type">'), kind, F.lit('</strong>: <span class="img-desc">'), told, F.lit("</span>"), more, F.lit("</figcaption>"))
    return F.when(annotation.isNull() | (told == ""), "").otherwise(html)


def caption_text(annotation: Column, form: str = "italic", detailed: bool = True) -> Column:
    """A caption as italic, blockquote or plain text."""
    content = F.concat(annotation_type(annotation), F.lit(": "), annotation_description(annotation, detailed))
    forms = {"italic": F.concat(F.lit("*["), content, F.lit("]*")), "blockquote": F.concat(F.lit("> "), content), "plain": F.concat(F.lit("["), content, F.lit("]"))}
    return F.when(annotation.isNull() | (annotation_description(annotation, detailed) == ""), "").otherwise(forms[form])


def annotation_summary(annotations: DataFrame, *groups: str) -> DataFrame:
    """Pages, images and counts by type, as columns and text, of `page_idx, image_type` rows."""
    by_type = annotations.groupBy(*groups, F.coalesce("image_type", F.lit("unknown")).alias("kind"), "page_idx").agg(F.count("*").alias("n"))
    counts = by_type.groupBy(*groups, "kind").agg(F.sum("n").alias("n"), F.collect_set("page_idx").alias("pages"))
    found = counts.groupBy(*groups).agg(F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.sum("n").alias("images"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("types"))
    return found


# ---- documents ----


def with_page_content(pages: DataFrame, optimize: bool = False, domain: str = "general", headers: bool = True, embed: bool = False) -> DataFrame:
    """Adds `content` to exploded pages: tables injected, images embedded, repaired page by page unless the domain is legal, with labels."""
    legal = domain in LEGAL_DOMAINS
    text = inject_tables(F.col("markdown"), F.col("tables"))
    if embed:
        content, extension = lambda x: image_content(x)[0], lambda x: image_content(x)[1]
        entry = lambda x, k: F.struct(F.coalesce(F.nullif(x["id"], F.lit("")), x["image_id"], F.concat(F.lit("img_"), k.cast("string"))).alias("key"), encode_data_uri(content(x), extension(x)).alias("uri"), F.nullif(describe_image(first_annotation(x), "markdown"), F.lit("")).alias("caption"))
        text = embed_images(text, F.transform("images", entry))
    if optimize and not legal:
        text = optimize_markdown(text)
    if headers and not legal:
        label = lambda c, before, name, after: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before + name), F.col(c), F.lit(after))).otherwise("")
        text = F.concat(label("header", "", HEADER_LABEL, "\n\n"), text, label("footer", "\n\n", FOOTER_LABEL, ""))
    return pages.withColumn("content", F.coalesce(text, F.lit("")))


def assemble(pages: DataFrame, content: Column | str = "content", separator: str = "\n\n", page_header: Callable[[Column], Column] | None = None) -> DataFrame:
    """`doc_id, text`: pages of `doc_id, page_idx` in order, each behind its header if a function of the page number is given."""
    own = F.col(content) if isinstance(content, str) else content
    text = F.concat(page_header(F.col("page_idx") + 1), own) if page_header else own
    found = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", F.coalesce(text, F.lit("")).alias("t")))).alias("p"))
    return found.select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), separator).alias("text"))


def assemble_markdown(pages: DataFrame, optimize: bool = False, domain: str = "general", headers: bool = True, embed: bool = False, separator: str = "\n\n") -> DataFrame:
    """Documents as markdown; a legal one is repaired as a whole."""
    found = assemble(with_page_content(pages, optimize, domain, headers, embed), separator=separator)
    return found.withColumn("text", optimize_markdown(F.col("text"))) if optimize and domain in LEGAL_DOMAINS else found


def assemble_text(pages: DataFrame, optimize: bool = False) -> DataFrame:
    """Documents as plain text with page headings and image descriptions."""
    text = plain_text(F.col("markdown"))
    text = optimize_text(text) if optimize else text
    told = F.filter(F.transform("images", lambda x: describe_image(first_annotation(x))), lambda d: d != "")
    more = F.when(F.size(told) > 0, F.concat(F.lit("\n"), F.array_join(told, "\n"))).otherwise("")
    found = assemble(pages, F.concat(F.coalesce(text, F.lit("")), F.coalesce(more, F.lit("")), F.lit("\n\n")), "", lambda n: F.format_string("=== PÁGINA %d ===\n\n", n))
    return found


def assemble_html_body(pages: DataFrame, optimize: bool = False, domain: str = "general") -> DataFrame:
    """Documents as markdown for rendering: a rule and a heading before each page, images embedded, no labels, case references escaped."""
    found = assemble(with_page_content(pages, optimize, domain, headers=False, embed=True), "content", "", lambda n: F.format_string("\n\n---\n\n## 📄 Página %d\n\n", n))
    return found.withColumn("text", escape_case_refs(F.col("text")))


def combined_markdown(pages: DataFrame) -> DataFrame:
    """Documents as markdown with embedded images."""
    return assemble_markdown(pages, embed=True)


def preview(pages: DataFrame) -> DataFrame:
    return assemble(pages, "markdown", "\n\n---\n\n")


def totals(responses: DataFrame) -> DataFrame:
    """Pages and images of each response, without exploding it."""
    images = F.aggregate("pages", F.lit(0), lambda n, p: n + F.greatest(F.size(F.coalesce(p["images"], F.array())), F.lit(0)))
    return responses.select("doc_id", F.greatest(F.size("pages"), F.lit(0)).alias("n_pages"), F.coalesce(images, F.lit(0)).alias("n_images"))


