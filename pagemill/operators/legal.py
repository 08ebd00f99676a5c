"""Structure of legal texts, on a flat table of lines: articles, fractions, subsections and amendment notes.

Three running sums over a document's lines give each line its article, the fraction in it and the subsection in that. A
tree is built from them only for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import WORD_CHAR, composed, replaced, strip
from pagemill.operators.blocks import with_blocks

# Heads of articles, fractions and subsections, and notes of amendments.
_LEAD = r"^[#*>\s]*"
ARTICLE = rf"(?iu){_LEAD}(?:art[íi]culo|art\.)\s+\d+"
SEPARATOR = r"^\s*---+\s*$"
ARTICLE_NUMBER = r"(?iu)(?:art[íi]culo|art\.)\s+(\d+)([oºa°])?\.?\s*(?:(-[A-Z])(?!\p{L}))?\s*(Bis|Ter|Quáter|Quinquies)?"
ARTICLE_REST = r"(?iu)(?:art[íi]culo|art\.)\s+\d+[oºa°]?\.?\s*(?:-[A-Z](?!\p{L}))?\s*(?:Bis|Ter|Quáter|Quinquies)?\s*\.?-?\s*(.*)$"
FRACTION = rf"{_LEAD}(?:\(?([IVXLCDM]+)\s*(?:\.-|\.|\)|-|:)|(?:Inciso|Fracción|FRACCIÓN)\s+([IVXLCDM]+)(?![\p{{L}}]))"
ROMAN = r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
SUBSECTION = rf"{_LEAD}(?<!{WORD_CHAR})(?:\(([a-z])\)|([a-zA-Z])\)|([a-z])\s*(?:\.-|\.|-))"
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
_MONTH = "(?:" + "|".join(MONTHS) + ")"
DATE = rf"(?:\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}|\d{{1,2}}\s+{_MONTH}\s+\d{{2,4}}|{_MONTH}\s+\d{{1,2}},?\s+\d{{2,4}})"
# The spellings of a vowel that recognition gives.
VOWELS = {"a": "aáàâãäå", "i": "iíìîï", "o": "oóòôõö", "u": "uúùûü"}


def _word(plain: str) -> str:
    """A word in which the capital letters stand for vowels with any accent or none."""
    return "".join(f"[{VOWELS[c.lower()]}]" if c.isupper() else c for c in plain)


_GAZETTE = r"(?:D\.O\.F\.|DOF)"
_PLURALS = f"(?:{_word('artIculos?')}|{_word('pArrafos?')}|fracciones?|incisos?)"


def _done(verb: str) -> str:
    """What a note says of a part: when the gazette had it."""
    return rf"\s+{verb}[oa]\s+{_GAZETTE}\s+{DATE}"


#: (kind, pattern behind the lead), in order of precedence.
AMENDMENTS = [
    ("addition", _word("artIculo") + _done("adicionad")),
    ("addition", _word("pArrafo") + _done("adicionad")),
    ("addition", _word("fracciOn") + _done("adicionad")),
    ("addition", "inciso" + _done("adicionad")),
    ("addition", _word("pArrafo") + r"\s+con\s+numerales" + _done("adicionad")),
    ("addition", _word("pArrafo") + r"\s+con\s+incisos" + _done("adicionad")),
    ("addition", rf"se\s+adicionan\s+(?:los\s+)?{_PLURALS}.*{DATE}"),
    ("reform", _word("artIculo") + _done("reformad")),
    ("reform", _word("pArrafo") + _done("reformad")),
    ("reform", _word("fracciOn") + _done("reformad")),
    ("reform", "inciso" + _done("reformad")),
    ("reform", "apartado" + _done("reformad")),
    ("reform", _word("fracciOn") + _done("recorrid")),
    ("reform", _word("pArrafo") + _done("reformad") + rf"(?:\s*,\s*{DATE})*"),
    ("reform", rf"{_word('pArrafo')}\s+adicionad[oa]\s+{_GAZETTE}\.\s*reformad[oa]\s+{_GAZETTE}\s+{DATE}"),
    ("reform", rf"{_word('Ultima')}\s+reforma\s+publicad[oa]\s+{_GAZETTE}\s+{DATE}"),
    ("reform", rf"se\s+reforman\s+(?:los\s+)?{_PLURALS}.*{DATE}"),
    ("note", rf"(?:{_word('artIculo')}|{_word('pArrafo')}|{_word('fracciOn')}|inciso|apartado|fe de erratas|numeral|anexo|punto).*(?:reformad[oa]|adicionad[oa]|derogad[oa]|publicad[oa]|recorrid[oa]|modificad[oa])"),
    ("note", rf"(?:{_word('reforma|adiciOn|derogaciOn|modificaciOn|publicaciOn|derogO|adicionO|reformO|modificO')}).*(?:D\.O\.F\.|DOF|vigente|{_word('cOd')}|ley)"),
    ("note", r"se\s+(?:reforman|adicionan|derogan|modifican)\s+"),
    ("note", r"\(?(?:reformado|derogado|adicionado|reformada|derogada|adicionada|modificado|modificada)\)?(?:\s+|$)"),
    ("note", rf"{_word('Ultima')}\s+reforma\s+"),
    ("note", rf".*{_GAZETTE}\s*\d{{1,2}}.*(?:{_MONTH}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}}-\d{{1,2}}-\d{{2,4}})"),
    ("note", r"fe\s+de\s+erratas.*\d{1,2}"),
]
PAGE_LINE = r"(?im)^\s*\d+\s+de\s+\d+\s*$"
# Blanks that aren't one space already.
BLANKS = r"[ \t]{2,}|\t"
ABBREVIATIONS = ["Art", "Lic", "Inc", "Fracc", "Núm", "No", "C.P", "Sr", "Sra", "Dr", "Mtro", "Ing", "etc", "v.g", "i.e"]
# Behind the dot, so that only dots are looked at.
_GUARD = "".join(rf"(?<!{a.replace('.', chr(92) + '.')}\.)" for a in ABBREVIATIONS)
PARAGRAPH_RULES = [
    ("\r\n", "\n"),
    (BLANKS, " "),
    (r"([^\n])\n(\*[^\n]+\*)", "$1\n\n$2"),
    (r"(\*[^\n]+\*)\n(?!\n)(?!\*)", "$1\n\n"),
    (rf"\.(?=\s+[A-ZÁÉÍÓÚÑ]){_GUARD}\s+([A-ZÁÉÍÓÚÑ])(?!\n\n)", ".\n\n$1"),
    (rf"\.(?=[A-ZÁÉÍÓÚÑ]){_GUARD}([A-ZÁÉÍÓÚÑ])(?!\n\n)", ".\n\n$1"),
    (r"\n(?<!-\n)\n{2,}(?!-)", "\n\n"),
]


def normalize_legal(text: Column) -> Column:
    """Composed form, line feeds unified, lines of page numbers emptied, runs of blanks squeezed."""
    text = F.regexp_replace(F.regexp_replace(composed(text), "\r\n|\r", "\n"), PAGE_LINE, "")
    return F.regexp_replace(text, BLANKS, " ")


def legal_lines(docs: DataFrame, text: str = "text", parity: bool = False) -> DataFrame:
    """`doc_id, line_no, line, kept` of normalised texts; header and footer blocks are kept as they are."""
    lines = docs.select("doc_id", F.posexplode(F.split(normalize_legal(F.col(text)), "\n")).alias("line_no", "line"))
    return with_blocks(lines, parity)


def is_article(line: Column) -> Column:
    return line.rlike(ARTICLE)


def article_number(line: Column) -> tuple[Column, Column, Column]:
    """(number with suffix, base, suffix) of an article's line; the first digits if it has no head, else 0."""
    g = lambda k: F.regexp_extract(line, ARTICLE_NUMBER, k)
    digits = F.coalesce(F.nullif(F.regexp_extract(line, r"(\d+)", 1), F.lit("")), F.lit("0"))
    base = F.coalesce(F.nullif(g(1), F.lit("")), digits)
    suffix = F.trim(F.concat(g(2), g(3), F.lit(" "), g(4)))
    return F.concat(base, suffix), base.cast("decimal(38,0)").cast("long"), suffix


def rest_of_article_line(line: Column) -> Column:
    return strip(F.regexp_extract(line, ARTICLE_REST, 1))


def fraction_numeral(line: Column) -> Column:
    """The Roman numeral that opens a fraction, null if there is none or it isn't well formed."""
    found = F.concat(F.regexp_extract(line, FRACTION, 1), F.regexp_extract(line, FRACTION, 2))
    return F.when((found != "") & found.rlike(ROMAN), found)


def subsection_letter(line: Column) -> Column:
    """The letter that opens a subsection, or null."""
    found = F.concat(*[F.regexp_extract(line, SUBSECTION, k) for k in (1, 2, 3)])
    return F.nullif(found, F.lit(""))


def amendment_pattern(line: Column) -> Column:
    """The number, from 1, of the first amendment pattern that a line matches; null for none and for lines in italics."""
    test = F.lit(None).cast("int")
    for k, (_, p) in reversed([*enumerate(AMENDMENTS, 1)]):
        test = F.when(line.rlike(rf"(?iu){_LEAD}{p}"), F.lit(k)).otherwise(test)
    any_of = "|".join(f"(?:{p})" for _, p in AMENDMENTS)
    italic = strip(line).rlike(r"^\*[^*].*\*$")
    return F.when(line.rlike(rf"(?iu){_LEAD}(?:{any_of})") & ~italic, test)


def amendment_kind(pattern: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k, _ in AMENDMENTS]), pattern - 1)


def amendment_dates(line: Column) -> Column:
    """The dates of a line, numeric ones and such with Spanish months; what is no date gives none."""
    found = F.regexp_extract_all(F.lower(line), F.lit(f"({DATE})"), F.lit(1))

    def date(x: Column) -> Column:
        for k, m in enumerate(MONTHS, 1):
            x = F.replace(x, F.lit(m), F.lit(f"{k}"))
        month_first = x.rlike(r"^\d+\s+\d+,\s")
        p = F.split(F.regexp_replace(x, r"[\s,/.-]+", "-"), "-")
        day, month = F.when(month_first, p[1]).otherwise(p[0]), F.when(month_first, p[0]).otherwise(p[1])
        year = F.when(F.length(p[2]) == 2, F.concat(F.lit("20"), p[2])).otherwise(p[2])
        return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    return F.array_compact(F.transform(found, date))


def with_structure(lines: DataFrame) -> DataFrame:
    """Adds to lines their section (preamble, article, orphan), article_seq, fraction_seq, subsection_seq and amendment pattern.

    An orphan stands between a separator line and the next article. Sequences count from 1, and 0 is what precedes the
    first. One sort of a document's lines serves all sums. Lines that are `kept` (see `blocks.with_blocks`), if there is
    such a column, are text of where they stand, whatever they look like.
    """
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    read = ~F.coalesce("kept", F.lit(False)) if "kept" in lines.columns else F.lit(True)
    found = lines.withColumns({"is_article": read & is_article(F.col("line")), "is_separator": read & F.col("line").rlike(SEPARATOR), "amendment": F.when(read, amendment_pattern(F.col("line")))})
    free = read & ~F.col("is_article") & F.col("amendment").isNull()
    found = found.withColumns({"numeral": F.when(free, fraction_numeral(F.col("line"))), "letter": F.when(free, subsection_letter(F.col("line")))})
    found = found.withColumn("letter", F.when(F.col("numeral").isNull(), F.col("letter")))
    seen = lambda c, w: F.coalesce(F.sum(c.cast("long")).over(w), F.lit(0).cast("long"))
    found = found.withColumns({"article_seq": seen(F.col("is_article"), by_line), "cut": F.last(F.when(F.col("is_article") | F.col("is_separator"), F.col("is_separator")), ignorenulls=True).over(by_line)})
    in_article = Window.partitionBy("doc_id", "article_seq").orderBy("line_no")
    found = found.withColumn("fraction_seq", F.when(F.col("article_seq") > 0, seen(F.col("numeral").isNotNull(), in_article)).otherwise(0))
    in_fraction = Window.partitionBy("doc_id", "article_seq", "fraction_seq").orderBy("line_no")
    found = found.withColumn("subsection_seq", F.when(F.col("article_seq") > 0, seen(F.col("letter").isNotNull(), in_fraction)).otherwise(0))
    section = F.when(F.col("article_seq") == 0, "preamble").when(F.coalesce("cut", F.lit(False)), "orphan").otherwise("article")
    return found.withColumn("section", section).drop("cut")


def articles(structured: DataFrame) -> DataFrame:
    """`doc_id, article_seq, number, base, suffix, body` of each article; amendment lines are in italics."""
    kept = structured.where("section = 'article' and article_seq > 0")
    number, base, suffix = article_number(F.col("head"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", marked_line().alias("line")))), lambda x: x["line"]), "\n")
    found = kept.groupBy("doc_id", "article_seq").agg(F.min_by("line", "line_no").alias("head"), body.alias("body"))
    return found.select("doc_id", "article_seq", number.alias("number"), base.alias("base"), suffix.alias("suffix"), "body")


def marked_line() -> Column:
    """A line as it is written out: amendments in italics."""
    return F.when(F.col("amendment").isNotNull(), F.concat(F.lit("*"), strip(F.col("line")), F.lit("*"))).otherwise(F.col("line"))


def structure_counts(structured: DataFrame) -> DataFrame:
    """For each document its articles, fractions, subsections and amendments."""
    return structured.groupBy("doc_id").agg(
        F.count_if("is_article").alias("articles"),
        F.count_if(F.col("numeral").isNotNull() & (F.col("article_seq") > 0)).alias("fractions"),
        F.count_if(F.col("letter").isNotNull() & (F.col("article_seq") > 0)).alias("subsections"),
        F.count_if(F.col("amendment").isNotNull()).alias("amendments"),
    )


def amendments(structured: DataFrame) -> DataFrame:
    """`doc_id, line_no, pattern, kind, date` with a row for each date of each amendment line (one of a null date without any)."""
    found = structured.where("amendment is not null")
    return found.select("doc_id", "line_no", F.col("amendment").alias("pattern"), amendment_kind(F.col("amendment")).alias("kind"), F.explode_outer(amendment_dates(F.col("line"))).alias("date"))


def amendments_by_year(structured: DataFrame) -> DataFrame:
    return amendments(structured).groupBy(F.year("date").alias("year"), "kind").agg(F.count("*").alias("n"))


def article_intro(structured: DataFrame) -> DataFrame:
    """`doc_id, article_seq, intro`: the text of an article before its first fraction or subsection."""
    kept = structured.where("section = 'article' and fraction_seq = 0 and subsection_seq = 0")
    return kept.groupBy("doc_id", "article_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", marked_line().alias("line")))), lambda x: x["line"]), "\n").alias("intro"))


def format_paragraphs(text: Column) -> Column:
    """Blank lines around amendments and between sentences, but not behind abbreviations; rules of dashes stay."""
    return strip(replaced(text, PARAGRAPH_RULES))


def rebuild_document(structured: DataFrame, separators: bool = False, parity: bool = False) -> DataFrame:
    """`doc_id, text`: headings of articles, fractions and subsections in markdown, amendments in italics, in order of lines.

    With `separators`, rules are put between articles if the document has none. With `parity` orphans are left out.
    """
    line = strip(F.col("line"))
    written = (
        F.when(F.col("amendment").isNotNull(), F.concat(F.lit("*"), line, F.lit("*")))
        .when(F.col("is_article"), F.concat(F.lit("## "), F.regexp_replace(line, r"^[#*>\s]+", "")))
        .when(F.col("numeral").isNotNull() & (F.col("article_seq") > 0), F.concat(F.lit("### "), F.regexp_replace(line, r"^[#*>\s]+", "")))
        .when(F.col("letter").isNotNull() & (F.col("article_seq") > 0), F.concat(F.lit("#### "), F.regexp_replace(line, r"^[#*>\s]+", "")))
        .otherwise(F.col("line"))
    )
    kept = structured.where("section <> 'orphan'") if parity else structured
    rows = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", written.alias("line"), (F.col("is_article") & (F.col("article_seq") > 1)).alias("rule")))).alias("rows"), F.max("is_separator").alias("has_rule"))
    rule = F.lit(separators) & ~F.col("has_rule")
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: F.when(rule & r["rule"], F.concat(F.lit("---\n\n"), r["line"])).otherwise(r["line"])), "\n").alias("text"))
