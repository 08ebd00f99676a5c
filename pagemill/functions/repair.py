"""Repair of recognised text by ordered rules, as columns.

Rules are pairs of a regular expression in Java's syntax and a replacement. Word boundaries are lookarounds on letters,
numbers and underscore of any script, so that they don't depend on the Java version.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from pagemill.functions.text import WORD_CHAR, WORD_END, replaced, split_lines, strip

Rules = Sequence[tuple[str, str]]


def _word(w: str, tail: str = WORD_END) -> str:
    """A whole word. Plain characters come first, so that the boundary is looked at only where they are."""
    plain = w if w.isalnum() else re.match("[A-Za-z]+", w)[0]
    return f"{plain}(?<!{WORD_CHAR}{plain}){w.removeprefix(plain)}{tail}"


def _between(c: str, before: str, behind: str) -> str:
    """A character between others; what stands before it is looked at only where it is."""
    return f"{c}(?<={before}{c})(?={behind})"


# The rules, in their order.
SPACING = [("  +", " "), (" +([.,;:!?])", "$1"), (r"([.,;:!?])(?=[A-Za-z])", "$1 ")]
PUNCTUATION = [("--+", "—")]
# Tried at hyphens only. The letter behind one is used up, so a hyphen right behind it has no word of its own.
HYPHENATION = [(rf"-(?<={WORD_CHAR}-)(?<!\G-)\s*[\r\n]+\s*([a-záéíóúüñ])", "$1")]
PAIRS = [
    ("\"([^\"']++)'", '"$1"'),
    ("'([^\"']++)\"", '"$1"'),
    (r"\(([^()\n]++)\n", "($1)\n"),
    (r"\n([^()\n]++)\)", "\n($1)"),
    (r"\[([^\[\]\n]++)\n", "[$1]\n"),
    (r"\n([^\[\]\n]++)\]", "\n[$1]"),
]
LETTERS_AND_DIGITS = [
    (rf"l(?<!{WORD_CHAR}l)(?=\d)", "1"),
    (_between("O", r"\d", r"\d"), "0"),
    (_between("o", r"\d", r"\d"), "0"),
    (_between("l", r"\d", r"\d"), "1"),
    (_between("I", r"\d", r"\d"), "1"),
    (_between("S", r"\d", r"\d"), "5"),
    (_between("Z", r"\d", r"\d"), "2"),
]
LETTER_PAIRS = [
    (_word("rn"), "m"),
    (_word("rn", r"(?=\s)"), "m"),
    (_word("cl"), "d"),
    (_word("vv"), "w"),
    (_word("ii"), "ll"),
    (_word("Il"), "ll"),
    (_word("lI"), "ll"),
    (_word("nn"), "ñ"),
]
WORDS = [
    (_word("eI"), "el"),
    (_word("Ia"), "la"),
    (_word("cle"), "de"),
    (_word("que", rf"{WORD_END}(?=\d)"), "que "),
    (_word("el", r"(?=\d)"), "el "),
    (_word("la", r"(?=\d)"), "la "),
    (_word("de", r"(?=\d)"), "de "),
    (_word("en", r"(?=\d)"), "en "),
]
SYMBOLS = [("¦", "l"), ("§", "S"), ("¢", "c"), ("£", "E"), ("µ", "u"), ("¶", "P"), ("º", "o"), ("ª", "a")]
CASES = [(_between("l", WORD_CHAR, "[A-Z]"), "I"), (_between("l", "[A-Z]", "[A-Z]"), "I")]
JOINED = [(r"([a-záéíóúñ])(\d)", "$1 $2"), (r"(\d)([a-záéíóúñ])", "$1 $2"), ("([.,;:!?])([A-ZÁÉÍÓÚÑ])", "$1 $2")]
ACCENTS = [(_word("ARTICULO"), "ARTÍCULO"), (_word("PAGINA"), "PÁGINA"), (_word("NUMERO"), "NÚMERO"), (_word("PARAGRAFO"), "PARÁGRAFO"), (_word(r"CAP\s*iTULO"), "CAPÍTULO")]
DASHES = [("---+", "—"), ("--", "—"), ("_+", "_")]
QUOTES = [("''", '"'), ("``", '"'), ("'([^']{1,50})'", '"$1"')]
ROMANS = [(_word(r"I\s+I"), "II"), (_word(r"I\s+V"), "IV"), (_word(r"V\s+I"), "VI")]
MATHS = [("1/2", "½"), ("1/4", "¼"), ("3/4", "¾"), ("<=", "≤"), (">=", "≥"), ("!=", "≠")]
OCR_RULES: list[tuple[str, str]] = [*LETTERS_AND_DIGITS, *LETTER_PAIRS, *WORDS, *SYMBOLS, *CASES, *JOINED, *ACCENTS, *DASHES, *QUOTES, *ROMANS, *MATHS]

PROFILE = {"spacing": SPACING, "punctuation": PUNCTUATION, "hyphenation": HYPHENATION, "pairs": PAIRS, "ocr": OCR_RULES}


def load_rules(rules: Iterable) -> list[tuple[str, str]]:
    """Rules from pairs; ValueError if one isn't a pair of strings."""
    found = []
    for r in rules:
        if not isinstance(r, (tuple, list)) or len(r) != 2 or not all(isinstance(x, str) for x in r):
            raise ValueError(f"a rule is a pair of a pattern and a replacement, not {r!r}")
        found.append((r[0], r[1]))
    return found


def profile_rules(off: Iterable[str] = (), custom: Iterable = ()) -> list[tuple[str, str]]:
    """The rules of the groups of PROFILE that aren't off, in order, then the custom ones."""
    off = set(off)
    if off - set(PROFILE):
        raise ValueError(f"no such group: {sorted(off - set(PROFILE))}")
    return [r for name, rules in PROFILE.items() if name not in off for r in rules] + load_rules(custom)


def fix_spacing(text: Column) -> Column:
    return replaced(text, SPACING)


def fix_punctuation(text: Column) -> Column:
    return replaced(text, PUNCTUATION)


def fix_hyphenation(text: Column) -> Column:
    return replaced(text, HYPHENATION)


def fix_unbalanced_pairs(text: Column) -> Column:
    return replaced(text, PAIRS)


def optimize_text(text: Column, custom: Iterable = (), off: Iterable[str] = ()) -> Column:
    """Spacing, punctuation, hyphenation, pairs, recognition errors, then custom rules; null stays null."""
    return replaced(text, profile_rules(off, custom))


# A heading's marks and title, tables in HTML, and header and footer blocks up to an empty line.
HEADING = r"^(#+)\s*([^\n]+)"
HTML_TABLE = r"(?is)<table\b.*?</table>"
BLOCKS = rf"(?:{HTML_TABLE})|(?:(?m)^\*\*Encabezado:\*\*[^\n]*(?:\n[^\n]+)*)|(?:(?<=\n\n)\*\*Pie de página:\*\*[^\n]*(?:\n[^\n]+)*)"


def line_kind(line: Column) -> Column:
    """image, heading, mark (of headings, without a title or behind blanks) or text."""
    bare = strip(line)
    heading = F.when(line.rlike(HEADING), "heading").otherwise("mark")
    return F.when(bare.startswith("!["), "image").when(bare.startswith("#"), heading).otherwise("text")


def segments(text: Column) -> Column:
    """A markdown text as `kind, value` parts: `kept` for tables in HTML and header and footer blocks, else `text`.

    The parts joined are the text. What must not be repaired is a part of its own instead of a placeholder, so nothing
    can be damaged or lost on the way back.
    """
    kept = F.regexp_extract_all(text, F.lit(f"({BLOCKS})"), F.lit(1))
    free = F.split(text, BLOCKS)
    both = F.zip_with(free, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.array(F.struct(F.lit("text").alias("kind"), a.alias("value")), F.struct(F.lit("kept").alias("kind"), b.alias("value"))))
    return F.filter(F.flatten(both), lambda s: s["value"] != "")


def optimize_markdown(text: Column, custom: Iterable = (), off: Iterable[str] = ()) -> Column:
    """Repairs a page's markdown line by line; `operators.markdown` does so for tables of documents, with drawn tables.

    Lines that an image opens and protected blocks stay, of headings the title is repaired.
    """
    rules = profile_rules(off, custom)

    def line(x: Column) -> Column:
        kind = line_kind(x)
        fixed = replaced(F.when(kind == "heading", F.regexp_extract(x, HEADING, 2)).otherwise(x), rules)
        return F.when(kind.isin("image", "mark") | (x == ""), x).when(kind == "heading", F.concat(F.regexp_extract(x, HEADING, 1), F.lit(" "), fixed)).otherwise(fixed)

    part = lambda s: F.when(s["kind"] == "kept", s["value"]).otherwise(F.array_join(F.transform(F.split(s["value"], "\n"), line), "\n"))
    return F.when(text == "", text).otherwise(F.array_join(F.transform(segments(text), part), ""))


def with_optimized_markdown(df: DataFrame, text: str = "text", name: str = "optimized") -> DataFrame:
    return df.withColumn(name, optimize_markdown(F.col(text)))


# What plain text takes out of a line or changes, in order.
TAGS = [("</?[a-zA-Z][^>]*>", ""), ("<([^<>]{1,200})>", "$1")]
LABELS = [("**Encabezado:**", "Encabezado:"), ("**Pie de página:**", "Pie de página:")]
MARKUP = [(r"^#+\s*", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1")]


@pandas_udf(ArrayType(StringType()))
def _unescaped(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else [None if y is None else html.unescape(y) for y in x])


def unescape(lines: Column) -> Column:
    """An array of lines with all named entities and numeric references of HTML decoded once.

    Names without a semicolon count where HTML has them, by the longest that fits, which no replacement of fixed texts can
    do; so this is an Arrow function. Only rows with an ampersand are handed to it.
    """
    return F.coalesce(_unescaped(F.when(F.exists(lines, lambda x: x.contains("&")), lines)), lines)


def plain_text(markdown: Column) -> Column:
    """The lines of a markdown text without tags, images, header marks, emphasis and links; blank ones are dropped.

    Entities are decoded first, then tags go; what else is in angle brackets loses these only. Lines of page headers and
    footers keep their labels, without emphasis. Blanks at the ends of lines stay.
    """

    def line(x: Column) -> Column:
        x = replaced(x, TAGS)
        for label, plain in LABELS:
            x = F.replace(x, F.lit(label), F.lit(plain))
        return F.when(~strip(x).startswith("!["), replaced(x, MARKUP))

    return F.array_join(F.filter(F.transform(unescape(split_lines(markdown)), line), lambda x: x.rlike(r"(?U)\S")), "\n")


def plain_preview(markdown: Column) -> Column:
    """Stripped lines without images and header marks."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: strip(x)), lambda x: ~x.startswith("!["))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^#+\s*", "")), "\n")


# What looks like a tag but refers to a case, in order.
CASE_REFS = [
    r"<\d+[aA]\.(?:/)?[jJ]?\.?\s*[^>]+?>",
    r"<[PAp]\.?[jJ]?\.?\s*[^>]+?>",
    r"<[Rr]eg\.\s*[^>]+?>",
    r"<[^>]*?=\"\"[^>]*?>",
    r"<[^>]*?\(\d+a\.\)[^>]*?>",
    r"<[IVXLCDM]+/\d{4}[^>]*?>",
    r"<\d+[aA]\./[JjPp][^>]*?>",
]


def escape_case_refs(text: Column) -> Column:
    """The text with the angle brackets in case references as entities."""
    for pattern in CASE_REFS:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
        escaped = lambda t, x: F.replace(t, x, F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
        text = F.aggregate(found, text, escaped)
    return text
