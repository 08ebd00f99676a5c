"""Column functions on text that other modules share."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: A word character: letters and numbers of any script, and the underscore, but no combining marks.
WORD_CHAR = r"[\p{L}\p{N}_]"
#: Word boundaries on that class, for use in place of \b.
WORD_START = rf"(?<!{WORD_CHAR})(?={WORD_CHAR})"
WORD_END = rf"(?<={WORD_CHAR})(?!{WORD_CHAR})"
#: Everything that ends a line of a plain text.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def tokens(text: Column) -> Column:
    """The maximal runs of word characters."""
    return F.regexp_extract_all(text, F.lit(rf"{WORD_CHAR}+"), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null, empty or only white space."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


@pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(text: Column) -> Column:
    """The text in composed form (NFC). Only texts with a character from U+0300 on can change, and only these go to Python."""
    return F.coalesce(_nfc(F.when(text.rlike("[^\\x{0}-\\x{2ff}]"), text)), text)


def split_lines(text: Column) -> Column:
    """The lines of a text by any line end; an end at the very end starts no further line."""
    lines = F.split(text, LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def replaced(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The text after each regular-expression rule in turn; a rule of plain characters needs no expression."""
    for pattern, replacement in rules:
        if any(c in pattern for c in r"\.[]{}()*+?^$|") or any(c in replacement for c in r"\$"):
            text = F.regexp_replace(text, pattern, replacement)
        else:
            text = F.replace(text, F.lit(pattern), F.lit(replacement))
    return text


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)`, with the value computed once a row however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a text are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))
