"""Words for matching: runs of a-z, 0-9 and characters beyond ASCII, after A-Z are lower-cased.

On UTF-8 bytes that is a translation of single bytes: all bytes of a character beyond ASCII are over 0x7F.
"""

from __future__ import annotations

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A text's words in order, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


_LINE_TABLE = bytes(0x0A if c == 0x0A else x for c, x in enumerate(_TABLE))


def lines_of(text: str | None) -> list[bytes]:
    """The words of each of a text's lines, joined by single spaces, as UTF-8; null has no lines."""
    if not text:
        return []
    spaced = text.encode("utf-8", "surrogatepass").translate(_LINE_TABLE)
    while b"  " in spaced:
        spaced = spaced.replace(b"  ", b" ")
    return spaced.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")
