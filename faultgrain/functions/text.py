"""Text expressions that agree with Python's ``str`` and ``re`` on every character.

Java's ``\\s``, ``\\w`` and ``\\d`` are ASCII by default and differ from Python's
even with ``(?U)``, so patterns are built from the explicit classes below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space (``str.isspace`` and
# ``\s``), word characters (``\w``), decimal digits (``\d``) and line ends
# (``str.splitlines``).
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
LINE_END_CHARS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def not_blank(text: Column) -> Column:
    """True when ``text`` holds at least one non-space character."""
    return text.rlike(f"[^{SPACE}]")


def strip(text: Column) -> Column:
    """``str.strip()``: white space of any kind off both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def decode_utf8(raw: Column) -> Column:
    """Bytes (or text) to text; bad bytes become U+FFFD, NULL becomes ''."""
    return F.coalesce(F.make_valid_utf8(raw.cast("string")), F.lit(""))


def split_lines(text: Column) -> Column:
    """``str.splitlines()``: no entry after a final line end, '' has no lines."""
    lines = F.split(text, LINE_END, -1)
    return F.when(
        F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)
    ).otherwise(lines)


def line_count(text: Column) -> Column:
    """``len(text.splitlines())`` by counting line-end characters, without a pattern."""
    ends = F.length(text) - F.length(F.translate(text, LINE_END_CHARS, ""))
    pairs = F.length(text) - F.length(F.replace(text, F.lit("\r\n")))
    unterminated = (text != "") & ~F.contains(F.lit(LINE_END_CHARS), F.right(text, F.lit(1)))
    return (ends - pairs / 2 + unterminated.cast("int")).cast("int")


def tail(text: Column, chars: int) -> Column:
    """The last ``chars`` characters, the part of a log that names the error."""
    return F.right(text, F.lit(chars))


def first_match(pattern: str, text: Column) -> Column:
    """Group 1 of the first match of ``pattern``, NULL when there is none.

    ``nullif(regexp_extract(...))`` would run the pattern twice.
    """
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))
