"""Words and lines of whole texts, as column expressions and as Python helpers.

A word is a longest run of characters other than space and the five control characters from tab to carriage
return. Both forms cut texts alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\x0B\f\r]"


def words(text: Column) -> Column:
    """Array of the words; null stays null."""
    return F.array_remove(F.split(text, BLANK), "")


def n_words(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def count_matches(text: Column, pattern: str) -> Column:
    """How often the pattern is found, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def byte_words(text: str | None) -> list[bytes]:
    """The words as UTF-8, with A-Z lower-cased. ``bytes.split`` cuts at exactly the blanks above."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
