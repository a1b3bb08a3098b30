"""Text functions of pages and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_middle(text: Column, limit: int) -> Column:
    """A text over the limit keeps two halves of (limit - 60) div 2 around a note of how much is left out."""
    if limit < 100:
        return F.when(F.char_length(text) <= limit, text).otherwise(F.left(text, F.lit(limit)))
    half = (limit - 60) // 2
    note = F.concat(F.lit("\n...["), (F.char_length(text) - 2 * half).cast("string"), F.lit(" chars omitted]...\n"))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(half)), note, F.right(text, F.lit(half))))


def clean_text(text: Column) -> Column:
    """Line ends as LF, runs of blanks as one, lines stripped, at most one empty line in a row."""
    out = F.regexp_replace(text, r"\r\n|\r", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"(?m)^ +| +$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def windows(length: Column, size: int) -> Column:
    """Offsets of all windows of a text; a text without characters has one."""
    return F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))
