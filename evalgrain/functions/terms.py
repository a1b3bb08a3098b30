"""Term sets of queries, pages and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date filters and year ranges that are no search terms, and the word lists of the rules below.
DATE_RANGES = (
    r"(?i)\b(?:after|before):\d{4}(?:-\d{2}-\d{2})?\b"
    r"|\b(?:1[5-9]\d{2}|20\d{2})\s*(?:\.\.|[-–—]|\bto\b)\s*(?:1[5-9]\d{2}|20\d{2})\b"
)
LINK_STOPWORDS = "a an and article at by for from in into of on or the to use uses with".split()
RESEARCH_TERMS = (
    "archive attribution biography chronicle chronicles culture discovery documented documentation evidence history origin"
    " origins primary research ritual source study traditional"
).split()
SIGNAL_TERMS = "according attributed credited described documented earliest first identified named reported wrote".split()
QUESTION_WORDS = "answer identify name named question tell what when where which who whose".split()
CONTRADICTION = (
    r"(?i)\b(?:did|does|do|is|are|was|were|has|have|had|can|could|would)\s+not\s+(?!only\b)|\bnever\b"
    r"|\b(?:incorrectly|falsely)\s+(?:attributed|credited|identified|reported)\b|\b(?:misattributed|disputed)\b"
)


def words_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def all_terms(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text without date ranges, in order, repeats kept."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), DATE_RANGES, " "), F.lit("[a-z0-9]+"), 0)


def terms(text: Column, without=()) -> Column:
    """Distinct terms, first places kept, without the words given."""
    found = F.array_distinct(all_terms(text))
    return F.array_except(found, words_array(without)) if without else found


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def term_set_key(text: Column) -> Column:
    """One string for each set of terms."""
    return F.array_join(F.sort_array(terms(text)), " ")
