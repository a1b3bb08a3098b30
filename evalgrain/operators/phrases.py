"""A positional index of pages: where phrases stand, and the text around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrain.sources.scratch import written

# Fixed value: words of answers, with inner apostrophes and hyphens.
ANSWER_WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
#: A word and what stands between it and the next.
_PIECE = ANSWER_WORD + r"[^\p{L}\p{N}]*"
_REST = r"[^\p{L}\p{N}]+$"


def fold(text: Column) -> Column:
    """Without case; letters that have no capital of their own (as in 'straße') become what their capitals would."""
    return F.lower(F.upper(text))


def phrase_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANSWER_WORD), 0), fold)


def word_places(pages: DataFrame) -> DataFrame:
    """page_id, at (from 0), word, piece (the word as it stands, and what follows it) of pages (page_id, page), written to the shared folder.

    A page is read once, however many phrases are looked for; its words are rows, so long pages spread. Null pages have none.
    """
    cut = pages.select("page_id", F.posexplode(F.regexp_extract_all("page", F.lit(_PIECE), 0)).alias("at", "piece"))
    return written(cut.select("page_id", "at", fold(F.regexp_replace("piece", _REST, "")).alias("word"), "piece"), "words")


def phrase_places(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id, phrase, start: where the words of a phrase stand one after another. wanted (page_id, phrase: array of folded words).

    A phrase is found by its rarest word (in all of the pages), so a common one costs nothing; the others are then looked up by
    position. A phrase with a word that no page has, or with none, is nowhere. Places may overlap.
    """
    asked = wanted.select("page_id", "phrase").where(F.size("phrase") > 0).distinct()
    words = asked.select("phrase").distinct().select("phrase", F.posexplode("phrase").alias("offset", "word"))
    used = words.select("word").distinct()
    df = places.join(used, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    rarest = words.join(df, "word").groupBy("phrase").agg(F.min(F.struct("df", "offset", "word")).alias("rare"), F.count("*").alias("n")).where(F.col("n") == F.size("phrase"))
    keyed = asked.join(rarest.select("phrase", "rare.offset", "rare.word"), "phrase")
    starts = places.select("page_id", "at", "word").join(keyed, ["page_id", "word"]).select("page_id", "phrase", (F.col("at") - F.col("offset")).alias("start"))
    starts = starts.where("start >= 0")
    other = starts.select("page_id", "phrase", "start", F.posexplode("phrase").alias("offset", "word")).select("page_id", "phrase", "start", (F.col("start") + F.col("offset")).alias("at"), "word")
    met = other.join(places.select("page_id", "at", "word"), ["page_id", "at", "word"]).groupBy("page_id", "phrase", "start").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == F.size("phrase")).select("page_id", "phrase", "start")


def windows(places: DataFrame, found: DataFrame, around: int = 24) -> DataFrame:
    """found (page_id, phrase, start) with window: the page's text from `around` words before the phrase to as many after it.

    A window's words are joined by position; nothing but one window is gathered at a time.
    """
    reach = F.sequence(F.greatest(F.col("start") - around, F.lit(0)), F.col("start") + F.size("phrase") + (around - 1))
    needed = found.select("page_id", "phrase", "start", F.explode(reach).alias("at"))
    pieces = needed.join(places.select("page_id", "at", "piece"), ["page_id", "at"])
    in_order = F.array_sort(F.collect_list(F.struct("at", "piece")))
    whole = pieces.groupBy("page_id", "phrase", "start").agg(in_order.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return whole.select("page_id", "phrase", "start", F.regexp_replace(text, _REST, "").alias("window"))
