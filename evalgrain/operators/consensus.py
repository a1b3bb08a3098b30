"""Agreement of reviews, and sums over untidy numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.operators.evidence import is_abstention


def consensus(reviews: DataFrame, least_votes: int = 2) -> DataFrame:
    """item_id, answer, votes, confidence_sum, best_request: the answer that most reviews of an item give.

    reviews (item_id, request_id, answer, confidence, ok): the first of a request counts; failed ones and abstentions
    don't. Answers are compared in lower case without outer blanks; ties go to the larger confidence sum, then the answer.
    """
    norm = F.lower(F.regexp_replace(F.trim("answer"), r"\s+", " "))
    valid = reviews.where(F.coalesce("ok", F.lit(False))).where(~is_abstention(F.col("answer"))).withColumn("norm", norm).where("norm <> ''")
    once = valid.groupBy("item_id", "request_id").agg(F.min(F.struct("norm", "answer", "confidence")).alias("r"))
    groups = once.groupBy("item_id", "r.norm").agg(
        F.count("*").alias("votes"), F.sum("r.confidence").alias("confidence_sum"), F.max(F.struct("r.confidence", "request_id", "r.answer")).alias("best")
    )
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("votes"), F.desc("confidence_sum"), "norm"))
    won = groups.where(F.col("votes") >= least_votes).withColumn("place", place).where("place = 1")
    return won.select("item_id", F.col("best.answer").alias("answer"), "votes", "confidence_sum", F.col("best.request_id").alias("best_request"))


def with_opened_citations(winners: DataFrame, citations: DataFrame, opened: DataFrame) -> DataFrame:
    """winners with the citations of their best review that were opened; winners without any are dropped."""
    kept = citations.join(opened.select("item_id", "url_key").distinct(), ["item_id", "url_key"], "left_semi")
    mine = kept.join(winners.select("item_id", F.col("best_request").alias("request_id")), ["item_id", "request_id"], "left_semi")
    return winners.join(mine.groupBy("item_id").agg(F.array_sort(F.collect_set("url_key")).alias("citations")), "item_id")


def clean_sums(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Sums in which negative values and text that is no number count 0."""
    number = lambda c: F.coalesce(F.greatest(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy(*by).agg(*[F.sum(number(c)).alias(c) for c in columns])
