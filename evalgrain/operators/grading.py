"""Grading of answer tables: extraction, deterministic equivalence, grader outputs, audit samples."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of answer lines, numbers, year ranges, clock times and match wordings.
EXACT_ANSWER = r"(?im)^\s*Exact Answer\s*:\s*(.+?)\s*$"
ANSWER_LINE = r"(?im)^\s*Answer\s*:\s*(.+?)\s*$"
NUMBER = re.compile(r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][-+]?\d+)?")
YEAR_RANGE = re.compile(r"\b(\d{4})\s*[-\u2013\u2014]\s*(\d{2})\b")
CLOCK = re.compile(r"\b([ap])\s*\.?\s*m\b\.?", re.I)
VERSUS = re.compile(r"\s+(?:v(?:s\.?)?|versus|and)\s+", re.I)
OFFICIAL = re.compile(r"^(?:republic of|state of)\s+")
GRADER_CORRECT = r"(?im)^\s*correct\s*:\s*(yes|no)\s*$"
GRADER_EXTRACTED = r"(?im)^\s*extracted_final_answer\s*:\s*(.*?)\s*$"
GRADER_REASONING = r"(?ims)^\s*reasoning\s*:\s*(.*?)(?=^\s*correct\s*:|\z)"
RELATIVE, ABSOLUTE = 1e-4, 1e-6

# What normalisation does after case folding, in order.
_STEPS = (
    (re.compile("&"), " and "),
    (CLOCK, lambda m: m[1].casefold() + "m"),
    (YEAR_RANGE, lambda m: f"{m[1]}-{full_year(int(m[1]), int(m[2]))}"),
    (re.compile(r"(?<=\d),(?=\d)"), ""),
    (re.compile("[\u2018\u2019\u201c\u201d]"), "'"),
    (re.compile(r"[^\w\s.+-]"), " "),
    (re.compile(r"\b(?:a|an|the)\b"), " "),
    (re.compile(r"\s+"), " "),
)


def full_year(start: int, short: int) -> int:
    """The first year from `start` on that ends in the two digits."""
    return start + (short - start) % 100


def normalize(answer: str) -> str:
    text = unicodedata.normalize("NFKC", answer).casefold()
    for pattern, to in _STEPS:
        text = pattern.sub(to, text)
    return text.strip()


def only_number(text: str) -> float | None:
    found = NUMBER.findall(text)
    return float(found[0].replace(",", "")) if len(found) == 1 else None


def two_parties(answer: str) -> tuple[str, ...] | None:
    parts = VERSUS.split(answer, maxsplit=1)
    if len(parts) < 2 or any(not p.strip() for p in parts):
        return None
    return tuple(OFFICIAL.sub("", normalize(p)).strip() for p in parts)


def equal_answers(predicted: str | None, reference: str | None) -> bool:
    """Equal when normalised; else as single numbers within the tolerances; else as the same two parties in order."""
    if predicted is None or reference is None:
        return False
    a, b = normalize(predicted), normalize(reference)
    if a == b:
        return True
    x, y = only_number(a), only_number(b)
    if x is not None and y is not None:
        return math.isclose(x, y, rel_tol=RELATIVE, abs_tol=ABSOLUTE)
    p, q = two_parties(predicted), two_parties(reference)
    return p is not None and p == q


def exact_answer(response: Column) -> Column:
    """The 'Exact Answer:' line; else a response of one line; else null."""
    line = F.nullif(F.regexp_extract(response, EXACT_ANSWER, 1), F.lit(""))
    whole = F.regexp_replace(response, r"^\s+|\s+$", "")
    return F.coalesce(line, F.when((whole != "") & ~whole.contains("\n"), whole))


def regrade(answers: DataFrame, response: str = "response", reference: str = "reference") -> DataFrame:
    """answers with extracted_answer and correct. The comparison runs once for each distinct pair that isn't plainly equal."""

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([equal_answers(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    found = answers.withColumn("extracted_answer", exact_answer(F.col(response)))
    pairs = found.select("extracted_answer", F.col(reference).alias("wanted")).where("extracted_answer IS NOT NULL AND wanted IS NOT NULL AND extracted_answer <> wanted").distinct()
    judged = pairs.withColumn("same", same("extracted_answer", "wanted")).where("same").select("extracted_answer", F.col("wanted").alias(reference), F.lit(True).alias("same"))
    out = found.join(judged, ["extracted_answer", reference], "left")
    correct = F.coalesce((F.col("extracted_answer") == F.col(reference)) | F.col("same"), F.coalesce("same", F.lit(False)))
    return out.withColumn("correct", correct).drop("same")


def parse_grader(outputs: DataFrame, text: str = "text") -> DataFrame:
    """outputs with correct (missing: false, with parse_error), extracted_answer ('none' is null) and reasoning."""
    verdict = F.lower(F.regexp_extract(text, GRADER_CORRECT, 1))
    extracted = F.nullif(F.regexp_extract(text, GRADER_EXTRACTED, 1), F.lit(""))
    return outputs.select(
        "*", (verdict == "yes").alias("correct"), F.when(verdict == "", "no verdict").alias("parse_error"),
        F.when(F.lower(extracted) != "none", extracted).alias("extracted_answer"), F.regexp_replace(F.regexp_extract(text, GRADER_REASONING, 1), r"^\s+|\s+$", "").alias("reasoning"),
    )


def grader_agreement(graded: DataFrame, deterministic: str = "deterministic") -> DataFrame:
    a, b = F.col("correct"), F.col(deterministic)
    return graded.agg(F.count("*").alias("n"), F.count_if(a == b).alias("agree"), F.count_if(a & ~b).alias("grader_only"), F.count_if(~a & b).alias("deterministic_only"), F.count("parse_error").alias("parse_errors"))


def plain_final(messages: DataFrame, content: str = "content", short: int = 400) -> DataFrame:
    """messages with answer, confidence and citations read from free text.

    Answer: the 'Exact Answer:' line, else the last \\boxed{}, else the 'Answer:' line, else a text of at most `short`
    characters. Confidence: 50 if none is given, clipped to 0 to 100.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    boxed = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^{}]*)\}"), 1), F.lit(-1))
    line = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    answer = F.coalesce(line(EXACT_ANSWER), F.nullif(boxed, F.lit("")), line(ANSWER_LINE), F.when((whole != "") & (F.char_length(whole) <= short), whole))
    said = F.regexp_extract(text, r"(?im)^\s*Confidence\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(said, F.lit(50.0))))
    cited = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"""https?://[^\s<>()\[\]{}"'`]+"""), 0), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))
    return messages.withColumns({"answer": answer, "confidence": confidence, "citations": cited})


def audit_sample(trials: DataFrame, per_stratum: int = 20, low_confidence: float = 50.0, seed: str = "audit") -> DataFrame:
    """Trials to read by hand: per_stratum right and wrong ones by hash, and all parse errors and low-confidence right ones."""
    right = F.coalesce("correct", F.lit(False))
    deal = F.sha2(F.concat_ws("|", F.lit(seed), "run_id", "item_id", F.col("attempt").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("right").orderBy("deal", "run_id", "item_id", "attempt"))
    dealt = trials.select("run_id", "item_id", "attempt", right.alias("right"), deal.alias("deal"), "confidence", F.col("grading.parse_error").alias("parse_error"))
    sampled = dealt.withColumn("place", place).where(F.col("place") <= per_stratum).select("run_id", "item_id", "attempt", F.when(F.col("right"), "positive").otherwise("negative").alias("reason"))
    errors = dealt.where("parse_error IS NOT NULL").select("run_id", "item_id", "attempt", F.lit("parse_error").alias("reason"))
    unsure = dealt.where(F.col("right") & (F.col("confidence") < low_confidence)).select("run_id", "item_id", "attempt", F.lit("low_confidence").alias("reason"))
    return sampled.unionByName(errors).unionByName(unsure)
