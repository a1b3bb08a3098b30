"""A training-data pipeline over `documents`: language ID, line dedup, near-duplicate removal, decontamination, encoding."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrain.llm import bpe, decontaminate, language, line_dedup, ngram_join
from evalgrain.llm.base import drop, free_name, materialize, recorded

#: Tables that stages wrote on their way and that are not dropped yet.
_written: list[str] = []


def _stage(function: Callable) -> Callable:
    """A stage drops what earlier stages wrote on their way: their results have been written, so only tables that docs still reads are kept."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _written, in_use=docs)
        with recorded() as made:
            out = function(spark, docs, sf_dir)
        _written.extend(made)
        return out

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can't be told (null, or without a letter) go; `lang` becomes the language that the text is in."""
    model = language.train(docs.where(F.coalesce(language.fold("doc_id") != 1, F.lit(True))))
    out = free_name("language", docs.columns)
    judged = language.predict(docs, model, out=out).where(F.col(out)["lang_pred"] != language.UNDETERMINED)
    return judged.select(*[F.col(out)["lang_pred"].alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go, and with them texts of which nothing is left."""
    aside = {c: free_name(f"own_{c}", docs.columns) for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(aside))
    left = F.coalesce(F.btrim("text", F.lit(line_dedup.BLANK + "\n")), F.lit(""))
    kept = out.where((F.col("n_dropped") == 0) | (left != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


@_stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one with the smallest id stays."""
    return ngram_join.keep_one(ngram_join.join(docs, n=5, num=80, den=100))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    out = free_name("contamination", docs.columns)
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out)
    return judged.where(~F.col(out)["contaminated"]).select(*docs.columns)


@_stage
def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of what is left."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", encode_bpe),
]

#: The line and n-gram stages are iterative; run() is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with recorded() as made:
                docs = materialize(docs, f"pipeline-{name}")
            _written.extend(made)
    return docs
