"""Queries opN_<name> over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrain.llm import bpe, conversations, decontaminate, hard_negatives, language, line_dedup, lm_scoring, ngram_join, secret_scan, sharding, sql, token_files, topk, url_filter
from evalgrain.llm.base import utf8_crc32

#: The rules of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    out = sharding.shard(docs, F.col("doc_id"), size, shards=16)
    # Size and digest are those of the text that arrived in the shard.
    return out.select("doc_id", size.alias("size"), utf8_crc32(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), out="found")
    return out.select("doc_id", "found.n_words", "found.n_hit", "found.n_items", "found.items_sha256", "found.contaminated")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where(topk.usable("embedding"))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vec"))
    return topk.top_k(whole, whole.where("vec_id % 50 = 0"), k=5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(language.fold("doc_id") == 1, F.lit(False))
    model = language.train(docs.where(~held_out))
    out = language.predict(docs, model, out="found")
    return out.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.filter_urls(pages, URL_RULES, out="found")
    return out.select("page_id", "found.host", "found.path", "found.rule", "found.verdict")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        files = token_files.write_token_files(docs, f.read(), end_id=2, vocabulary=50_257)
    return token_files.read_documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan.scan(docs, secret_scan.fit(docs), out="found")
    return out.select("doc_id", "found.n_assign", "found.n_access", "found.n_hex", "found.base_sha256", "found.spans")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, max_edits=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.components(ngram_join.join(docs, n=3, num=90, den=100))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & topk.usable("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vec"))
    return hard_negatives.mine(whole, whole.where("vec_id % 100 = 0"), positives=5, negatives=10, low_percent=30, high_percent=90)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    done = conversations.repair(conversations.damage(rows))
    whole = rows.select(F.col("conv_id").alias("conv")).distinct().unionByName(done.report, allowMissingColumns=True).unionByName(conversations.digests(done.messages()), allowMissingColumns=True)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = whole.groupBy(F.col("conv").alias("conv_id")).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.max("sha256").alias("sha256"))
    return out.select("conv_id", *counts, "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
    learned_from = docs.where(~held_out)
    counts = lm_scoring.count_words(learned_from)
    out = lm_scoring.score(docs, lm_scoring.train(learned_from, counts), counts, out="lm")
    return out.select("doc_id", held_out.alias("held_out"), "lm.n_tokens", "lm.n_known", "lm.train_tokens", "lm.base_score", "lm.score")


OPERATORS = (
    op1_histogram_sort_shards,
    op2_byte_bpe,
    op3_benchmark_decontamination,
    op4_token_files,
    op5_secret_scan,
    op6_exact_topk,
    op7_line_dedup,
    op8_ngram_jaccard,
    op9_language_id,
    op10_url_filter,
    op11_hard_negatives,
    op12_conversation_repair,
    op13_lm_scoring,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": sql.OP3, "op6_exact_topk": sql.OP6, "op8_ngram_jaccard": sql.OP8, "op11_hard_negatives": sql.OP11}
