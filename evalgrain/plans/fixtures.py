"""The driver's tables as the tables of the library, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trials: two runs, a user is an item, the events of a user in order are its attempts."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind, value = F.col("event_type"), F.col("value")
    attempt = F.row_number().over(Window.partitionBy("run_id", "user_id").orderBy("ts", "event_id"))
    e = e.withColumn("k", k).withColumn("run_id", F.when(F.col("event_id") % 2 == 0, "run_a").otherwise("run_b"))
    urls = F.when(F.col("k") % 3 > 0, F.transform(F.sequence(F.lit(1), (F.col("k") % 3).cast("int")), lambda i: F.concat(F.lit("https://d/"), i))).otherwise(F.array().cast("array<string>"))
    k = F.col("k")
    metrics = F.struct(
        (k % 10 + 1).alias("steps"), (k % 6).alias("search_calls"), (k % 4).alias("page_opens"), (k % 3).alias("find_calls"), (k * 7).alias("retrieved_chars"),
        value.alias("duration_seconds"), (k * 100).alias("input_tokens"), (k * 10).alias("output_tokens"), k.alias("cached_tokens"),
        (k / 1000).alias("model_cost_usd"), (k / 5000).alias("grader_cost_usd"), (k / 1000 + k / 5000).alias("total_cost_usd"),
    )
    status = F.when(kind == "error", F.when(value < 50, "timeout").otherwise("error")).when(kind == "signup", "empty_answer").otherwise("completed")
    correct = F.when(kind == "purchase", True).when(kind == "error", F.lit(None)).otherwise(False)
    return e.select(
        "run_id", F.concat(F.lit("item-"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("item_id"), F.col("user_id").alias("subset_rank"),
        F.col("user_id").alias("source_index"), attempt.cast("long").alias("attempt"), F.lit("model-x").alias("model"), status.alias("status"),
        F.col("ts").alias("finished_at"), F.when(kind.isin("purchase", "click", "view"), kind).alias("extracted_answer"),
        F.when(kind != "error", F.least(F.round(value), F.lit(100.0))).alias("confidence"), urls.alias("citations"), correct.cast("boolean").alias("correct"),
        F.struct(F.when(kind == "error", "no verdict").alias("parse_error")).alias("grading"), metrics.alias("metrics"), "event_id",
    )


#: The same in SQL.
TRIALS = """
trials_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE WHEN event_id % 2 = 0 THEN 'run_a' ELSE 'run_b' END AS run_id FROM events),
trials AS (
  SELECT run_id, 'item-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS item_id, user_id AS subset_rank, user_id AS source_index,
         row_number() OVER (PARTITION BY run_id, user_id ORDER BY ts, event_id) AS attempt,
         CASE WHEN event_type = 'error' THEN CASE WHEN value < 50 THEN 'timeout' ELSE 'error' END
              WHEN event_type = 'signup' THEN 'empty_answer' ELSE 'completed' END AS status,
         ts AS finished_at, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN event_type END AS extracted_answer,
         CASE WHEN event_type <> 'error' THEN least(round(value), 100.0) END AS confidence, k % 3 AS n_citations,
         CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'error' THEN NULL ELSE false END AS correct,
         event_type = 'error' AS parse_error, k % 10 + 1 AS steps, k % 6 AS search_calls, k % 4 AS page_opens, k % 3 AS find_calls,
         k * 7 AS retrieved_chars, value AS duration_seconds, k * 100 AS input_tokens, k * 10 AS output_tokens, k AS cached_tokens,
         k / 1000.0::DOUBLE AS model_cost, k / 5000.0::DOUBLE AS grader_cost, k / 1000.0::DOUBLE + k / 5000.0::DOUBLE AS total_cost, event_id
  FROM trials_k)"""


def with_trials(sql: str) -> str:
    return f"WITH {TRIALS}\n{sql}" if not sql.lstrip().startswith(",") else f"WITH {TRIALS}{sql}"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Floating-point results to a fixed number of digits, as sums depend on their order."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def r6(c: Column) -> Column:
    return F.round(c, 6)
