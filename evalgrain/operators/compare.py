"""Paired comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrain.functions.stats import exact_sign_pvalue
from evalgrain.operators import draws
from evalgrain.sources.scratch import written

KEY = ("source_index", "attempt")
#: What must be equal in two runs' locks for their results to compare.
LOCK_FIELDS = ("subset_indices_sha256", "dataset.sha256")
CONFIG_SECTIONS = ("search", "browser", "agent", "grader", "report")
RUN_FIELDS = ("attempts", "concurrency", "task_timeout_seconds", "shuffle", "seed")


def pair_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on (source_index, attempt): correctness (null counts as wrong), duration and cost of either side.

    Bucket both tables by the key to compare one run with many without moving it each time.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(
            *KEY, F.lit(True).alias(f"in_{s}"), F.coalesce("correct", F.lit(False)).alias(f"correct_{s}"),
            F.col("metrics.duration_seconds").alias(f"seconds_{s}"), F.col("metrics.total_cost_usd").alias(f"cost_{s}"),
        )

    return side(left, "left").join(side(right, "right"), list(KEY), "full_outer")


def key_overlap(pairs: DataFrame) -> DataFrame:
    both = F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    return pairs.agg(
        F.count_if(both).alias("n_common"),
        F.count_if(F.col("in_right").isNull()).alias("n_left_only"),
        F.count_if(F.col("in_left").isNull()).alias("n_right_only"),
    )


def common(pairs: DataFrame) -> DataFrame:
    return pairs.where("in_left AND in_right")


def contingency(pairs: DataFrame) -> DataFrame:
    """Cells, accuracies, their difference and the exact p-value over common keys. No common key: null accuracies, p 1."""
    a, b = F.col("correct_left"), F.col("correct_right")
    cells = common(pairs).agg(
        F.count_if(a & b).alias("both_correct"), F.count_if(a & ~b).alias("left_only_correct"),
        F.count_if(~a & b).alias("right_only_correct"), F.count_if(~a & ~b).alias("both_wrong"), F.count("*").alias("n"),
    )
    left, right = (F.try_divide(F.col("both_correct") + F.col(f"{s}_only_correct"), F.col("n")) for s in ("left", "right"))
    cells = cells.withColumn("left_accuracy", left).withColumn("right_accuracy", right)
    cells = cells.withColumn("accuracy_difference", F.col("left_accuracy") - F.col("right_accuracy"))
    a, b = F.col("left_only_correct"), F.col("right_only_correct")
    return cells.withColumn("pvalue", exact_sign_pvalue(a, b))


def mean_differences(pairs: DataFrame) -> DataFrame:
    """Mean left minus right of duration and cost over common keys that have both."""
    return common(pairs).agg(F.avg(F.col("seconds_left") - F.col("seconds_right")).alias("mean_seconds_difference"), F.avg(F.col("cost_left") - F.col("cost_right")).alias("mean_cost_difference"))


def paired_bootstrap(pairs: DataFrame, replicates: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """low and high of the resampled accuracy difference, by interpolated percentiles; one multinomial draw a replicate.

    A replicate's pairs right on the left only are one binomial draw, those right on the right only another of what is left of the pairs.
    """
    cells = contingency(pairs).select("n", F.col("left_only_correct").alias("a"), F.col("right_only_correct").alias("b")).where("n > 0")
    grid = cells.select(F.lit(0).alias("law"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("id"))
    left = draws.binomial_draws(grid.withColumn("u", draws.uniform(seed, "id", F.lit("left"))), cells.select(F.lit(0).alias("law"), "n", (F.col("a") / F.col("n")).alias("p")))
    left = written(left.select("id", F.col("draw").alias("x")), "left-draws")
    others = left.select(F.col("x").alias("law")).distinct().join(F.broadcast(cells), F.lit(True))
    laws = others.select("law", (F.col("n") - F.col("law")).alias("n"), F.coalesce(F.try_divide("b", F.col("n") - F.col("a")), F.lit(0.0)).alias("p"))
    right = draws.binomial_draws(left.select(F.col("x").alias("law"), "id", draws.uniform(seed, "id", F.lit("right")).alias("u")), laws)
    drawn = right.join(F.broadcast(cells), F.lit(True)).select(((F.col("law") - F.col("draw")) / F.col("n")).alias("difference"))
    alpha = (1 - confidence) / 2
    at = lambda q: F.coalesce(F.percentile("difference", q), F.lit(0.0))
    return drawn.agg(at(alpha).alias("difference_low"), at(1 - alpha).alias("difference_high"))


def lock_mismatches(locks: DataFrame, left: str, right: str) -> DataFrame:
    """Names of the protocol fields in which two locks (run_id and a map of field to JSON text) differ, nulls being equal."""
    names = [*LOCK_FIELDS, *[f"config.{s}" for s in CONFIG_SECTIONS], *[f"config.run.{f}" for f in RUN_FIELDS]]
    a = locks.where(F.col("run_id") == left).select(F.lit(1).alias("one"), F.col("fields").alias("a"))
    b = locks.where(F.col("run_id") == right).select(F.lit(1).alias("one"), F.col("fields").alias("b"))
    found = F.array_compact(F.array(*[F.when(~F.try_element_at("a", F.lit(n)).eqNullSafe(F.try_element_at("b", F.lit(n))), n) for n in names]))
    return a.join(b, "one").select(found.alias("mismatches"), (F.size(found) == 0).alias("compatible"))
