"""Summaries of runs: accuracy, rates, costs, durations, calibration, pass@k and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.functions.stats import wilson_bounds
from evalgrain.operators import draws

CALLS = ("search_calls", "page_opens", "find_calls", "steps", "retrieved_chars")


def metric(name: str) -> Column:
    """A field of the metrics struct; missing counts as 0 and stays in every denominator."""
    return F.coalesce(F.col(f"metrics.{name}").cast("double"), F.lit(0.0))


def accuracy_columns() -> list[Column]:
    """Counts and accuracy with every attempt in the denominator."""
    correct = F.count_if("correct")
    return [
        F.count("*").alias("n_records"),
        F.count("correct").alias("n_graded"),
        (F.count("*") - F.count("correct")).alias("n_ungraded"),
        F.count_distinct("item_id").alias("n_items"),
        correct.alias("n_correct"),
        (correct / F.count("*")).alias("accuracy"),
    ]


def error_columns() -> list[Column]:
    known = F.col("status").isin("completed", "empty_answer")
    return [
        F.count_if(~F.coalesce(known, F.lit(False))).alias("n_errors"),
        F.count_if(F.coalesce(F.col("grading.parse_error"), F.lit("")) != "").alias("grader_parse_errors"),
    ]


def rate_columns() -> list[Column]:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    no_search = metric("search_calls") == 0
    return [
        share(F.coalesce(F.col("extracted_answer"), F.lit("")) != "").alias("answer_rate"),
        share(F.coalesce(F.size("citations"), F.lit(0)) > 0).alias("citation_rate"),
        share(no_search).alias("zero_search_rate"),
        F.count_if(no_search & F.coalesce("correct", F.lit(False))).alias("correct_zero_search_count"),
    ]


def cost_columns() -> list[Column]:
    total = F.sum(metric("total_cost_usd"))
    return [
        *[F.sum(metric(f"{k}_tokens")).cast("long").alias(f"{k}_tokens") for k in ("input", "output", "cached")],
        total.alias("cost_usd"),
        F.sum(metric("model_cost_usd")).alias("model_cost_usd"),
        F.sum(metric("grader_cost_usd")).alias("grader_cost_usd"),
        F.try_divide(total, F.count_if("correct")).alias("cost_per_correct_usd"),
    ]


def duration_columns() -> list[Column]:
    seconds = metric("duration_seconds")
    return [
        F.sum(seconds).alias("duration_total"),
        F.avg(seconds).alias("duration_mean"),
    ]


def with_duration_quantiles(summary: DataFrame, trials: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """summary with the exact median, p90 and p95 of the duration."""
    own = trials.select(*by, metric("duration_seconds").alias("seconds"))
    return summary.join(exact_quantiles(own, "seconds", {"duration_median": 0.5, "duration_p90": 0.9, "duration_p95": 0.95}, by), list(by), "left")


def exact_quantiles(rows: DataFrame, value: str, quantiles: dict[str, float], by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """by, and exact quantiles of a column by name, with linear interpolation; nulls don't count.

    Two passes: percentile_approx(), whose error in ranks is bounded, gives values below and above each quantile; then only the
    distinct values between these are ranked, by their counts. No task holds the values of a run, however many there are.
    """
    accuracy, by = 10_000, list(by)
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    near = [F.struct(F.lit(k).alias("name"), F.lit(q).alias("q"), F.percentile_approx("v", max(0.0, q - 2 / accuracy), accuracy).alias("low"), F.percentile_approx("v", min(1.0, q + 2 / accuracy), accuracy).alias("high")) for k, q in quantiles.items()]
    brackets = known.groupBy(*by).agg(F.count("*").alias("n"), F.array(*near).alias("near")).select(*by, "n", F.inline("near"))
    part = known.join(brackets, by).where("v <= high").groupBy(*by, "name", "q", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*by, "name").orderBy(F.asc_nulls_first("v")))
    ranked = part.withColumn("upto", upto).where("v IS NOT NULL")
    place = (F.col("n") - 1) * F.col("q")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    found = ranked.groupBy(*by, "name").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.any_value(place - F.floor(place)).alias("share"))
    each = found.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("share"))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in quantiles])


def call_columns() -> list[Column]:
    return [f(metric(c)).alias(f"{c}_{n}") for c in CALLS for n, f in (("total", F.sum), ("mean", F.avg))]


def summarize(trials: DataFrame, columns: list[Column], by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One pass over the trials: any of the column lists of this module, by run."""
    return trials.groupBy(*by).agg(*columns)


def with_wilson(summary: DataFrame, confidence: float = 0.95) -> DataFrame:
    low, high = wilson_bounds(F.col("n_correct"), F.col("n_records"), confidence)
    return summary.withColumn("wilson_low", low).withColumn("wilson_high", high)


def status_histogram(trials: DataFrame) -> DataFrame:
    return trials.groupBy("run_id", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def calibration(trials: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error of graded trials with a confidence (0 to 100).

    Bin b holds [b/bins, (b+1)/bins), the last bin 1 as well; confidences outside [0, 1] count in n but in no bin.
    Runs without such trials have n 0 and null scores. Two aggregations; the second has a few rows a run.
    """
    p = F.col("confidence").cast("double") / 100
    hit = F.when(F.col("correct"), 1.0).otherwise(0.0)
    scored = trials.select("run_id", F.when(F.col("confidence").isNotNull() & F.col("correct").isNotNull(), p).alias("p"), hit.alias("hit"))
    edges = [F.when((F.col("p") >= b / bins) & (F.col("p") < (b + 1) / bins), b) for b in range(bins)]
    bin_of = F.coalesce(*edges, F.when(F.col("p") == 1.0, bins - 1), F.lit(-1))
    binned = scored.groupBy("run_id", F.when(F.col("p").isNotNull(), bin_of).alias("bin")).agg(
        F.count("p").alias("n"), F.avg("p").alias("p"), F.avg("hit").alias("hit"), F.sum((F.col("p") - F.col("hit")) ** 2).alias("squares")
    )
    gap = F.sum(F.when(F.col("bin") >= 0, F.col("n") * F.abs(F.col("p") - F.col("hit"))))
    n = F.sum("n")
    return binned.groupBy("run_id").agg(n.alias("n"), F.try_divide(F.sum("squares"), n).alias("brier"), F.try_divide(F.coalesce(gap, F.lit(0.0)), n).alias("ece"))


def pass_at_k(trials: DataFrame) -> DataFrame:
    """run_id, k, pass_at_k for k from 1 to the run's largest attempt: share of items correct within k attempts.

    Items shrink to their first correct attempt; a running sum over the counts by attempt gives every k.
    """
    items = trials.groupBy("run_id", "item_id").agg(F.min(F.when(F.col("correct"), F.col("attempt"))).alias("first"))
    firsts = items.groupBy("run_id", "first").agg(F.count("*").alias("n"))
    per_run = trials.groupBy("run_id").agg(F.max("attempt").alias("last"), F.count_distinct("item_id").alias("items"))
    grid = per_run.where("last >= 1").select("run_id", "items", F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))).alias("k"))
    solved = grid.join(firsts.withColumnRenamed("first", "k"), ["run_id", "k"], "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("run_id").orderBy("k"))
    early = firsts.where("first < 1").groupBy("run_id").agg(F.sum("n").alias("early"))
    return solved.withColumn("within", running).join(early, "run_id", "left").select("run_id", F.col("k").cast("long").alias("k"), ((F.col("within") + F.coalesce("early", F.lit(0))) / F.col("items")).alias("pass_at_k"))


def bootstrap_accuracy(trials: DataFrame, replicates: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """run_id, bootstrap_low, bootstrap_high: order statistics of the resampled accuracy at fixed positions.

    A resampled accuracy depends on the run's counts only, so each replicate is one binomial draw (a function of seed and replicate):
    the cost grows with the root of the number of trials, and the draw doesn't depend on partitioning.
    """
    counts = trials.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    laws = counts.select(F.col("run_id").alias("law"), "n", (F.col("k") / F.col("n")).alias("p"))
    grid = counts.select(F.col("run_id").alias("law"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("id"))
    drawn = draws.binomial_draws(grid.withColumn("u", draws.uniform(seed, "id")), laws).join(laws, "law")
    drawn = drawn.select(F.col("law").alias("run_id"), F.col("id").alias("replicate"), (F.col("draw") / F.col("n")).alias("estimate"))
    alpha = (1 - confidence) / 2
    low, high = max(0, int(alpha * replicates)), min(replicates - 1, int((1 - alpha) * replicates) - 1)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("estimate", "replicate")) - 1
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("estimate")))
    return drawn.withColumn("place", place).groupBy("run_id").agg(at(low).alias("bootstrap_low"), at(high).alias("bootstrap_high"))
