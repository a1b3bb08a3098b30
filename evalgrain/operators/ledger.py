"""Campaign ledgers over all runs' trials, work lists and retry states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("strict_first_terminal", "latest_terminal", "best_observed_after_repair", "graded_first_completion", "graded_latest_completion")


def graded_completion() -> Column:
    return F.coalesce((F.col("status") == "completed") & F.col("correct").isNotNull(), F.lit(False))


def terminal_identity() -> Column:
    return F.col("subset_rank").isNotNull() & (F.coalesce(F.col("finished_at").cast("string"), F.lit("")) != "")


def ledgers(trials: DataFrame, carry: tuple[str, ...] = ("run_id", "attempt", "status", "correct", "finished_at")) -> DataFrame:
    """subset_rank, policy and the chosen trial's columns, for five policies, in one pass by rank.

    Trials of a rank are in order of (finished_at, run_id, attempt, source, line). The order and the row travel as one
    struct, so each policy is a min or max with partial aggregation, and no rank's trials are gathered.
    """
    have = trials.columns
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in have else F.lit(0)
    order = [text("finished_at").alias("o1"), text("run_id").alias("o2"), number("attempt").alias("o3"), text("source").alias("o4"), number("source_line").alias("o5")]
    row = F.struct(*order, *[F.col(c) for c in carry])
    base = trials.where(terminal_identity()).select("subset_rank", row.alias("row"), graded_completion().alias("graded"), F.coalesce("correct", F.lit(False)).alias("right"))
    graded, right = F.when(F.col("graded"), F.col("row")), F.when(F.col("right"), F.col("row"))
    found = base.groupBy("subset_rank").agg(
        F.min("row").alias("strict_first_terminal"), F.max("row").alias("latest_terminal"),
        F.coalesce(F.max(right), F.max("row")).alias("best_observed_after_repair"),
        F.min(graded).alias("graded_first_completion"), F.max(graded).alias("graded_latest_completion"),
    )
    one = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("row")) for p in POLICIES]))
    listed = found.select("subset_rank", one.alias("x")).where("x.row IS NOT NULL")
    return listed.select("subset_rank", "x.policy", *[F.col(f"x.row.{c}").alias(c) for c in carry])


def ledger_summary(ledger: DataFrame, total_questions: int, listed: bool = True) -> DataFrame:
    """Counts by policy. With `listed` also the ranks, a list as long as the question set; rank_ranges() gives them as rows."""
    n, right = F.count("*"), F.count_if("correct")
    ranks = [F.array_join(F.sort_array(F.collect_list("subset_rank")), ",").alias("subset_ranks")] if listed else []
    return ledger.groupBy("policy").agg(
        n.alias("attempted"), right.alias("correct"), (n - right).alias("incorrect"), (right / n).alias("accuracy_among_attempted"),
        F.greatest(F.lit(total_questions) - n, F.lit(0)).alias("questions_without_terminal_record"),
        F.try_divide(right, F.lit(total_questions)).alias("full_set_correct_coverage"), *ranks,
    )


def rank_ranges(ledger: DataFrame, block: int = 4096) -> DataFrame:
    """(policy, low, high): the ranks of each policy as ranges without gaps.

    Ranges are found within blocks of ranks; only those that touch a block's border, two a block at most, meet in one
    task a policy to be put together.
    """
    rows = ledger.select("policy", F.col("subset_rank").cast("long").alias("rank")).where("rank IS NOT NULL").distinct()
    rows = rows.withColumn("start", F.col("rank") - F.pmod("rank", F.lit(block)))
    island = F.col("rank") - F.row_number().over(Window.partitionBy("policy", "start").orderBy("rank"))
    found = rows.withColumn("island", island).groupBy("policy", "start", "island").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    border = (F.col("low") == F.col("start")) | (F.col("high") == F.col("start") + block - 1)
    in_order = Window.partitionBy("policy").orderBy("low")
    begins = F.when(F.lag("high").over(in_order) == F.col("low") - 1, 0).otherwise(1)
    touching = found.where(border).withColumn("begins", begins).withColumn("chain", F.sum("begins").over(in_order))
    whole = touching.groupBy("policy", "chain").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return found.where(~border).select("policy", "low", "high").unionByName(whole.drop("chain"))


def version_counts(trials: DataFrame) -> DataFrame:
    t = terminal_identity()
    return trials.agg(
        F.count_if(t).alias("terminal_record_versions"), F.count_if(t & graded_completion()).alias("graded_record_versions"),
        F.count_if(~graded_completion()).alias("unscored_record_versions"), F.count_if(~t).alias("quarantined_record_versions"),
    )


def work_list(items: DataFrame, done: DataFrame, attempts: int) -> DataFrame:
    """Every item and attempt without a finished trial: an anti join on (item_id, attempt)."""
    wanted = items.select("item_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(attempts).cast("long"))).alias("attempt"))
    return wanted.join(done.select("item_id", "attempt"), ["item_id", "attempt"], "left_anti")


def seeded_order(work: DataFrame, seed: int, key: tuple[str, ...] = ("item_id", "attempt")) -> DataFrame:
    """A place for each row, a pure function of (seed, key): ranks of hashes instead of a shuffle in memory."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *key), 256)
    by_prefix = Window.partitionBy("prefix").orderBy("digest", *key)
    placed = work.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, 2))
    counts = placed.groupBy("prefix").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.withColumn("in_prefix", F.row_number().over(by_prefix)).join(F.broadcast(before), "prefix").select(*work.columns, (F.col("before") + F.col("in_prefix")).alias("place"))


def retry_states(trials: DataFrame, max_attempts: int) -> DataFrame:
    """Per item: next attempt, state, and the distinct answers tried in order of attempt."""
    right = F.coalesce(F.bool_or("correct"), F.lit(False))
    # An answer counts once, at its first attempt, before any list is made: a list is as long as what it gives.
    once = trials.groupBy("run_id", "item_id", "extracted_answer").agg(F.max("attempt").alias("last"), right.alias("solved"), F.min(F.struct("attempt", "extracted_answer")).alias("first"))
    tried = F.array_sort(F.collect_list(F.when(F.col("extracted_answer").isNotNull(), F.col("first"))))
    state = F.when(F.col("solved"), "completed").when(F.col("last") < max_attempts, "retry_pending").otherwise("failed")
    per = once.groupBy("run_id", "item_id").agg(F.max("last").alias("last"), F.bool_or("solved").alias("solved"), F.transform(tried, lambda x: x["extracted_answer"]).alias("tried"))
    return per.select("run_id", "item_id", (F.col("last") + 1).alias("next_attempt"), state.alias("state"), F.array_join("tried", "|").alias("tried"))
