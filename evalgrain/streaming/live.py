"""Live views of runs on Structured Streaming. Events later than the watermark are dropped and counted by Spark's metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalgrain.sources.scratch import scratch_path

#: Columns too bulky for a status view, and run states that end a run.
BULKY = ("body", "transcript", "messages", "result", "assistant_content", "assistant_reasoning")
TERMINAL = ("completed", "completed_with_errors", "interrupted", "failed")


def ingest(events: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The event stream with its watermark and without bulky columns."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).drop(*BULKY)


def once(trials: DataFrame, key: tuple[str, ...] = ("item_id", "attempt")) -> DataFrame:
    """Each trial once by its key, as long as repeats come within the watermark."""
    return trials.dropDuplicatesWithinWatermark(list(key))


def append_new(batch: DataFrame, ledger: DataFrame, key: tuple[str, ...] = ("item_id", "attempt")) -> DataFrame:
    """Rows of a micro-batch that a ledger doesn't have: for foreachBatch, beyond the watermark's memory."""
    return batch.dropDuplicates(list(key)).join(ledger.select(*key), list(key), "left_anti")


def counters(trials: DataFrame) -> DataFrame:
    """Counters by run over what has come so far (update mode)."""
    bad = ~F.col("status").isin("completed", "empty_answer")
    return trials.groupBy("run_id").agg(
        F.count("*").alias("finished"), F.count_if("correct").alias("correct"), F.count_if(F.col("correct") == False).alias("graded_incorrect"),  # noqa: E712
        F.count_if(~F.coalesce("correct", F.lit(False))).alias("strict_incorrect"), F.count_if(bad).alias("failed"),
    )


def with_assigned(counts: DataFrame, assigned: DataFrame) -> DataFrame:
    """counters() joined with the static number of trials assigned to each run: pending and the three accuracies."""
    out = counts.join(assigned, "run_id")
    right = F.col("correct")
    return out.select(
        "*", (F.col("assigned") - F.col("finished")).alias("pending"), F.try_divide(right, F.col("finished")).alias("accuracy_finished"),
        F.try_divide(right, right + F.col("graded_incorrect")).alias("accuracy_graded"), F.try_divide(right, F.col("assigned")).alias("accuracy_assigned"),
    )


def rate(finished: Column, remaining: Column, seconds: Column) -> tuple[Column, Column]:
    """Trials per hour, and hours that the rest will take; null before anything is finished."""
    per_hour = F.try_divide(finished * 3600.0, seconds)
    return per_hour, F.try_divide(remaining.cast("double"), per_hour)


def run_state(finished: Column, assigned: Column, failed: Column, interrupted: Column) -> Column:
    return F.when(interrupted, "interrupted").when(finished < assigned, "running").when(failed > 0, "completed_with_errors").otherwise("completed")


def active(events: DataFrame, end: str = "purchase") -> DataFrame:
    """The latest action of each trial, updated as events come, and whether the trial is still open.

    events: user_id (the trial), event_id (order), action. The state is the greatest event of each trial, an ended one's too,
    so a late event with a smaller number neither changes nor revives it. Built-in aggregation, no Python.
    """
    last = F.max(F.struct("event_id", "action"))
    return events.groupBy("user_id").agg(last.alias("last")).select("user_id", "last.event_id", "last.action", (F.col("last.action") != end).alias("active"))


_ALERT = "run_id string, last_seen timestamp, state string, alert string"


def stale_alerts(status: DataFrame, stale_seconds: int, confirmations: int = 1, check_seconds: int = 60) -> DataFrame:
    """An alert when a run that hasn't ended is silent for stale_seconds of event time and still is at each of the next
    confirmations - 1 checks, check_seconds apart; ending or new activity clears it.

    status: run_id, ts (with watermark), state. Checks are event-time timeouts, so replays give the same alerts. State: when
    a run was last seen, its state, and the checks passed in silence.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, name, checks = state.get if state.exists else (0, "", 0)
        if state.hasTimedOut:
            if checks + 1 < confirmations:
                state.update((seen, name, checks + 1))
                state.setTimeoutTimestamp(max(seen + 1000 * (stale_seconds + (checks + 1) * check_seconds), state.getCurrentWatermarkMs() + 1))
                return
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "last_seen": [pd.Timestamp(seen, unit="ms")], "state": [name], "alert": ["stale"]})
            return
        for batch in batches:
            newest = batch.loc[batch["ts"].idxmax()]
            at = int(newest["ts"].timestamp() * 1000)
            if at >= seen:
                seen, name = at, str(newest["state"])
        if name in TERMINAL:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "last_seen": [pd.Timestamp(seen, unit="ms")], "state": [name], "alert": ["cleared"]})
            return
        state.update((seen, name, 0))
        state.setTimeoutTimestamp(max(seen + 1000 * stale_seconds, state.getCurrentWatermarkMs() + 1))

    return status.groupBy("run_id").applyInPandasWithState(step, _ALERT, "seen long, name string, checks int", "append", GroupStateTimeout.EventTimeTimeout)


def stale_now(status: DataFrame, stale_seconds: int, now: Column) -> DataFrame:
    """The batch form: runs that haven't ended and whose last activity is older than stale_seconds."""
    last = status.groupBy("run_id").agg(F.max("ts").alias("last_seen"), F.max_by("state", "ts").alias("state"))
    return last.where(~F.col("state").isin(*TERMINAL)).where(F.unix_timestamp(now) - F.unix_timestamp("last_seen") > stale_seconds)


def unify_status(rows: DataFrame) -> DataFrame:
    """Two shapes of status files to one: run_id, done, failed, remaining, state, ts."""
    done = F.coalesce("completed", "finished_items", F.size("done"))
    remaining = F.coalesce("remaining", F.col("target_total_questions") - F.coalesce("current_records", done))
    state = F.coalesce("state", F.when(remaining <= 0, "completed").otherwise("running"))
    return rows.select("run_id", done.alias("done"), F.coalesce("failed", F.lit(0)).alias("failed"), remaining.alias("remaining"), state.alias("state"), F.col("updated_at").alias("ts"))


def run_to_end(stream: DataFrame, mode: str, schema_of: Callable[[DataFrame], DataFrame] | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over what is there and return every row it emitted, with the number of its micro-batch as `epoch`.

    Each micro-batch is written to its own folder, so a repeated batch replaces itself: exactly once. With the folder `out` of an earlier
    run the stream goes on from that run's state and source position.
    """
    spark: SparkSession = stream.sparkSession
    out = out or scratch_path(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = schema_of(batch) if schema_of else batch
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = (schema_of(spark.createDataFrame([], stream.schema)) if schema_of else stream).schema
    return spark.read.schema(schema.add("epoch", T.IntegerType())).option("basePath", out).parquet(f"{out}/epoch=*")


def latest(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The last emitted row of each key of an update stream."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "epoch").alias("x"))
    return last.select(key, *[F.col(f"x.{c}").alias(c) for c in columns])
