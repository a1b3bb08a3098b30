"""Repeats across micro-batches and restarts."""

from pyspark.sql import functions as F

from evalgrain.sources.scratch import scratch_path
from evalgrain.streaming import live


def test_repeats_in_later_batches_and_after_a_restart_are_dropped(spark):
    root, out = scratch_path(spark, "repeats"), scratch_path(spark, "emitted")
    hour = "2024-01-01 {:02d}:{:02d}:00"
    batches = [
        [("a", 1, hour.format(1, 0)), ("b", 1, hour.format(1, 10)), ("a", 1, hour.format(1, 0))],
        [("a", 1, hour.format(1, 20)), ("a", 2, hour.format(1, 30))],
        [("b", 1, hour.format(1, 40)), ("c", 1, hour.format(1, 50))],  # after the restart
        [("d", 1, hour.format(9, 0))],
        [("c", 1, hour.format(1, 55)), ("e", 1, hour.format(9, 30))],  # far behind the watermark
    ]

    def put(k):
        rows = spark.createDataFrame(batches[k], "item_id string, attempt int, ts string")
        rows.coalesce(1).write.parquet(f"{root}/part={k}")

    def emitted():
        events = live.ingest(spark.readStream.schema("item_id string, attempt int, ts string").option("maxFilesPerTrigger", 1).parquet(f"{root}/part=*"))
        return live.run_to_end(live.once(events), "append", out=out)

    put(0)
    put(1)
    assert sorted((r.item_id, r.attempt) for r in emitted().collect()) == [("a", 1), ("a", 2), ("b", 1)]
    for k in (2, 3, 4):
        put(k)
    rows = emitted()
    assert sorted((r.item_id, r.attempt) for r in rows.collect()) == [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 1)]
    assert rows.select(F.max("epoch")).first()[0] >= 4
