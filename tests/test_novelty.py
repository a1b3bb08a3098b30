"""Near repeats of queries against the greedy loop, and how a long conversation is spread."""

import random

from pyspark.sql import functions as F

from evalgrain.operators import trajectory


def plain(rows):
    """(group, pos) of redundant queries, one after another."""
    out, accepted, seen = set(), {}, {}
    for g, pos, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s = frozenset((text or "").split())
        near = any(len(s | a) >= 5 and len(s & a) >= 0.9 * len(s | a) for a in accepted.get(g, ()))
        if not s or s in seen.get(g, ()) or near:
            out.add((g, pos))
        else:
            accepted.setdefault(g, []).append(s)
        seen.setdefault(g, set()).add(s)
    return out


def marked(df):
    return {(r.conv_id, r.pos) for r in df.collect() if r.redundant}


def test_equals_the_loop(spark):
    rng, rows = random.Random(8), []
    for g in (*range(6), None):
        base = [[f"t{rng.randrange(60)}" for _ in range(rng.choice([3, 9, 12, 20, 40]))] for _ in range(4)]
        for pos in range(60):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(["the", "of", f"u{rng.randrange(9)}"])
            rows.append((g, pos, " ".join(words) if rng.random() > 0.05 else rng.choice(["", None])))
    frame = spark.createDataFrame(rows, "conv_id int, pos int, query string").repartition(5)
    assert marked(trajectory.novelty(frame)) == plain(rows) and len(rows) == trajectory.novelty(frame).count()
    assert trajectory.novelty(frame.limit(0)).count() == 0


def test_chains_and_one_long_conversation(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, k, " ".join(words[k : k + 20])) for k in range(300)]  # each is near the one before and after
    frame = spark.createDataFrame(rows[:24], "conv_id int, pos int, query string")
    assert marked(trajectory.novelty(frame)) == plain(rows[:24])
    sets = spark.createDataFrame([(1, k, k, ["common", *words[k : k + 19]]) for k in range(300)], "conv_id int, node long, place long, terms array<string>").repartition(8)
    near = trajectory.near_sets(sets, "conv_id", 0.9, 5)
    assert {tuple(r) for r in near.collect()} == {(k, k + 1) for k in range(299)}
    plan = near._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "key" in plan
    spread = sets.select(F.col("conv_id"), F.explode("terms").alias("key")).repartition(8, "conv_id", "key")
    assert spread.select(F.spark_partition_id()).distinct().count() > 4  # one conversation's keys lie in several tasks
