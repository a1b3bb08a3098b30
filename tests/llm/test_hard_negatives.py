"""Hard negatives against every pair, and bounds against exact products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrain.llm import hard_negatives, queries, sql


def plain(rows, anchors, k=5, n=10, low=30, high=90):
    ok = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and None not in v]
    first = {}
    for i, label, v in sorted((i, label, v) for i, label, v in ok if i in anchors):
        first.setdefault(i, (label, v))
    out = []
    for a, (label, v) in first.items():
        score = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in ok if i != a and len(w) == len(v)]
        best = sorted((s, i) for s, i, other in score if other == label)[:k]
        for s, p in best:
            fit = sorted((t, i) for t, i, other in score if other != label and low * -s <= 100 * -t <= high * -s)[:n]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


SCHEMA = "vec_id long, label int, vec array<long>, dim string, n string, bucket string, deal string, chunk string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "n", "b", "e", "c") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("chunk_rows, anchor_block", [(4096, 16384), (7, 3)])
def test_against_every_pair(spark, chunk_rows, anchor_block):
    rng = np.random.default_rng(3)
    centers = rng.integers(-40, 40, (4, 20))
    rows = [(i, int(rng.integers(0, 4)), (centers[rng.integers(0, 4)] + rng.integers(-25, 25, 20)).tolist()) for i in range(160)]
    rows += [(200 + i, 1, rows[3][2]) for i in range(20)] + [(300, None, rows[0][2]), (None, 1, rows[0][2]), (301, 2, None), (302, 2, [1, None, 2])]
    rows += [(400, 9, [0] * 20), (401, 9, [0] * 20), (402, 3, [1, 2, 3]), (403, 3, [1, 2, 2]), (404, 4, [1, 1, 1]), (405, 4, []), (5, 2, rows[9][2]), (8, 1, rows[8][2])]
    anchors = {i for i in range(0, 500, 5)}
    whole = frame(spark, rows)
    out = hard_negatives.mine(whole, whole.where("vec_id % 5 = 0"), chunk_rows=chunk_rows, anchor_block=anchor_block)
    assert found(out) == plain(rows, anchors)
    assert hard_negatives.mine(whole.limit(0), whole.limit(0)).count() == 0
    assert hard_negatives.mine(whole, whole.limit(0)).columns == out.columns


def test_bounds_hold_and_tighten_and_prune():
    rng = np.random.default_rng(4)
    drift = np.repeat(rng.normal(0, 60, (400, 4)), 16, axis=1) + np.repeat(rng.normal(0, 10, (400, 16)), 4, axis=1)
    vectors = np.floor(drift + rng.normal(0, 8, (400, 64))).astype(np.int64)
    exact = vectors @ vectors[:10].T
    own, of = hard_negatives.summaries(vectors), hard_negatives.summaries(vectors[:10])
    widths = []
    for (mean, deviation), (of_mean, of_deviation) in zip(own, of, strict=True):
        middle, width = mean @ of_mean.T, deviation @ of_deviation.T
        assert (np.abs(exact - middle) <= width * (1 + 1e-9) + 1e-6).all()
        widths.append(width.mean())
    assert widths[0] > widths[1] > widths[2]
    floor, looked = np.sort(exact, axis=0)[-5], []
    pairs = hard_negatives.pairs_in_reach(own, of, lambda least, most, c: most >= floor[c], looked.append)
    assert set(zip(*np.nonzero(exact >= floor), strict=True)) <= set(zip(*pairs, strict=True)) and len(pairs[0]) < exact.size / 20
    assert looked[0] == exact.size >= looked[1] > looked[2]


def test_query_against_sql(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    gone = F.when(F.col("vec_id") % 17 == 0, None).otherwise(F.col("embedding"))
    nan = F.when(F.col("vec_id") % 19 == 0, F.transform("embedding", lambda x: x * float("nan"))).otherwise(gone)
    rows.withColumn("embedding", nan).withColumn("label", F.when(F.col("vec_id") % 23 != 0, F.col("label"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = found(queries.op11_hard_negatives(spark, str(tmp_path)))
    duckdb.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert out and out == sorted(duckdb.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({sql.OP11})").fetchall())
