"""Counter-based draws against the exact law."""

import hashlib
import math

from pyspark.sql import functions as F

from evalgrain.operators import compare, draws


def plain_uniform(*counters):
    return int(hashlib.md5(":".join(map(str, counters)).encode()).hexdigest()[:13], 16) / 2**52


def plain_draw(u, n, p):
    total = 0.0
    for j in range(n + 1):
        total += math.comb(n, j) * p**j * (1 - p) ** (n - j)
        if u <= total:
            return j
    return n


def test_inverse_of_the_exact_law(spark):
    laws = [(1, 30, 0.3), (2, 1, 0.5), (3, 200, 0.97), (4, 17, 0.0), (5, 17, 1.0), (6, 0, 0.4), (7, 90, 1e-9)]
    frame = spark.createDataFrame(laws, "law int, n long, p double")
    points = frame.select("law", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("id")).withColumn("u", draws.uniform(7, "law", "id"))
    got = {(r.law, r.id): r.draw for r in draws.binomial_draws(points, frame).collect()}
    assert got == {(law, i): plain_draw(plain_uniform(7, law, i), n, p) for law, n, p in laws for i in range(300)}


def test_mean_and_spread_of_many_draws(spark):
    frame = spark.createDataFrame([(1, 10**8, 0.25)], "law int, n long, p double")
    points = spark.range(4000).select(F.lit(1).alias("law"), "id", draws.uniform(1, "id").alias("u"))
    told = draws.binomial_draws(points, frame).agg(F.avg("draw").alias("m"), F.stddev("draw").alias("s")).first()
    sd = math.sqrt(10**8 * 0.25 * 0.75)
    assert abs(told.m - 0.25e8) < 4 * sd / math.sqrt(4000) and abs(told.s / sd - 1) < 0.05


def test_paired_bootstrap_at_its_edges(spark):
    def pairs(rows):
        return spark.createDataFrame([(k, 1, x, y, 1.0, 1.0, 1.0, 1.0, True, True) for k, (x, y) in enumerate(rows)], "source_index int, attempt int, correct_left boolean, correct_right boolean, seconds_left double, seconds_right double, cost_left double, cost_right double, in_left boolean, in_right boolean")

    assert tuple(compare.paired_bootstrap(pairs([(True, False)] * 5), 50).first()) == (1.0, 1.0)
    assert tuple(compare.paired_bootstrap(pairs([(True, True)] * 5), 50).first()) == (0.0, 0.0)
    low, high = compare.paired_bootstrap(pairs([(True, False), (False, True), (True, True), (False, False)] * 10), 400).first()
    assert -0.4 < low < 0 < high < 0.4
