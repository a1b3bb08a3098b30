"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrain.llm.base import drop, materialize, recorded


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return _distinct(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    smaller = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _distinct(smaller.unionByName(least.select("a", F.col("least").alias("b"))))


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node of its component) for every node of links (a, b longs); none for other nodes.

    Links may repeat and go either way. Each round is two joins on pre-aggregated minima and is written, so lineage
    stays short, and the round before is dropped; the number of rounds grows with the logarithm of the longest path. Only
    a count and a checksum reach the driver.
    """
    spark = links.sparkSession
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    with recorded() as made:
        edges, last = materialize(_distinct(ordered), "links"), None
        while True:
            n, check = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if n == 0 or (n, check) == last:
                break
            last = (n, check)
            edges = materialize(_small_star(_large_star(edges)), "stars")
            drop(spark, made, edges)
        roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    out = materialize(found, "components")
    drop(spark, made)
    return out
