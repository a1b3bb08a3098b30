"""Random draws that are functions of a counter: the same rows give the same draws, whatever the partitions and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Standard deviations (and as many whole numbers more) about a mean beyond which a binomial law has nothing left in double precision.
_REACH = 9


def uniform(seed: int, *counters: Column | str) -> Column:
    """A number from 0 to 1 (excluded) from the md5 of the seed and the counters as text, joined by colons: its first 52 bits."""
    said = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in counters])
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / float(1 << 52)


def binomial_table(laws: DataFrame) -> DataFrame:
    """law, j, cdf of binomial laws (law, n, p): some dozen times the standard deviation rows for each, by the ratios of one probability to the next."""
    sd, mean = F.sqrt(F.col("n") * F.col("p") * (1 - F.col("p"))), F.col("n") * F.col("p")
    low = F.when(F.col("p") >= 1, F.col("n")).otherwise(F.greatest(F.lit(0), F.floor(mean - _REACH * sd - _REACH))).cast("long")
    high = F.when(F.col("p") <= 0, F.lit(0)).otherwise(F.least(F.col("n"), F.ceil(mean + _REACH * sd + _REACH))).cast("long")
    rows = laws.select("law", "n", "p", low.alias("low"), high.alias("high"))
    rows = rows.select("*", F.explode(F.sequence(F.least("low", "high"), "high")).alias("j"))
    ratio = F.when(F.col("j") > F.col("low"), F.log((F.col("n") - F.col("j") + 1) / F.col("j")) + F.log(F.col("p") / (1 - F.col("p")))).otherwise(0.0)
    by, up_to = Window.partitionBy("law"), Window.partitionBy("law").orderBy("j")
    weighed = rows.withColumn("w", F.sum(ratio).over(up_to)).withColumn("w", F.exp(F.col("w") - F.max("w").over(by)))
    return weighed.select("law", "j", (F.sum("w").over(up_to) / F.sum("w").over(by)).alias("cdf"))


def binomial_draws(points: DataFrame, laws: DataFrame) -> DataFrame:
    """law, id, draw: for points (law, id, u) the inverse of the laws (law, n, p) at u: how many values of the table lie below it.

    Points and tables are put in one order by value, so no point is held against a table row by row.
    """
    table = binomial_table(laws)
    rows = table.select("law", F.lit(None).cast("long").alias("id"), F.col("cdf").alias("value"), "j")
    both = rows.unionByName(points.select("law", F.col("id").cast("long").alias("id"), F.col("u").alias("value"), F.lit(None).cast("long").alias("j")))
    below = F.count("j").over(Window.partitionBy("law").orderBy("value", F.col("j").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = both.withColumn("below", below).withColumn("low", F.min("j").over(Window.partitionBy("law")))
    return placed.where("id IS NOT NULL").select("law", "id", (F.col("low") + F.col("below")).alias("draw"))
