"""Statistics as column expressions."""

from __future__ import annotations

from math import lgamma, log, pi
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_bounds(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval of a share; (0, 0) without trials, clipped to [0, 1]."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    n = total.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    scale = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / scale
    half = F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) * z / scale
    empty = total <= 0
    return F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


def _stirling_error(x: Column) -> Column:
    """log(x!) less Stirling's formula for it, of a whole x >= 1: by a table of 15 values, then by three terms of its series."""
    table = F.array(*[F.lit(lgamma(k + 1) - (k + 0.5) * log(k) + k - 0.5 * log(2 * pi)) for k in range(1, 16)])
    return F.when(x <= 15, F.element_at(table, F.least(x, F.lit(15)).cast("int"))).otherwise(1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))


def exact_sign_pvalue(a: Column, b: Column) -> Column:
    """Two-sided binomial(n, 1/2) p-value of a against b, n = a + b; 1 if n is 0. One form at every size.

    The largest term, at k = min(a, b), comes from Loader's form, which loses no digits by cancellation; those below it from the
    ratios of neighbours. Beyond 8 sqrt(n) + 50 steps they are less than e**-100 of it and are left out.
    """
    n, k = (a + b).cast("double"), F.least(a, b).cast("double")
    e = (n - 2 * k) / n
    apart = n / 2 * ((1 + e) * F.log1p(e) + (1 - e) * F.log1p(-e))
    top = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - apart - 0.5 * F.log(2 * pi * k * (n - k) / n)
    top = F.when(k == 0, -n * log(2.0)).otherwise(top)
    steps = F.least(k, F.ceil(8 * F.sqrt(n)) + 50).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, d: Column) -> Column:
        term = s["term"] * (k - d + 1) / (n - k + d)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    below = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * F.aggregate(below, start, step, lambda s: s["sum"])))
