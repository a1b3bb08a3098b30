"""Sharding by histogram sort: exact bytes below candidate boundaries are counted until the splitters fit, then one exchange."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.llm.base import materialize, partitions, without

LEAST = -(1 << 63)
_TOP = 1 << 128


def _as_bytes(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """(key, tie) as 16 bytes each that sort like the pair of signed numbers."""
    pair = np.stack([key.astype(np.int64), tie.astype(np.int64)], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.frombuffer(pair.astype(">u8").tobytes(), dtype="V16").view("S16") if len(pair) else np.empty(0, "S16")


def _edges(probes: list[int]) -> np.ndarray:
    return np.array([p.to_bytes(16, "big") for p in probes], dtype="S16") if probes else np.empty(0, "S16")


def _bucket(probes: list[int]):
    """Number of probes at or below a row's (key, tie)."""

    @F.pandas_udf("int")
    def bucket(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        edges = _edges(probes)
        for key, tie in batches:
            yield pd.Series(np.searchsorted(edges, _as_bytes(key.to_numpy(), tie.to_numpy()), side="right").astype(np.int32))

    return bucket


def counts_below(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each probe: one pass, partial sums by task, as many rows to the driver as probes."""
    got = {r.b: (r.size, r.rows) for r in keys.groupBy(_bucket(probes)("key", "tie").alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}
    out, size, rows = [], 0, 0
    for b in range(len(probes)):
        size, rows = size + got.get(b, (0, 0))[0], rows + got.get(b, (0, 0))[1]
        out.append((size, rows))
    return out


def find_splitters(keys: DataFrame, targets: list[int], tolerances: list[int], low: int, high: int, total: tuple[int, int], probes: int = 15) -> list[tuple[int, int, int]]:
    """For each target a splitter (position, bytes below, rows below) with bytes within its tolerance of the target.

    Where no position is that close (one row is larger than the tolerance), the closest position is taken.
    """
    known: dict[int, tuple[int, int]] = {low: (0, 0), high: total}
    while True:
        at = sorted(known)
        sizes = [known[x][0] for x in at]
        wanted: set[int] = set()
        best = []
        for target, near in zip(targets, tolerances, strict=True):
            k = min(max(bisect_left(sizes, target), 1), len(at) - 1)
            left, right = at[k - 1], at[k]
            choice = min(left, right, key=lambda x: (abs(known[x][0] - target), x))
            best.append((choice, *known[choice]))
            if abs(known[choice][0] - target) > near and right - left > 1:
                step = max(1, (right - left) // (probes + 1))
                wanted.update(range(left + step, min(right, left + step * probes + 1), step))
        if not wanted:
            return sorted(best)
        new = sorted(wanted - known.keys())
        known |= dict(zip(new, counts_below(keys, new), strict=True))


def dealt_parts(keys: DataFrame, parts: int, tolerance: float = 0.1):
    """A function of (key, tie) arrays to parts of about equal size in order: keys (key, tie, size).

    Each boundary is within tolerance of a part's size, or at the closest position; rows of a position at which several
    boundaries lie are dealt over the parts between them.
    """
    low, high, total, n = keys.agg(F.min("key"), F.max("key"), F.sum("size"), F.count("*")).first()
    found = []
    if n:
        flip = 1 << 63
        targets = [total * j // parts for j in range(1, parts)]
        found = find_splitters(keys, targets, [int(tolerance * total / parts)] * len(targets), (low + flip) << 64, min(_TOP - 1, (high + flip + 1) << 64), (total, n))
    probes = [x[0] for x in found]

    def part_of(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        at, edges = _as_bytes(key, tie), _edges(probes)
        first, last = np.searchsorted(edges, at, side="left"), np.searchsorted(edges, at, side="right")
        # A row below the first of equal boundaries is its left neighbour's; one at them is dealt over the parts between.
        first = np.minimum(first + 1, last)
        return (first + np.random.default_rng(len(key)).integers(0, last - first + 1)).astype(np.int32)

    return part_of


def shard(
    df: DataFrame,
    key: Column,
    size: Column,
    shards: int = 16,
    tolerance: float = 0.0005,
    part_tolerance: float = 0.2,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """df plus a shard from 0 to shards-1 and a slot, gapless from 0 within its shard.

    Rows are in order of `key` (a long expression over df; null counts as the least) over all shards and slots, rows
    with one key in any order. `size` is a row's weight; the sums of the shards are as equal as the order allows: each
    boundary is within tolerance * (total / shards) of its place, or at the closest row.

    df is written once (so ties keep their place); passes over (key, tie, size) refine the splitters. A shard is
    sorted in several parts, as many in all as there are shuffle partitions, so no task holds a whole shard; rows with
    one key are split like others. One exchange moves the rows. An empty table gives an empty result; null sizes count
    0; columns named like the new ones, whatever their case, are replaced.
    """
    spark = df.sparkSession
    keep = without(df.columns, shard_col, slot_col)
    rows = materialize(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
            F.coalesce(key.cast("long"), F.lit(LEAST)).alias("key"),
            F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
            F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        ),
        "shard",
    )
    keys = rows.select("key", "tie", "size")
    least, most, total, n = keys.agg(F.min("key"), F.max("key"), F.sum("size"), F.count("*")).first()
    per = max(1, -(-partitions(spark) // shards))
    parts = shards * per
    found = []
    if n:
        flip = 1 << 63
        found = find_splitters(
            keys,
            [total * j // parts for j in range(1, parts)],
            [int(tolerance * total / shards) if j % per == 0 else int(part_tolerance * total / parts) for j in range(1, parts)],
            (least + flip) << 64,
            min(_TOP - 1, (most + flip + 1) << 64),
            (total, n),
        )
    splitters = [x[0] for x in found]
    before = [0, *(x[2] for x in found)]
    offsets = [b - before[k // per * per] for k, b in enumerate(before)]
    place = rows.withColumn("part", _bucket(splitters)("key", "tie"))
    placed = place.repartitionById(parts, F.col("part"))
    in_part = F.row_number().over(Window.partitionBy("part").orderBy("key", "tie"))
    start = F.element_at(F.split(F.lit(",".join(map(str, offsets))), ","), F.col("part") + 1).cast("long")
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        (F.col("part") / per).cast("int").alias(shard_col),
        (start + in_part - 1).alias(slot_col),
    )
