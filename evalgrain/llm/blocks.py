"""Documents written in blocks of a fixed number of rows, and per-row results brought to them without moving their texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrain.llm.base import materialize_by_block, partitions

BLOCK_BITS = 11


def write_blocks(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """df with its `columns` renamed to c0, c1, ... (so no name can clash), and a node number, block and the other columns.

    node is unique and fixed from here on; a block is at most 2**BLOCK_BITS rows of one task.
    """
    node = F.monotonically_increasing_id()
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], *others, node.alias("node"))
    return materialize_by_block(made.withColumn("block", block_of(F.col("node"))), name, partitions(df.sparkSession))


def block_of(node: Column) -> Column:
    return F.shiftright(node, BLOCK_BITS)


def beside_blocks(rows: DataFrame, needed: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """function(rows of a block, needed rows of it) for each block. `needed` has a column node and is exchanged; rows are not."""
    by_block = needed.select(*[F.col(c).alias(c) for c in needed.columns], block_of(F.col("node")).alias("block"))
    return rows.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(function, schema)
