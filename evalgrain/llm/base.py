"""Shared pieces: tables written to the cluster's shared folder, and stable row addresses."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables written so far, in the order of writing; each belongs to the innermost recorded() that was open.
_open: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Without one, a folder of this machine where all runs in this process; elsewhere an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/evalgrain-{name}-{uuid.uuid4().hex}"
    for made in _open[-1:]:
        made.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the tables written meanwhile, for drop()."""
    _open.append(made := [])
    try:
        yield made
    finally:
        _open.pop()
        for outer in _open[-1:]:
            outer += made


def drop(spark: SparkSession, made: list[str], in_use: DataFrame | None = None) -> None:
    """Remove written tables, but for those that in_use still reads; what is removed leaves the list."""
    read = in_use.inputFiles() if in_use is not None else []
    for path in list(made):
        if not any(f"/{path.rpartition('/')[2]}/" in f for f in read):
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            made.remove(path)


def _table_name(path: str) -> str:
    return path.rpartition("/")[2].replace("-", "_")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by_block(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """As materialize(), bucketed by the column `block`.

    A block is made by one task, so its rows lie in one file and no shuffle is needed to write the buckets. What is
    worked out elsewhere about a block then joins it without moving the block's texts.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = _table_name(path)
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(table)
    return spark.table(table)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores as it takes to differ from all names taken, whatever the case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def without(columns: Iterable[str], *names: str) -> list[str]:
    """The columns that are not named like one of names, whatever the case."""
    lower = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in lower]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_crc32(column) -> F.Column:
    """Unsigned crc32 of a string's UTF-8 bytes (null counts as empty)."""
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))
