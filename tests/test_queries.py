"""Every registered query of the library against its SQL twin on the small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from evalgrain.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or str(getattr(value, "dtype", "")) == "bool":
        return bool(value)
    return f"{float(value):.6g}" if isinstance(value, (int, float)) or hasattr(value, "dtype") else str(value)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found.columns)
    if name in SQL:
        wanted = con.execute(SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))
