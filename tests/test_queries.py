"""Every query with SQL equals it, value for value."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from brightloom import queries as base

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    show = lambda v: "null" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v.date()) if isinstance(v, (datetime.datetime, pd.Timestamp)) else str(v)
    return sorted("|".join(show(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(base.ORACLE))
def test_equals_sql(spark, sf, duck, name):
    ours, theirs = base.QUERIES[name](spark, sf).toPandas(), duck.sql(base.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert plain(ours) == plain(theirs)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(base.QUERIES) <= set(entry.queries()) and set(base.ORACLE) <= set(entry.oracle_sql())
