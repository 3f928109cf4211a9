"""Every contract query against its SQL on the smallest tables, where they are on this machine."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from pactlake import catalogue

TABLES = Path(os.environ.get("DRIVER_TABLES", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not TABLES.exists(), reason="no driver tables on this machine")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, str(TABLES)).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not TABLES.exists(), reason="no driver tables on this machine")
def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
