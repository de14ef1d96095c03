"""Every query with SQL against the oracle engine at the smallest scale."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from statementspark.jobs import registry

from .conftest import SF


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, datetime.date | pd.Timestamp):
        return str(pd.Timestamp(value).date())
    value = value.item() if hasattr(value, "item") else value
    return round(float(value), 6) if isinstance(value, float) or hasattr(value, "is_signed") else value


def table(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr([plain(v) for v in row]) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, oracle, name):
    assert table(registry.QUERIES[name](spark, SF).toPandas()) == table(oracle.sql(registry.ORACLE[name]).df())
