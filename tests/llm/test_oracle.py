"""The parts of operators that SQL can express, against the oracle engine."""

import decimal

import duckdb
import pytest

from statementspark.llm import queries

from ..conftest import SF


def rounded(row):
    """As text, since a row may hold nulls; doubles to six places."""
    return repr([round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v for v in row])


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query(spark, name, scale):
    folder = SF.replace("0.001", scale)
    con = duckdb.connect()
    for each in ("documents", "conversations"):
        con.sql(f"create view {each} as select * from '{folder}/{each}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"SELECT {columns} FROM ({queries.SQL[name]}) AS x")
    assert sorted(got.columns) == sorted(con.sql(queries.SQL[name]).columns)
    assert sorted(map(rounded, got.collect())) == sorted(map(rounded, want.fetchall()))
