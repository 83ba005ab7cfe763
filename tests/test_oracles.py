"""Every registered query against DuckDB: same columns, types and rows."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry.oracles import ORACLES
from registry.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
WITHOUT_ORACLE: set[str] = set()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, duck):
    found = queries()[name](spark, SF_DIR)
    expected = duck.sql(oracle_sql()[name])
    spark_types = {column: TYPES[kind] for column, kind in found.dtypes}
    assert spark_types == dict(zip(expected.columns, map(str, expected.types)))
    left, right = ordered(found.toPandas()), ordered(expected.df())
    assert len(left) == len(right)
    for column in left.columns:
        if left[column].dtype == float:
            pd.testing.assert_series_equal(left[column], right[column], rtol=0, atol=1.5e-6)
        else:
            same = (left[column] == right[column]) | (left[column].isna() & right[column].isna())
            assert same.all(), (column, left[~same].head(), right[~same].head())


def test_every_query_has_sql_or_a_stated_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


def test_entry_gives_rows(spark):
    result = entry(spark)
    assert result.columns[-1] == "split" and result.count() > 0
