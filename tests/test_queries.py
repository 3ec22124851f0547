"""Every query with SQL gives the rows that DuckDB gives: exact columns alike, floats to nine places."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import SF

SQL, QUERIES = entry.oracle_sql(), entry.queries()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df: pd.DataFrame, floats: set[str]) -> pd.DataFrame:
    """Columns by name, rows in the order of the exact columns first; floats order only what those leave equal."""
    df = df[sorted(df.columns)].copy()
    for c in floats:
        df[c] = df[c].astype("float64")
    keys = pd.DataFrame({c: df[c].round(5) + 0.0 if c in floats else df[c].astype(str) for c in sorted(df.columns, key=lambda c: c in floats)})
    return df.loc[keys.sort_values(list(keys.columns)).index].reset_index(drop=True) if len(df) else df


def compare(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    floats = {c for c in got.columns if got[c].dtype.kind == "f" or want[c].dtype.kind == "f"}
    a, b = rows(got, floats), rows(want, floats)
    for c in a:
        if c in floats:
            np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_names():
    assert SQL.keys() <= QUERIES.keys() and len(QUERIES) > 120


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    compare(QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["k1_branch_table", "l13_cyl_dia", "o3_collect_runs", "p4_reattach", "h8_continuity"])
def test_larger_tables(spark, name):
    """Sums of many rows, ten times the size."""
    large = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for f in os.listdir(large):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{large}/{f}'")
    compare(QUERIES[name](spark, large).toPandas(), c.sql(SQL[name]).df())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "total_volume" in df.columns


def test_fixture_facts(spark):
    """Known sums of the fixtures."""
    from sylva.sources.fixtures import load

    assert load(spark, "/root/testdata/sf0.01", "points").count() == 60_000
    c = load(spark, "/root/testdata/sf0.01", "cylinders")
    assert c.count() == 60_000 and c.filter("position = 1").agg({"branch_order": "sum"}).first()[0] == 28_275
