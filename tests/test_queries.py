"""Every registered query with an SQL twin gives the same rows in the check engine."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        view = os.path.basename(f)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{f}')")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = (df[c].astype(float).round(6) if df[c].dtype.kind in "iufb" else df[c].map(str))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_names():
    queries = entry_points.queries()
    assert set(SQL) <= set(queries) and len(queries) >= 60


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf_dir, engine, name):
    got = tidy(entry_points.queries()[name](spark, sf_dir).toPandas())
    want = tidy(engine.execute(SQL[name]).df())
    assert len(want)
    pd.testing.assert_frame_equal(got, want)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"Attack Type", "n", "weight"}
