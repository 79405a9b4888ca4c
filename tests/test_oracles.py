"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerwatch.plans import oracles, registry

TABLES = "events customer lineitem orders".split()
SQL = oracles.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def normal(rows: pd.DataFrame) -> list[tuple]:
    rows = rows[sorted(rows.columns)]
    cell = lambda v: "" if v is None or v != v else repr(round(float(v), 6) + 0.0) if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)
    return sorted(tuple(map(cell, r)) for r in rows.astype(object).itertuples(index=False))


def test_every_query_with_sql_is_registered():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, con, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
