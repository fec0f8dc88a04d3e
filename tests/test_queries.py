"""Every query runs; those with SQL give what DuckDB gives."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sylva.oracles import SQL
from sylva.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
        yield c


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda x: None if x is None or x is pd.NA or x != x else str(x) if isinstance(x, (str, bool)) else round(float(x), 8) + 0.0
    return sorted(str(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    expected = duck.sql(SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
