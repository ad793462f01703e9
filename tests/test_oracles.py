"""Every query of the catalogue against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tracelake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool" else f"{float(v):.4f}"

    cols = sorted(df.columns)
    return sorted(tuple(value(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE_SQL.keys()))
def test_rows_without_sql(spark, sf, name):
    rows = catalogue.QUERIES[name](spark, sf).collect()
    assert rows and all(r["same"] for r in rows if "same" in r)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
