import os

import duckdb
import pytest

from strataloom import queries


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_query_matches_sql(spark, sf, tables, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(tables.execute(queries.SQL[name]).df())


def test_root_hash_query(spark, sf):
    row = queries.root_hash_customer(spark, sf).head()
    assert len(row.root_hash) == 64 and row.levels >= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 276
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
