import os

import duckdb
import pytest

from strataloom.llm import entry


@pytest.mark.parametrize("name", list(entry.SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")

    def rows(df):
        cols = sorted(df.columns)
        return cols, sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))

    got = entry.QUERIES[name](spark, sf).toPandas()
    got = got.astype({c: "Int64" for c in got if got[c].dtype == "float64"})
    assert rows(got) == rows(con.execute(entry.SQL[name]).df())
