"""The queries that SQL can express, against DuckDB over whole small tables."""

import glob
import os

import duckdb
import pytest

from veritab.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([dict(zip(names, r))[c] for c in cols]) for r in cur.fetchall())
