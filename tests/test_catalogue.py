"""Every catalogue query with SQL against DuckDB, over whole small tables."""

import glob
import os

import duckdb
import pytest

from veritab.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or v != v else round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(str([plain(dict(zip(names, r))[c]) for c in cols]) for r in cur.fetchall())


def test_amounts_above_minus_one_keep_their_sign(spark, tmp_path):
    amounts = [-0.01, -0.5, -0.99, -1.0, -1.5, 0.0, 0.5, 1.0, -999.99, 9999.99]
    d = spark.createDataFrame([(8 * i + k, a) for i, a in enumerate(amounts) for k in range(8)], "c_custkey long, c_acctbal double")
    d.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    name = "signed_prefix_intervals"
    got = sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select("c_custkey", "low", "high", "fits").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{glob.glob(f'{tmp_path}/customer.parquet/*.parquet')[0]}')")
    assert got == sorted(con.execute(f"SELECT c_custkey, low, high, fits FROM ({catalogue.ORACLE_SQL[name]})").fetchall())
