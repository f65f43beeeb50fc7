"""Every query with SQL agrees with DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from quern import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(df):
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA:
            return None
        if isinstance(x, str):
            return x
        return None if math.isnan(x) else float(f"{float(x):.9g}")

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr(tuple(map(value, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    assert normal(catalogue.QUERIES[name](spark, DATA).toPandas()) == normal(db.execute(catalogue.ORACLE_SQL[name]).df())
