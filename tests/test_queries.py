"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidegauge.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def cell(v):
    if isinstance(v, (float, np.floating)):
        return "null" if v != v else f"{v:.8g}"
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    return str(v).removesuffix(" 00:00:00")


def rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_without_optional_parts():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
