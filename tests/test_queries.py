"""Each registered query of the library against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import loomwright.plans.catalogue  # noqa: F401
from loomwright.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df):
    def one(v):
        if v is None or not hasattr(v, "__len__") and pd.isna(v):
            return "-"
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(list(v)) if getattr(v, "ndim", 0) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
