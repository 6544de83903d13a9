"""Every registered query of the library against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidewater.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or pd.isna(v):
            return None
        return v if isinstance(v, (str, bool, bytes)) else round(float(v), 6) if not hasattr(v, "isoformat") else v.isoformat()

    return sorted(str(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    from tidewater import Engine

    frame = Engine(spark, DATA).table("orders").field("o_orderkey").where("o_totalprice", ">", 1000.0).all()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
