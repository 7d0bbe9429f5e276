from __future__ import annotations

import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH", "")]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tests-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def same(spark):
    """Compare a query with its SQL on the same tables."""
    import datetime

    import duckdb
    import pandas as pd

    def plain(v):
        if isinstance(v, dict):
            return tuple(plain(x) for x in v.values())
        if isinstance(v, (list, tuple)) or type(v).__name__ in ("ndarray", "Row"):
            return tuple(plain(x) for x in v)
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v

    def rows(df):
        return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)

    def check(query, sql, sf_dir=SF):
        con = duckdb.connect()
        con.sql("set timezone = 'UTC'")
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        got, expected = query(spark, sf_dir).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)

    return check
