import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from millrace.workspace import ship

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Are two pandas frames the same rows, in any order?"""

    def one(v):
        import pandas as pd

        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return ""
        if isinstance(v, float):
            return f"{v:.9g}"
        return f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        rows = lambda x: sorted(tuple(map(one, r)) for r in x[cols].astype(object).itertuples(index=False))
        assert rows(a) == rows(b)

    return check
