import glob
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session, ship_package

    s = build_session("tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, float) else v


def rows(frame, columns):
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(spark_df, sql_frame):
        got = spark_df.toPandas()
        cols = sorted(got.columns)
        assert cols == sorted(sql_frame.columns)
        assert rows(got, cols) == rows(sql_frame, cols)

    return check
