"""A local session for all tests, and DuckDB views of the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(frame) -> list:
    """Rows of a pandas frame, columns by name, in an order of their own; numbers compare by value."""
    import numpy as np
    import pandas as pd

    def plain(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return tuple(map(plain, x))
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, (float, np.floating)) and x != x):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, np.integer)):
            return int(x)
        if isinstance(x, (float, np.floating)):
            return int(x) if x == int(x) and abs(x) < 2**53 else float(f"{x:.9g}")
        return x

    names = sorted(frame.columns)
    return [names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False)), key=repr)]
