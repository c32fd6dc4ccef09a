"""Every ledger query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quillstone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def normal(frame):
    cols = sorted(frame.columns)

    def text(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        if isinstance(v, float) and v.is_integer():
            return str(int(v))  # integers with nulls arrive as floats
        if isinstance(v, float):
            return repr(float(f"{v:.9g}")) if math.isfinite(v) else str(v)
        return str(v).removesuffix(" 00:00:00")

    return cols, sorted(tuple(text(v) for v in r) for r in frame[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees(spark, con, name):
    assert normal(registry.QUERIES[name](spark, SF).toPandas()) == normal(con.execute(registry.SQL[name]).df())
