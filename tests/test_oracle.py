"""Every registered query over the smallest tables, against its DuckDB SQL where it has any."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from graphweave.plans import catalog

TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in sorted(TABLES.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    return f"{float(value):.5f}" if isinstance(value, (int, float)) or hasattr(value, "dtype") and value.dtype.kind in "iuf" else str(value)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(TABLES)).toPandas()
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) and len(got)
