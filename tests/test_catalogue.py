"""The catalogue of packs over nations with many customers and suppliers."""

from __future__ import annotations

import threading

import pytest

from graphweave.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    n = spark.createDataFrame([(1, "A", 0), (2, "B", 0), (3, "B", 0), (4, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    held = {
        "nation": n,
        "customer": spark.range(40_000).selectExpr("id AS c_custkey", "IF(id < 10, 3, 1) AS c_nationkey", "'x' AS c_mktsegment"),
        "supplier": spark.range(40_000).selectExpr("id % 30000 AS s_suppkey", "IF(id < 20, 2, 1) AS s_nationkey"),
        "orders": spark.range(8).selectExpr("id AS o_orderkey", "id AS o_custkey", "IF(id % 2 = 0, '1-URGENT', '5-LOW') AS o_orderpriority"),
    }
    for name, df in held.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_customers_and_suppliers_of_a_nation_make_no_product(spark, tables):
    """1.6 billion pairs in the first nation; nations of one name count together, one without either has a row."""
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = {r["pack"]: tuple(r)[1:] for r in catalog.QUERIES["pack_catalogue"](spark, tables).collect()}
        total = catalog.QUERIES["catalogue_totals"](spark, tables).first().asDict()
    finally:
        late.cancel()
    assert got == {"A": (39_990, 29_980 + 20, 1, None, None), "B": (10, 20, 3, 0.0, 0.0), "N": (0, 0, 4, None, None)}
    assert total == {"packs": 3, "articles": 40_000, "entities": 30_020, "relationships": 8, "evaluated": 1, "wins": 0, "ties": 1}
