"""The stored vector index against exact search: recall, files read, growth, exact mode."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave.operators import vector
from graphweave.operators.vector_index import CELL, VectorIndex, calibrated, k_means


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + k, f"t{(first + k) // 3}", x.tolist()) for k, x in enumerate(v)], "id long, title string, embedding array<double>")


def queries(spark, v):
    return spark.createDataFrame([(f"q{k}", x.tolist()) for k, x in enumerate(v)], "seed string, query_vector array<double>")


def answers(df):
    out = {}
    for r in df.orderBy("seed", "near").collect():
        out.setdefault(r["seed"], []).append(r["id"])
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 24))
    v = centres[rng.integers(0, 40, 6000)] + 0.5 * rng.normal(size=(6000, 24))
    v[5], v[6] = 0, 0
    v[100:140] = v[100]
    return v


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    return VectorIndex.build(frame(spark, clustered), f"file://{tmp_path_factory.mktemp('index')}/i", "id")


def test_recall_with_a_third_of_the_files(spark, clustered, index):
    rng = np.random.default_rng(8)
    asked = clustered[rng.choice(6000, 30)] + 0.2 * rng.normal(size=(30, 24))
    want = answers(vector.nearest(queries(spark, asked), frame(spark, clustered), "id", 10))
    got = answers(index.search(queries(spark, asked), 10))
    assert np.mean([len({*got[s]} & {*want[s]}) / 10 for s in want]) >= 0.95
    every = set(index.store.read("vectors").inputFiles())
    for k in range(5):
        one = index.search(queries(spark, asked[k : k + 1]), 10)
        read = [f for f in one.inputFiles() if "/vectors-" in f]
        assert 0 < len(read) < len(every) / 3


def test_exact_mode_equals_the_scan(spark, clustered, index):
    rng = np.random.default_rng(9)
    asked = np.concatenate([clustered[[3, 5, 100]], rng.normal(size=(6, 24))])
    for k in (1, 7, 50):
        q = queries(spark, asked)
        assert answers(index.search(q, k, probes=1, exact=True)) == answers(vector.nearest(q, frame(spark, clustered), "id", k))


def test_rows_come_without_a_rebuild(spark, clustered, tmp_path):
    index = VectorIndex.build(frame(spark, clustered[:1500]), f"file://{tmp_path}/i", "id", cells=20)
    before, centres = index.store.version(), index.store.read("centres").collect()
    index.append(frame(spark, clustered[1500:3000], 1500))
    index.append(frame(spark, clustered[3000:3000], 3000))
    q = queries(spark, clustered[[0, 1700, 2500]])
    want = answers(vector.nearest(q, frame(spark, clustered[:3000]), "id", 5))
    assert answers(index.search(q, 5, exact=True)) == want and index.store.read("centres").collect() == centres
    assert index.store.rows(before, "vectors").count() == 1500
    n = len(index.store.read("vectors").inputFiles())
    index.compact()
    assert answers(index.search(q, 5, exact=True)) == want and len(index.store.read("vectors").inputFiles()) < n
    assert index.store.read("vectors").where(F.col(CELL).isNull()).count() == 0


def test_cells_without_enough_rows_lead_on(spark, tmp_path):
    v = np.eye(4)[[0, 0, 1, 1, 2, 3]]
    index = VectorIndex.build(frame(spark, v), f"file://{tmp_path}/i", "id", cells=4)
    assert len(answers(index.search(queries(spark, v[:1]), 5, probes=1))["q0"]) == 5


def test_what_does_not_fit_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", None)], "id long, title string, embedding array<double>")
    index = VectorIndex.build(rows, f"file://{tmp_path}/i", "id")
    assert index.store.read("vectors").count() == 1
    with pytest.raises(ValueError):
        index.append(spark.createDataFrame([(3, "c", [1.0])], rows.schema))
    with pytest.raises(ValueError):
        index.search(queries(spark, np.ones((1, 3))), 1)
    with pytest.raises(ValueError):
        VectorIndex.build(rows.unionByName(spark.createDataFrame([(3, "c", [1.0])], rows.schema)), f"file://{tmp_path}/j", "id")
    with pytest.raises(ValueError):
        vector.few_queries(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "seed string, query_vector array<double>"))
    none = VectorIndex.build(rows.where("id > 5"), f"file://{tmp_path}/k", "id")
    assert none.search(queries(spark, np.ones((1, 1))), 3).count() == 0


def test_calibration_grows_with_the_aim():
    rng = np.random.default_rng(3)
    unit = vector.unit_rows(rng.normal(size=(2000, 16)))
    centres = k_means(unit, 40)
    assert 1 <= calibrated(unit, centres, aim=0.5) < calibrated(unit, centres, aim=0.99) <= 40
