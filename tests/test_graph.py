"""Traversal and centrality on graphs small enough to work out by hand."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphweave.operators import graph, retrieve


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


CYCLE = (("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))


def test_walks_come_back_and_shortest_hops_do_not(spark):
    e = edges(spark, *CYCLE)
    assert rows(graph.walk_hops(e, seeds(spark, "a"), 3), "node", "hops") == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.shortest_hops(e, seeds(spark, "a"), 3), "node", "hops") == [("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.shortest_hops(e, seeds(spark, "d"), 3, keep_seed=True), "node", "hops") == [("d", 0)]


def test_bounds(spark):
    e = edges(spark, *CYCLE)
    with pytest.raises(ValueError):
        graph.walk_hops(e, seeds(spark, "a"), 11)
    with pytest.raises(ValueError):
        graph.expand_related(e, spark.createDataFrame([("a",)], "title string"), 4)


def test_centrality_of_a_star(spark):
    e = edges(spark, ("x", "a"), ("x", "b"), ("x", "c"))
    nodes = spark.createDataFrame([("x",), ("a",), ("gone",)], "title string")
    got = dict(rows(graph.centrality(e, nodes), "title", "centrality"))
    assert got["x"] == 1 and got["a"] == pytest.approx(1 / 3) and got["gone"] == 0


def test_sparse_graph_adds_nothing_to_the_rank(spark):
    e, articles = edges(spark, ("a", "b")), spark.createDataFrame([("a",), ("b",)], "title string")
    found = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "title string, score double")
    assert dict(rows(graph.rerank(found, e, articles), "title", "score")) == {"a": 0.3, "b": 0.6}
    with pytest.raises(ValueError):
        graph.rerank(found, e, articles, 0.9, 0.9)


def test_paths_are_walks_shortest_first(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("b", "c", "z"), ("a", "c", "w")], "src string, dst string, relation string")
    pairs = spark.createDataFrame([("a", "c")], "source string, target string")
    got = [tuple(r) for r in graph.paths(e, pairs).orderBy("place").select("path", "relations", "hops").collect()]
    assert got == [(["a", "c"], ["w"], 1), (["a", "b", "c"], ["x", "z"], 2), (["a", "b", "c"], ["y", "z"], 2)]


def test_cooccurrence_needs_two_shared(spark):
    p = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x")], "article int, entity string")
    assert rows(graph.cooccurrence(p), "src", "dst", "shared") == [(1, 2, 2), (2, 1, 2)]


def test_fusion_keeps_the_old_order_if_its_first_would_fall(spark):
    # the old first has no links; ten others are better linked
    found = spark.createDataFrame([("s", f"t{k}", k + 1) for k in range(6)], "seed string, title string, rank int")
    e = edges(spark, *[(f"t{k}", f"u{j}") for k in range(1, 6) for j in range(k)])
    got = {r["title"]: r["place"] for r in retrieve.fuse(found, e).collect()}
    assert got["t0"] <= 2 or got == {f"t{k}": k for k in range(6)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_hops_match_a_plain_search(spark, pairs):
    pairs = {(a, b) for a, b in pairs if a != b}
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs] or [("x", "y")], "src string, dst string")
    want, now = {"0": 0}, {"0"}
    for h in range(1, 4):
        now = {str(b) for a, b in pairs if str(a) in now} - want.keys()
        want |= dict.fromkeys(now, h)
    assert dict(rows(graph.shortest_hops(e, seeds(spark, "0"), 3, True), "node", "hops")) == want
