"""Paths from both ends, co-occurrence with heavy entities and in steps, and kept degrees, against plain readings."""

from __future__ import annotations

import random
import threading
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphweave.operators import degree_table, graph


def every_walk(edges, source, target, most):
    now, out = [((source,), ())], []
    for h in range(1, most + 1):
        now = [((*p, b), (*r, x)) for p, r in now for a, b, x in edges if a == p[-1]]
        out += [(h, p, r) for p, r in now if p[-1] == target]
    return out


@pytest.mark.parametrize(("seed", "hops", "limit"), [(1, 1, 3), (2, 2, 2), (3, 3, 5), (4, 4, 1), (5, 5, 4)])
def test_paths_equal_all_walks(spark, seed, hops, limit):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}", rng.choice("xyz")) for _ in range(14)]
    edges += edges[:2]  # the same edge twice gives walks of its own
    pairs = [("n0", "n1"), ("n2", "n2"), ("n3", "gone"), ("n4", "n0")]
    found = graph.paths(spark.createDataFrame(edges, "src string, dst string, relation string"), spark.createDataFrame(pairs, "source string, target string"), hops, limit)
    got = {}
    for r in found.orderBy("place").collect():
        got.setdefault((r["source"], r["target"]), []).append((r["hops"], tuple(r["path"]), tuple(r["relations"])))
    want = {(s, t): w for s, t in pairs if (w := sorted(every_walk(edges, s, t, hops))[:limit])}
    assert got == want


def test_paths_where_walks_explode(spark):
    """Thirty nodes all linked: 20 million walks of six steps, of which no more than the limit are kept for a node."""
    n = spark.range(30).select(F.format_string("n%02d", "id").alias("n"))
    e = n.toDF("src").crossJoin(n.toDF("dst")).where("src <> dst").withColumn("relation", F.lit("r"))
    pairs = spark.createDataFrame([("n00", "n00")], "source string, target string")
    rows = graph.paths(e, pairs, 6, 40).collect()
    assert len(rows) == 40 and {r["hops"] for r in rows} == {2, 3} and rows[0]["path"] == ["n00", "n01", "n00"]


def plain(pairs, least):
    of = {}
    for a, e in pairs:
        of.setdefault(a, set()).add(e)
    both = {(a, b): len(of[a] & of[b]) for a, b in combinations(sorted(of), 2)}
    return sorted(x for (a, b), n in both.items() if n >= least for x in ((a, b, n), (b, a, n)))


def articles(seed, n=60):
    rng = random.Random(seed)
    out = {(a, f"e{rng.randrange(40)}") for a in range(n) for _ in range(4)}
    for hub, share in (("h1", 0.4), ("h2", 0.35), ("h3", 0.3)):  # each in a third of all articles or more
        out |= {(a, hub) for a in range(n) if rng.random() < share}
    return sorted(out)


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "article int, entity string")


def rows(df):
    return sorted(tuple(r) for r in df.select("src", "dst", "shared").collect())


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("heavy", [5, 12, 1000])
def test_heavy_entities_change_nothing(spark, least, heavy):
    pairs = articles(least)
    assert rows(graph.cooccurrence(frame(spark, pairs), least, heavy=heavy)) == plain(pairs, least)


def test_an_entity_in_a_third_of_all_articles_makes_no_large_key(spark):
    """6,000 articles, 2,000 of them with two entities of all: no row of the join for pairs that share one of them alone."""
    p = spark.range(6000).selectExpr("id AS article", "explode(IF(id % 3 = 0, array(concat('o', id), 'hub'), array(concat('o', id - id % 3 + 1)))) AS entity")
    found = graph.cooccurrence(p, 2, heavy=100)
    assert found.count() == 0
    two = p.unionByName(spark.range(40).selectExpr("id * 3 AS article", "'other hub' AS entity")).unionByName(spark.range(300).selectExpr("id * 3 + 1 AS article", "'other hub' AS entity"))
    assert graph.cooccurrence(two, 2, heavy=100).count() == 40 * 39


@pytest.mark.parametrize("heavy", [5, 1000])
def test_steps_equal_the_whole(spark, heavy):
    pairs = articles(9)
    rng = random.Random(2)
    first = [p for p in pairs if p[0] % 5 and rng.random() < 0.9]
    false = [(a, "e1") for a in range(3, 50, 7) if (a, "e1") not in pairs]
    before = frame(spark, first + false)
    old = graph.cooccurrence(before, 2, heavy=heavy)
    edges, now = graph.cooccurrence_after(old, before, frame(spark, [p for p in pairs if p not in set(first)]), frame(spark, false), heavy=heavy)
    assert rows(edges) == plain(pairs, 2) and sorted(tuple(r) for r in now.collect()) == pairs


@pytest.mark.parametrize("least", [2, 3])
@pytest.mark.parametrize("wide", [2, 4, 5, 16])
def test_articles_of_few_and_of_many_entities_meet(spark, least, wide):
    """By pairs of entities up to `wide`, by entity beyond; in one go and in steps."""
    pairs = articles(least, 40) + sorted({(a, f"e{e}") for a in (100, 101, 102) for e in range(a % 7, 40, 3)})
    assert rows(graph.cooccurrence(frame(spark, pairs), least, heavy=5, wide=wide)) == plain(pairs, least)
    first = [p for p in pairs if p[0] % 5]
    before = frame(spark, first)
    old = graph.cooccurrence(before, least, wide=wide)
    edges, _ = graph.cooccurrence_after(old, before, frame(spark, [p for p in pairs if not p[0] % 5]), None, least, heavy=5, wide=wide)
    assert rows(edges) == plain(pairs, least)


def test_articles_with_one_entity_in_common_are_not_joined(spark):
    """60,000 articles share one entity and two of them another: one pair, where 1.8 billion were joined to find it."""
    p = spark.range(60_000).selectExpr("id AS article", "explode(IF(id < 2, array('all', 'two'), array('all', concat('own', id)))) AS entity")
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert rows(graph.cooccurrence(p, heavy=100_000)) == [(0, 1, 2), (1, 0, 2)]
    finally:
        late.cancel()


def test_kept_degrees_equal_counting_again(spark, tmp_path):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(40)}
    link = lambda e: spark.createDataFrame(sorted(e), "src string, dst string")
    table = degree_table.LinkTable.create(link(edges), f"file://{tmp_path}/l", 4)
    for _ in range(3):
        new = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(8)}
        gone = set(rng.sample(sorted(edges), 6)) | {("none", "gone")}
        table.change(link(new), link(gone))
        edges = (edges - gone) | new
        assert {tuple(r) for r in table.edges().collect()} == edges
        want = Counter(x for e in edges for x in e)
        assert {r["title"]: r["degree"] for r in table.degrees().collect()} == want
    got = {r["title"]: r["centrality"] for r in table.centrality(spark.createDataFrame([("n1",), ("n2",), ("gone",)], "title string")).collect()}
    most = max(want["n1"], want["n2"])
    assert got == {"n1": want["n1"] / most, "n2": want["n2"] / most, "gone": 0.0}
    before = table.store.version().number
    table.change(link({min(edges)}))  # is there already
    assert table.store.version().number == before
