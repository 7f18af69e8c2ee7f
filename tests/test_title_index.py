"""The index on titles against comparing all titles, stored, grown and made in the plan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphweave.operators import retrieve
from graphweave.operators.title_index import TitleIndex, patterns, postings, runs_of

WORDS = ["Graph", "graphs", "ΣΑΣ", "É", "été", "日本語", "a", "Go", "x-y", "C++", "100%", "a_b", "Theory of", "  "]


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(4)
    return sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))) for _ in range(500)} | {"", "ab", "a"})


@pytest.fixture(scope="module")
def articles(spark, titles):
    return spark.createDataFrame([(t, "c") for t in titles] + [(None, "c")], "title string, category string")


ASKED = ["graph", "GRAPH t", "a", "go", "日本", "é", "+", "x-y C", "100%", "_", "no such title", "", "theory of theory", "aphs"]


@pytest.fixture(scope="module", params=["plan", "stored", "grown"])
def index(request, spark, articles, tmp_path_factory):
    if request.param == "plan":
        return TitleIndex.of(articles)
    path, half = f"file://{tmp_path_factory.mktemp('titles')}/i", F.pmod(F.xxhash64("title"), F.lit(2)) == 0
    if request.param == "stored":
        TitleIndex.build(articles, path)
    else:
        TitleIndex.build(articles.where(half), path).append(articles.where(~half))
    return TitleIndex.open(spark, path)


def test_same_titles_as_comparing_all(spark, titles, index):
    got = sorted(tuple(r) for r in index.containing(patterns(spark, [(q, q) for q in ASKED])).collect())
    assert got == sorted((q, t) for q in ASKED if q for t in titles if q.lower() in t.lower())


def test_no_join_compares_all_with_all(spark, articles, index):
    asked = spark.createDataFrame([("what is graph theory",), ("explain GO",)], "question string")
    found = retrieve.title_lookup(articles, asked, index=index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {"explain GO": [t for t in sorted(t for t, _ in articles.dropna().collect() if t.lower() == "go")]}
    assert [r["title"] for r in found.where("question = 'explain GO'").collect()] == want["explain GO"]


def test_a_lookup_reads_its_buckets_only(spark, articles, tmp_path):
    index = TitleIndex.build(articles, f"file://{tmp_path}/i")
    every = set(index.store.read("postings").inputFiles())
    read = [f for f in index.containing(patterns(spark, [("q", "theory of")])).inputFiles() if "/postings-" in f]
    assert 0 < len(read) <= 3 < len(every) / 3


def test_autocomplete(spark, articles, titles, index):
    got = [(r["title"], r["match_type"]) for r in retrieve.autocomplete(articles, "gr", 30, index).collect()]
    fit = sorted((not t.lower().startswith("gr"), t) for t in titles if "gr" in t.lower())[:30]
    assert got == [(t, "contains" if late else "prefix") for late, t in fit]


def test_runs(spark):
    df = spark.createDataFrame([("Abcab",), (None,), ("",)], "title string")
    assert sorted(r["run"] for r in postings(df).collect()) == sorted({"a", "b", "c", "ab", "bc", "ca", "abc", "bca", "cab"})
    assert runs_of("abcabc") == ["abc", "bca", "cab"] and runs_of("ab") == ["ab"]
    with pytest.raises(ValueError):
        TitleIndex.of(df).containing(spark.range(1001).selectExpr("id AS key", "concat('p', id) AS pattern"))
