"""Facts of entities: each text once for a name, without texts as keys."""

from __future__ import annotations

import re

from graphweave.operators import retrieve


def test_texts_are_told_apart_without_being_copied_for_each_name(spark):
    facts = spark.createDataFrame([("A1", "x"), ("A1", "x"), ("A2", "x"), ("A2", None), ("A3", ""), ("A4", "own"), ("A4", "own"), ("E9", "named")], "title string, content string")
    entities = spark.createDataFrame([("A1", "E1"), ("A2", "E1"), ("A2", "E2"), ("A3", "E2"), ("A4", "E2"), ("A0", "E9"), ("A1", "other")], "src string, dst string")
    names = spark.createDataFrame([("E1",), ("E1",), ("E2",), ("E9",), ("A4",), ("gone",)], "name string")
    found = retrieve.facts_of(names, facts, entities)
    want = {("E1", "x"), ("E1", None), ("E2", "x"), ("E2", None), ("E2", ""), ("E2", "own"), ("E9", "named"), ("A4", "own")}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*name#\d+, content#", plan)
