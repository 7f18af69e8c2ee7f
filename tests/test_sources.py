"""File sources, packs, the schema and the streaming form of the queue."""

from __future__ import annotations

import json
import tarfile
from datetime import datetime, timedelta

import pytest

from graphweave import schema
from graphweave.sources import files
from graphweave.streaming import claims


def lines(path, *rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_questions_are_strict(spark, tmp_path):
    good = json.dumps({"id": "q1", "domain": "d", "difficulty": "easy", "question": "q", "ground_truth": "t"})
    assert files.questions(spark, lines(tmp_path / "a.jsonl", good, "", good)).count() == 2
    with pytest.raises(ValueError, match="line 2"):
        files.questions(spark, lines(tmp_path / "b.jsonl", good, '{"id": "q2"}'))


def test_lists(spark, tmp_path):
    p = lines(tmp_path / "u.txt", "# c", " https://a/x ", "http://b", "", "https://c", " # d")
    assert [r["url"] for r in files.urls(spark, p).collect()] == ["https://a/x", "https://c"]
    assert files.urls(spark, p, 1).count() == 1 and files.urls(spark, p, 0).count() == 2
    assert files.urls_loosely(spark, p).count() == 4
    t = lines(tmp_path / "t.txt", "- one", "2. two", "", "# no", "* three")
    assert [r["topic"] for r in files.topics(spark, t).orderBy("ord").collect()] == ["one", "two", "three"]


def test_examples_of_both_kinds(spark, tmp_path):
    rows = [{"query": "a", "answer": "b"}, {"query": "c", "answer": "d"}]
    a = lines(tmp_path / "a.json", json.dumps(rows))
    b = lines(tmp_path / "b.json", *map(json.dumps, rows))
    assert files.examples(spark, a, "query string, answer string").collect() == files.examples(spark, b, "query string, answer string").collect()


MANIFEST = {"name": "go-expert", "version": "1.0.0", "description": "d", "graph_stats": {"articles": 1, "entities": 2, "relationships": 3, "size_mb": 0.5}, "license": "MIT", "created": "2024-01-01T00:00:00Z", "source_urls": ["https://x"]}


def test_manifests(spark, tmp_path):
    for name, change in (("a", {}), ("b", {"version": "1", "source_urls": ["http://x"], "name": "-x"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(MANIFEST | change))
    m = files.manifests(spark, str(tmp_path))
    assert {r["folder"]: sorted(r["errors"]) for r in files.manifest_errors(m).collect()} == {"a": [], "b": ["name", "source_urls", "version"]}


def test_packs_keep_results_and_refuse_escapes(tmp_path):
    src, root = tmp_path / "src", tmp_path / "root"
    (src / "eval/results").mkdir(parents=True)
    (src / "manifest.json").write_text(json.dumps(MANIFEST))
    archive = files.package(src, tmp_path / "p.tar.gz")
    target = files.unpackage(archive, root)
    (target / "eval/results").mkdir(parents=True, exist_ok=True)
    (target / "eval/results/r.json").write_text("{}")
    assert (files.unpackage(archive, root) / "eval/results/r.json").exists()
    assert files.packs(root) == [] and files.pack_errors(target) == ["no pack.db", "no skill.md", "no kg_config.json"]
    (target / "pack.db").mkdir()
    (target / "skill.md").write_text("s")
    (target / "kg_config.json").write_text("{}")
    assert files.packs(root) == [target]
    (target / "manifest.json").write_text("{")
    assert files.pack_errors(target) == ["manifest.json can't be read"]
    (target / "manifest.json").write_text(json.dumps(MANIFEST))
    with tarfile.open(tmp_path / "bad.tar.gz", "w:gz") as tar:
        tar.add(src / "manifest.json", "../manifest.json")
    with pytest.raises(ValueError, match="unsafe"):
        files.unpackage(tmp_path / "bad.tar.gz", root)


def test_schema_tables(spark):
    made = schema.create_tables(spark, "t_")
    assert len(made) == 13 and schema.missing_tables(spark, "t_") == []
    schema.drop_tables(spark, "t_")
    assert len(schema.missing_tables(spark, "t_")) == 13


def test_stream_of_states(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("a", "discovered", at), ("a", "claimed", at + timedelta(minutes=1)), ("b", "claimed", at + timedelta(minutes=2)), ("b", "loaded", at + timedelta(minutes=3))]
    spark.createDataFrame(rows, "key string, state string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    late = [("z", "discovered", at + timedelta(hours=5))]
    stream = spark.readStream.schema("key string, state string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = claims.states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    for _ in range(2):
        spark.createDataFrame(late, "key string, state string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
    q.stop()
    got = [(r["key"], r["state"]) for r in spark.table("states").collect()]
    assert ("b", "loaded") in got and ("a", "claimed") in got and got.index(("a", "discovered")) > got.index(("a", "claimed"))
