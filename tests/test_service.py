"""Services over a small graph, the way from a question to its sources, and what surrounds them."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphweave import service
from graphweave.functions import text as X
from graphweave.operators import ingest
from graphweave.sources import files

WORDS = " ".join(f"word{k}" for k in range(60))


@pytest.fixture(scope="module")
def graph(spark):
    names = ["Go", "Go channels", "Rust", "Python", "Java"]
    articles = spark.createDataFrame([(n, "lang" if k % 2 else "core", 60 * k, "loaded") for k, n in enumerate(names)], "title string, category string, word_count long, expansion_state string")
    sections = spark.createDataFrame([(n, f"{n}#{i}", i, f"{n} text {i} {WORDS}", [1.0, k / 5, i / 9]) for k, n in enumerate(names) for i in range(2)], "title string, section_id string, section_index int, content string, embedding array<double>")
    edges = spark.createDataFrame([("Go", "Go channels"), ("Go", "Rust"), ("Rust", "Python"), ("Java", "Go")], "src string, dst string")
    facts = spark.createDataFrame([("Go", "Go has goroutines")], "title string, content string")
    return service.Graph(articles, sections, edges, facts)


def test_search_and_its_bounds(graph):
    rows = service.search(graph, "Go", limit=3).orderBy("rank").collect()
    assert [r["title"] for r in rows] == ["Go channels", "Rust", "Python"] and rows[0]["summary"].startswith("Go channels text 0") and rows[0]["summary"].endswith("...")
    assert service.search(graph, "Go", "lang", 3).count() == 2 and service.search(graph, "none").count() == 0
    for bad in ({"limit": 0}, {"limit": 101}, {"threshold": 1.5}):
        with pytest.raises(ValueError):
            service.search(graph, "Go", **bad)
    assert [r["title"] for r in service.autocomplete(graph, "go").collect()] == ["Go", "Go channels"]
    with pytest.raises(ValueError):
        service.autocomplete(graph, "g")
    assert {r["title"] for r in service.hybrid_search(graph, "Go", max_hops=1).collect()} == {"Go channels", "Rust"}
    with pytest.raises(ValueError):
        service.hybrid_search(graph, "Go", max_hops=4)


def test_views(graph):
    nodes, edges = service.neighbourhood(graph, "Go", 1)
    assert {(r["title"], r["depth"]) for r in nodes.collect()} == {("Go", 0), ("Go channels", 1), ("Rust", 1)}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("Go", "Go channels"), ("Go", "Rust")}
    one = service.article(graph, "Go").first()
    assert one["links"] == ["Go channels", "Rust"] and one["backlinks"] == ["Java"] and [s["section_index"] for s in one["sections"]] == [0, 1]
    assert service.article(graph, "none").count() == 0
    assert {r["category"]: r["n"] for r in service.categories(graph).collect()} == {"core": 3, "lang": 2}
    assert service.statistics(graph).first().asDict() == {"articles": 5, "sections": 10, "links": 4, "sections_each": 2.0, "links_each": 0.8, "categories": 2}


def test_chat_asks_the_model_with_sources(graph):
    asked = []
    out = service.chat(graph, "What is Go?", lambda ts: [[1.0, 0.0, 0.0] for _ in ts], lambda q, c: asked.append(c) or "yes", 3)
    assert out["answer"] == "yes" and out["sources"][0] == "Go" and len(out["sources"]) <= 7
    assert "## Sources" in asked[0] and "[Go] Go has goroutines" in asked[0] and "### Go" in asked[0]
    unsure = service.chat(graph, "zzz", lambda ts: [[-1.0, 0.0, 0.0] for _ in ts], lambda q, c: 1 / 0, 3)
    assert unsure["sources"] == []

    def fails(texts):
        raise RuntimeError("token=abcdefgh12345 was refused")

    *_, (event, message) = service.chat_events(graph, "zzz", fails, lambda q, c: "")
    assert event == "error" and "abcdefgh12345" not in message
    events = [e for e, _ in service.chat_events(graph, "Go", fails, lambda q, c: "a")]  # the title's own vector
    assert events == ["sources", "token", "done"]


def test_answers_come_bit_by_bit(graph):
    vector, asked = (lambda ts: [[1.0, 0.0, 0.0] for _ in ts]), []

    def model(question, context):
        asked.append(question)
        yield "Go "
        yield "has them."

    events = service.chat_events(graph, "What is Go?", vector, model, 3)
    assert next(events)[0] == "sources" and asked == []  # sources show before the model is asked
    assert [(e, json.loads(x)) for e, x in events] == [("token", "Go "), ("token", "has them."), ("done", {})]
    assert service.chat(graph, "What is Go?", vector, model, 3)["answer"] == "Go has them."

    def breaks(question, context):
        yield "a"
        raise RuntimeError("password=abcdefgh12345")

    last = list(service.chat_events(graph, "Go", vector, breaks, 3))
    assert [e for e, _ in last] == ["sources", "token", "error"] and "abcdefgh12345" not in last[-1][1]


def test_stored_indexes_give_the_same(spark, graph, tmp_path):
    from dataclasses import replace

    from graphweave.operators.degree_table import LinkTable
    from graphweave.operators.title_index import TitleIndex
    from graphweave.operators.vector_index import VectorIndex

    vectors = VectorIndex.build(graph.sections.select("section_id", "title", "embedding"), f"file://{tmp_path}/v", "section_id", cells=1)
    stored = replace(graph, vectors=vectors, titles=TitleIndex.build(graph.articles, f"file://{tmp_path}/t"), degrees=LinkTable.create(graph.edges, f"file://{tmp_path}/l").degrees())
    same = lambda f: f(graph).collect() == f(stored).collect()
    assert same(lambda g: service.search(g, "Go", limit=3).orderBy("rank")) and same(lambda g: service.autocomplete(g, "go"))
    ask = lambda g: service.chat(g, "What is Go?", lambda ts: [[1.0, 0.0, 0.0] for _ in ts], lambda q, c: c, 3)
    assert ask(graph) == ask(stored)


def test_tools_by_name_of_pack(graph, tmp_path):
    (tmp_path / "go/pack.db").mkdir(parents=True)
    (tmp_path / "bare").mkdir()
    for name in ("go", "bare"):
        (tmp_path / name / "manifest.json").write_text(json.dumps({"name": name, "version": "1.0.0"}))
    opened = []
    tools = service.Tools(tmp_path, lambda place: opened.append(place) or graph, lambda ts: [[1.0, 0.0, 0.0] for _ in ts], lambda q, c: "yes").offered()
    assert tools["query_knowledge_pack"]("go", "What is Go?")["answer"] == "yes" and opened == [tmp_path / "go"]
    assert tools["pack_info"]("go")["db_exists"] and not tools["pack_info"]("bare")["db_exists"]
    for name in ("bare", "../go", "none"):
        assert tools["query_knowledge_pack"](name, "q").keys() == {"error", "pack"}
    assert len(opened) == 1


def test_statistics_are_kept_for_a_minute(graph):
    now, asked = [0.0], []
    kept = service.Kept(lambda: asked.append(1) or {"n": len(asked)}, 60, lambda: now[0])
    assert (kept(), kept()) == ({"n": 1}, {"n": 1})
    now[0] = 60
    assert kept() == {"n": 2}
    assert service.kept_statistics(graph)()["articles"] == 5


def test_packs_by_name(tmp_path, capsys):
    home = tmp_path / "go"
    (home / "pack.db").mkdir(parents=True)
    for part in ("skill.md", "kg_config.json"):
        (home / part).write_text("{}")
    (home / "manifest.json").write_text(json.dumps({"name": "go", "version": "1.0.0", "description": "d", "graph_stats": {"articles": 1}, "license": "MIT"}))
    assert service.list_packs(tmp_path) == [{"name": "go", "version": "1.0.0", "description": "d"}] and service.pack_info(tmp_path, "go")["license"] == "MIT"
    with pytest.raises(ValueError):
        service.pack_info(tmp_path, "../go")
    assert service.main(["pack", "validate", str(home)]) == 0 and "valid" in capsys.readouterr().out
    assert service.main(["pack", "remove", "go", "--root", str(tmp_path)]) == 0 and not home.exists()


def test_command_line_over_tables(spark, graph, capsys):
    assert service.main(["--prefix", "cli_", "create"], spark) == 0
    assert service.main(["--prefix", "cli_", "status"], spark) == 0
    assert '"total"' in capsys.readouterr().out
    from graphweave import schema

    schema.drop_tables(spark, "cli_")


def test_wiki_responses(spark):
    page = {"parse": {"title": "A", "pageid": 7, "wikitext": {"*": "#REDIRECT [[B]]"}, "links": [{"ns": 0, "*": "B"}, {"ns": 14, "*": "Category:C"}], "categories": [{"*": "C"}]}}
    df = spark.createDataFrame([("a", json.dumps(page)), ("x", json.dumps({"error": {"code": "missing", "info": "no page, token=abcdefgh123"}})), ("y", "{")], "title string, body string")
    got = {r["asked"]: r for r in ingest.wiki_pages(df).collect()}
    a = got["a"]
    assert (a["title"], a["pageid"], a["links"], a["categories"], a["redirect"], a["error"]) == ("A", 7, ["B"], ["C"], "B", None)
    assert "abcdefgh123" not in got["x"]["error"] and got["y"]["error"] == "unexpected response" and got["y"]["title"] == "y"


def test_relations_need_entities_of_their_article(spark):
    relations = spark.createDataFrame([("A", "x", "y"), ("B", "x", "y"), ("A", "x", "z")], "article string, source string, target string")
    entities = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "article string, name string")
    assert [tuple(r) for r in ingest.named_relations(relations, entities).select("article", "source", "target").collect()] == [("A", "x", "y")]


def test_merged_edges(spark):
    e = lambda *rows: spark.createDataFrame(rows, "src string, dst string")
    assert ingest.merge_edges(e(("a", "b")), e(("a", "b"), ("b", "a"))).count() == 2


@pytest.mark.parametrize(("text", "want"), [('say {"a": {"b": 1}} end', '{"a": {"b": 1}}'), ("none", "none"), ("} {", "} {")])
def test_outer_braces(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.braces(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    "secret", ['{"api_key": "abcdefgh12345678"}', '{"x-api-key": "abcdefgh12345678"}', "GET https://h/p?key=abcdefgh12345678&q=1", "Authorization: Bearer abcdefgh12345678", "password: 'abcdefgh12345678'", "sk-abcdefgh12345678xyz"]
)
def test_redaction_of_every_form(spark, secret):
    assert "abcdefgh12345678" not in spark.createDataFrame([(secret,)], "t string").select(X.redacted(F.col("t"))).first()[0]


def test_line_numbers_of_many_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"https://{name}/{k}" for k in range(300)) + "\n")
    got = files.urls(spark, f"{tmp_path}/*.txt").collect()
    assert sorted(r["ord"] for r in got) == sorted([*range(1, 301)] * 2)
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"id": f"t{k}", "prompt": "p", "validation": {"language": "go"}}) for k in range(5)))
    assert [(r["line"], r["id"], r["validation"]["language"]) for r in files.tasks(spark, f"{tmp_path}/t.jsonl", 2).collect()] == [(1, "t0", "go"), (2, "t1", "go")]


def test_reports_settings_and_caches(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ("c", None)], "name string, n int")
    files.write_report(df, f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text())[0] == {"name": "a|b", "n": 1}
    files.write_report(df, f"{tmp_path}/r.md", "markdown")
    assert (tmp_path / "r.md").read_text().splitlines() == ["| name | n |", "| --- | --- |", "| a\\|b | 1 |", "| c |  |"]
    files.write_report(df, f"{tmp_path}/rows", "jsonl")
    assert spark.read.json(f"{tmp_path}/rows").count() == 2
    (tmp_path / "s.yml").write_text("host: 'h'  # note\nport: 81\n")
    assert files.settings(f"{tmp_path}/s.yml", {"GRAPHWEAVE_PORT": "82", "GRAPHWEAVE_DEBUG": "yes"}, host="x", port=80, debug=False) == {"host": "h", "port": 82, "debug": True}
    with pytest.raises(ValueError, match="unknown"):
        files.settings(f"{tmp_path}/s.yml", {}, host="x")
    now = datetime.now()
    assert files.fresh(spark, f"{tmp_path}/r.*", now).where("fresh").count() == 2 and files.fresh(spark, f"{tmp_path}/r.*", now + timedelta(days=8)).where("fresh").count() == 0


def test_entry_loads_without_the_libraries_of_training_data():
    code = "import sys; sys.modules['ahocorasick'] = None; sys.modules['tokenizers'] = None; import __spark_entry__ as e; n = e.queries(); assert 'hybrid_query' in n and not any(x.startswith('op') for x in n), n"
    here = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", code], cwd=here, env=os.environ | {"PYTHONPATH": str(here)}, capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr
