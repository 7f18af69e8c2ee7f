"""Text, URL, version and page functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphweave.functions import text as X
from graphweave.operators import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("n", "want"), [(19, 0.0), (20, 0.26), (200, 0.8), (400, 0.8)])
def test_quality_by_length(spark, n, want):
    got = one(spark, X.section_quality(F.col("a"), F.col("q")), a=" ".join(["word"] * n), q="the of")
    assert got == pytest.approx(want)


def test_quality_by_keywords(spark):
    text = " ".join(["Alpha"] * 200)
    assert one(spark, X.section_quality(F.col("a"), F.col("q")), a=text, q="alpha beta") == pytest.approx(0.9)
    assert one(spark, X.section_quality(F.col("a"), F.col("q")), a=text, q="what is alpha") == pytest.approx(1.0)


@pytest.mark.parametrize(("said", "want"), [("Co-Founded", "founded"), ("co-authored", "co_authored"), ("Depends on", "requires"), ("unknown verb", "unknown_verb"), ("part_of", "part_of"), (" Wrote ", "authored")])
def test_relations(spark, said, want):
    assert one(spark, X.relation(F.col("a")), a=said) == want


@pytest.mark.parametrize(("title", "want"), [("Python", True), ("Wikipedia:About", False), ("List of x", False), ("list of x", True), ("X (disambiguation)", False), ("FILE:a", False), ("a", False), ("", False)])
def test_links(spark, title, want):
    assert one(spark, X.valid_link(F.col("a")), a=title) is want


@pytest.mark.parametrize(("a", "b", "want"), [("1.0.0", "1.0.0-alpha", 1), ("1.10.0", "1.9.0", 1), ("1.0.0+x", "1.0.0", 0), ("1.0.0-a", "1.0.0-b", -1), ("1.0", "1.0.0", None)])
def test_versions(spark, a, b, want):
    assert one(spark, X.compare_versions(F.col("a"), F.col("b")), a=a, b=b) == want


def test_cleaning(spark):
    text = "Feedback\n\n\n\nok\n12\nIn this article we share a long line\nHome > Docs > Section > Page\nplain text stays"
    assert one(spark, X.clean(F.col("a")), a=text) == "we share a long line\nplain text stays"
    assert one(spark, X.clean(F.col("a")), a="nothing special\n\n\n\nabc\nhere it is") == "nothing special\n\nhere it is"


def test_questions(spark):
    assert one(spark, X.normal_question(F.col("a")), a="What is Spark? ") == "spark"
    assert one(spark, X.search_terms(F.col("a")), a="Tell me about Deep Learning? now please") == ["Deep", "Learning?", "please"]


def test_domain(spark):
    assert one(spark, X.domain(F.split("a", ",")), a="War history,battle") == "history"
    assert one(spark, X.domain(F.split("a", ",")), a="war") is None


def test_redaction(spark):
    got = one(spark, X.redacted(F.col("a")), a="api_key=abcdefgh12345 at /home/me/x and https://u:p@h/ Bearer abc.def")
    assert "abcdefgh12345" not in got and "/home/me" not in got and "u:p@" not in got and "abc.def" not in got


def test_judge(spark):
    assert one(spark, X.judge_score(F.col("a")), a='```json\n{"score": 12}\n```') == 10
    assert one(spark, X.judge_score(F.col("a"), None), a="Score: 7 of 10") == 7
    assert one(spark, X.judge_score(F.col("a")), a="none") == 0


PAGE = '<html><head><title>Big &amp; Small | Site</title></head><body><nav><a href="/n">n</a></nav><h1>Top</h1><p>One &lt; two</p><ul><li>x</li></ul><pre><code>c</code></pre><a href="/a">a</a><a href="#f">f</a><a href="b?c=1">b</a><a href="https://other/x">o</a><a href="/a">again</a></body></html>'


def test_pages(spark):
    web = spark.createDataFrame([("https://h/docs/big-page/v2/index", PAGE)], "url string, html string")
    r = ingest.pages(web, 3).first()
    assert r["title"] == "Big & Small"
    assert r["links"] == ["https://h/n", "https://h/a", "https://h/docs/big-page/v2/b?c=1"]
    assert r["categories"] == ["Big Page"]
    assert r["markdown"].startswith("Big & Small | Site\n# Top\n\nOne < two") and "- x" in r["markdown"]


def test_sections(spark):
    md = "intro text that is long enough\n# Head\nshort\n## Sub\nthis one is also long enough"
    df = spark.createDataFrame([(md,)], "a string").select(ingest.markdown_sections(F.col("a")).alias("s"))
    assert [tuple(x) for x in df.first()["s"]] == [(2, "Introduction", "intro text that is long enough"), (2, "Sub", "this one is also long enough")]


def test_wikitext():
    text = "== A ==\n{{x|{{y}}}}'''Bold''' [[File:z.png|thumb]] [[link|shown]] <ref>no</ref> " + "word " * 30 + "\n=== B ===\nshort"
    (s,) = ingest.wiki_sections_of(text)
    assert s["level"] == 2 and s["title"] == "A" and "shown" in s["content"] and "{{" not in s["content"] and "no" not in s["content"].split()


@pytest.mark.parametrize(("n", "want"), [(0, []), (2000, [2000]), (2001, [2000, 401]), (3300, [2000, 1700, 100])])
def test_chunks_without_sentences(n, want):
    assert [len(c) for c in ingest.chunks_of("x" * n)] == want


def test_chunks_end_at_sentences():
    a, b = ingest.chunks_of("x" * 1500 + ". " + "y" * 1000)
    assert a == "x" * 1500 + "." and b.startswith("x" * 399)
    with pytest.raises(ValueError):
        ingest.chunks_of("x", 5, 5)


def test_urls_and_queries(spark):
    assert one(spark, X.wiki_url(F.col("a")), a="C (language)/é") == "https://en.wikipedia.org/wiki/C_%28language%29/%C3%A9"
    assert one(spark, X.title_of_url(F.col("a")), a="https://h/docs/error-handling.html") == "Error Handling"
    assert one(spark, X.listed_urls(F.col("a")), a='<loc>https://h/a&amp;b</loc><link>https://h/c</link><link href="https://h/d"/><loc>https://h/c</loc>') == ["https://h/a&b", "https://h/c", "https://h/d"]
    assert [tuple(s) for s in one(spark, X.heading_sections(F.col("a")), a="intro\n# A\nx\n## B\n\n# C\ny")] == [("", "intro"), ("A", "x"), ("C", "y")]
    for query, want in (("MATCH (a) RETURN 'DELETE'", True), ("match (a) set a.x = 1", False), ("MATCH (a)-[:L*1..3]->(b) RETURN b", False), ("RETURN 1", False)):
        assert one(spark, X.safe_query(F.col("a")), a=query) is want
    assert one(spark, X.safe_url(F.col("a")), a="https://10.0.0.1/x") is False and one(spark, X.safe_url(F.col("a")), a="https://h.org/x") is True


def test_sanitised_records(spark):
    df = spark.createDataFrame([([(" a ", "Wrote", "b", None), ("", "x", "y", "c"), ("a", " ", "b", "c")], [" f ", "", None])], "r array<struct<source:string,relation:string,target:string,context:string>>, f array<string>")
    r = df.select(X.relations_sane(F.col("r")).alias("r"), X.facts_sane(F.col("f")).alias("f")).first()
    assert [tuple(x) for x in r["r"]] == [("a", "authored", "b", ""), ("a", "related_to", "b", "c")] and r["f"] == ["f"]


def test_validators(spark):
    from graphweave.operators import evaluate

    rows = [("p", "python", "```python\ndef f():\n    return 1\n```", ["return"], ["eval"], [r"def \w+", "class"]), ("b", "python", "def f(:", [], [], []), ("j", "json", '{"a": 1}', ["a", "z"], ["a"], []), ("r", "rust", "fn x() { (", [], [], [])]
    df = spark.createDataFrame(rows, "id string, language string, output string, must_contain array<string>, must_not_contain array<string>, expected_constructs array<string>")
    got = {r["id"]: (r["syntax"], r["required"], r["forbidden"], r["constructs"]) for r in evaluate.validation(df).collect()}
    assert got == {"p": (1, 1, 1, 0.5), "b": (0, 1, 1, 1), "j": (1, 0.5, 0, 1), "r": (1, 1, 1, 1)}


def test_embedding_is_injected(spark):
    from graphweave.operators import vector

    df = spark.createDataFrame([("a", "xx"), ("b", None)], "seed string, text string")
    got = {r["seed"]: r["query_vector"] for r in vector.embed(df, lambda ts: [[len(t), 1] for t in ts], prefix="q:").collect()}
    assert got == {"a": [4.0, 1.0], "b": [2.0, 1.0]}


def test_display_formats(spark):
    df = spark.createDataFrame([(5, 10, 3661), (0, 0, 65), (30, 10, 5)], "done int, total int, seconds int")
    got = [tuple(r) for r in df.select(X.progress_bar(F.col("done"), F.col("total"), 10), X.duration(F.col("seconds"))).collect()]
    assert got == [("[#####-----]", "1h 1m"), ("[----------]", "1m 5s"), ("[##########]", "5s")]


def test_wiki_links_are_trimmed_of_blanks_only(spark):
    df = spark.createDataFrame([("[[1 A ]] [[ 0]] [[File:x.png]] [[b|c]]",)], "t string")
    assert df.select(X.wiki_links(F.col("t"))).first()[0] == ["1 A", "0", "b"]


@pytest.mark.parametrize(("page", "want"), [("a&amp;b &copy; &#233;&#xE9;", "a&b \u00a9 \u00e9\u00e9"), ("a&ampb &amp\u00e9 &copy", "a&ampb &amp\u00e9 &copy"), ("&notit; &#65 &amp;lt;", "&notit; &#65 &lt;")])
def test_references_need_their_semicolon(spark, page, want):
    """A text that is cut within a reference keeps what is left of it, in Markdown as in titles and in the SQL."""
    assert ingest.markdown_of(f"<p>{page}</p>") == want
    assert one(spark, ingest.html_to_markdown(F.col("a")), a=page) == want
