"""Web pages as a source."""

from __future__ import annotations

from graphweave.sources import web

WORDS = " ".join(f"word{k}" for k in range(30))
PAGES = {
    "https://a.test/docs/good-page": (200, "text/html", f'<title>Good | A</title><h1>Good</h1><p>{WORDS}</p><h2>More</h2><p>{WORDS}</p><a href="/x">x</a><a href="https://b.test/y">y</a>'),
    "https://a.test/thin": (200, "text/html", "<p>few words</p>"),
    "https://a.test/gone.html": (404, "text/html", ""),
    "https://a.test/file": (200, "application/pdf", "x"),
}


def test_pages_sections_and_links(spark):
    pages = PAGES

    def fetch(url):
        if url not in pages:
            raise OSError("token=abcdefgh12345 refused")
        status, kind, body = pages[url]
        return {"status": status, "content_type": kind, "body": body}

    source = web.WebPages(fetch, least_words=20)
    asked = [*PAGES, "https://a.test/none", "http://a.test/plain", "https://127.0.0.1/x", next(iter(PAGES))]
    articles = source.articles(spark.createDataFrame([(u,) for u in asked], "title string")).persist()
    errors = {r["url"]: r["error"] for r in articles.collect()}
    assert len(errors) == 7 == articles.count()
    assert errors["https://a.test/docs/good-page"] is None and errors["https://a.test/thin"] == "only 2 words"
    assert errors["https://a.test/gone.html"] == "status 404" and errors["https://a.test/file"] == "no HTML"
    assert errors["http://a.test/plain"] == errors["https://127.0.0.1/x"] == "no public https address"
    assert "refused" in errors["https://a.test/none"] and "abcdefgh12345" not in errors["https://a.test/none"]
    assert [(r["section_index"], r["level"], r["heading"]) for r in source.sections(articles).orderBy("section_index").collect()] == [(0, 1, "Good"), (1, 2, "More")]
    assert [tuple(r) for r in source.links(articles).collect()] == [("Good", "https://a.test/x")]
    articles.unpersist()
    assert source.articles(spark.createDataFrame([], "title string")).count() == 0
