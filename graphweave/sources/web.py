"""Web pages as a source of a graph: pages of URLs, their sections and their links, as the protocol of sources asks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.functions import text as X
from graphweave.operators import ingest

PAGES = "url string, html string, error string"


class WebPages:
    """Pages behind URLs, fetched in the tasks by a function that is passed in: url to {"status", "content_type", "body"}.

    A page is fetched once for every call of articles(); keep the result where sections and links
    are taken from it. What can't be fetched, isn't HTML or has fewer than `least_words` words is no
    article; why is in its error, redacted.
    """

    def __init__(self, fetch: Callable[[str], dict], least_words: int = 200) -> None:
        self.fetch, self.least_words = fetch, least_words

    def pages(self, titles: DataFrame) -> DataFrame:
        """(url, html, error) of titles(title), which are URLs; one row for each of them, however often it is given."""
        fetch = self.fetch

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for url in part["title"]:
                    try:
                        got = fetch(url)
                        wrong = f"status {got['status']}" if got["status"] != 200 else "" if "html" in (got.get("content_type") or "") else "no HTML"
                        rows.append((url, None, wrong) if wrong else (url, got.get("body") or "", None))
                    except Exception as e:  # a page without an answer has its reason
                        rows.append((url, None, str(e) or type(e).__name__))
                yield pd.DataFrame(rows, columns=["url", "html", "error"])

        safe = titles.select("title").distinct().withColumn("safe", X.safe_url(F.col("title")))
        asked = safe.where("safe").select("title").mapInPandas(run, PAGES)
        refused = safe.where("NOT safe").select(F.col("title").alias("url"), F.lit(None).cast("string").alias("html"), F.lit("no public https address").alias("error"))
        return asked.unionByName(refused).withColumn("error", X.redacted(F.col("error")))

    def articles(self, titles: DataFrame) -> DataFrame:
        """(title, text, categories, url, page_links, error) of titles(title): text is Markdown, null where there is no article."""
        raw = self.pages(titles)
        parsed = ingest.pages(raw.where("error IS NULL"), self.least_words)
        thin = ~F.col("found")
        good = parsed.select("title", F.when(~thin, F.col("markdown")).alias("text"), "categories", "url", F.col("links").alias("page_links"), F.when(thin, F.concat(F.lit("only "), F.col("word_count").cast("string"), F.lit(" words"))).alias("error"))
        bad = raw.where("error IS NOT NULL").select(X.title_of_url(F.col("url")).alias("title"), F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("categories"), "url", F.array().cast("array<string>").alias("page_links"), "error")
        return good.unionByName(bad)

    def sections(self, articles: DataFrame) -> DataFrame:
        """(title, section_index, level, heading, content)."""
        return ingest.page_sections(articles.where("text IS NOT NULL").select("title", F.col("text").alias("markdown"))).select("title", "section_index", "level", "heading", "content")

    def links(self, articles: DataFrame) -> DataFrame:
        """(src, dst): an article's title and the URLs of its own host that it leads to."""
        return articles.where("text IS NOT NULL").select(F.col("title").alias("src"), F.explode("page_links").alias("dst")).distinct()
