"""A crawl in rounds: the next pages of every source in breadth-first order, with robots rules, host by host.

Frontier, visited pages and links found are versioned tables, and a round is one transaction: a crawl
that is stopped goes on where its last whole round ended. Pages are fetched in the tasks by a function
that is passed in; all of a round's pages of one host are fetched by one task, one after another, with
a pause between them. A source is done when it has found `max_urls` links or no page is left.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweave.schema import bounded, top
from graphweave.sources.versions import Store, Transaction

#: url to {"status": int, "content_type": str, "body": str}; raises where there is no answer.
Fetch = Callable[[str], dict]

FRONTIER = "source string, url string, depth int, number long"
VISITED = "source string, url string, depth int, number long, state string"
FOUND = "source string, number long, position int, url string, title string, depth int"
ROBOTS = "host string, body string"


class _Links(HTMLParser):
    """(reference, text) of every anchor with a reference; text only where an anchor holds nothing else."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            href = dict(attrs).get("href")
            self.open = href is not None
            if self.open:
                self.found.append([href, None, 0])
        elif self.open:
            self.found[-1][2] = 9

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open:
            self.found[-1][2] += 1
            self.found[-1][1] = data


def links_of(html: str, url: str, host: str) -> list[tuple[str, str | None]]:
    """Absolute links of one host, in order, each as often as it stands there."""
    parser = _Links()
    parser.feed(html)
    parser.close()
    out = [(urljoin(url, href), text if n == 1 else None) for href, text, n in parser.found]
    return [(link, text) for link, text in out if urlparse(link).netloc == host]


def rules_of(body: str | None) -> RobotFileParser:
    """Rules of a robots file; without one everything is allowed."""
    rules = RobotFileParser()
    rules.parse((body or "").splitlines())
    return rules


@dataclass
class Crawl:
    """A crawl in a folder that driver and executors share; started once, then run in rounds, by one driver at a time."""

    spark: SparkSession
    path: str
    fetch: Fetch
    max_urls: int = 100
    max_depth: int = 2
    batch: int = 10
    pause: float = 1.0
    agent: str = "graphweave"
    sleep: Callable[[float], None] = time.sleep
    store: Store = field(init=False)

    def __post_init__(self) -> None:
        bounded("max_urls", self.max_urls, 1, 100_000)
        bounded("max_depth", self.max_depth, 0, 10)
        bounded("batch", self.batch, 1, 10_000)
        self.store = Store(self.spark, self.path)

    def start(self, sources: DataFrame) -> None:
        """Begins with sources(source, url); a source that was begun before stays as it is."""
        first = sources.groupBy("source").agg(F.min("url").alias("url")).select("source", "url", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("number"))

        def run(t: Transaction) -> None:
            if "frontier" not in t.base.tables:
                t.create("frontier", ["source"], first)
                for name, shape in (("visited", VISITED), ("found", FOUND)):
                    t.create(name, ["source"], self.spark.createDataFrame([], shape).schema)
                t.create("robots", ["host"], self.spark.createDataFrame([], ROBOTS).schema)
            else:
                t.append("frontier", first.join(t.read("frontier").select("source"), "source", "left_anti"))

        self.store.transact(run, "start")

    def due(self, t: Transaction | None = None) -> DataFrame:
        """(source, url, depth, number): the next pages of every source that isn't done, `batch` of each."""
        read = t.read if t else self.store.read
        done = read("found").groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= self.max_urls).select("source")
        left = read("frontier").join(done, "source", "left_anti").join(read("visited").select("source", "url"), ["source", "url"], "left_anti")
        return top(left, ["source"], [F.col("number")], self.batch, "row").drop("row")

    def round(self) -> int:
        """Visits the next pages; how many they were, 0 when the crawl is done."""

        def run(t: Transaction) -> int:
            pages = self.due(t).withColumn("host", F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
            n = pages.count()
            if not n:
                return 0
            known = t.read("robots")
            new = pages.select("host", F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("root")).join(known, "host", "left_anti")
            rules = t.once(self._robots(new))
            seen = t.once(self._visits(pages.join(known.unionByName(rules), "host", "left")))
            t.append("robots", rules)
            t.append("visited", seen.select("source", "url", "depth", "number", "state"))
            links = seen.select("source", "number", "depth", F.posexplode("links").alias("position", "l")).select("source", "number", "position", "l.url", "l.title", (F.col("depth") + 1).alias("depth"))
            t.append("found", links)
            t.append("frontier", self._numbered(t, links))
            return n

        return self.store.transact(run, "round")

    def run(self, most: int = 1000) -> None:
        for _ in range(most):
            if not self.round():
                return

    def found(self) -> DataFrame:
        """(source, place, url, title, depth): the first max_urls links of each source in the order of the crawl, each as often as it was met."""
        return top(self.store.read("found"), ["source"], [F.col("number"), F.col("position")], self.max_urls, "place").select("source", "place", "url", "title", "depth")

    def _numbered(self, t: Transaction, links: DataFrame) -> DataFrame:
        """Links to pages that are new to their source, numbered on in the order in which they were met; no source has more than max_urls at once."""
        held = t.read("frontier")
        first = top(links, ["source"], [F.col("number"), F.col("position")], self.max_urls, "row").where(F.col("depth") <= self.max_depth)
        new = first.groupBy("source", "url").agg(F.min(F.struct("number", "position", "depth")).alias("m")).join(held.select("source", "url"), ["source", "url"], "left_anti")
        last = held.groupBy("source").agg(F.max("number").alias("last"))
        order = F.row_number().over(Window.partitionBy("source").orderBy("m.number", "m.position"))
        return new.withColumn("row", order).join(last, "source").select("source", "url", "m.depth", (F.col("last") + F.col("row")).alias("number"))

    def _robots(self, hosts: DataFrame) -> DataFrame:
        """(host, body) of the robots file of hosts(host, root); nothing where there is none."""
        fetch = self.fetch

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                bodies = []
                for root in part["root"]:
                    try:
                        got = fetch(f"{root}/robots.txt")
                        bodies.append(got["body"] if got["status"] == 200 else None)
                    except Exception:  # a host without an answer has no rules
                        bodies.append(None)
                yield pd.DataFrame({"host": part["host"], "body": bodies})

        return hosts.groupBy("host").agg(F.min("root").alias("root")).mapInPandas(run, ROBOTS)

    def _visits(self, pages: DataFrame) -> DataFrame:
        """pages(source, url, depth, number, host, body) with their state and links; a host's pages one after another."""
        fetch, agent, pause, sleep = self.fetch, self.agent, self.pause, self.sleep

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            host, rules, wait, last = None, None, 0.0, None
            for part in parts:
                states, links = [], []
                for r in part.itertuples(index=False):
                    if r.host != host:
                        host, rules, last = r.host, rules_of(r.body), None
                        wait = max(pause, float(rules.crawl_delay(agent) or 0))
                    if not rules.can_fetch(agent, r.url):
                        states.append("refused")
                        links.append([])
                        continue
                    if last is not None:
                        sleep(max(0.0, wait - (time.monotonic() - last)))
                    last = time.monotonic()
                    try:
                        got = fetch(r.url)
                    except Exception:  # a page without an answer is passed over
                        states.append("failed")
                        links.append([])
                        continue
                    good = got["status"] == 200 and "text/html" in (got.get("content_type") or "")
                    states.append("read" if good else "failed")
                    links.append([{"url": u, "title": x} for u, x in links_of(got.get("body") or "", r.url, r.host)] if good else [])
                yield pd.DataFrame({"source": part["source"], "url": part["url"], "depth": part["depth"], "number": part["number"], "state": states, "links": links})

        by_host = pages.select("source", "url", "depth", "number", "host", "body").repartition("host").sortWithinPartitions("host", "number", "source")
        return by_host.mapInPandas(run, f"{VISITED}, links array<struct<url:string,title:string>>")

