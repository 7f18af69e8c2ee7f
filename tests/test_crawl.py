"""The crawl in rounds against a plain queue over a made-up site, and the history of pages."""

from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta
from pathlib import Path
from urllib.parse import urljoin, urlparse
from urllib.robotparser import RobotFileParser

import pytest

from graphweave.operators import snapshots
from graphweave.operators.crawl import Crawl, links_of

ROBOTS = "User-agent: *\nDisallow: /private\nCrawl-delay: 2\n"


def site(seed, n=40):
    """Pages of two hosts: url to (status, kind, html)."""
    rng, pages = random.Random(seed), {}
    for host in ("a.test", "b.test"):
        names = ["/", *(f"/p{k}" for k in range(n)), "/private/x", "/file.pdf", "/gone"]
        for name in names:
            links = [rng.choice([x, f"https://{host}{x}", f"https://other.test{x}", x.lstrip("/") or "."]) for x in rng.choices(names, k=6)]
            status, kind = (404, "text/html") if name == "/gone" else (200, "application/pdf" if name.endswith("pdf") else "text/html; charset=utf-8")
            pages[f"https://{host}{name}"] = (status, kind, "".join(f'<p><a href="{x}">to {k}</a>' for k, x in enumerate(links)) + "<a>none</a>")
    return pages


def by_queue(pages, base, most, deepest):
    """Links in the order of one worker, and the pages that it asks for."""
    rules = RobotFileParser()
    rules.parse(ROBOTS.splitlines())
    host, seen, todo, out, asked = urlparse(base).netloc, set(), deque([(base, 0)]), [], []
    while todo and len(out) < most:
        url, depth = todo.popleft()
        if url in seen or depth > deepest:
            continue
        seen.add(url)
        if not rules.can_fetch("graphweave", url):
            continue
        asked.append(url)
        status, kind, html = pages.get(url, (404, "", ""))
        if status != 200 or "text/html" not in kind:
            continue
        for part in html.split('<a href="')[1:]:
            link = urljoin(url, part.split('"')[0])
            if urlparse(link).netloc == host:
                out.append(link)
                if depth < deepest:
                    todo.append((link, depth + 1))
                if len(out) >= most:
                    break
    return out[:most], asked


def fetcher(pages, log):
    def fetch(url):
        if url.endswith("/robots.txt"):
            return {"status": 200, "content_type": "text/plain", "body": ROBOTS}
        with open(log, "a") as f:
            f.write(url + "\n")
        if url not in pages:
            raise OSError("no answer")
        status, kind, html = pages[url]
        return {"status": status, "content_type": kind, "body": html}

    return fetch


def found(crawl):
    out = {}
    for r in crawl.found().orderBy("place").collect():
        out.setdefault(r["source"], []).append(r["url"])
    return out


@pytest.mark.parametrize(("most", "deepest", "batch"), [(25, 2, 2), (60, 2, 6)])
def test_same_links_in_the_same_order(spark, tmp_path, most, deepest, batch):
    pages, log = site(most), str(tmp_path / "log")
    bases = {"A": "https://a.test/", "B": "https://b.test/", "none": "https://nobody.test/"}
    crawl = Crawl(spark, f"file://{tmp_path}/c", fetcher(pages, log), most, deepest, batch, 0.0, sleep=lambda seconds: None)
    crawl.start(spark.createDataFrame(list(bases.items()), "source string, url string"))
    assert crawl.round() > 0
    again = Crawl(spark, f"file://{tmp_path}/c", fetcher(pages, log), most, deepest, batch, 0.0, sleep=lambda seconds: None)  # another driver goes on
    again.start(spark.createDataFrame(list(bases.items()), "source string, url string"))
    again.run()
    want = {s: by_queue(pages, b, most, deepest) for s, b in bases.items()}
    assert found(again) == {s: w[0] for s, w in want.items() if w[0]}
    asked = Path(log).read_text().split()
    assert len(asked) == len(set(asked)) and not any("/private" in u for u in asked)
    for _, w in want.values():
        assert set(w) <= set(asked)
    over = len(asked) - sum(len(w) for _, w in want.values())
    assert 0 <= over <= 3 * (batch - 1)


def test_a_host_is_asked_slowly_and_a_failed_round_leaves_nothing(spark, tmp_path):
    pages, log = site(3), str(tmp_path / "log")
    naps = str(tmp_path / "naps")

    def sleep(seconds):
        with open(naps, "a") as f:
            f.write(f"{seconds}\n")

    crawl = Crawl(spark, f"file://{tmp_path}/c", fetcher(pages, log), 50, 1, 5, 0.5, sleep=sleep)
    crawl.start(spark.createDataFrame([("A", "https://a.test/")], "source string, url string"))
    crawl.run()
    assert all(1.5 < float(x) <= 2 for x in Path(naps).read_text().split())  # the site's own rule is slower than ours
    broken = Crawl(spark, f"file://{tmp_path}/d", fetcher(pages, log), 50, 1, 5, 0.0, sleep=lambda seconds: None)
    broken.start(spark.createDataFrame([("A", "https://a.test/")], "source string, url string"))
    number, broken._numbered = broken.store.version().number, None
    with pytest.raises(TypeError):
        broken.round()
    assert broken.store.version().number == number and broken.store.read("visited").count() == 0


def test_links():
    html = '<a href="/x">one</a><a href="y?z=1">t<b>w</b></a><a href="https://o.test/">no</a><a name="n">no</a><a href="#f"></a>'
    assert links_of(html, "https://a.test/d/e", "a.test") == [("https://a.test/x", "one"), ("https://a.test/d/y?z=1", None), ("https://a.test/d/e#f", None)]


T0 = datetime(2024, 1, 1)
CRAWL = "pack string, url string, status int, error string, etag string, last_modified string, hash string"


def crawled(spark, *rows):
    return spark.createDataFrame([("p", u, s, e, *v) for u, s, e, v in rows], CRAWL)


def test_history_of_pages(spark, tmp_path):
    h = snapshots.UrlHistory(spark, f"file://{tmp_path}/h")
    ok = lambda u, *v: (u, 200, None, v)
    h.record(crawled(spark, ok("a", "e1", None, "h1"), ok("b", "e1", None, None), ok("c", None, "m1", None), ("d", 500, None, ("x", "x", "x")), ok("e", None, None, "h1")), T0)
    two = crawled(spark, ok("a", "e1", None, "h2"), ok("b", "e2", None, None), ok("c", None, "m1", "h9"), ok("d", "e1", None, None), ("e", 0, "timeout", (None, None, None)))
    day = T0 + timedelta(days=1)
    known = snapshots.current(h.read())
    kinds = {r["url"]: r["kind"] for r in snapshots.compared(known, two).collect()}
    assert kinds == {"a": "changed", "b": "changed", "c": "same", "d": "first", "e": "error"}
    assert [tuple(r) for r in snapshots.freshness(known, two).select("checked", "changed", "needs_rebuild").collect()] == [(4, 2, True)]
    for _ in range(2):  # a crawl that is recorded twice counts once
        h.record(two, day)
    h.record(spark.createDataFrame([("q", "a", 200, None, "z", None, None)], CRAWL), day)
    h.record(crawled(spark, ok("a", "e1", None, "h2"), ok("c", None, "m1", "h9")), day + timedelta(days=1))
    got = sorted((r["pack"], r["url"], r["etag"], r["hash"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day) for r in h.read().collect() for r in [r.asDict()])
    got = [tuple("-" if x is None else x for x in r) for r in got]
    assert got == sorted([("p", "a", "e1", "h1", 1, 2), ("p", "a", "e1", "h2", 2, "-"), ("p", "b", "e1", "-", 1, 2), ("p", "b", "e2", "-", 2, 3), ("p", "c", "-", "h9", 1, "-"), ("p", "d", "e1", "-", 2, 3), ("p", "e", "-", "h1", 1, 3), ("q", "a", "z", "-", 2, "-")])
    assert {r["url"] for r in snapshots.as_of(h.read(), T0 + timedelta(hours=5)).collect()} == {"a", "b", "c", "e"}
