"""What a caller of the engine's services sees: one function for each, with its bounds and columns, and a command line.

A web framework, a tool server or a shell need only hand parameters over. Language models and
embedders are functions that are passed in.
"""

from __future__ import annotations

import argparse
import json
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave import schema
from graphweave.functions import text as X
from graphweave.operators import answer, graph, retrieve, stats, vector, work_queue
from graphweave.operators.title_index import TitleIndex
from graphweave.operators.vector_index import VectorIndex
from graphweave.schema import bounded
from graphweave.sources import files

Embedder = Callable[[list[str]], list[list[float]]]
#: (question, context) to an answer, whole or bit by bit.
Model = Callable[[str, str], str | Iterable[str]]


@dataclass(frozen=True)
class Graph:
    """articles(title, category, word_count, ...), sections(title, section_id, section_index, content, embedding, ...), edges(src, dst), facts(title, content).

    Stored indexes of the sections' vectors and of the titles, and a kept table of degrees, are used
    where they are there.
    """

    articles: DataFrame
    sections: DataFrame
    edges: DataFrame
    facts: DataFrame
    vectors: VectorIndex | None = None
    titles: TitleIndex | None = None
    degrees: DataFrame | None = None

    def seed(self, **columns: str) -> DataFrame:
        return self.articles.sparkSession.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))


def search(g: Graph, query: str, category: str | None = None, limit: int = 10, threshold: float = 0.0) -> DataFrame:
    """(title, similarity, rank, category, word_count, summary) of articles like one; the threshold is held against the first `limit`."""
    bounded("limit", limit, 1, 100)
    bounded("threshold", threshold, 0, 1)
    found = vector.semantic_search(g.sections, g.seed(seed=query), g.articles, category, limit, g.vectors).where(F.col("similarity") >= threshold)
    lead = g.sections.where("section_index = 0").select("title", X.summary(F.col("content")).alias("summary"))
    return found.join(g.articles.select("title", "category", "word_count"), "title").join(lead, "title", "left").select("title", "similarity", "rank", "category", "word_count", "summary")


def autocomplete(g: Graph, q: str, limit: int = 10) -> DataFrame:
    """(title, category, match_type); q has two characters or more."""
    bounded("limit", limit, 1, 20)
    return retrieve.autocomplete(g.articles, q, limit, g.titles)


def hybrid_search(g: Graph, query: str, category: str | None = None, max_hops: int = 2, limit: int = 10) -> DataFrame:
    """(title, similarity, hops, score, rank, category, word_count) of articles both near and linked."""
    bounded("max_hops", max_hops, 1, 3)
    bounded("limit", limit, 1, 100)
    found = retrieve.hybrid_query(g.sections, g.edges, g.articles, g.seed(seed=query), category, max_hops, limit).drop("seed")
    return found.join(g.articles.select("title", "category", "word_count"), "title")


def neighbourhood(g: Graph, article: str, depth: int = 2, limit: int = 50, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (title, depth, category, word_count, links) around an article, and the edges (src, dst) among them."""
    bounded("depth", depth, 1, 3)
    bounded("limit", limit, 1, 200)
    nodes = graph.graph_neighbors(g.edges, g.seed(seed=article), g.articles, depth, limit, category)
    return nodes.drop("seed"), graph.induced_edges(g.edges, nodes).drop("seed")


def article(g: Graph, title: str, most: int = 500) -> DataFrame:
    """One row (title, category, word_count, sections, links, backlinks), or none; sections by their index."""
    own = g.articles.where(F.col("title") == title).select("title", "category", "word_count")
    parts = g.sections.where(F.col("title") == title).agg(F.array_sort(F.collect_list(F.struct("section_index", "content"))).alias("sections"))
    ends = [g.edges.where(F.col(a) == title).select(b).distinct().orderBy(b).limit(most).agg(F.sort_array(F.collect_list(b)).alias(name)) for a, b, name in (("src", "dst", "links"), ("dst", "src", "backlinks"))]
    return own.join(parts, F.lit(True)).join(ends[0], F.lit(True)).join(ends[1], F.lit(True))  # one row each


def categories(g: Graph) -> DataFrame:
    return stats.categories(g.articles)


def statistics(g: Graph) -> DataFrame:
    """One row: articles, sections, links, both by article, and how many categories there are. Callers keep it for a while."""
    return stats.averages(g.articles, g.sections, g.edges).join(g.articles.agg(F.count_distinct("category").alias("categories")), F.lit(True))


class Kept:
    """A value that is found again once it is older than `seconds`, as pages ask for statistics far more often than they change."""

    def __init__(self, find: Callable[[], dict], seconds: float = 60, clock: Callable[[], float] = time.monotonic) -> None:
        self.find, self.seconds, self.clock = find, seconds, clock
        self.held: tuple[float, dict] | None = None
        self.lock = threading.Lock()

    def __call__(self) -> dict:
        with self.lock:  # of callers at once one looks
            if self.held is None or self.clock() - self.held[0] >= self.seconds:
                self.held = self.clock(), self.find()
            return self.held[1]


def kept_statistics(g: Graph, seconds: float = 60, clock: Callable[[], float] = time.monotonic) -> Kept:
    return Kept(lambda: statistics(g).first().asDict(), seconds, clock)


def _told(g: Graph, question: str, embed: Embedder, max_results: int, score: Callable | None) -> tuple[list[str], str]:
    """The titles that a question's answer is drawn from, and the text that goes to the model."""
    bounded("max_results", max_results, 1, 1000)
    asked = g.seed(seed="q", question=question)
    chosen = answer.sources(g.sections, g.articles, g.edges, asked, vector.query_vectors(g.sections, asked, embed), max_results, score=score, index=g.vectors, titles=g.titles, degrees=g.degrees).persist()
    try:
        titles = [r["title"] for r in chosen.orderBy("place").collect()]
        bodies = answer.context(g.sections, g.facts, asked, chosen).collect() if titles else []
    finally:
        chosen.unpersist()
    return titles, bodies[0]["body"] if bodies else ""


NO_SOURCE = "No source in the graph answers this."


def chat(g: Graph, question: str, embed: Embedder, model: Model, max_results: int = 10, score: Callable | None = None) -> dict:
    """The whole way of a question: {answer, sources, context}. Without any source the model isn't asked."""
    titles, told = _told(g, question, embed, max_results, score)
    said = model(question, told) if titles else NO_SOURCE
    return {"answer": said if isinstance(said, str) else "".join(said), "sources": titles, "context": told}


def chat_events(g: Graph, question: str, embed: Embedder, model: Model, max_results: int = 10, score: Callable | None = None) -> Iterator[tuple[str, str]]:
    """(event, JSON) in the order of a stream: the sources before the model is asked, its words as they come, the end.

    A model gives its answer whole or bit by bit. An error takes the place of the rest, redacted.
    """
    try:
        titles, told = _told(g, question, embed, max_results, score)
        yield "sources", json.dumps(titles)
        said = model(question, told) if titles else NO_SOURCE
        for part in [said] if isinstance(said, str) else said:
            yield "token", json.dumps(part)
        yield "done", "{}"
    except Exception as e:  # a stream that has begun can only tell
        message = g.seed(m=str(e)).select(X.redacted(F.col("m"))).first()[0]
        yield "error", json.dumps(message)


def list_packs(root: Path) -> list[dict]:
    """Name, version and description of every whole pack."""
    held = (json.loads((p / "manifest.json").read_text()) for p in files.packs(root))
    return [{k: m.get(k) for k in ("name", "version", "description")} for m in held]


def pack_info(root: Path, name: str) -> dict:
    """A pack's manifest; the name is checked before it becomes part of a path."""
    return json.loads((files.inside(root, name) / "manifest.json").read_text())


@dataclass(frozen=True)
class Tools:
    """What a tool server offers over a folder of packs; packs are called by name, and their graphs opened by a function that is passed in."""

    root: Path
    open_graph: Callable[[Path], Graph]
    embed: Embedder
    model: Model

    def list_packs(self) -> list[dict]:
        return list_packs(self.root)

    def pack_info(self, pack_name: str) -> dict:
        """The manifest, and whether database and list of URLs are there."""
        place = files.inside(self.root, pack_name)
        return pack_info(self.root, pack_name) | {"db_exists": (place / "pack.db").exists(), "urls_file_exists": (place / "urls.txt").exists()}

    def query_knowledge_pack(self, pack_name: str, question: str, max_results: int = 5) -> dict:
        """{answer, sources, context} from a pack, or {error, pack} where it can't be asked."""
        try:
            place = files.inside(self.root, pack_name)
            if not (place / "pack.db").exists():
                raise FileNotFoundError(f"{pack_name} has no database")
            return chat(self.open_graph(place), question, self.embed, self.model, max_results)
        except Exception as e:  # a tool's caller gets the reason as its result
            return {"error": str(e), "pack": pack_name}

    def offered(self) -> dict[str, Callable]:
        return {f.__name__: f for f in (self.list_packs, self.pack_info, self.query_knowledge_pack)}


def stored_graph(spark: SparkSession, prefix: str = "") -> Graph:
    """The graph in the session's tables."""
    t = lambda name: spark.table(f"{prefix}{name}".lower())
    sections = t("section").join(t("has_section").select(F.col("src"), F.col("dst").alias("section_id"), "section_index"), "section_id")
    return Graph(t("article"), sections.drop("title").withColumnRenamed("src", "title"), t("links_to"), t("has_fact").select(F.col("src").alias("title"), F.col("dst").alias("fact_id")).join(t("fact"), "fact_id"))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None, embed: Embedder | None = None, model: Model | None = None) -> int:
    """The command line: create, status, query (with the functions for vectors and answers that a program passes in), search, autocomplete, hybrid, graph, and pack list, info, validate, install, update, remove."""
    p = argparse.ArgumentParser(prog="graphweave")
    p.add_argument("--prefix", default="", help="of the tables' names")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("create", "status"):
        sub.add_parser(name)
    for name in ("query", "search", "autocomplete", "hybrid", "graph"):
        one = sub.add_parser(name)
        one.add_argument("query")
        one.add_argument("--limit", type=int, default=10)
        one.add_argument("--category")
    pack = sub.add_parser("pack")
    pack.add_argument("action", choices=("list", "info", "validate", "install", "update", "remove", "create"))
    pack.add_argument("name", nargs="?", default="")
    pack.add_argument("--root", type=Path, default=Path("packs"))
    a = p.parse_args(arguments)
    if a.command == "pack":
        return _pack(a.action, a.name, a.root)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "create":
        print("\n".join(schema.create_tables(spark, a.prefix)))
        return 0
    g = stored_graph(spark, a.prefix)
    if a.command == "query":
        if embed is None or model is None:
            p.error("query needs a function for vectors and one for answers")
        print(json.dumps(chat(g, a.query, embed, model, a.limit), indent=2, ensure_ascii=False))
        return 0
    run = {
        "status": lambda: work_queue.queue_stats(g.articles), "search": lambda: search(g, a.query, a.category, a.limit), "autocomplete": lambda: autocomplete(g, a.query, a.limit),
        "hybrid": lambda: hybrid_search(g, a.query, a.category, limit=a.limit), "graph": lambda: neighbourhood(g, a.query, limit=a.limit, category=a.category)[0],
    }
    for row in run[a.command]().toJSON().collect():
        print(row)
    return 0


def archive_name(archive: Path) -> str:
    """The name of the pack in an archive called name.tar.gz or name-1.2.3.tar.gz."""
    return re.sub(r"(-\d+(\.\d+)*)?(\.tar\.gz|\.tgz)$", "", archive.name)


def _pack(action: str, name: str, root: Path) -> int:
    if action == "list":
        print(json.dumps(list_packs(root), indent=2))
    elif action == "info":
        print(json.dumps(pack_info(root, name), indent=2))
    elif action == "install":
        print(files.unpackage(Path(name), root))
    elif action == "update":
        print(" to ".join(map(str, files.update_pack(Path(name), root, archive_name(Path(name))))))
    elif action == "create":
        print(files.package(Path(name), root / f"{Path(name).name}.tar.gz"))
    elif action == "remove":
        pack_info(root, name)
        files.remove(root, name)
    else:
        errors = files.pack_errors(Path(name))
        print("\n".join(errors) or "valid")
        return int(bool(errors))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
