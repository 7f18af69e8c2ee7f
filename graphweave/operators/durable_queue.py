"""The graph's writes and its work queue as transactions on versioned tables.

Every function is one transaction of `versions.Store`: it takes effect as a whole, and of workers that
touch the same rows at once the later one looks again. Only the buckets that hold a call's titles are
rewritten, so a claim of ten articles doesn't cost a pass of writing over all of them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators import ingest, work_queue
from graphweave.schema import EDGES, NODES
from graphweave.sources.versions import Store, Transaction

#: Keys by which the tables of a graph are dealt into buckets and replaced; children by their parent.
KEYS = {"Article": "title", "Section": "title", "Category": "name", "Entity": "entity_id", "Fact": "fact_id", "Chunk": "article_title"} | {edge: "src" for edge in EDGES}


def create(spark: SparkSession, path: str, buckets: int = 16, **tables: DataFrame) -> Store:
    """A store with the tables of the whole schema: those given by name with their rows, the others empty."""
    store = Store(spark, path, buckets)
    if unknown := sorted(set(tables) - set(KEYS)):
        raise ValueError(f"no tables of the schema: {', '.join(unknown)}")

    def make(t: Transaction) -> None:
        for name, shape in {**NODES, **EDGES}.items():
            if name not in t.base.tables:
                t.create(name, [KEYS[name]], tables.get(name, shape))

    store.transact(make, "create")
    return store


def _titles(store: Store, titles: list[str]) -> DataFrame:
    return store.spark.createDataFrame([(t,) for t in titles], "title string")


def claim(store: Store, batch: int, now: datetime) -> list[str]:
    """Titles that are now claimed by this caller and no other: the least deep discovered ones, by title in a tie."""

    def run(t: Transaction) -> list[str]:
        due, _ = work_queue.claim(t.read("Article"), batch, now)
        mine = [r["title"] for r in due.collect()]  # batch of them
        if mine:
            t.update("Article", _titles(store, mine), lambda rows: rows.withColumns({
                "expansion_state": F.when(F.col("title").isin(mine), "claimed").otherwise(F.col("expansion_state")), "claimed_at": F.when(F.col("title").isin(mine), F.lit(now)).otherwise(F.col("claimed_at")),
            }))
        return mine

    return store.transact(run, "claim")


def heartbeat(store: Store, titles: list[str], now: datetime) -> None:
    store.transact(lambda t: t.update("Article", _titles(store, titles), lambda rows: work_queue.heartbeat(rows, titles, now)), "heartbeat")


def advance(store: Store, titles: list[str], state: str, now: datetime) -> None:
    store.transact(lambda t: t.update("Article", _titles(store, titles), lambda rows: work_queue.advance(rows, titles, state, now)), state)


def fail(store: Store, titles: list[str], most: int = 3) -> None:
    store.transact(lambda t: t.update("Article", _titles(store, titles), lambda rows: work_queue.fail(rows, titles, most)), "fail")


def reclaim(store: Store, now: datetime, seconds: int = 300) -> int:
    """How many claims went back as nobody had renewed them for `seconds`."""

    def run(t: Transaction) -> int:
        old = t.read("Article").where(work_queue.stale(now, seconds)).select("title")
        t.update("Article", old, lambda rows: work_queue.reclaim(rows, now, seconds))
        return old.count()

    return store.transact(run, "reclaim")


def discover(store: Store, found: DataFrame, max_depth: int = 2) -> None:
    """Articles and edges of found(src, dst, depth) that are new; another worker's article of that title stays as it is."""

    def run(t: Transaction) -> None:
        fresh, edges = ingest.discover_links(found, t.read("Article"), t.read("LINKS_TO"), max_depth)
        rows = fresh.select("title", "expansion_state", F.col("expansion_depth").cast("int").alias("expansion_depth"), F.lit(0).alias("word_count"), F.lit(0).alias("retry_count"))
        t.update("Article", rows.select("title"), lambda old: old.unionByName(rows.join(old.select("title"), "title", "left_anti"), allowMissingColumns=True))
        linked = edges.select("src", "dst", F.lit("internal").alias("link_type"))
        t.update("LINKS_TO", linked.select("src"), lambda old: old.unionByName(linked.join(old.select("src", "dst"), ["src", "dst"], "left_anti")))

    store.transact(run, "discover")


def load(store: Store, loaded: DataFrame, sections: DataFrame, categories: DataFrame, now: datetime) -> None:
    """An article with all that hangs on it, at once: loaded(title, category, word_count), its sections in place of old ones, category counts.

    sections(title, section_id, section_index, content, level, word_count, embedding); categories(name,
    article_count) are added to the counts.
    """
    parts = sections.select("section_id", "title", "content", "embedding", "level", "word_count")
    edges = sections.select(F.col("title").alias("src"), F.col("section_id").alias("dst"), "section_index")

    def run(t: Transaction) -> None:
        stamped = loaded.withColumn("processed_at", F.lit(now))
        t.update("Article", loaded.select("title"), lambda old: ingest.upsert_articles(old, stamped).join(old.select("title", "claimed_at"), "title", "left"))
        gone = loaded.select("title")
        t.update("Section", gone, lambda old: old.join(gone, "title", "left_anti").unionByName(parts.select(*old.columns)))
        t.update("HAS_SECTION", gone.select(F.col("title").alias("src")), lambda old: old.join(gone.select(F.col("title").alias("src")), "src", "left_anti").unionByName(edges))
        t.update("Category", categories.select("name"), lambda old: ingest.merge_counts(old, categories))

    store.transact(run, "load")


def remove(store: Store, titles: list[str]) -> None:
    """Articles with their sections and all edges from and to them."""
    gone = _titles(store, titles)

    def run(t: Transaction) -> None:
        ends = gone.select(F.col("title").alias("end"))
        t.delete("Article", gone)
        t.delete("Section", gone)
        for edge in ("HAS_SECTION", "LINKS_TO", "IN_CATEGORY", "HAS_ENTITY", "HAS_FACT", "HAS_CHUNK"):
            old = t.read(edge)
            hit = old.join(ends, F.col("src") == F.col("end"), "left_semi").select("src")
            if edge == "LINKS_TO":
                hit = hit.union(old.join(ends, F.col("dst") == F.col("end"), "left_semi").select("src"))
            t.update(edge, hit, lambda rows: rows.join(ends, F.col("src") == F.col("end"), "left_anti").join(ends, F.col("dst") == F.col("end"), "left_anti"))

    store.transact(run, "remove")

