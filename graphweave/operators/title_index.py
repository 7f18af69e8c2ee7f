"""An inverted index on titles: which titles hold a run of characters, without comparing all of them.

Postings name the titles of every run of one to three characters. A pattern is looked up by its
rarest runs of three (or as a whole, if it is shorter); titles that are in all of these postings are
candidates, and only they are compared. Stored postings lie in buckets by run, of which a lookup reads
those that it asks for; without a stored index the same postings are made from the articles in the
plan, and all that aren't asked for are dropped where they are made.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.sources.versions import Store, Transaction

#: Patterns of one call, and postings that are intersected for each.
MOST_PATTERNS, RUNS = 1000, 3
BUCKETS = 64


def runs_of(pattern: str) -> list[str]:
    """The runs by which a pattern is looked up."""
    return sorted({pattern[k : k + 3] for k in range(len(pattern) - 2)}) if len(pattern) > 2 else [pattern]


def postings(articles: DataFrame) -> DataFrame:
    """(run, title): every run of one to three characters of each title in lower case, once."""
    low = F.lower("title")
    sized = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    every = F.array_distinct(F.filter(F.concat(sized(1), sized(2), sized(3)), lambda r: r != ""))
    return articles.where("title is not null").select(F.explode(every).alias("run"), "title")


def _few(rows: DataFrame) -> list[tuple]:
    """rows(key, pattern) of one call, lower case, which must be few; empty patterns ask for nothing."""
    asked = rows.select("key", F.lower("pattern").alias("pattern")).where("pattern <> ''").distinct().limit(MOST_PATTERNS + 1).collect()
    if len(asked) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns in one call")
    return [(r["key"], r["pattern"]) for r in asked]


class TitleIndex:
    """Postings of the titles of articles, stored or made in the plan."""

    def __init__(self, spark: SparkSession, store: Store | None = None, articles: DataFrame | None = None) -> None:
        self.spark, self.store, self.articles = spark, store, articles

    @classmethod
    def of(cls, articles: DataFrame) -> TitleIndex:
        """Without anything stored."""
        return cls(articles.sparkSession, articles=articles)

    @classmethod
    def build(cls, articles: DataFrame, path: str) -> TitleIndex:
        """Stored in a folder that driver and executors share. Titles are distinct; null ones are left out."""
        spark = articles.sparkSession
        store = Store(spark, path, BUCKETS)
        index, rows = cls(spark, store), postings(articles)

        def make(t: Transaction) -> None:
            t.create("postings", ["run"], rows)
            t.create("runs", ["run"], rows.groupBy("run").agg(F.count("*").alias("n")))

        store.transact(make, "build")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TitleIndex:
        return cls(spark, Store(spark, path, BUCKETS))

    def append(self, articles: DataFrame) -> None:
        """Postings of more articles, whose titles aren't in the index."""
        rows = postings(articles)

        def add(t: Transaction) -> None:
            t.append("postings", rows)
            t.append("runs", rows.groupBy("run").agg(F.count("*").alias("n")))

        self.store.transact(add, "append")

    def containing(self, patterns: DataFrame) -> DataFrame:
        """(key, title) of patterns(key, pattern): titles that hold a key's pattern, whatever the case; few patterns."""
        asked = _few(patterns)
        kind = patterns.schema["key"].dataType.simpleString()
        every = sorted({r for _, p in asked for r in runs_of(p)})
        if self.store is None:
            known, held = dict.fromkeys(every, 0), postings(self.articles)
            chosen = {p: runs_of(p)[:: max(1, len(runs_of(p)) // RUNS)][:RUNS] for _, p in asked}
        else:
            version = self.store.version()
            t = Transaction(self.store, version)
            places = {r["run"]: r["b"] for r in self.spark.createDataFrame([(r,) for r in every], "run string").select("run", t.bucket("runs").alias("b")).collect()}
            counts = self.store.rows(version, "runs", sorted({*places.values()}))
            known = {r["run"]: r["n"] for r in counts.where(F.col("run").isin(every)).groupBy("run").agg(F.sum("n").alias("n")).collect()}
            chosen = {p: sorted(runs_of(p), key=lambda r: (known[r], r))[:RUNS] for _, p in asked if all(r in known for r in runs_of(p))}
            held = self.store.rows(version, "postings", sorted({places[r] for x in chosen.values() for r in x}))
        wanted = [(key, p, r, len(chosen[p])) for key, p in asked if p in chosen for r in chosen[p]]
        ask = self.spark.createDataFrame(wanted, f"key {kind}, pattern string, run string, need int")
        some = held.where(F.col("run").isin(sorted({w[2] for w in wanted})))
        both = some.join(F.broadcast(ask), "run").groupBy("key", "pattern", "need", "title").agg(F.count("*").alias("n")).where("n = need")
        return both.where(F.lower("title").contains(F.col("pattern"))).select("key", "title")


def patterns(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "key string, pattern string")
