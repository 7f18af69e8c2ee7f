"""Counts, distributions and audits of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.operators.work_queue import loaded


def counted(df: DataFrame, by: Column, name: str, null_as: str | None = None) -> DataFrame:
    """(name, n): rows by a value; nulls are left out, or counted under null_as."""
    d = df.select(by.alias(name))
    d = d.where(F.col(name).isNotNull()) if null_as is None else d.select(F.coalesce(F.col(name).cast("string"), F.lit(null_as)).alias(name))
    return d.groupBy(name).agg(F.count("*").alias("n"))


def categories(articles: DataFrame) -> DataFrame:
    return counted(articles, F.col("category"), "category").orderBy(F.desc("n"), "category")


def top_categories(articles: DataFrame, limit: int = 5) -> DataFrame:
    """The categories with most loaded articles; the missing one is named after the limit."""
    some = articles.where(loaded(F.col("expansion_state"))).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(limit)
    return some.select(F.coalesce("category", F.lit("Uncategorized")).alias("category"), "n")


def loaded_depths(articles: DataFrame) -> DataFrame:
    return counted(articles.where(loaded(F.col("expansion_state"))), F.coalesce("expansion_depth", F.lit(-1)), "depth")


def averages(articles: DataFrame, sections: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of articles, sections and links, and both by article to one place."""
    a, s, e = (d.agg(F.count("*").alias(n)) for d, n in ((articles, "articles"), (sections, "sections"), (edges, "links")))
    each = lambda c: F.when(F.col("articles") > 0, F.bround(F.col(c) / F.col("articles"), 1)).otherwise(0.0)
    return a.join(s, F.lit(True)).join(e, F.lit(True)).select("articles", "sections", "links", each("sections").alias("sections_each"), each("links").alias("links_each"))  # one row each


def words_by_article(sections: DataFrame) -> DataFrame:
    return sections.groupBy("title").agg(F.sum("word_count").alias("words"))


def audit(words: DataFrame, thin: int = 200) -> DataFrame:
    """One row over words(words): count, least, most, mean and median to one place, thin articles and their percent."""
    n, few = F.count("*"), F.count(F.when(F.col("words") < thin, 1))
    return words.agg(
        n.alias("n"), F.min("words").alias("least"), F.max("words").alias("most"), F.round(F.avg("words"), 1).alias("mean"), F.round(F.median("words"), 1).alias("median"),
        few.alias("thin"), F.round(F.when(n > 0, few * 100.0 / n), 1).alias("thin_percent"),
    )


def pack_counts(articles: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: how many articles, entities and relationships a pack has."""
    a, e, r = (df.agg(F.count("*").alias(n)) for df, n in ((articles, "articles"), (entities, "entities"), (relationships, "relationships")))
    return a.join(e, F.lit(True)).join(r, F.lit(True))  # one row each


def edge_total(*edges: DataFrame) -> int:
    return sum(e.count() for e in edges)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys on more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def token_cost(usage: DataFrame, by: list[str], per_million: tuple[float, float] = (15.0, 75.0)) -> DataFrame:
    """Tokens in and out and their price, by group."""
    i, o = F.sum("tokens_in"), F.sum("tokens_out")
    return usage.groupBy(*by).agg(i.alias("tokens_in"), o.alias("tokens_out"), ((i * per_million[0] + o * per_million[1]) / 1e6).alias("cost"))
