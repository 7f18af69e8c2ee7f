"""The graph over the base tables, as DataFrames, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.text import word_count
from graphweave.schema import STATES


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, title, section_id, section_index, embedding, content, label, word_count: every document, with its vector if it has one."""
    e = base(spark, sf_dir, "embeddings")
    d = base(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    aid = F.floor(F.col("vec_id") / 5).cast("long")
    return d.join(e, "vec_id", "left").select(
        aid.alias("article_id"), F.concat(F.lit("A"), aid.cast("string")).alias("title"),
        F.concat(F.lit("A"), aid.cast("string"), F.lit("#"), (F.col("vec_id") % 5).cast("string")).alias("section_id"),
        (F.col("vec_id") % 5).cast("int").alias("section_index"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce("text", F.lit("")).alias("content"), "label", word_count(F.coalesce("text", F.lit(""))).alias("word_count"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title, article_id, category, word_count, expansion_state, expansion_depth."""
    s = sections(spark, sf_dir).groupBy("title", "article_id").agg(
        F.concat(F.lit("cat_"), F.max(F.when(F.col("section_index") == 0, F.col("label"))).cast("string")).alias("category"), F.sum("word_count").alias("word_count")
    )
    state = F.get(F.array(*map(F.lit, STATES)), (F.col("article_id") % 5).cast("int"))
    return s.select("title", "article_id", "category", "word_count", state.alias("expansion_state"), (F.col("article_id") % 3).cast("int").alias("expansion_depth"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct article links (src, dst) without loops, from all orders: a customer's article to that of their latest order."""
    n = articles_in(spark, sf_dir)
    last = base(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).crossJoin(F.broadcast(n))  # one row
    name = lambda c: F.concat(F.lit("A"), (F.col(c) % F.col("n")).cast("string"))
    return last.select(name("o_custkey").alias("src"), name("o_orderkey").alias("dst")).where("src <> dst").distinct()


def articles_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the number of articles (n)."""
    return base(spark, sf_dir, "documents").agg(F.count_distinct(F.floor(F.col("doc_id") / 5)).alias("n"))


def customer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale graph: each order's customer to the next order's, by day of order; distinct, without loops.

    Within a day orders are chained by key; the last of a day leads to the first of the next day
    that has one. Days are chained through a table of one row a day, so no task sorts all orders.
    """
    from pyspark.sql import Window

    o = base(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.to_date("o_orderdate").alias("day"))
    inside = Window.partitionBy("day").orderBy("o_orderdate", "o_orderkey")
    chained = o.select("day", "o_custkey", F.lead("o_custkey").over(inside).alias("next"))
    first = o.groupBy("day").agg(F.min_by("o_custkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))
    month = Window.partitionBy(F.lit(0)).orderBy("day")
    after = first.select("day", F.lead("first").over(month).alias("tomorrow"))  # a row for each day
    e = chained.join(after, "day").select(F.col("o_custkey").alias("src"), F.coalesce("next", "tomorrow").alias("dst"))
    return e.where("dst is not null and src <> dst").distinct()


def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (article, entity): orders and the parts in them."""
    return base(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("entity")).distinct()


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title, fact_id, content: turns of conversations, dealt to articles by conversation."""
    title = F.concat(F.lit("A"), (F.col("conv_id") % F.col("n")).cast("string"))
    return base(spark, sf_dir, "conversations").crossJoin(F.broadcast(articles_in(spark, sf_dir))).select(title.alias("title"), F.concat_ws(":fact:", title, F.concat_ws("-", "conv_id", "turn")).alias("fact_id"), F.col("text").alias("content"))


WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
#: Common table expressions of the same views.
SQL = f"""
sec AS (SELECT d.doc_id // 5 AS article_id, 'A' || (d.doc_id // 5) AS title, 'A' || (d.doc_id // 5) || '#' || (d.doc_id % 5) AS section_id, d.doc_id % 5 AS section_index,
  CAST(e.embedding AS DOUBLE[]) AS v, coalesce(d.text, '') AS content, e.label, {WORDS.format("coalesce(d.text, '')")} AS word_count
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
art AS (SELECT title, article_id, 'cat_' || max(CASE WHEN section_index = 0 THEN label END) AS category, CAST(sum(word_count) AS BIGINT) AS word_count,
  ['discovered', 'claimed', 'loaded', 'processed', 'failed'][CAST(article_id % 5 AS INT) + 1] AS expansion_state, CAST(article_id % 3 AS INT) AS expansion_depth FROM sec GROUP BY title, article_id),
num AS (SELECT count(*) AS n FROM art),
lnk AS (SELECT DISTINCT 'A' || (o_custkey % n) AS src, 'A' || (k % n) AS dst FROM (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey), num WHERE o_custkey % n <> k % n),
fct AS (SELECT 'A' || (conv_id % n) AS title, text AS content, conv_id, turn FROM conversations, num)
"""
