"""From questions to the text that an answer is written from: the whole way of retrieval, for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave import storage
from graphweave.operators import retrieve, vector
from graphweave.operators.title_index import TitleIndex
from graphweave.operators.vector_index import VectorIndex
from graphweave.schema import bounded, top

CONFIDENCE = 0.5


def merged(direct: DataFrame, found: DataFrame, hybrid: DataFrame) -> DataFrame:
    """(seed, title, rank): title matches first, then vector hits, then hybrid ones; a title keeps its first place."""
    parts = [df.select("seed", "title", F.struct(F.lit(k).alias("part"), F.col(c).alias("place")).alias("at")) for k, (df, c) in enumerate(((direct, "place"), (found, "rank"), (hybrid, "rank")))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = every.groupBy("seed", "title").agg(F.min("at").alias("at"))
    return top(first, ["seed"], [F.col("at"), F.col("title")], 10).select("seed", "title", "rank")


def sources(
    sections: DataFrame, articles: DataFrame, edges: DataFrame, questions: DataFrame, vectors: DataFrame, max_results: int = 5, confidence: float = CONFIDENCE, score: Callable[[Column, Column], Column] | None = None,
    index: VectorIndex | None = None, titles: TitleIndex | None = None, degrees: DataFrame | None = None,
) -> DataFrame:
    """(seed, title, place) of questions(seed, question): what an answer is drawn from, best first, place from 0.

    vectors(seed, query_vector) holds a vector for each question. With a pair scorer twice as many
    candidates, 40 at most, are searched and the best kept. Vector hits that aren't sure enough are
    dropped, and all of a question's with them. Title matches come first, hybrid hits last; ten of
    them are fused with their degrees, and linked articles are added. Stored indexes of the sections
    and titles and a kept table of degrees are used where they are given. The vector hits, a few rows
    for each question, are written once, as three signals build on them.
    """
    bounded("max_results", max_results, 1, 1000)
    if score:
        found = vector.confidence_gate(vector.agent_search(sections, vectors, min(2 * max_results, 40), index), confidence)
        found = retrieve.pair_rerank(found, questions, max_results, score).select("seed", "title", "similarity", F.col("new_rank").alias("rank"))
    else:
        found = vector.confidence_gate(vector.agent_titles(sections, vectors, max_results, index), confidence)
    sure = storage.written(found.select("seed", "title", "similarity", "rank").coalesce(1), "hits")
    direct = retrieve.title_lookup(articles, questions.select("question").distinct(), index=titles).join(questions, "question").select("seed", "title", "place")
    hybrid = retrieve.hybrid_retrieve(sure, edges, articles, questions, max_results, index=titles)
    return retrieve.add_neighbours(retrieve.fuse(merged(direct, sure, hybrid), edges, known=degrees), edges)


def context(sections: DataFrame, facts: DataFrame, questions: DataFrame, chosen: DataFrame, fact_chars: int = 500) -> DataFrame:
    """(seed, body): the sources, their facts and the good part of their texts as Markdown, for sources(seed, title, place)."""
    told = chosen.join(facts.select("title", "content"), "title").select("seed", "place", F.concat(F.lit("["), F.col("title"), F.lit("] "), F.substring("content", 1, fact_chars)).alias("text"))
    bodies = retrieve.source_text(chosen, sections, questions).select("seed", "place", F.concat(F.lit("### "), F.col("title"), F.lit("\n\n"), F.col("body")).alias("text"))
    return retrieve.context_markdown(chosen.select("seed", "place", F.col("title").alias("text")), told, bodies)


def context_sample(articles: DataFrame, sections: DataFrame, most: int = 20, listed: int = 15, snippets: int = 5, chars: int = 200) -> DataFrame:
    """One row (body): how many of the first `most` articles there are, their titles, and the start of some lead sections."""
    few = articles.select("title").orderBy("title").limit(most)
    lead = sections.join(few, "title", "left_semi").groupBy("title").agg(F.min_by("content", "section_index").alias("content")).orderBy("title").limit(snippets)
    snippet = F.concat(F.lit("["), F.col("title"), F.lit("]: "), F.replace(F.substring("content", 1, chars), F.lit("\n"), F.lit(" ")), F.lit("..."))
    titles = few.agg(F.sort_array(F.collect_list("title")).alias("titles"))
    parts = lead.select("title", snippet.alias("s")).agg(F.array_sort(F.collect_list(F.struct("title", "s"))).alias("parts"))
    head = F.concat(F.lit("Pack contains "), F.size("titles").cast("string"), F.lit(" articles including:\n\n"), F.array_join(F.transform(F.slice("titles", 1, listed), lambda t: F.concat(F.lit("- "), t)), "\n"))
    tail = F.when(F.size("parts") > 0, F.concat(F.lit("\n\nSample content snippets:\n"), F.array_join(F.transform("parts", lambda p: F.concat(F.lit("\n"), p["s"])), "\n"))).otherwise("")
    return titles.join(parts, F.lit(True)).select(F.when(F.size("titles") > 0, F.concat(head, tail)).otherwise("").alias("body"))  # one row each
