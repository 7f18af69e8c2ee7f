"""Cosine search over section vectors for a stated set of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.schema import bounded, top

if TYPE_CHECKING:
    from graphweave.operators.vector_index import VectorIndex

#: Queries of one call; their vectors go to every task, so the number is bounded and checked.
MOST_QUERIES = 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def few_queries(queries: DataFrame, wide: int | None = None) -> tuple[list, np.ndarray]:
    """Seeds and unit vectors of a call's queries(seed, query_vector), which must be few, of one length and without gaps."""
    asked = queries.select("seed", "query_vector").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in one call")
    wide = wide or (len(asked[0]["query_vector"] or []) if asked else 0)
    for r in asked:
        if r["query_vector"] is None or len(r["query_vector"]) != wide or None in r["query_vector"]:
            raise ValueError(f"the query {r['seed']} has no vector of {wide} components")
    return [r["seed"] for r in asked], unit_rows(np.array([r["query_vector"] for r in asked], dtype=np.float64).reshape(len(asked), wide))


def nearest(queries: DataFrame, items: DataFrame, key: str, k: int) -> DataFrame:
    """(seed, distance, near) with the columns of items(embedding, ...): the k items nearest to each query(seed, query_vector).

    Exact, by cosine distance, then key; a zero vector has distance 1 to all. Items without a vector
    take no part; one of another length than the queries' is an error in the task that meets it.
    """
    return scan(queries, few_queries(queries), items, key, k)


def scan(queries: DataFrame, asked: tuple[list, np.ndarray], items: DataFrame, key: str, k: int, cell: tuple[str, dict[int, np.ndarray]] | None = None) -> DataFrame:
    """The same for queries that few_queries gave, each against the rows of its own cells where a column of cells is named.

    The queries, few and checked, go to every task; a task compares Arrow batches by one matrix
    product, takes what is within rounding of the k best of a batch, and sums those products component
    by component.
    """
    carried = [c for c in items.columns if c != "embedding" and c != (cell and cell[0])]
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *items.schema)}
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in ("seed", *carried)) + ", distance double"
    seeds, unit = asked
    if not seeds:
        return top(items.sparkSession.createDataFrame([], shape), ["seed"], [F.col("distance"), F.col(key)], k, "near")
    wide = unit.shape[1]

    def compared(batch: pa.RecordBatch, mine: np.ndarray) -> pa.RecordBatch:
        if (batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False) != wide).any():
            raise ValueError(f"an item's vector doesn't have the queries' {wide} components")
        v = unit_rows(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide))
        close = unit[mine] @ v.T
        least = np.partition(close, -k, axis=1)[:, -k] if close.shape[1] > k else np.full(len(close), -np.inf)
        q, i = np.nonzero(close >= least[:, None] - 1e-9)
        distance = 1 - (unit[mine[q]] * v[i]).sum(axis=1)
        there = batch.select(carried).take(pa.array(i))
        return pa.RecordBatch.from_arrays([pa.array([seeds[x] for x in mine[q].tolist()]), *there.columns, pa.array(distance)], ["seed", *carried, "distance"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and cell is None:
                yield compared(batch, np.arange(len(seeds)))
            elif batch.num_rows:
                own = batch.column(cell[0]).to_numpy(zero_copy_only=False)
                for c in np.unique(own):
                    if len(cell[1].get(int(c), ())):
                        yield compared(batch.filter(pa.array(own == c)), cell[1][int(c)])

    sound = items.where(F.col("embedding").isNotNull()).select(*carried, *([cell[0]] if cell else []), F.col("embedding").cast("array<double>").alias("embedding"))
    return top(sound.mapInArrow(search, shape), ["seed"], [F.col("distance"), F.col(key)], k, "near")


def unit_rows(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(size == 0, 1.0, size)


def index_nearest(queries: DataFrame, sections: DataFrame, k: int, index: VectorIndex | None = None, exact: bool = False) -> DataFrame:
    """(seed, section_id, title, distance, near): the k sections nearest to each query; their texts are joined by who needs them.

    Through a stored index of the sections where one is given, else by comparing all.
    """
    if index is not None:
        return index.search(queries, k, exact=exact).select("seed", "section_id", "title", "distance", "near")
    return nearest(queries, sections.select("section_id", "title", "embedding"), "section_id", k)


def lead_vectors(sections: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, query_vector): the lead section's vector of each seed title; seeds without one are left out."""
    lead = sections.where("section_index = 0 AND embedding IS NOT NULL").select(F.col("title").alias("seed"), F.col("embedding").alias("query_vector"))
    return lead.join(seeds, "seed", "left_semi")


def best_section(near: DataFrame) -> DataFrame:
    """The nearest section of each article for each seed."""
    best = F.min_by(F.struct("section_id", "distance"), F.struct("distance", "section_id"))
    return near.groupBy("seed", "title").agg(best.alias("b")).select("seed", "title", "b.*")


def semantic_search(sections: DataFrame, seeds: DataFrame, articles: DataFrame | None = None, category: str | None = None, top_k: int = 10, index: VectorIndex | None = None, exact: bool = False) -> DataFrame:
    """(seed, title, section_id, similarity, rank): articles nearest to each seed title, itself left out.

    index, a stored one of these sections, is asked in place of them, exactly on request. Takes five times top_k sections (200 at most) first; a category filter comes after that, so it
    can leave fewer than top_k.
    """
    bounded("top_k", top_k, 1, 500)
    near = index_nearest(lead_vectors(sections, seeds), sections, min(5 * top_k, 200), index, exact)
    best = best_section(near.where("title <> seed"))
    if category is not None:
        best = best.join(articles.where(F.col("category") == category).select("title"), "title", "left_semi")
    ranked = top(best, ["seed"], [F.col("distance"), F.col("title")], top_k)
    return ranked.select("seed", "title", "section_id", similarity(F.col("distance")).alias("similarity"), "rank")


def agent_titles(sections: DataFrame, queries: DataFrame, top_k: int = 10, index: VectorIndex | None = None) -> DataFrame:
    """(seed, title, section_id, similarity, rank) for queries(seed, query_vector): three times top_k sections, no article left out."""
    bounded("top_k", top_k, 1, 500)
    best = best_section(index_nearest(queries, sections, 3 * top_k, index))
    few = top(best, ["seed"], [F.col("distance"), F.col("title")], top_k)
    return few.select("seed", "title", "section_id", similarity(F.col("distance")).alias("similarity"), "rank")


def agent_search(sections: DataFrame, queries: DataFrame, top_k: int = 10, index: VectorIndex | None = None) -> DataFrame:
    """(seed, title, content, similarity, rank): the same with the text of the section."""
    few = agent_titles(sections, queries, top_k, index)
    return few.join(sections.select("section_id", "content"), "section_id").select("seed", "title", "content", "similarity", "rank")


def query_vectors(sections: DataFrame, questions: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(seed, query_vector) of questions(seed, question): the vector of the first section of an article of that title, else the model's."""
    first = sections.where("embedding IS NOT NULL").groupBy("title").agg(F.min_by("embedding", "section_index").alias("query_vector"))
    known = questions.join(first, F.col("question") == F.col("title")).select("seed", "query_vector")
    rest = questions.join(known.select("seed"), "seed", "left_anti").select("seed", F.col("question").alias("text"))
    return known.unionByName(embed(rest, model))


def multi_query_search(sections: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """(seed, title, content, similarity, rank) over all phrasings, queries(seed, phrase, query_vector): the best similarity of each title, not cut to top_k."""
    top_k = max(1, min(20, top_k))
    each = queries.select(F.struct("seed", "phrase").cast("struct<seed:string,phrase:int>").alias("p"), "query_vector").select(F.to_json("p").alias("seed"), "query_vector")
    found = agent_search(sections, each, top_k).withColumn("seed", F.get_json_object("seed", "$.seed"))
    best = found.groupBy("seed", "title").agg(F.max_by(F.struct("content", "similarity"), F.struct("similarity", F.expr("-rank"))).alias("b")).select("seed", "title", "b.*")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc(F.round("similarity", 9)), "title")))


def multi_query(found: DataFrame) -> DataFrame:
    """(title, similarity): the best similarity of each title over all queries of found(title, similarity)."""
    return found.groupBy("title").agg(F.max("similarity").alias("similarity"))


def confidence_gate(found: DataFrame, least: float = 0.5) -> DataFrame:
    """found without the rows of seeds whose best similarity is under `least`."""
    best = F.max("similarity").over(Window.partitionBy("seed"))  # of a few rows for each seed
    return found.withColumn("best", best).where(F.col("best") >= least).drop("best")


def few_shot(examples: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(seed, example, score, rank): the k examples(example, embedding) most similar to each query, earlier ones first in a tie."""
    near = nearest(queries, examples.select("example", "embedding"), "example", k)
    return near.select("seed", "example", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("distance"))).alias("score"), F.col("near").alias("rank"))


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], prefix: str = "", batch: int = 32) -> DataFrame:
    """texts(seed, text) with query_vector from an injected model, called in the tasks by batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [prefix + t for t in part["text"].fillna("")]
            vectors = [v for at in range(0, len(rows), batch) for v in model(rows[at : at + batch])]
            yield pd.DataFrame({"seed": part["seed"], "query_vector": [[float(x) for x in v] for v in vectors]})

    kind = texts.schema["seed"].dataType.simpleString()
    return texts.select("seed", "text").mapInPandas(run, f"seed {kind}, query_vector array<double>")
