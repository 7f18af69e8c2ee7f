"""Title lookup, fusion of signals, and the text that goes to an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave import storage
from graphweave.functions import text as X
from graphweave.operators import graph, vector
from graphweave.operators.title_index import TitleIndex, patterns
from graphweave.schema import small, top


def title_lookup(articles: DataFrame, questions: DataFrame, most: int = 3, index: TitleIndex | None = None) -> DataFrame:
    """(question, title, exact, place): articles whose title is the question's subject, else contains it, shortest first.

    Through an index of the titles, a stored one where it is given; questions are few.
    """
    q = questions.select("question", X.normal_question(F.col("question")).alias("subject")).where("subject <> ''").distinct()
    found = (index or TitleIndex.of(articles)).containing(q.select(F.col("question").alias("key"), F.col("subject").alias("pattern")))
    told = found.select(F.col("key").alias("question"), "title", (F.lower("title") == X.normal_question(F.col("key"))).alias("exact"))
    few = top(told, ["question"], [F.desc("exact"), F.length("title"), F.col("title")], most, "place")
    sure = F.max("exact").over(Window.partitionBy("question"))  # of the few
    return few.withColumn("sure", sure).where("exact = sure").drop("sure")


def autocomplete(articles: DataFrame, q: str, limit: int = 10, index: TitleIndex | None = None) -> DataFrame:
    """(title, category, match_type): titles that start with q, then those that contain it, each by title."""
    if len(q) < 2:
        raise ValueError("q needs two characters")
    found = (index or TitleIndex.of(articles)).containing(patterns(articles.sparkSession, [("q", q)]))
    starts = F.lower("title").startswith(F.lower(F.lit(q)))
    first = found.select("title", F.when(starts, "prefix").otherwise("contains").alias("match_type")).orderBy(F.col("match_type") == "contains", "title").limit(limit)
    told = first.join(articles.select("title", "category"), "title").select("title", "category", "match_type")
    return told.orderBy(F.col("match_type") == "contains", "title")


def hybrid_query(sections: DataFrame, edges: DataFrame, articles: DataFrame, seeds: DataFrame, category: str | None = None, max_hops: int = 2, top_k: int = 10) -> DataFrame:
    """(seed, title, similarity, hops, score, rank): .7 similarity and .3 by hops of articles both near and linked.

    Seeds with nothing linked keep their semantic results alone. The fewest hops count. Both sides
    give their first hundred.
    """
    near = vector.semantic_search(sections, seeds, articles, category, 100).select("seed", "title", "similarity")
    far = graph.graph_traversal(edges, seeds, articles, max_hops, category, 100).groupBy("seed", "title").agg(F.min("hops").alias("hops"))
    linked = far.select("seed").distinct().withColumn("linked", F.lit(True))
    both = near.join(far, ["seed", "title"], "left").join(linked, "seed", "left").where("hops is not null or linked is null")
    score = 0.7 * F.col("similarity") + F.coalesce(0.3 / (F.col("hops") + 1), F.lit(0.0))
    return top(both.withColumn("score", score), ["seed"], [F.desc("score"), F.col("title")], top_k).select("seed", "title", "similarity", "hops", "score", "rank")


def hybrid_retrieve(found: DataFrame, edges: DataFrame, articles: DataFrame, questions: DataFrame, max_results: int = 10, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), index: TitleIndex | None = None) -> DataFrame:
    """(seed, title, score, rank): vector hits found(seed, title, similarity, rank), links of the first three, and keywords.

    questions(seed, question) gives the keywords; each signal adds max_results rows at most for one source.
    """
    v, g, k = weights
    one = found.select("seed", "title", (v * F.col("similarity")).alias("part"))
    first = found.where("rank <= 3").select("seed", F.col("title").alias("src"))
    linked = top(first.join(edges.select("src", F.col("dst").alias("title")), "src"), ["seed", "src"], [F.col("title")], max_results, "row")
    two = linked.select("seed", "title", F.lit(g * 0.5).alias("part"))
    words = questions.select("seed", F.posexplode(X.search_terms(F.col("question"))).alias("at", "word"))
    named = (index or TitleIndex.of(articles)).containing(words.select(F.struct("seed", "at").alias("key"), F.col("word").alias("pattern")))
    three = top(named, ["key"], [F.col("title")], max_results, "row").select("key.seed", "title", F.lit(k * 0.7).alias("part"))
    total = one.unionByName(two).unionByName(three).groupBy("seed", "title").agg(F.sum("part").alias("score"))
    return top(total, ["seed"], [F.desc(F.round("score", 9)), F.col("title")], max_results).select("seed", "title", "score", "rank")


def rank_score(place: Column, k: int = 60) -> Column:
    """What a place from 0 counts in a fusion of ranks."""
    return 1.0 / (k + place)


def reciprocal_rank(rankings: DataFrame, k: int = 60) -> DataFrame:
    """(seed, title, score): sum of weight / (k + rank from 0) over rankings(seed, title, weight, place)."""
    return rankings.groupBy("seed", "title").agg(F.sum(F.col("weight") * rank_score(F.col("place"), k)).alias("score"))


def fuse(found: DataFrame, edges: DataFrame | None, keep: int = 5, known: DataFrame | None = None) -> DataFrame:
    """(seed, title, place): the first ten of found(seed, title, rank) fused with their centrality; the old order
    stays where fusing would move its first out of the first three. known(title, degree) stands for the
    degrees of all edges where a table of them is kept."""
    first = found.where("rank <= 10").select("seed", "title", (F.col("rank") - 1).alias("old"))
    d = first.join(graph.degrees(edges) if known is None else known, "title", "left").select("seed", "title", "old", F.coalesce("degree", F.lit(0)).alias("degree"))
    w = Window.partitionBy("seed")  # ten rows each
    both = d.withColumn("linked", F.row_number().over(w.orderBy(F.desc("degree"), "old")) - 1)
    scored = both.withColumn("score", rank_score(F.col("old")) + 0.5 * rank_score(F.col("linked")))
    placed = scored.withColumn("new", F.row_number().over(w.orderBy(F.desc(F.round("score", 12)), "old")) - 1)
    placed = placed.withColumn("safe", F.max((F.col("old") == 0) & (F.col("new") < 3)).over(w))
    out = placed.select("seed", "title", F.when(F.col("safe"), F.col("new")).otherwise(F.col("old")).alias("place"), "safe")
    return out.where(~F.col("safe") | (F.col("place") < keep)).select("seed", "title", F.col("place").cast("int").alias("place"))


def add_neighbours(sources: DataFrame, edges: DataFrame, most_new: int = 2, cap: int = 7) -> DataFrame:
    """sources(seed, title, place) and up to two linked titles of each seed's first source, `cap` in all."""
    head = sources.where("place = 0").select("seed", F.col("title").alias("src"))
    linked = top(head.join(edges.select("src", F.col("dst").alias("title")), "src"), ["seed"], [F.col("title")], most_new, "row").select("seed", "title", (F.col("row") + 100_000).alias("place"))
    every = sources.select("seed", "title", "place").unionByName(linked).groupBy("seed", "title").agg(F.min("place").alias("place"))
    ranked = top(every, ["seed"], [F.col("place"), F.col("title")], cap, "at")
    return ranked.select("seed", "title", (F.col("at") - 1).cast("int").alias("place"))


def source_text(sources: DataFrame, sections: DataFrame, questions: DataFrame, most_articles: int = 5, most_chars: int = 3000, least_quality: float = 0.3) -> DataFrame:
    """(seed, title, place, body): the good sections of a seed's first sources, cleaned, in order, cut at most_chars.

    Every section is cleaned once, however many seeds it serves. The sources, a few for each seed, are
    written once as both joins need them; sections are dealt out before cleaning, which is the work here.
    """
    few = storage.written(sources.where(F.col("place") < most_articles).join(questions, "seed"), "sources")
    parts = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = sections.select("title", "section_index", "content").join(few.select("title").distinct(), "title", "left_semi").repartition(parts, "title", "section_index")
    cleaned = some.select("title", "section_index", F.transform(F.array(X.clean(F.col("content"))), lambda c: c)[0].alias("content"))
    good = few.join(cleaned, "title").where(X.section_quality(F.col("content"), F.col("question")) >= least_quality)
    parts = good.groupBy("seed", "title", "place").agg(F.sort_array(F.collect_list(F.struct("section_index", "content"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n")
    return parts.select("seed", "title", "place", F.when(F.length(body) > most_chars, F.concat(F.substring(body, 1, most_chars), F.lit("..."))).otherwise(body).alias("body"))


def entity_articles(entities: DataFrame, has_entity: DataFrame, names: DataFrame) -> DataFrame:
    """(name, type, articles): entities of names(name), with the sorted titles that hold them, maybe none."""
    found = entities.join(names, "name", "left_semi").join(has_entity.select(F.col("dst").alias("entity_id"), F.col("src").alias("title")), "entity_id", "left")
    return found.groupBy("name", "type").agg(F.sort_array(F.collect_set("title")).alias("articles"))


def facts_of(names: DataFrame, facts: DataFrame, has_entity: DataFrame) -> DataFrame:
    """(name, content): facts of articles with that entity; of the article of that name where there are none."""
    # Texts go to many names: what is joined and told apart are their digests, dealt out before, so that no task holds its own rows' product.
    keyed = facts.select("title", F.coalesce(F.unhex(F.sha2("content", 256)), F.lit(b"")).alias("key"), "content")
    of = keyed.select("title", "key").distinct()
    names = names.distinct()
    linked = names.join(has_entity.select(F.col("dst").alias("name"), F.col("src").alias("title")), "name")
    held = linked.join(of, "title").select("name", "key").repartition("name", "key").distinct()
    rest = names.join(linked.join(of.select("title").distinct(), "title", "left_semi").select("name").distinct(), "name", "left_anti")
    own = rest.join(of.withColumnRenamed("title", "name"), "name").select("name", "key")
    return held.unionByName(own).join(keyed.select("key", "content").dropDuplicates(["key"]), "key").select("name", "content")


def citations(sources: DataFrame) -> DataFrame:
    """(seed, body): a numbered Markdown list of sources(seed, title, place)."""
    each = F.sort_array(F.collect_list(F.struct("place", "title")))
    return sources.groupBy("seed").agg(each.alias("s")).select("seed", F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["title"])), "\n").alias("body"))


def graph_context(edges: DataFrame, seeds: DataFrame, articles: DataFrame, sections: DataFrame, max_hops: int = 2, each: int = 5, cap: int = 15) -> DataFrame:
    """(title, place, hops, content): seeds(seed, ord) found in any letters and `each` related articles with words, `cap` in all.

    Seeds come in their order, each followed by what is linked to it, nearest first; a title keeps its
    first place. content is the lead section's.
    """
    named = articles.select("title", F.lower("title").alias("low")).join(small(seeds.select(F.lower("seed").alias("low"), "ord")), "low").select(F.col("title").alias("seed"), "ord")
    near = graph.shortest_hops(edges, named.select("seed").distinct(), max_hops).select("seed", F.col("node").alias("title"), "hops")
    near = near.join(articles.where("word_count > 0").select("title"), "title", "left_semi")
    related = top(near, ["seed"], [F.col("hops"), F.col("title")], each, "row").join(named, "seed").select("title", "hops", F.struct("ord", F.col("row").alias("row")).alias("at"))
    own = named.select(F.col("seed").alias("title"), F.lit(0).alias("hops"), F.struct("ord", F.lit(0).alias("row")).alias("at"))
    first = own.unionByName(related).groupBy("title").agg(F.min("at").alias("at"), F.min_by("hops", "at").alias("hops"))
    few = first.orderBy("at", "title").limit(cap).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at", "title")))  # cap rows
    lead = sections.where("section_index = 0").select("title", "content")
    return few.join(lead, "title", "left").select("title", "place", "hops", "content")


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that the text has: the scorer of pairs where no model is given."""
    q = F.array_distinct(X.words(F.lower(question)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.array_distinct(X.words(F.lower(text))))) / F.size(q)).otherwise(0.0)


def pair_rerank(found: DataFrame, questions: DataFrame, top_k: int = 5, score: Callable[[Column, Column], Column] | None = overlap_score) -> DataFrame:
    """found(seed, title, content, rank) by the score of (question, content, or title without one), the best top_k.

    score is a Column function or a pandas UDF of a model; questions are cut at 2000 characters.
    Without one, found stays as it is.
    """
    if score is None:
        return found
    text = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.col("title"))
    scored = found.join(small(questions), "seed").withColumn("score", score(F.substring("question", 1, 2000), text))
    return top(scored, ["seed"], [F.desc("score"), F.col("rank")], max(1, top_k), "new_rank").drop("question")


def context_markdown(sources: DataFrame, facts: DataFrame, bodies: DataFrame) -> DataFrame:
    """(seed, body): sources, facts and section texts of a seed under Markdown headings, those that aren't empty."""
    listed = lambda df, mark: df.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("x")).select("seed", F.array_join(F.transform("x", lambda r: F.concat(F.lit(mark), r["text"])), "\n").alias("part"))
    out = sources.select("seed").distinct()
    heads = []
    for head, df, mark in (("Sources", sources, "- "), ("Facts", facts, "- "), ("Context", bodies, "")):
        out = out.join(listed(df, mark).withColumnRenamed("part", head), "seed", "left")
        heads.append(F.when(F.col(head).isNotNull(), F.concat(F.lit(f"## {head}\n\n"), F.col(head))))
    return out.select("seed", F.concat_ws("\n\n", *heads).alias("body"))
