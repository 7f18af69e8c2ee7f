"""Traversal, degrees, neighbourhoods and co-occurrence over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave import storage
from graphweave.schema import bounded, top


def walk_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Distinct (seed, node, hops): nodes at the end of a walk of so many steps; a node can have several.

    One join for each step, on distinct (seed, node) pairs, so walks themselves never multiply.
    """
    bounded("hops", hops, 1, 10)
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    now = seeds.select("seed", F.col("seed").alias("node"))
    out = None
    for h in range(1, hops + 1):
        now = now.join(e, "node").select("seed", F.col("to").alias("node")).distinct()
        step = now.withColumn("hops", F.lit(h))
        out = step if out is None else out.unionByName(step)
    return out


def shortest_hops(edges: DataFrame, seeds: DataFrame, hops: int, keep_seed: bool = False) -> DataFrame:
    """(seed, node, hops): breadth-first distance up to `hops`; the seed itself, at 0, on request."""
    bounded("hops", hops, 0, 10)
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    edge_of = seen
    for h in range(1, hops + 1):
        new = edge_of.join(e, "node").select("seed", F.col("to").alias("node")).distinct()
        edge_of = new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(edge_of)
    return seen if keep_seed else seen.where("hops > 0")


def graph_traversal(edges: DataFrame, seeds: DataFrame, articles: DataFrame, max_hops: int = 2, category: str | None = None, max_results: int = 50) -> DataFrame:
    """(seed, title, hops) of walks, by hops then title, `max_results` rows for each seed; hops are clamped to 1-10."""
    found = walk_hops(edges, seeds, max(1, min(10, max_hops))).withColumnRenamed("node", "title")
    if category is not None:
        found = found.join(articles.where(F.col("category") == category).select("title"), "title", "left_semi")
    return top(found, ["seed"], [F.col("hops"), F.col("title")], max_results, "row").select("seed", "title", "hops")


def graph_neighbors(edges: DataFrame, seeds: DataFrame, articles: DataFrame, depth: int = 2, limit: int = 50, category: str | None = None) -> DataFrame:
    """(seed, title, depth, category, word_count, links): nodes around each seed, itself at depth 0, nearest first.

    A category leaves out nodes of others, the seed too. Every node counts once towards the limit.
    """
    bounded("depth", depth, 1, 3)
    found = shortest_hops(edges, seeds, depth, keep_seed=True).select("seed", F.col("node").alias("title"), F.col("hops").alias("depth")).join(articles.select("title", "category", "word_count"), "title")
    if category is not None:
        found = found.where(F.col("category") == category)
    found = top(found, ["seed"], [F.col("depth"), F.col("title")], limit, "row").drop("row")
    out = edges.groupBy(F.col("src").alias("title")).agg(F.count("*").alias("links"))
    return found.join(out, "title", "left").select("seed", "title", "depth", "category", "word_count", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def induced_edges(edges: DataFrame, nodes: DataFrame, limit: int = 1000) -> DataFrame:
    """(seed, src, dst): edges with both ends among a seed's nodes(seed, title), `limit` for each seed."""
    a = nodes.select("seed", F.col("title").alias("src"))
    b = nodes.select("seed", F.col("title").alias("dst"))
    inside = edges.select("src", "dst").distinct().join(a, "src").join(b, ["seed", "dst"])
    return top(inside, ["seed"], [F.col("src"), F.col("dst")], limit, "row").select("seed", "src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(title, degree): edges out and in, of nodes that have any."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("title"))
    return ends.groupBy("title").agg(F.count("*").alias("degree"))


def centrality(edges: DataFrame | None, nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(title, centrality) of nodes(title): degree by the largest degree among them, 0 for unknown ones.

    known(title, degree) stands for the degrees of all edges where a table of them is kept.
    """
    d = nodes.select("title").distinct().join(degrees(edges) if known is None else known, "title", "left").select("title", F.coalesce("degree", F.lit(0)).alias("degree"))
    most = d.agg(F.max("degree").alias("most"))  # one row
    return d.join(F.broadcast(most), F.lit(True)).select("title", F.when(F.col("most") > 0, F.col("degree") / F.col("most")).otherwise(0.0).alias("centrality"))


def density(edges: DataFrame, articles: DataFrame) -> float:
    n = articles.count()
    return edges.count() / n if n else 0.0


def rerank(found: DataFrame, edges: DataFrame | None, articles: DataFrame, vector_weight: float = 0.6, graph_weight: float = 0.4, known: DataFrame | None = None) -> DataFrame:
    """found(title, score) with the weighted score; a sparse graph (under two links an article) adds nothing.

    All in one plan: how dense the graph is, is a row of it. known(title, degree) as in centrality.
    """
    if vector_weight < 0 or graph_weight < 0 or abs(vector_weight + graph_weight - 1) > 0.001:
        raise ValueError("weights must not be negative and must sum to 1")
    n = edges.agg(F.count("*").alias("links")) if known is None else known.agg((F.coalesce(F.sum("degree"), F.lit(0)) / 2).alias("links"))
    dense = n.join(articles.agg(F.count("*").alias("nodes")), F.lit(True)).select((F.col("links") >= 2.0 * F.col("nodes")).alias("dense"))  # one row each
    c = centrality(edges, found, known).join(F.broadcast(dense), F.lit(True)).select("title", F.when(F.col("dense"), F.col("centrality")).otherwise(0.0).alias("centrality"))
    return found.join(c, "title").withColumn("score", F.col("score") * vector_weight + F.col("centrality") * graph_weight)


def _walks(edges: DataFrame, roots: DataFrame, steps: int, limit: int) -> list[DataFrame]:
    """For each number of steps, the `limit` first walks (root, at, path, relations) from each root to each node.

    path leaves the root out. edges has at, to, relation; walks are in order of path, then relations.
    """
    none = F.array().cast("array<string>")
    levels = [roots.select("root", F.col("root").alias("at"), none.alias("path"), none.alias("relations"))]
    for _ in range(steps):
        longer = levels[-1].join(edges, "at").select("root", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("relations", F.array("relation")).alias("relations"))
        levels.append(top(longer, ["root", "at"], [F.col("path"), F.col("relations")], limit, "row").drop("row"))
    return levels


def _walks_back(edges: DataFrame, roots: DataFrame, steps: int, limit: int) -> list[DataFrame]:
    """The same towards each root: path and relations lead from a node, which is left out, to the root."""
    none = F.array().cast("array<string>")
    levels = [roots.select("root", F.col("root").alias("at"), none.alias("path"), none.alias("relations"))]
    for _ in range(steps):
        longer = levels[-1].join(edges.withColumnRenamed("at", "before").withColumnRenamed("to", "at"), "at")
        longer = longer.select("root", F.col("before").alias("at"), F.concat(F.array("at"), F.col("path")).alias("path"), F.concat(F.array("relation"), F.col("relations")).alias("relations"))
        levels.append(top(longer, ["root", "at"], [F.col("path"), F.col("relations")], limit, "row").drop("row"))
    return levels


def paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 3, limit: int = 5) -> DataFrame:
    """(source, target, path, relations, hops, place): walks from source to target of pairs, shortest first, `limit` a pair.

    edges has src, dst, relation; parallel edges give walks of their own. Walks grow from both ends and
    meet in the middle. Of the walks of so many steps between two nodes only the first `limit` are kept:
    of a walk among a pair's first, every part is among the first between its ends, as walks of one
    length that share the rest are in the order of their parts. So no step holds more than `limit` rows
    for a root and a node, whatever the number of walks.
    """
    bounded("max_hops", max_hops, 1, 10)
    bounded("limit", limit, 1, 1000)
    e = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "relation")
    ahead = _walks(e, pairs.select(F.col("source").alias("root")).distinct(), -(-max_hops // 2), limit)
    back = _walks_back(e, pairs.select(F.col("target").alias("root")).distinct(), max_hops // 2, limit)
    out = None
    for h in range(1, max_hops + 1):
        first = ahead[-(-h // 2)].select(F.col("root").alias("source"), "at", "path", "relations")
        rest = back[h // 2].select(F.col("root").alias("target"), "at", F.col("path").alias("path2"), F.col("relations").alias("relations2"))
        met = pairs.select("source", "target").join(first, "source").join(rest, ["target", "at"])
        whole = met.select("source", "target", F.concat(F.array("source"), F.col("path"), F.col("path2")).alias("path"), F.concat("relations", "relations2").alias("relations"), F.lit(h).alias("hops"))
        out = whole if out is None else out.unionByName(whole)
    ranked = top(out, ["source", "target"], [F.col("hops"), F.col("path"), F.col("relations")], limit, "row")
    return ranked.select("source", "target", "path", "relations", "hops", F.col("row").alias("place"))


def expand_related(edges: DataFrame, seeds: DataFrame, max_hops: int = 1, max_articles: int = 50) -> DataFrame:
    """(title, hops): articles around all seeds(title) together, nearest first, up to max_articles with the seeds."""
    bounded("max_hops", max_hops, 0, 3)
    bounded("max_articles", max_articles, 1, 100)
    n = seeds.count()
    bounded("seeds", n, 0, 100)
    each = shortest_hops(edges, seeds.select(F.col("title").alias("seed")), max_hops)
    near = each.groupBy(F.col("node").alias("title")).agg(F.min("hops").alias("hops")).join(seeds, "title", "left_anti")
    return near.orderBy("hops", "title").limit(max(0, max_articles - n))


def cooccurrence(pairs: DataFrame, least: int = 2, hub: int | None = None, heavy: int = 1000, changed: DataFrame | None = None, wide: int = 24) -> DataFrame:
    """(src, dst, shared): articles with `least` entities or more in common, in both directions.

    pairs(article, entity) is distinct. `hub` leaves out entities in more articles than that, where a
    caller wants it; none are left out by default. With changed(article) only pairs with one of these
    articles are given.

    Articles that share two entities share a pair of them, and few others do: those of up to `wide`
    entities meet by pair of entities, so what is joined grows with the articles, not with the square
    of an entity's. Articles of more entities, and all if one shared entity is enough, meet by entity.
    """
    bounded("least", least, 1, 1000)
    if changed is None:
        p = pairs.select("article", "entity", F.lit(True).alias("fresh"))
    else:
        mark = changed.select("article").distinct().withColumn("fresh", F.lit(True))
        p = pairs.join(mark, "article", "left").select("article", "entity", F.coalesce("fresh", F.lit(False)).alias("fresh"))
        p = p.join(p.where("fresh").select("entity").distinct(), "entity", "left_semi")
    if hub is not None:
        p = p.join(p.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") <= hub), "entity", "left_semi")
    if least == 1:
        up = _by_entity(p.withColumn("lead", F.col("fresh")), least, heavy)
    else:
        p = p.where("entity IS NOT NULL")
        place = F.row_number().over(Window.partitionBy("article").orderBy("entity"))
        few = p.withColumn("place", place).where(F.col("place") <= wide + 1).groupBy("article", "fresh").agg(F.array_sort(F.collect_list("entity")).alias("held"))
        few = storage.written(few.where(F.size("held") >= least), "entities")  # one more than `wide` tells an article of many
        up = _by_two(few.where(F.size("held") <= wide), heavy)
        many = few.where(F.size("held") > wide).select("article", F.lit(True).alias("lead"))
        if not many.isEmpty():
            p = p.join(p.join(many, "article").select("entity").distinct(), "entity", "left_semi").join(few.select("article"), "article", "left_semi")
            p = p.join(many, "article", "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
            up = up.unionByName(_by_entity(storage.written(p, "pairs"), least, heavy))
    up = up.where(F.col("shared") >= least)
    return up.select("src", "dst", "shared").unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "shared"))


def _meeting(left: DataFrame, right: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """(src, dst) with src < dst, once for each key that both have, of a leading article and any other, one of them fresh."""
    a = left.where("lead").select(*keys, F.col("article").alias("a"), F.col("fresh").alias("new"), *(F.col(c).alias(f"a_{c}") for c in more))
    b = right.select(*keys, F.col("article").alias("b"), "lead", "fresh", *(F.col(c).alias(f"b_{c}") for c in more))
    both = a.join(b, keys).where("a <> b AND (NOT lead OR a < b) AND (new OR fresh)")
    return both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), *keys, *(x for c in more for x in (f"a_{c}", f"b_{c}")))


def _dealt(groups: DataFrame, keys: list[str], block: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of groups' meeting by keys, x and y: large groups over pairs of blocks of about `block` articles, so no key is large."""
    sizes = groups.groupBy(*keys).agg(F.count("*").alias("size"), F.max("lead").alias("led")).where("size > 1 AND led").drop("led")
    kept = storage.written(groups.join(sizes, keys), "groups")  # few of them, and read twice
    dealt = kept.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("article"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = dealt.select("article", "lead", "fresh", *more, *keys, F.col("own").alias("x"), F.col("other").alias("y"))
    right = dealt.select("article", "lead", "fresh", *more, *keys, F.col("other").alias("x"), F.col("own").alias("y"))
    return left, right


def _by_two(held: DataFrame, block: int) -> DataFrame:
    """(src, dst, shared) of articles that share two entities or more, of held(article, fresh, held) with few each: they meet once for every two they share."""
    one = held.select("article", F.col("fresh").alias("lead"), "fresh", "held", F.posexplode("held").alias("at", "first"))
    two = one.select("article", "lead", "fresh", "first", F.explode(F.expr("slice(held, at + 2, size(held))")).alias("second"))
    met = _meeting(*_dealt(two, ["first", "second"], block), ["first", "second", "x", "y"]).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return met.select("src", "dst", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("shared"))  # s entities make n = s(s - 1)/2 twos


def _by_entity(p: DataFrame, least: int, heavy: int) -> DataFrame:
    """(src, dst, shared) of leading articles and any others, by the entities in p(article, entity, lead, fresh).

    Entities of more than `heavy` articles never put their articles together one by one. Articles that
    share another entity look up how many heavy ones they share besides; those that share heavy ones
    alone meet in groups of two heavy entities (of one, if one is enough), where every pair counts.
    """
    n = p.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1")
    light = p.join(n.where(F.col("n") <= heavy).select("entity"), "entity", "left_semi")
    up = _meeting(light, light, ["entity"]).groupBy("src", "dst").agg(F.count("*").alias("shared"))
    many = n.where(F.col("n") > heavy).select("entity")
    return up if many.isEmpty() else _with_heavy(up, p.join(many, "entity", "left_semi"), least, heavy)


def _with_heavy(up: DataFrame, heavy_pairs: DataFrame, least: int, block: int) -> DataFrame:
    """up(src, dst, shared) with the shared entities of heavy_pairs added, and the pairs that share only those."""
    held = heavy_pairs.groupBy("article", "lead", "fresh").agg(F.array_sort(F.collect_set("entity")).alias("held"))
    own = held.select("article", "held")
    none = F.array_except("a_held", "a_held")
    known = up.join(own.toDF("src", "a_held"), "src", "left").join(own.toDF("dst", "b_held"), "dst", "left")
    both = F.array_intersect(F.coalesce("a_held", none), F.coalesce("b_held", none))
    known = known.select("src", "dst", (F.col("shared") + F.coalesce(F.when(F.col("a_held").isNotNull() & F.col("b_held").isNotNull(), F.size(both)), F.lit(0))).alias("shared"))
    # groups: two heavy entities of an article (one, if one is enough)
    two = F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.array(x, y))))
    groups = held.withColumn("group", F.explode(F.transform("held", lambda x: F.array(x)) if least == 1 else two))
    met = _meeting(*_dealt(groups, ["group"], block, "held"), ["group", "x", "y"], "held").withColumn("both", F.array_intersect("a_held", "b_held"))
    alone = met.where(F.col("group") == F.slice("both", 1, 1 if least == 1 else 2)).select("src", "dst", F.size("both").cast("long").alias("shared"))  # a pair's first group
    return known.unionByName(alone).groupBy("src", "dst").agg(F.max("shared").alias("shared"))


def cooccurrence_after(old: DataFrame, pairs: DataFrame, added: DataFrame, removed: DataFrame | None = None, least: int = 2, heavy: int = 1000, wide: int = 24) -> tuple[DataFrame, DataFrame]:
    """(edges, pairs) after pairs(article, entity) are added and removed: only edges of articles among those are made anew."""
    now = pairs.select("article", "entity")
    changed = added.select("article")
    if removed is not None:
        now, changed = now.join(removed, ["article", "entity"], "left_anti"), changed.union(removed.select("article"))
    now = now.unionByName(added.select("article", "entity")).distinct()
    changed = changed.distinct()
    kept = old.join(changed.withColumnRenamed("article", "src"), "src", "left_anti").join(changed.withColumnRenamed("article", "dst"), "dst", "left_anti")
    return kept.select("src", "dst", "shared").unionByName(cooccurrence(now, least, heavy=heavy, changed=changed, wide=wide)), now


def linked_by_entities(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Co-occurrence as edges of the graph: (src, dst, link_type)."""
    return cooccurrence(pairs, least).select("src", "dst", F.lit("cooccurrence").alias("link_type"))


def shown(nodes: DataFrame, categories: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Nodes(title, category, depth) that a view shows: of some categories (all without any) and not too deep."""
    kept = nodes if not categories else nodes.where(F.col("category").isin(categories))
    return kept if max_depth is None else kept.where(F.col("depth") <= max_depth)


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """(page, depth) in the order of a breadth-first crawl from seeds(page), `max_pages` at most."""
    found = shortest_hops(links, seeds.select(F.col("page").alias("seed")), max_depth, keep_seed=True)
    return found.groupBy(F.col("node").alias("page")).agg(F.min("hops").alias("depth")).orderBy("depth", "page").limit(max_pages)


def merge_graphs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, the new one where both have it."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti")).dropDuplicates(keys)
