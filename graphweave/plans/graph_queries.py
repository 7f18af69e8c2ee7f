"""Graph queries: traversal, neighbourhoods, degrees, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave import storage
from graphweave.operators import graph, retrieve, stats
from graphweave.operators.degree_table import LinkTable
from graphweave.plans.catalog import query
from graphweave.sources import views as v

SEED_SQL = "seeds AS (SELECT 'A' || (k * 3) AS seed FROM range(20) t(k))"
WALKS = """w1 AS (SELECT DISTINCT seed, dst AS title, 1 AS hops FROM seeds JOIN lnk ON src = seed),
  w2 AS (SELECT DISTINCT seed, dst AS title, 2 AS hops FROM w1 JOIN lnk ON src = title)"""
BFS = f"{WALKS}, near AS (SELECT seed, title, min(hops) AS depth FROM (SELECT seed, seed AS title, 0 AS hops FROM seeds UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY ALL)"


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"A{k}",) for k in range(0, 60, 3)], "seed string")


@query(f"WITH {v.SQL}, {SEED_SQL}, {WALKS} SELECT * FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hops, title) <= 50")
def graph_traversal(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_traversal(v.links(spark, d), seeds(spark), v.articles(spark, d))


@query(f"WITH {v.SQL}, {SEED_SQL}, {WALKS} SELECT w.* FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) w JOIN art USING (title) WHERE category IN ('cat_1') QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hops, title) <= 50")
def graph_traversal_in_category(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_traversal(v.links(spark, d), seeds(spark), v.articles(spark, d), category="cat_1")


@query(f"WITH {v.SQL}, {SEED_SQL}, {BFS} SELECT seed, title AS node, CAST(depth AS INT) AS hops FROM near WHERE depth > 0")
def shortest_hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_hops(v.links(spark, d), seeds(spark), 2)


_NEIGHBOURS = "nb AS (SELECT seed, near.title, depth, category, word_count FROM near JOIN art USING (title) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, near.title) <= 20)"


@query(f"WITH {v.SQL}, {SEED_SQL}, {BFS}, {_NEIGHBOURS} SELECT nb.*, coalesce(links, 0) AS links FROM nb LEFT JOIN (SELECT src AS title, count(*) AS links FROM lnk GROUP BY src) USING (title)")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_neighbors(v.links(spark, d), seeds(spark), v.articles(spark, d), limit=20)


@query(f"WITH {v.SQL}, {SEED_SQL}, {BFS}, {_NEIGHBOURS} SELECT a.seed, src, dst FROM lnk JOIN nb a ON a.title = src JOIN nb b ON b.title = dst AND a.seed = b.seed QUALIFY row_number() OVER (PARTITION BY a.seed ORDER BY src, dst) <= 1000")
def graph_neighbor_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.induced_edges(v.links(spark, d), graph_neighbors(spark, d))


@query(f"""WITH cl AS (SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE src <> dst),
  l1 AS (SELECT DISTINCT dst AS n FROM cl WHERE src = 1), l2 AS (SELECT DISTINCT dst AS n FROM cl JOIN l1 ON src = n), l3 AS (SELECT DISTINCT dst AS n FROM cl JOIN l2 ON src = n)
  SELECT n AS node, CAST(min(h) AS INT) AS hops FROM (SELECT n, 1 AS h FROM l1 UNION ALL SELECT n, 2 FROM l2 UNION ALL SELECT n, 3 FROM l3) WHERE n <> 1 GROUP BY n""")
def customer_reach(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([(1,)], "seed long")
    return graph.shortest_hops(v.customer_links(spark, d), one, 3).select("node", "hops")


@query(f"WITH {v.SQL}, deg AS (SELECT title, count(*) AS degree FROM (SELECT src AS title FROM lnk UNION ALL SELECT dst FROM lnk) GROUP BY title) SELECT art.title, round(coalesce(degree, 0)::DOUBLE / max(coalesce(degree, 0)) OVER (), 6) AS centrality FROM art LEFT JOIN deg USING (title)")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.centrality(v.links(spark, d), v.articles(spark, d)).select("title", F.round("centrality", 6).alias("centrality"))


@query(f"WITH {v.SQL}, deg AS (SELECT title, count(*) AS degree FROM (SELECT src AS title FROM lnk UNION ALL SELECT dst FROM lnk) GROUP BY title) SELECT art.title, round(coalesce(degree, 0)::DOUBLE / max(coalesce(degree, 0)) OVER (), 6) AS centrality FROM art LEFT JOIN deg USING (title)")
def maintained_centrality(spark: SparkSession, d: str) -> DataFrame:
    """The same from kept degrees: half of the links at first, then the others come and links that are not in the graph go."""
    links = v.links(spark, d)
    half = F.pmod(F.xxhash64("src", "dst"), F.lit(2)) == 0
    false = links.where(half).select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(links, ["src", "dst"], "left_anti")
    table = LinkTable.create(links.where(half).unionByName(false), storage.new_path(spark, "links"))
    table.change(links.where(~half), false)
    return table.centrality(v.articles(spark, d)).select("title", F.round("centrality", 6).alias("centrality"))


@query(f"WITH {v.SQL} SELECT round((SELECT count(*) FROM lnk) / (SELECT count(*) FROM art), 6) AS density")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(graph.density(v.links(spark, d), v.articles(spark, d)), 6),)], "density double")


@query(f"""WITH {v.SQL}, {SEED_SQL}, few AS (SELECT seed FROM seeds WHERE seed IN ('A0', 'A3', 'A6')), h1 AS (SELECT DISTINCT dst AS title, 1 AS hops FROM few JOIN lnk ON src = seed), h2 AS (SELECT DISTINCT dst AS title, 2 AS hops FROM h1 JOIN lnk ON src = title)
  SELECT title, CAST(min(hops) AS INT) AS hops FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE title NOT IN (SELECT seed FROM few) GROUP BY title ORDER BY hops, title LIMIT 27""")
def expand_related(spark: SparkSession, d: str) -> DataFrame:
    few = spark.createDataFrame([("A0",), ("A3",), ("A6",)], "title string")
    return graph.expand_related(v.links(spark, d), few, 2, 30)


_REL = "rel AS (SELECT src, dst, 'r' || (CAST(substring(dst, 2) AS INT) % 3) AS relation FROM lnk)"


@query(f"""WITH {v.SQL}, {_REL}, pr AS (SELECT 'A' || k AS source, 'A' || (k + 5) AS target FROM range(10) t(k)),
  p1 AS (SELECT source, target, dst AS here, [source, dst] AS path, [relation] AS relations FROM pr JOIN rel ON src = source),
  p2 AS (SELECT source, target, dst AS here, list_append(path, dst) AS path, list_append(relations, relation) AS relations FROM p1 JOIN rel ON src = here),
  p3 AS (SELECT source, target, dst AS here, list_append(path, dst) AS path, list_append(relations, relation) AS relations FROM p2 JOIN rel ON src = here),
  al AS (SELECT *, 1 AS hops FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3)
  SELECT source, target, array_to_string(path, '>') AS path, array_to_string(relations, '>') AS relations, hops, CAST(row_number() OVER (PARTITION BY source, target ORDER BY hops, al.path, al.relations) AS INT) AS place FROM al WHERE here = target QUALIFY place <= 5""")
def relationship_paths(spark: SparkSession, d: str) -> DataFrame:
    e = v.links(spark, d).withColumn("relation", F.concat(F.lit("r"), (F.substring("dst", 2, 9).cast("int") % 3).cast("string")))
    pairs = spark.createDataFrame([(f"A{k}", f"A{k + 5}") for k in range(10)], "source string, target string")
    return graph.paths(e, pairs).withColumns({c: F.array_join(c, ">") for c in ("path", "relations")})


_TOGETHER = """WITH p AS (SELECT DISTINCT l_orderkey AS article, l_partkey AS entity FROM lineitem), u AS (SELECT a.article AS src, b.article AS dst, count(*) AS shared FROM p a JOIN p b USING (entity) WHERE a.article < b.article GROUP BY ALL HAVING count(*) >= 2)
  SELECT src, dst, shared FROM u UNION ALL SELECT dst, src, shared FROM u"""


@query(_TOGETHER)
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence(v.entity_pairs(spark, d))


@query(_TOGETHER)
def cooccurrence_increment(spark: SparkSession, d: str) -> DataFrame:
    """The same in a step: every hundredth article comes later, and entities that none has go."""
    p = storage.written(v.entity_pairs(spark, d), "pairs")  # read by every step
    late = F.col("article") % 100 == 0
    false = p.where(F.col("article") % 100 == 1).select("article", (F.col("entity") + 1).alias("entity")).join(p, ["article", "entity"], "left_anti").distinct()
    before = p.where(~late).unionByName(false)
    return graph.cooccurrence_after(graph.cooccurrence(before), before, p.where(late), false)[0]


@query(f"WITH {v.SQL}, {SEED_SQL}, {BFS}, {_NEIGHBOURS} SELECT * FROM nb WHERE category IN ('cat_1', 'cat_2') AND depth <= 1")
def shown_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.shown(graph_neighbors(spark, d).drop("links"), ["cat_1", "cat_2"], 1)


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS article, l_partkey AS entity FROM lineitem), u AS (SELECT a.article AS src, b.article AS dst FROM p a JOIN p b USING (entity) WHERE a.article <> b.article GROUP BY ALL HAVING count(*) >= 2)
  SELECT src, dst, 'cooccurrence' AS link_type FROM u""")
def linked_by_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.linked_by_entities(v.entity_pairs(spark, d))


@query(f"WITH {v.SQL}, {SEED_SQL} SELECT * FROM (SELECT seed, 'out' AS direction, dst AS title FROM seeds JOIN lnk ON src = seed UNION ALL SELECT seed, 'in', src FROM seeds JOIN lnk ON dst = seed) QUALIFY row_number() OVER (PARTITION BY seed, direction ORDER BY title) <= 500")
def article_links(spark: SparkSession, d: str) -> DataFrame:
    from graphweave.schema import top

    e, s = v.links(spark, d), seeds(spark)
    out = s.join(e.withColumnRenamed("src", "seed"), "seed").select("seed", F.lit("out").alias("direction"), F.col("dst").alias("title"))
    back = s.join(e.withColumnRenamed("dst", "seed"), "seed").select("seed", F.lit("in").alias("direction"), F.col("src").alias("title"))
    return top(out.unionByName(back), ["seed", "direction"], [F.col("title")], 500, "row").drop("row")


_ENT = "ent AS (SELECT p_partkey AS entity_id, p_name AS name, p_type AS type FROM part), he AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), asked AS (SELECT p_name AS name FROM part WHERE p_partkey <= 30)"


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = v.base(spark, d, "part")
    pairs = v.entity_pairs(spark, d).select(F.col("article").alias("src"), F.col("entity").alias("dst"))
    return part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")), pairs, part.where("p_partkey <= 30").select(F.col("p_name").alias("name")).distinct()


@query(f"WITH {_ENT} SELECT name, type, array_to_string(list_sort(list(DISTINCT src) FILTER (src IS NOT NULL)), ',') AS articles FROM ent LEFT JOIN he ON dst = entity_id WHERE name IN (SELECT name FROM asked) GROUP BY name, type")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    e, he, asked = _entities(spark, d)
    return retrieve.entity_articles(e, he, asked).withColumn("articles", F.array_join(F.col("articles").cast("array<string>"), ","))


@query(f"WITH {v.SQL}, he AS (SELECT DISTINCT 'A' || (l_orderkey % n) AS src, 'E' || (l_partkey % 50) AS dst FROM lineitem, num), asked AS (SELECT 'E' || k AS name FROM range(60) t(k) UNION ALL SELECT 'A1'), held AS (SELECT DISTINCT dst AS name, content FROM he JOIN fct ON title = src WHERE dst IN (SELECT name FROM asked)) SELECT * FROM held UNION ALL SELECT DISTINCT title, content FROM fct WHERE title IN (SELECT name FROM asked) AND title NOT IN (SELECT name FROM held)")
def entity_facts(spark: SparkSession, d: str) -> DataFrame:
    title, name = F.concat(F.lit("A"), (F.col("l_orderkey") % F.col("n")).cast("string")), F.concat(F.lit("E"), (F.col("l_partkey") % 50).cast("string"))
    he = v.base(spark, d, "lineitem").crossJoin(F.broadcast(v.articles_in(spark, d))).select(title.alias("src"), name.alias("dst")).distinct()
    asked = spark.createDataFrame([(f"E{k}",) for k in range(60)] + [("A1",)], "name string")
    return retrieve.facts_of(asked, v.facts(spark, d), he)


@query(f"WITH {v.SQL}, {SEED_SQL}, {BFS} SELECT title AS page, CAST(min(depth) AS INT) AS depth FROM near WHERE seed IN ('A0', 'A3') GROUP BY title ORDER BY depth, page LIMIT 25")
def crawl_order(spark: SparkSession, d: str) -> DataFrame:
    links = v.links(spark, d)
    return graph.crawl(links, spark.createDataFrame([("A0",), ("A3",)], "page string"), 2, 25)


@query(f"WITH {v.SQL}, new AS (SELECT title, 'new' AS version FROM art WHERE article_id % 4 = 0) SELECT * FROM new UNION ALL SELECT title, 'old' FROM art WHERE article_id % 2 = 0 AND title NOT IN (SELECT title FROM new)")
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    a = v.articles(spark, d)
    part = lambda n, name: a.where(F.col("article_id") % n == 0).select("title", F.lit(name).alias("version"))
    return graph.merge_graphs(part(2, "old"), part(4, "new"), ["title"])


@query(f"WITH {v.SQL} SELECT count(*) AS n FROM lnk")
def edge_count(spark: SparkSession, d: str) -> DataFrame:
    return v.links(spark, d).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS article, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return stats.repeated(v.base(spark, d, "lineitem").select(F.col("l_orderkey").alias("article")), "article")
