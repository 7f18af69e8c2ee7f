"""Search queries: vector search and its callers, lookups, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave import storage
from graphweave.operators import answer, graph, retrieve, vector
from graphweave.operators.title_index import TitleIndex
from graphweave.operators.vector_index import VectorIndex
from graphweave.plans.catalog import query
from graphweave.sources import views as v

SEEDS = [f"A{k}" for k in range(0, 60, 3)]
SEED_SQL = "seeds AS (SELECT 'A' || (k * 3) AS seed FROM range(20) t(k))"
QUESTIONS = [("A0", "What is A12?"), ("A3", "Explain A1"), ("A6", "tell me about zzz"), ("A9", "describe the thing near A7")]
QUESTION_SQL = "qs AS (SELECT * FROM (VALUES ('A0', 'What is A12?'), ('A3', 'Explain A1'), ('A6', 'tell me about zzz'), ('A9', 'describe the thing near A7')) t(seed, question))"
DISTANCE = "1 - list_dot_product(list_transform(s.v, lambda x: x / sqrt(list_dot_product(s.v, s.v))), list_transform(q.v, lambda x: x / sqrt(list_dot_product(q.v, q.v))))"


def _near(k: int, own: str = "s.title <> n.seed") -> str:
    """The k nearest sections of each seed, then the best of each article."""
    return f"""
    q AS (SELECT seed, v FROM seeds JOIN sec ON sec.title = seed AND section_index = 0 AND v IS NOT NULL),
    d AS (SELECT seed, s.title, s.section_id, s.content, {DISTANCE} AS distance FROM q, sec s WHERE s.v IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, section_id) AS k FROM d QUALIFY k <= {k}),
    best AS (SELECT seed, title, section_id, content, distance FROM n s {'WHERE s.title <> s.seed' if own else ''} QUALIFY row_number() OVER (PARTITION BY seed, title ORDER BY distance, section_id) = 1)"""


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "seed string")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "seed string, question string")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _ranked(k: int) -> str:
    return f"SELECT seed, title, section_id, round(greatest(0, least(1, 1 - distance)), 6) AS similarity, CAST(row_number() OVER (PARTITION BY seed ORDER BY distance, title) AS INT) AS rank FROM best QUALIFY rank <= {k}"


@query(f"WITH {v.SQL}, {SEED_SQL}, {_near(50)} {_ranked(10)}")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector.semantic_search(v.sections(spark, d), seeds(spark)), "similarity")


@query(f"WITH {v.SQL}, {SEED_SQL}, {_near(50)} {_ranked(10)}")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The same through a stored index, built from half of the sections, to which the others were added."""
    s = v.sections(spark, d)
    kept = s.select("section_id", "title", "embedding")
    half = F.pmod(F.xxhash64("section_id"), F.lit(2)) == 0
    index = VectorIndex.build(kept.where(half), storage.new_path(spark, "vectors"), "section_id")
    index.append(kept.where(~half))
    return rounded(vector.semantic_search(s, seeds(spark), index=index, exact=True), "similarity")


@query(f"WITH {v.SQL}, {SEED_SQL}, {_near(50)}, inside AS (SELECT * FROM best WHERE title IN (SELECT title FROM art WHERE category = 'cat_3')) {_ranked(10).replace('FROM best', 'FROM inside')}")
def semantic_search_in_category(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector.semantic_search(v.sections(spark, d), seeds(spark), v.articles(spark, d), "cat_3"), "similarity")


@query(f"""WITH {v.SQL}, {SEED_SQL}, {_near(50)}, r AS ({_ranked(10).replace("SELECT seed,", "SELECT greatest(0, least(1, 1 - distance)) AS exact, seed,")}),
  lead AS (SELECT title, content FROM sec WHERE section_index = 0)
  SELECT seed, r.title, similarity, rank, category, word_count, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS summary
  FROM r JOIN art USING (title) LEFT JOIN lead USING (title) WHERE exact >= 0.3""")
def search_with_details(spark: SparkSession, d: str) -> DataFrame:
    from graphweave.functions.text import summary

    found = rounded(vector.semantic_search(v.sections(spark, d), seeds(spark)).where("similarity >= 0.3"), "similarity")
    lead = v.sections(spark, d).where("section_index = 0").select("title", summary(F.col("content")).alias("summary"))
    return found.join(v.articles(spark, d), "title").join(lead, "title", "left").select("seed", "title", "similarity", "rank", "category", "word_count", "summary")


@query(f"WITH {v.SQL}, {SEED_SQL}, {_near(15, '')} SELECT seed, title, content, round(greatest(0, least(1, 1 - distance)), 6) AS similarity, CAST(row_number() OVER (PARTITION BY seed ORDER BY distance, title) AS INT) AS rank FROM best QUALIFY rank <= 5")
def agent_search(spark: SparkSession, d: str) -> DataFrame:
    s = v.sections(spark, d)
    return rounded(vector.agent_search(s, vector.lead_vectors(s, seeds(spark)), 5), "similarity")


@query(f"WITH {v.SQL}, {SEED_SQL}, {_near(50)}, r AS ({_ranked(10)}) SELECT title, max(similarity) AS similarity FROM r GROUP BY title")
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    return vector.multi_query(semantic_search(spark, d))


@query(f"WITH {v.SQL}, {SEED_SQL}, {_near(50)}, r AS ({_ranked(10)}) SELECT * FROM r WHERE seed IN (SELECT seed FROM r GROUP BY seed HAVING max(similarity) >= 0.4)")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return vector.confidence_gate(semantic_search(spark, d), 0.4)


@query(f"""WITH {v.SQL}, {SEED_SQL}, q AS (SELECT seed, v FROM seeds JOIN sec ON sec.title = seed AND section_index = 0 AND v IS NOT NULL)
  SELECT seed, example, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY seed ORDER BY s DESC, example) AS INT) AS rank
  FROM (SELECT seed, vec_id AS example, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS s FROM embeddings e, q) QUALIFY rank <= 3""")
def few_shot(spark: SparkSession, d: str) -> DataFrame:
    shots = v.base(spark, d, "embeddings").select(F.col("vec_id").alias("example"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rounded(vector.few_shot(shots, vector.lead_vectors(v.sections(spark, d), seeds(spark))), "score")


_LOOKUP = f"""WITH {v.SQL}, {QUESTION_SQL}, s AS (SELECT question, regexp_replace(regexp_replace(lower(trim(question)), '^(what is|explain|describe|tell me about)\\s+', ''), '[?. ]+$', '') AS subject FROM qs),
  exact AS (SELECT question, title, true AS exact FROM s JOIN art ON lower(title) = subject),
  part AS (SELECT question, title, false AS exact FROM s JOIN art ON contains(lower(title), subject) WHERE question NOT IN (SELECT question FROM exact))
  SELECT question, title, exact, CAST(row_number() OVER (PARTITION BY question ORDER BY length(title), title) AS INT) AS place FROM (SELECT * FROM exact UNION ALL SELECT * FROM part) QUALIFY place <= 3"""


@query(_LOOKUP)
def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.title_lookup(v.articles(spark, d), questions(spark).select("question"))


@query(_LOOKUP)
def indexed_title_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The same through a stored index, built from half of the titles, to which the others were added."""
    a = v.articles(spark, d)
    half = F.pmod(F.xxhash64("title"), F.lit(2)) == 0
    index = TitleIndex.build(a.where(half), storage.new_path(spark, "titles"))
    index.append(a.where(~half))
    return retrieve.title_lookup(a, questions(spark).select("question"), index=index)


@query(f"WITH {v.SQL} SELECT title, category, CASE WHEN starts_with(lower(title), 'a1') THEN 'prefix' ELSE 'contains' END AS match_type FROM art WHERE contains(lower(title), 'a1') ORDER BY match_type <> 'prefix', title LIMIT 10")
def autocomplete(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.autocomplete(v.articles(spark, d), "a1")


HYBRID = f"""{_near(200)}, near AS (SELECT seed, title, greatest(0, least(1, 1 - distance)) AS similarity FROM best QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, title) <= 100),
  w1 AS (SELECT DISTINCT seed, dst AS title, 1 AS hops FROM seeds JOIN lnk ON src = seed),
  w2 AS (SELECT DISTINCT seed, dst AS title, 2 AS hops FROM w1 JOIN lnk ON src = title),
  far AS (SELECT seed, title, min(hops) AS hops FROM (SELECT * FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hops, title) <= 100) GROUP BY ALL),
  sc AS (SELECT near.seed, near.title, similarity, hops, 0.7 * similarity + coalesce(0.3 / (hops + 1), 0) AS score FROM near LEFT JOIN far USING (seed, title) WHERE hops IS NOT NULL OR near.seed NOT IN (SELECT seed FROM far))"""


@query(f"WITH {v.SQL}, {SEED_SQL}, {HYBRID} SELECT seed, title, round(similarity, 6) AS similarity, hops, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, title) AS INT) AS rank FROM sc QUALIFY rank <= 10")
def hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieve.hybrid_query(v.sections(spark, d), v.links(spark, d), v.articles(spark, d), seeds(spark)), "similarity", "score")


_RETRIEVE = f"""r AS ({_ranked(10)}),
  one AS (SELECT seed, title, 0.5 * similarity AS part FROM r),
  two AS (SELECT r.seed, dst AS title, 0.15 AS part FROM r JOIN lnk ON src = r.title WHERE rank <= 3 QUALIFY row_number() OVER (PARTITION BY r.seed, r.title ORDER BY dst) <= 10),
  kw AS (SELECT * FROM (VALUES ('A9', 1, 'thing'), ('A9', 2, 'near'), ('A0', 1, 'A12?')) t(seed, pos, word)),
  three AS (SELECT seed, title, 0.14 AS part FROM kw JOIN art ON contains(lower(title), lower(word)) QUALIFY row_number() OVER (PARTITION BY seed, pos ORDER BY title) <= 10),
  tot AS (SELECT seed, title, sum(part) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY ALL)"""


@query(f"WITH {v.SQL}, {SEED_SQL}, {_near(50)}, {_RETRIEVE} SELECT seed, title, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, title) AS INT) AS rank FROM tot QUALIFY rank <= 10")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieve.hybrid_retrieve(semantic_search(spark, d), v.links(spark, d), v.articles(spark, d), questions(spark)), "score")


_FUSED = f"""r AS ({_ranked(10)}), deg AS (SELECT title, count(*) AS degree FROM (SELECT src AS title FROM lnk UNION ALL SELECT dst FROM lnk) GROUP BY title),
  f AS (SELECT seed, r.title, rank - 1 AS old, coalesce(degree, 0) AS degree FROM r LEFT JOIN deg USING (title)),
  g AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY degree DESC, old) - 1 AS pd FROM f),
  h AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(1.0::DOUBLE / (60 + old) + 0.5::DOUBLE / (60 + pd), 12) DESC, old) - 1 AS new FROM g),
  z AS (SELECT *, bool_or(old = 0 AND new < 3) OVER (PARTITION BY seed) AS safe FROM h),
  fused AS (SELECT seed, title, CAST(CASE WHEN safe THEN new ELSE old END AS INT) AS place FROM z WHERE NOT safe OR new < 5)"""


@query(f"WITH {v.SQL}, {SEED_SQL}, {_near(50)}, {_FUSED} SELECT * FROM fused")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.fuse(semantic_search(spark, d), v.links(spark, d))


@query(f"""WITH {v.SQL}, {SEED_SQL}, {_near(50)}, {_FUSED},
  more AS (SELECT seed, dst AS title, 100000 + row_number() OVER (PARTITION BY seed ORDER BY dst) AS late FROM fused JOIN lnk ON src = fused.title WHERE fused.place = 0 QUALIFY late <= 100002),
  al AS (SELECT seed, title, min(p) AS p FROM (SELECT seed, title, place AS p FROM fused UNION ALL SELECT * FROM more) GROUP BY ALL)
  SELECT seed, title, CAST(row_number() OVER (PARTITION BY seed ORDER BY p, title) - 1 AS INT) AS place FROM al QUALIFY row_number() OVER (PARTITION BY seed ORDER BY p, title) <= 7""")
def one_hop_expansion(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.add_neighbours(rank_fusion(spark, d), v.links(spark, d))


@query(f"""WITH {v.SQL}, {SEED_SQL}, {_near(50)}, {_FUSED} SELECT seed, string_agg('[' || (place + 1) || '] ' || title, chr(10) ORDER BY place) AS body FROM fused GROUP BY seed""")
def citation_list(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.citations(rank_fusion(spark, d))


@query()
def source_text(spark: SparkSession, d: str) -> DataFrame:
    asked = seeds(spark).withColumn("question", F.lit("what is the thing"))
    return retrieve.source_text(rank_fusion(spark, d), v.sections(spark, d), asked)


@query(f"""WITH {v.SQL}, {SEED_SQL}, {_near(50)}, r AS ({_ranked(10)}), deg AS (SELECT title, count(*) AS degree FROM (SELECT src AS title FROM lnk UNION ALL SELECT dst FROM lnk) GROUP BY title),
  t AS (SELECT DISTINCT title FROM r), c AS (SELECT title, CASE WHEN (SELECT count(*) FROM lnk) < 2 * (SELECT n FROM num) THEN 0.0::DOUBLE ELSE coalesce(degree, 0)::DOUBLE / max(coalesce(degree, 0)) OVER () END AS centrality FROM t LEFT JOIN deg USING (title))
  SELECT seed, title, round(similarity * 0.6 + centrality * 0.4, 6) AS score FROM r JOIN c USING (title)""")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    found = semantic_search(spark, d).select("seed", "title", F.col("similarity").alias("score"))
    return rounded(graph.rerank(found, v.links(spark, d), v.articles(spark, d)), "score").select("seed", "title", "score")


_ANSWER = f"""{SEED_SQL}, {QUESTION_SQL}, {_near(15, '')},
  vh AS (SELECT seed, title, greatest(0, least(1, 1 - distance)) AS similarity, row_number() OVER (PARTITION BY seed ORDER BY distance, title) AS rank FROM best WHERE seed IN (SELECT seed FROM qs) QUALIFY rank <= 5),
  sure AS (SELECT * FROM vh WHERE seed IN (SELECT seed FROM vh GROUP BY seed HAVING max(similarity) >= 0.5)),
  sj AS (SELECT seed, question, regexp_replace(regexp_replace(lower(trim(question)), '^(what is|explain|describe|tell me about)\\s+', ''), '[?. ]+$', '') AS subject FROM qs),
  ex AS (SELECT seed, title FROM sj JOIN art ON lower(title) = subject), pt AS (SELECT seed, title FROM sj JOIN art ON contains(lower(title), subject) WHERE seed NOT IN (SELECT seed FROM ex)),
  dm AS (SELECT seed, title, row_number() OVER (PARTITION BY seed ORDER BY length(title), title) AS place FROM (SELECT * FROM ex UNION ALL SELECT * FROM pt) QUALIFY place <= 3),
  h1 AS (SELECT seed, title, 0.5 * similarity AS part FROM sure),
  h2 AS (SELECT s.seed, dst AS title, 0.15 AS part FROM sure s JOIN lnk ON src = s.title WHERE rank <= 3 QUALIFY row_number() OVER (PARTITION BY s.seed, s.title ORDER BY dst) <= 5),
  kw AS (SELECT * FROM (VALUES ('A9', 1, 'thing'), ('A9', 2, 'near'), ('A0', 1, 'A12?')) t(seed, pos, word)),
  h3 AS (SELECT seed, title, 0.14 AS part FROM kw JOIN art ON contains(lower(title), lower(word)) QUALIFY row_number() OVER (PARTITION BY seed, pos ORDER BY title) <= 5),
  hs AS (SELECT seed, title, round(sum(part), 9) AS part FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY seed, title),
  hy AS (SELECT seed, title, row_number() OVER (PARTITION BY seed ORDER BY part DESC, title) AS rank FROM hs QUALIFY rank <= 5),
  bag AS (SELECT seed, title, min(spot) AS spot FROM (SELECT seed, title, place AS spot FROM dm UNION ALL SELECT seed, title, 1000 + rank FROM sure UNION ALL SELECT seed, title, 2000 + rank FROM hy) GROUP BY ALL),
  r AS (SELECT seed, title, row_number() OVER (PARTITION BY seed ORDER BY spot, title) AS rank FROM bag QUALIFY rank <= 10),
  {_FUSED[_FUSED.index("deg AS"):]},
  more AS (SELECT seed, dst AS title, 100000 + row_number() OVER (PARTITION BY seed ORDER BY dst) AS late FROM fused JOIN lnk ON src = fused.title WHERE fused.place = 0 QUALIFY late <= 100002),
  al AS (SELECT seed, title, min(p) AS p FROM (SELECT seed, title, place AS p FROM fused UNION ALL SELECT * FROM more) GROUP BY ALL)"""


@query(f"WITH {v.SQL}, {_ANSWER} SELECT seed, title, CAST(row_number() OVER (PARTITION BY seed ORDER BY p, title) - 1 AS INT) AS place FROM al QUALIFY row_number() OVER (PARTITION BY seed ORDER BY p, title) <= 7")
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    s = v.sections(spark, d)
    asked = questions(spark)
    return answer.sources(s, v.articles(spark, d), v.links(spark, d), asked, vector.lead_vectors(s, asked.select("seed")))


@query(f"""WITH {v.SQL}, {SEED_SQL}, {_near(15, '')}, p AS (SELECT seed, title, greatest(0, least(1, 1 - distance)) AS similarity, row_number() OVER (PARTITION BY seed ORDER BY distance, title) AS rank FROM best QUALIFY rank <= 5),
  m AS (SELECT CASE WHEN CAST(substring(seed, 2) AS INT) < 30 THEN 'low' ELSE 'high' END AS seed, title, max(similarity) AS s FROM p GROUP BY ALL)
  SELECT seed, title, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY seed ORDER BY round(s, 9) DESC, title) AS INT) AS rank FROM m""")
def multi_query_search(spark: SparkSession, d: str) -> DataFrame:
    s = v.sections(spark, d)
    n = F.substring("seed", 2, 9).cast("int")
    phrased = vector.lead_vectors(s, seeds(spark)).select(F.when(n < 30, "low").otherwise("high").alias("seed"), n.alias("phrase"), "query_vector")
    return rounded(vector.multi_query_search(s, phrased, 5), "similarity").select("seed", "title", "similarity", "rank")


@query(f"""WITH {v.SQL}, few AS (SELECT title FROM art ORDER BY title LIMIT 20),
  lead AS (SELECT title, arg_min(content, section_index) AS content FROM sec WHERE title IN (SELECT title FROM few) GROUP BY title ORDER BY title LIMIT 5)
  SELECT 'Pack contains ' || (SELECT count(*) FROM few) || ' articles including:' || chr(10) || chr(10) || (SELECT string_agg('- ' || title, chr(10) ORDER BY title) FROM (SELECT title FROM few ORDER BY title LIMIT 15))
    || chr(10) || chr(10) || 'Sample content snippets:' || chr(10) || (SELECT string_agg(chr(10) || '[' || title || ']: ' || replace(substring(content, 1, 200), chr(10), ' ') || '...', chr(10) ORDER BY title) FROM lead) AS body""")
def context_sample(spark: SparkSession, d: str) -> DataFrame:
    return answer.context_sample(v.articles(spark, d), v.sections(spark, d))


@query(f"""WITH {v.SQL}, s AS (SELECT * FROM (VALUES ('a0', 0), ('A7', 1), ('none', 2)) t(seed, ord)), named AS (SELECT title AS seed, ord FROM s JOIN art ON lower(title) = lower(seed)),
  w1 AS (SELECT DISTINCT seed, dst AS title, 1 AS hops FROM named JOIN lnk ON src = seed), w2 AS (SELECT DISTINCT seed, dst AS title, 2 AS hops FROM w1 JOIN lnk ON src = title),
  nr AS (SELECT seed, title, min(hops) AS hops FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) WHERE title <> seed AND title IN (SELECT title FROM art WHERE word_count > 0) GROUP BY ALL),
  rel AS (SELECT title, hops, ord * 1000 + row_number() OVER (PARTITION BY seed ORDER BY hops, title) AS pos FROM nr JOIN named USING (seed) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hops, title) <= 5),
  al AS (SELECT title, min(pos) AS pos, arg_min(hops, pos) AS hops FROM (SELECT seed AS title, 0 AS hops, ord * 1000 AS pos FROM named UNION ALL SELECT * FROM rel) GROUP BY title)
  SELECT title, CAST(row_number() OVER (ORDER BY pos, title) AS INT) AS place, CAST(hops AS INT) AS hops, content FROM al LEFT JOIN (SELECT title, content FROM sec WHERE section_index = 0) USING (title) QUALIFY place <= 15""")
def graph_context(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([("a0", 0), ("A7", 1), ("none", 2)], "seed string, ord int")
    return retrieve.graph_context(v.links(spark, d), s, v.articles(spark, d), v.sections(spark, d))


@query(f"""WITH {v.SQL}, {SEED_SQL}, {_near(15, '')}, f AS (SELECT seed, title, content, CAST(row_number() OVER (PARTITION BY seed ORDER BY distance, title) AS INT) AS rank FROM best QUALIFY rank <= 5),
  k AS (SELECT list_distinct(string_split('the of anat thing', ' ')) AS ks),
  sc AS (SELECT seed, title, rank, len(list_intersect(ks, list_transform(list_filter(regexp_split_to_array(CASE WHEN content <> '' THEN content ELSE title END, '\\s+'), lambda w: w <> ''), lambda w: lower(w)))) / len(ks) AS score FROM f, k)
  SELECT seed, title, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, rank) AS INT) AS new_rank FROM sc QUALIFY new_rank <= 3""")
def pair_rerank(spark: SparkSession, d: str) -> DataFrame:
    asked = seeds(spark).withColumn("question", F.lit("the of anat thing"))
    return rounded(retrieve.pair_rerank(agent_search(spark, d), asked, 3), "score").select("seed", "title", "score", "new_rank")
