"""Ingest queries: text functions, pages, links, upserts and the work queue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave import storage
from graphweave.functions import table_functions
from graphweave.functions import text as X
from graphweave.functions import vocabulary as V
from graphweave.operators import durable_queue, ingest, stats, work_queue
from graphweave.plans.catalog import query
from graphweave.schema import NODES
from graphweave.sources import views as v
from graphweave.sources.versions import Store

QUESTION = "what is the relationship between anat and thing"
STOPS = "[" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + "]"
NOW = datetime(2024, 1, 1)


@query(f"SELECT doc_id, {v.WORDS.format('text')} AS n FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("n"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
  k AS (SELECT list_distinct(list_filter(string_split(lower('{QUESTION}'), ' '), lambda x: NOT list_contains({STOPS}, x))) AS ks)
  SELECT doc_id, round(CASE WHEN len(ws) < 20 THEN 0 ELSE least(1.0, least(0.8, 0.2 + len(ws) / 200 * 0.6) + len(list_intersect(ks, list_transform(ws, lambda x: lower(x)))) / len(ks) * 0.2) END, 6) AS quality FROM w, k""")
def section_quality(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "documents").select("doc_id", F.round(X.section_quality(F.col("text"), F.lit(QUESTION)), 6).alias("quality"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS summary FROM documents")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "documents").select("doc_id", X.summary(F.col("text")).alias("summary"))


@query("SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "part").select("p_type", X.slug(F.col("p_type")).alias("slug")).distinct()


_MAP = ", ".join(f"('{s}', '{c}')" for s, c in V.RELATION_SPELLINGS.items())
_RAW = "raw AS (SELECT DISTINCT event_type || CASE event_id % 6 WHEN 0 THEN ' by' WHEN 1 THEN '-on' WHEN 2 THEN '' ELSE '' END AS r, CASE event_id % 6 WHEN 3 THEN 'Depends on' WHEN 4 THEN ' Co-Founded ' WHEN 5 THEN 'co-authored' END AS s FROM events)"


@query(f"WITH {_RAW}, m AS (SELECT * FROM (VALUES {_MAP}) t(a, b)) SELECT DISTINCT coalesce(s, r) AS relation, coalesce(b, translate(lower(trim(coalesce(s, r))), ' -', '__')) AS canonical FROM raw LEFT JOIN m ON a = translate(lower(trim(coalesce(s, r))), ' -', '__')")
def canonical_relations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    made = F.when(k == 0, F.concat("event_type", F.lit(" by"))).when(k == 1, F.concat("event_type", F.lit("-on"))).when(k == 3, "Depends on").when(k == 4, " Co-Founded ").when(k == 5, "co-authored").otherwise(F.col("event_type"))
    return v.base(spark, d, "events").select(made.alias("relation")).distinct().select("relation", X.relation(F.col("relation")).alias("canonical"))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
_PLAIN_TITLE = "trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1))"
for _code, _char in _ENTITIES:
    _PLAIN_TITLE = f"replace({_PLAIN_TITLE}, '{_code}', '{_char}')"


@query(f"""WITH t AS (SELECT page_id, html, trim(regexp_split_to_array({_PLAIN_TITLE}, '\\s*[|\u2013\u2014]\\s*')[1]) AS cut,
    regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS last FROM pages)
  SELECT page_id, CASE WHEN cut <> '' THEN cut ELSE list_aggregate(list_transform(regexp_extract_all(translate(last, '-_', '  '), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') END AS title,
    CAST(len(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1)) AS BIGINT) AS n_hrefs FROM t""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit(r'<a[^>]+href="([^"]*)"'), F.lit(1))
    return v.base(spark, d, "pages").select("page_id", X.page_title(F.col("html"), F.col("url")).alias("title"), F.size(hrefs).cast("long").alias("n_hrefs"))


@query()
def parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    p = ingest.pages(v.base(spark, d, "pages"), 20)
    return p.withColumns({"categories": F.array_join("categories", ","), "links": F.array_join("links", " ")})


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


_BARE = _replaced("html", *((rf"(?is)<{x}[^>]*>.*?</{x}[^>]*>", "''") for x in ("script", "style", "nav", "footer", "header")), ("(?s)<!--.*?-->", "''"))
_MARKED = _replaced(_BARE, ("(?i)<h1[^>]*>", "chr(10) || '# '"), ("(?i)</h1>|<br>|</p>", "chr(10)"), ("(?i)<p>", "chr(10) || chr(10)"), ("(?i)<li>", "chr(10) || '- '"), ("<[^>]*>", "''"))
_PLAIN = f"replace(replace(replace(replace({_MARKED}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&')"
_MARKDOWN = _replaced(_PLAIN, (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]+", "' '"), (r"^\s+|\s+$", "''"))
_SECTIONS = f"""WITH t AS (SELECT html, trim(regexp_split_to_array({_PLAIN_TITLE}, '\\s*[|–—]\\s*')[1]) AS cut,
    regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS last FROM pages),
  m AS (SELECT CASE WHEN cut <> '' THEN cut ELSE list_aggregate(list_transform(regexp_extract_all(translate(last, '-_', '  '), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') END AS title,
    regexp_replace({_MARKDOWN}, '(?m)^(#{{1,6}})\\s+(.+)$', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g') AS marked FROM t),
  p AS (SELECT title, unnest(string_split(marked, chr(1))) AS part, generate_subscripts(string_split(marked, chr(1)), 1) AS i, row_number() OVER () AS r FROM m),
  s AS (SELECT title, i, r, CASE WHEN i = 1 THEN 2 ELSE length(string_split(part, chr(2))[1]) END AS level, CASE WHEN i = 1 THEN 'Introduction' ELSE trim(string_split(string_split(part, chr(2))[2], chr(3))[1]) END AS heading,
    regexp_replace(CASE WHEN i = 1 THEN part ELSE string_split(part, chr(3))[2] END, '^\\s+|\\s+$', '', 'g') AS content FROM p),
  n AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS INT) AS section_index FROM s WHERE length(content) > 20)
  SELECT title || '#' || section_index AS section_id, title, section_index, CAST(level AS INT) AS level, heading, content FROM n"""


@query(_SECTIONS)
def page_section_rows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.page_sections(ingest.pages(v.base(spark, d, "pages"), 20))


@query(_SECTIONS)
def lateral_page_sections(spark: SparkSession, d: str) -> DataFrame:
    """The same by a table function, as SQL calls it."""
    table_functions.register(spark)
    web = v.base(spark, d, "pages").select("html", X.page_title(F.col("html"), F.col("url")).alias("title"))
    return spark.sql("SELECT title || '#' || section_index AS section_id, title, s.* FROM {web}, LATERAL parse_sections(html) AS s", web=web)


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '<a[^>]+href="(/[^"]*)"', 1)) AS href FROM pages)
  SELECT DISTINCT page_id, root || href AS link FROM h WHERE NOT starts_with(href, '//')""")
def same_host_links(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "pages").select("page_id", F.explode(X.page_links(F.col("html"), F.col("url"))).alias("link"))


_CHUNKS = rf"""WITH RECURSIVE {v.SQL}, t AS MATERIALIZED (SELECT title, section_index, section_id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS text FROM sec WHERE word_count > 0),
  cut AS (SELECT section_id, unnest(regexp_extract_all(text, '(?s).*?[.?!][ \n]')) AS piece, generate_subscripts(regexp_extract_all(text, '(?s).*?[.?!][ \n]'), 1) AS i FROM t),
  stops AS (SELECT section_id, list(pos) AS stops FROM (SELECT section_id, CAST(sum(length(piece)) OVER (PARTITION BY section_id ORDER BY i) - 1 AS BIGINT) AS pos FROM cut) GROUP BY section_id),
  u AS MATERIALIZED (SELECT t.*, length(text) AS n, coalesce(stops, []) AS stops FROM t LEFT JOIN stops USING (section_id)),
  w AS (SELECT section_id, 0 AS n_th, 0::BIGINT AS a, 0::BIGINT AS z FROM u WHERE false
    UNION ALL SELECT section_id, 1, 0, CASE WHEN 2000 >= n THEN 2000 ELSE coalesce(nullif(greatest(coalesce(list_max(list_filter(stops, lambda x: x < least(2200, n) AND x > 1000)), 0), 0), 0), 2000) END FROM u
    UNION ALL SELECT section_id, n_th + 1, z - 400, CASE WHEN z - 400 + 2000 >= n THEN z - 400 + 2000 ELSE coalesce(list_max(list_filter(stops, lambda x: x < least(z - 400 + 2200, n) AND x > z - 400 + 1000)), z - 400 + 2000) END
      FROM w JOIN u USING (section_id) WHERE n > 2000 AND z - 400 < n),
  c AS (SELECT title, section_index, n_th, length(regexp_replace(substring(text, a + 1, z - a), '^\s+|\s+$', '', 'g')) AS n_chars FROM w JOIN u USING (section_id)),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY title, section_index ORDER BY n_th) - 1 AS INT) AS chunk_index FROM c WHERE n_chars > 0)
  SELECT title || '|s' || section_index || '|c' || chunk_index AS chunk_id, title, CAST(section_index AS INT) AS section_index, chunk_index, n_chars FROM k"""


@query(_CHUNKS)
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = v.sections(spark, d).where("word_count > 0")
    return ingest.chunks(s.select("title", "section_index", "content")).select("chunk_id", "title", "section_index", "chunk_index", F.length("content").cast("long").alias("n_chars"))


@query(_CHUNKS)
def lateral_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same by a table function, as SQL calls it."""
    table_functions.register(spark)
    s = v.sections(spark, d).where("word_count > 0")
    return spark.sql("SELECT concat(title, '|s', section_index, '|c', chunk_index) AS chunk_id, title, section_index, chunk_index, CAST(length(c.content) AS BIGINT) AS n_chars FROM {s} AS s, LATERAL chunk_text(s.content, 2000, 400) AS c", s=s)


@query()
def cleaned_documents(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "documents").select("doc_id", F.md5(X.clean(F.col("text"))).alias("cleaned_md5"))


_TITLES = "t AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'Category:X' WHEN 1 THEN 'List of things' WHEN 2 THEN 'Thing (disambiguation)' WHEN 3 THEN 'x' WHEN 4 THEN 'FILE:a.png' ELSE 'Order ' || o_orderkey END AS title FROM orders)"
_NAMES = "|".join(V.NAMESPACES)


@query(f"WITH {_TITLES} SELECT k, title FROM t WHERE length(title) >= 2 AND NOT regexp_matches(lower(title), '^({_NAMES}):') AND NOT starts_with(title, 'List of ') AND NOT contains(title, '(disambiguation)')")
def valid_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    title = F.when(k == 0, "Category:X").when(k == 1, "List of things").when(k == 2, "Thing (disambiguation)").when(k == 3, "x").when(k == 4, "FILE:a.png").otherwise(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
    return v.base(spark, d, "orders").select(F.col("o_orderkey").alias("k"), title.alias("title")).where(X.valid_link(F.col("title")))


_FOUND = "f AS (SELECT src, 'A' || (CAST(substring(dst, 2) AS INT) * 2) AS dst, expansion_depth AS depth FROM lnk JOIN art ON title = src)"


def _found(spark: SparkSession, d: str) -> DataFrame:
    dst = F.concat(F.lit("A"), (F.substring("dst", 2, 9).cast("int") * 2).cast("string"))
    return v.links(spark, d).join(v.articles(spark, d), F.col("title") == F.col("src")).select("src", dst.alias("dst"), F.col("expansion_depth").alias("depth"))


@query(f"WITH {v.SQL}, {_FOUND} SELECT dst AS title, CAST(min(depth) + 1 AS INT) AS expansion_depth, 'discovered' AS expansion_state FROM f WHERE depth < 2 AND src <> dst AND dst NOT IN (SELECT title FROM art) GROUP BY dst")
def discovered_articles(spark: SparkSession, d: str) -> DataFrame:
    return ingest.discover_links(_found(spark, d), v.articles(spark, d), v.links(spark, d))[0]


@query(f"WITH {v.SQL}, {_FOUND} SELECT DISTINCT src, dst FROM f WHERE depth < 2 AND src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM lnk) AND dst NOT IN (SELECT title FROM art WHERE expansion_state = 'failed')")
def discovered_edges(spark: SparkSession, d: str) -> DataFrame:
    return ingest.discover_links(_found(spark, d), v.articles(spark, d), v.links(spark, d))[1]


def queue_rows(spark: SparkSession, d: str) -> DataFrame:
    minutes = F.make_interval(mins=F.col("article_id") % 10)
    return v.articles(spark, d).withColumns({"claimed_at": F.when(F.col("expansion_state") == "claimed", F.lit(NOW) - minutes), "processed_at": F.lit(None).cast("timestamp"), "retry_count": (F.col("article_id") % 4).cast("int")})


@query(f"WITH {v.SQL} SELECT title FROM art WHERE expansion_state = 'discovered' ORDER BY expansion_depth, title LIMIT 10")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    return work_queue.claim(queue_rows(spark, d), 10, NOW)[0]


@query(f"WITH {v.SQL} SELECT title, CASE WHEN expansion_state = 'claimed' AND article_id % 10 > 5 THEN 'discovered' ELSE expansion_state END AS expansion_state FROM art")
def queue_reclaim(spark: SparkSession, d: str) -> DataFrame:
    return work_queue.reclaim(queue_rows(spark, d), NOW).select("title", "expansion_state")


@query(f"WITH {v.SQL} SELECT title, CASE WHEN title IN ('A1', 'A2', 'A3', 'A6') AND expansion_state IN ('loaded', 'claimed') THEN 'processed' ELSE expansion_state END AS expansion_state FROM art")
def queue_advance(spark: SparkSession, d: str) -> DataFrame:
    return work_queue.advance(queue_rows(spark, d), ["A1", "A2", "A3", "A6"], "processed", NOW).select("title", "expansion_state")


@query(f"WITH {v.SQL} SELECT title, CASE WHEN article_id >= 8 THEN expansion_state WHEN article_id % 4 + 1 >= 3 THEN 'failed' ELSE 'discovered' END AS expansion_state, CAST(article_id % 4 + CASE WHEN article_id < 8 THEN 1 ELSE 0 END AS INT) AS retry_count FROM art")
def queue_fail(spark: SparkSession, d: str) -> DataFrame:
    return work_queue.fail(queue_rows(spark, d), [f"A{k}" for k in range(8)]).select("title", "expansion_state", "retry_count")


@query("SELECT user_id AS key, max_by(event_type, (ts, event_id)) AS state, max(ts) AS at FROM events GROUP BY user_id")
def current_states(spark: SparkSession, d: str) -> DataFrame:
    e = v.base(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return work_queue.current_state(e)


@query(f"WITH {v.SQL}, s AS (SELECT unnest(['discovered', 'claimed', 'loaded', 'processed', 'failed']) AS state) SELECT s.state, count(title) AS n FROM s LEFT JOIN art ON expansion_state = s.state GROUP BY s.state UNION ALL SELECT 'total', count(*) FROM art")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return work_queue.queue_stats(v.articles(spark, d))


def _durable(spark: SparkSession, d: str) -> Store:
    rows = queue_rows(spark, d).select(*NODES["Article"].names)
    links = v.links(spark, d).withColumn("link_type", F.lit("internal"))
    return durable_queue.create(spark, storage.new_path(spark, "graph"), Article=rows, LINKS_TO=links)


@query(f"""WITH {v.SQL}, o AS (SELECT title, row_number() OVER (ORDER BY expansion_depth, title) AS n FROM art WHERE expansion_state = 'discovered')
  SELECT title, CASE WHEN n <= 10 THEN 'processed' WHEN n <= 20 THEN 'claimed' WHEN expansion_state = 'claimed' AND article_id % 10 > 5 THEN 'discovered' ELSE expansion_state END AS expansion_state FROM art LEFT JOIN o USING (title)""")
def durable_claims(spark: SparkSession, d: str) -> DataFrame:
    """Two workers claim from versioned tables, one of them finishes, stale claims go back."""
    store = _durable(spark, d)
    mine = durable_queue.claim(store, 10, NOW)
    durable_queue.claim(store, 10, NOW)
    durable_queue.advance(store, mine, "processed", NOW)
    durable_queue.reclaim(store, NOW)
    return store.read("Article").select("title", "expansion_state")


@query(f"""WITH {v.SQL}, {_FOUND}, n AS (SELECT DISTINCT src, dst FROM f WHERE depth < 2 AND src <> dst AND dst NOT IN (SELECT title FROM art WHERE expansion_state = 'failed')),
  e AS (SELECT src, dst FROM lnk UNION SELECT src, dst FROM n) SELECT src, dst FROM e WHERE src NOT IN ('A1', 'A2') AND dst NOT IN ('A1', 'A2')""")
def durable_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Links found are added to versioned tables, twice, as a worker that starts again does; then two articles go."""
    store, found = _durable(spark, d), _found(spark, d)
    durable_queue.discover(store, found)
    durable_queue.discover(store, found)
    durable_queue.remove(store, ["A1", "A2"])
    return store.read("LINKS_TO").select("src", "dst")


@query(f"WITH {v.SQL} SELECT title, CASE WHEN article_id % 3 = 0 THEN 'new' ELSE category END AS category, CASE WHEN article_id % 3 = 0 THEN 7 ELSE word_count END AS word_count, CASE WHEN article_id % 3 = 0 THEN 'loaded' ELSE expansion_state END AS expansion_state, expansion_depth, CAST(article_id % 4 AS INT) AS retry_count FROM art UNION ALL SELECT 'B' || k, 'new', 7, 'loaded', 0, 0 FROM range(5) t(k)")
def upsert_articles(spark: SparkSession, d: str) -> DataFrame:
    a = queue_rows(spark, d)
    more = spark.range(5).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("title"))
    new = a.where("article_id % 3 = 0").select("title").unionByName(more).select("title", F.lit("new").alias("category"), F.lit(7).cast("long").alias("word_count"), F.lit(NOW).alias("processed_at"))
    return ingest.upsert_articles(a, new).drop("processed_at")


@query(f"WITH {v.SQL}, c AS (SELECT category AS name, count(*) AS article_count FROM art GROUP BY category) SELECT name, CAST(sum(article_count) AS BIGINT) AS article_count FROM (SELECT * FROM c UNION ALL SELECT * FROM c WHERE name < 'cat_5') GROUP BY name")
def merge_category_counts(spark: SparkSession, d: str) -> DataFrame:
    c = v.articles(spark, d).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("article_count"))
    return ingest.merge_counts(c, c.where("name < 'cat_5'"))


@query("SELECT p_brand AS name, arg_min(p_type, p_partkey) AS type FROM part GROUP BY p_brand")
def first_writer_entities(spark: SparkSession, d: str) -> DataFrame:
    return ingest.first_writer(v.base(spark, d, "part").select(F.col("p_brand").alias("name"), "p_partkey", F.col("p_type").alias("type")), "name", "p_partkey").select("name", "type")


@query("WITH e AS (SELECT DISTINCT p_name AS name, 'part' AS type FROM part WHERE p_size <= 25), r AS (SELECT p_name AS src, p_brand AS dst FROM part), n AS (SELECT src AS name FROM r UNION SELECT dst FROM r) SELECT * FROM e UNION ALL SELECT name, 'concept' FROM n WHERE name NOT IN (SELECT name FROM e)")
def concept_endpoints(spark: SparkSession, d: str) -> DataFrame:
    p = v.base(spark, d, "part")
    e = p.where("p_size <= 25").select(F.col("p_name").alias("name"), F.lit("part").alias("type")).distinct()
    return ingest.with_missing_endpoints(e, p.select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst")))


@query(f"WITH {v.SQL} SELECT src, dst FROM lnk WHERE src IN (SELECT title FROM art WHERE article_id % 2 = 0) AND dst IN (SELECT title FROM art WHERE article_id % 2 = 0)")
def edges_between(spark: SparkSession, d: str) -> DataFrame:
    return ingest.insert_edges(v.links(spark, d), v.articles(spark, d).where("article_id % 2 = 0"))


@query(f"WITH {v.SQL} SELECT src, dst FROM lnk WHERE src NOT IN ('A1', 'A2') AND dst NOT IN ('A1', 'A2')")
def delete_articles(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([("A1",), ("A2",)], "title string")
    return ingest.delete_nodes(v.articles(spark, d), v.links(spark, d), gone)[1]


@query(f"WITH {v.SQL} SELECT title, section_id FROM sec WHERE article_id % 4 <> 0 UNION ALL SELECT title, title || '#new' FROM art WHERE article_id % 4 = 0")
def replace_sections(spark: SparkSession, d: str) -> DataFrame:
    new = v.articles(spark, d).where("article_id % 4 = 0").select("title", F.concat("title", F.lit("#new")).alias("section_id"))
    return ingest.replace_children(v.sections(spark, d).select("title", "section_id"), new, "title")


@query("WITH a AS (SELECT 'n' || n_nationkey AS title FROM nation), n AS (SELECT 'n' || n_nationkey AS f, 'N' || n_nationkey AS t FROM nation WHERE n_nationkey % 2 = 0), r AS (SELECT 'N' || n_nationkey AS f, 'R' || n_regionkey AS t FROM nation WHERE n_nationkey % 4 = 0), e AS (SELECT 'R' || r_regionkey AS t FROM region UNION ALL SELECT 'n7') SELECT title, CASE WHEN coalesce(r.t, n.t, title) IN (SELECT t FROM e) THEN coalesce(r.t, n.t, title) END AS resolved FROM a LEFT JOIN n ON n.f = title LEFT JOIN r ON r.f = coalesce(n.t, title)")
def resolved_titles(spark: SparkSession, d: str) -> DataFrame:
    n, r = v.base(spark, d, "nation"), v.base(spark, d, "region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    asked = n.select(name("n", "n_nationkey").alias("title"))
    normal = n.where("n_nationkey % 2 = 0").select(name("n", "n_nationkey").alias("from"), name("N", "n_nationkey").alias("to"))
    redirects = n.where("n_nationkey % 4 = 0").select(name("N", "n_nationkey").alias("from"), name("R", "n_regionkey").alias("to"))
    existing = r.select(name("R", "r_regionkey").alias("title")).unionByName(spark.createDataFrame([("n7",)], "title string"))
    return ingest.validate_titles(asked, normal, redirects, existing)


@query(f"WITH {v.SQL} SELECT coalesce(category, 'Uncategorized') AS category, n FROM (SELECT category, count(*) AS n FROM art WHERE expansion_state IN ('loaded', 'processed') GROUP BY category ORDER BY n DESC, category NULLS FIRST LIMIT 5)")
def top_loaded_categories(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_categories(v.articles(spark, d))
