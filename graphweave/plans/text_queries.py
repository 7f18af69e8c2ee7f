"""Text, URL and message functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import text as X
from graphweave.functions import vocabulary as V
from graphweave.operators import work_queue
from graphweave.plans.catalog import query
from graphweave.plans.ingest_queries import NOW, queue_rows
from graphweave.sources import views as v

_CAPITALS = "array_to_string(list_transform(regexp_extract_all({0}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _steps(text: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


_REDACTED = _steps(
    "text", (r"(?i)(https?://)[^/\s:@]+:[^/\s@]+@", r"\1***REDACTED***@"), (r"(?i)([?&](?:api[_-]?key|key|token|access_token|secret|password)=)[^&\s''\"]+", r"\1***REDACTED***"),
    (r"(?i)([''\"](?:x-)?(?:api[_-]?key|token|secret|password|authorization)[''\"]\s*:\s*[''\"])[^''\"]+([''\"])", r"\1***REDACTED***\2"), (r"(?i)\b(authorization:\s*(?:bearer|basic)\s+|bearer\s+)[A-Za-z0-9_\-.=+/]+", r"\1***REDACTED***"),
    (r"(?i)\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)[''\"]?[A-Za-z0-9_\-.]{8,}[''\"]?", r"\1\2***REDACTED***"), (r"(?i)\bsk-[A-Za-z0-9_\-]{16,}", "***REDACTED***"),
    (r"(?i)\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "***REDACTED_JWT***"), (r"(?i)(^|[^\w:/])/(?:home|root|usr|var|tmp|etc|opt|users)/[^\s''\":]+", r"\1***REDACTED_PATH***"),
)


@query(f"SELECT doc_id, md5({_REDACTED}) AS redacted_md5 FROM documents")
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "documents").select("doc_id", F.md5(X.redacted(F.col("text"))).alias("redacted_md5"))


@query(f"""WITH p AS (SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/') AS parts FROM pages), l AS (SELECT page_id, parts, regexp_replace(parts[-1], '\\.html$', '') AS last FROM p)
  SELECT page_id, {_CAPITALS.format("replace(CASE WHEN last <> '' THEN last ELSE parts[-2] END, '-', ' ')")} AS title FROM l""")
def url_titles(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "pages").select("page_id", X.title_of_url(F.col("url")).alias("title"))


@query("SELECT doc_id, md5('https://en.wikipedia.org/wiki/' || replace(replace(replace(url_encode(replace(text, ' ', '_')), '%2F', '/'), '%3A', ':'), '%40', '@')) AS url_md5 FROM documents")
def wiki_urls(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "documents").select("doc_id", F.md5(X.wiki_url(F.col("text"))).alias("url_md5"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html || ' ' || url, '(https?://[^\\s<>"'')\\]]+)', 1))), ' ') AS links FROM pages""")
def text_links(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat_ws(" ", "html", "url")
    return v.base(spark, d, "pages").select("page_id", F.array_join(F.array_sort(X.text_links(whole)), " ").alias("links"))


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all('[[File:' || source || '.png]] [[' || lang || '|' || doc_id || ']] ' || replace(text, '. ', ' [[') || ']]', '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1), lambda x: NOT regexp_matches(lower(trim(x)), '^(file|image|category|template|wikipedia):')), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), chr(10)) AS links FROM documents""")
def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    marked = F.expr("concat('[[File:', source, '.png]] [[', lang, '|', doc_id, ']] ', replace(text, '. ', ' [['), ']]')")
    return v.base(spark, d, "documents").select("doc_id", F.array_join(X.wiki_links(marked), "\n").alias("links"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' ' || doc_id END AS target FROM documents")
def redirect_targets(spark: SparkSession, d: str) -> DataFrame:
    wikitext = F.expr("concat(IF(doc_id % 3 = 0, concat(' #redirect  [[', source, ' ', doc_id, ']]\n'), ''), replace(text, '#', ''))")
    return v.base(spark, d, "documents").select("doc_id", X.redirect_target(wikitext).alias("target"))


@query(f"""WITH s AS (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: length(x) > 2)[1:3] AS parts FROM pages),
  c AS (SELECT page_id, list_filter(list_transform(parts, lambda y: {_CAPITALS.format("translate(y, '-_', '  ')")}), lambda x: lower(x) NOT IN ({", ".join(f"'{x}'" for x in V.PLAIN_SEGMENTS)})) AS categories FROM s)
  SELECT page_id, array_to_string(categories, ',') AS categories FROM c""")
def page_categories(spark: SparkSession, d: str) -> DataFrame:
    return v.base(spark, d, "pages").select("page_id", F.array_join(X.page_categories(F.col("url")), ",").alias("categories"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN least(conv_id % 13, 10) WHEN turn % 3 = 1 THEN least(conv_id % 12, 10) ELSE 0 END AS score FROM conversations")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    said = F.expr("""CASE turn % 3 WHEN 0 THEN concat('Here:\n```json\n{"score": ', conv_id % 13, ', "why": "x"}\n```') WHEN 1 THEN concat('I give a Score: ', conv_id % 12, ' of 10') ELSE 'none' END""")
    return v.base(spark, d, "conversations").select("conv_id", "turn", X.judge_score(said).cast("long").alias("score"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{' || text || '}' ELSE regexp_replace(text, '[{}]', '', 'g') END AS sliced FROM conversations")
def json_slices(spark: SparkSession, d: str) -> DataFrame:
    said = F.expr("IF(turn % 2 = 0, concat('so: {', text, '} ok'), regexp_replace(text, '[{}]', ''))")
    return v.base(spark, d, "conversations").select("conv_id", "turn", X.braces(said).alias("sliced"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN replace(url, 'https', 'http') WHEN 1 THEN 'https://10.0.0.' || page_id || '/x' WHEN 2 THEN 'https://localhost:8080/' || page_id WHEN 3 THEN 'https://172.' || (page_id % 40) || '.1.1/' WHEN 4 THEN 'https://a@db.internal/' ELSE url END AS url FROM pages),
  h AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':\\d+$|^[^@]*@', '', 'g')) AS host FROM u)
  SELECT page_id, starts_with(url, 'https://') AND host <> '' AND NOT regexp_matches(host, '^(localhost|127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2\\d|3[01])\\.|169\\.254\\.|0\\.|22[4-9]\\.|2[3-5]\\d\\.|\\[)|\\.(local|internal)$') AS safe FROM h""")
def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr("CASE page_id % 8 WHEN 0 THEN replace(url, 'https', 'http') WHEN 1 THEN concat('https://10.0.0.', page_id, '/x') WHEN 2 THEN concat('https://localhost:8080/', page_id) WHEN 3 THEN concat('https://172.', page_id % 40, '.1.1/') WHEN 4 THEN 'https://a@db.internal/' ELSE url END")
    return v.base(spark, d, "pages").select("page_id", X.safe_url(url).alias("safe"))


@query(r"""WITH q AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'MATCH (n) WHERE n.t = "' || replace(text, '"', '') || '" RETURN n' WHEN 1 THEN 'match (n) set n.x = 1' WHEN 2 THEN 'MATCH (a)-[r*]->(b) RETURN b' ELSE text END AS q FROM conversations),
  b AS (SELECT *, upper(regexp_replace(regexp_replace(q, '"[^"]*"', '', 'g'), '''[^'']*''', '', 'g')) AS bare FROM q)
  SELECT conv_id, turn, regexp_matches(trim(bare), '^(MATCH|CALL)\b') AND NOT regexp_matches(bare, '\b(CREATE|DELETE|DROP|SET|MERGE|REMOVE|DETACH)\b') AND NOT regexp_matches(q, '\[[\w:]*\*[^\]]*\]') AS safe FROM b""")
def safe_queries(spark: SparkSession, d: str) -> DataFrame:
    q = F.expr("""CASE conv_id % 4 WHEN 0 THEN concat('MATCH (n) WHERE n.t = "', replace(text, '"', ''), '" RETURN n') WHEN 1 THEN 'match (n) set n.x = 1' WHEN 2 THEN 'MATCH (a)-[r*]->(b) RETURN b' ELSE text END""")
    return v.base(spark, d, "conversations").select("conv_id", "turn", X.safe_query(q).alias("safe"))


@query("SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN substring(trim(text), 1, 1024) ELSE '' END AS facts FROM conversations")
def sane_facts(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.lit(" "), F.concat(F.lit("  "), F.col("text")), F.lit(None).cast("string"))
    return v.base(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.facts_sane(raw), "|").alias("facts"))


@query(f"WITH {v.SQL} SELECT title, CASE WHEN expansion_state = 'claimed' AND article_id % 2 = 0 THEN TIMESTAMP '2024-01-01' WHEN expansion_state = 'claimed' THEN TIMESTAMP '2024-01-01' - to_minutes(CAST(article_id % 10 AS INT)) END AS claimed_at FROM art")
def queue_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    """Every second article's worker says that it is alive."""
    return work_queue.heartbeat_where(queue_rows(spark, d), F.col("article_id") % 2 == 0, NOW).select("title", "claimed_at")


@query(f"WITH {v.SQL}, s AS (SELECT DISTINCT 'A' || (n_nationkey * 50) AS title FROM nation) SELECT title, expansion_state, expansion_depth FROM art UNION ALL SELECT title, 'discovered', 0 FROM s WHERE title NOT IN (SELECT title FROM art)")
def queue_seeds(spark: SparkSession, d: str) -> DataFrame:
    titles = v.base(spark, d, "nation").select(F.concat(F.lit("A"), (F.col("n_nationkey") * 50).cast("string")).alias("title"))
    a = v.articles(spark, d).drop("article_id").withColumn("retry_count", F.lit(0))
    return work_queue.seed(a, titles, "seed").select("title", "expansion_state", "expansion_depth")
