"""Report queries: counts and distributions, audits, evaluation and freshness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import text as X
from graphweave.functions import vocabulary as V
from graphweave.operators import evaluate, snapshots, stats, work_queue
from graphweave.plans.catalog import query
from graphweave.sources import files
from graphweave.sources import views as v


@query(f"WITH {v.SQL} SELECT category, count(*) AS n FROM art WHERE category IS NOT NULL GROUP BY category")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.categories(v.articles(spark, d))


@query(f"WITH {v.SQL} SELECT expansion_depth AS depth, count(*) AS n FROM art GROUP BY 1")
def depth_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.counted(v.articles(spark, d), F.col("expansion_depth"), "depth")


@query(f"WITH {v.SQL} SELECT coalesce(nullif(expansion_state, 'failed'), 'unknown') AS state, count(*) AS n FROM art GROUP BY 1")
def state_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.counted(v.articles(spark, d), F.nullif(F.col("expansion_state"), F.lit("failed")), "state", "unknown")


@query(f"WITH {v.SQL} SELECT expansion_depth AS depth, count(*) AS n FROM art WHERE expansion_state IN ('loaded', 'processed') GROUP BY 1")
def loaded_depths(spark: SparkSession, d: str) -> DataFrame:
    return stats.loaded_depths(v.articles(spark, d))


@query(f"""WITH {v.SQL}, c AS (SELECT count(*) FILTER (expansion_state IN ('loaded', 'processed')) AS l, count(*) FILTER (expansion_state = 'failed') AS f FROM art)
  SELECT l AS loaded, round(l * 100.0 / 1000, 4)::DOUBLE AS percent, round(l * 100.0 / (l + f), 4)::DOUBLE AS success_rate, round(l / 30.0, 4)::DOUBLE AS per_minute, round((1000 - l) / (l / 30.0), 4)::DOUBLE AS minutes_left FROM c""")
def expansion_progress(spark: SparkSession, d: str) -> DataFrame:
    return work_queue.progress(v.articles(spark, d), 1000, 30.0)


@query(f"WITH {v.SQL}, c AS (SELECT (SELECT count(*) FROM art) AS articles, (SELECT count(*) FROM sec) AS sections, (SELECT count(*) FROM lnk) AS links) SELECT *, round_even(sections / articles, 1) AS sections_each, round_even(links / articles, 1) AS links_each FROM c")
def graph_averages(spark: SparkSession, d: str) -> DataFrame:
    return stats.averages(v.articles(spark, d), v.sections(spark, d), v.links(spark, d))


@query(f"WITH {v.SQL}, w AS (SELECT title, sum(word_count) AS words FROM sec GROUP BY title) SELECT count(*) AS n, CAST(min(words) AS BIGINT) AS least, CAST(max(words) AS BIGINT) AS most, round(avg(words), 1) AS mean, round(median(words), 1) AS median, count(*) FILTER (words < 200) AS thin, round(count(*) FILTER (words < 200) * 100.0 / count(*), 1)::DOUBLE AS thin_percent FROM w")
def content_audit(spark: SparkSession, d: str) -> DataFrame:
    return stats.audit(stats.words_by_article(v.sections(spark, d)))


@query(f"WITH {v.SQL} SELECT CAST((SELECT count(*) FROM sec) + (SELECT count(*) FROM lnk) + (SELECT count(category) FROM art) AS BIGINT) AS edges")
def edge_totals(spark: SparkSession, d: str) -> DataFrame:
    n = stats.edge_total(v.sections(spark, d), v.links(spark, d), v.articles(spark, d).where("category IS NOT NULL"))
    return spark.createDataFrame([(n,)], "edges long")


@query(f"WITH {v.SQL} SELECT (SELECT count(*) FROM art) AS articles, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS entities, (SELECT count(*) FROM lnk) AS relationships")
def pack_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.pack_counts(v.articles(spark, d), v.entity_pairs(spark, d).select("entity").distinct(), v.links(spark, d))


@query("SELECT c_mktsegment AS model, CAST(sum(o_orderkey % 5000) AS BIGINT) AS tokens_in, CAST(sum(o_orderkey % 700) AS BIGINT) AS tokens_out, (sum(o_orderkey % 5000) * 15.0::DOUBLE + sum(o_orderkey % 700) * 75.0::DOUBLE) / 1e6 AS cost FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def token_costs(spark: SparkSession, d: str) -> DataFrame:
    o = v.base(spark, d, "orders").join(v.base(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    used = o.select(F.col("c_mktsegment").alias("model"), (F.col("o_orderkey") % 5000).alias("tokens_in"), (F.col("o_orderkey") % 700).alias("tokens_out"))
    return stats.token_cost(used, ["model"])


_ANS = "a AS (SELECT doc_id, doc_id % 50 AS question_id, lower(trim(text)) AS x, text, n_chars::DOUBLE AS latency_ms, n_chars / 1e6 AS cost_usd FROM documents), q AS (SELECT item_id AS question_id, lower(trim(text)) AS t FROM benchmark)"
_HEDGE = " OR ".join(f"contains(x, '{h}')" for h in V.HEDGES)
_CITE = " OR ".join(f"regexp_matches(text, '{c}')" for c in V.CITES)


@query(rf"""WITH {_ANS}, s AS (SELECT a.*, t, CASE WHEN t IS NULL THEN NULL WHEN x = t THEN 1.0 WHEN contains(x, t) THEN 0.8 WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: length(w) > 3 AND contains(x, w))) > 0 THEN 0.5 ELSE 0 END AS score FROM a LEFT JOIN q USING (question_id))
  SELECT round(avg(score)::DOUBLE, 6) AS accuracy, round(avg(CASE WHEN ({_HEDGE}) AND NOT ({_CITE}) THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS hallucination_rate, round(avg(CASE WHEN {_CITE} OR regexp_matches(text, '(?i)reference:') THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS citation_rate, round(avg(latency_ms), 4) AS latency_ms, round(sum(cost_usd), 6) AS cost_usd, count(*) AS n FROM s""")
def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = v.base(spark, d, "documents").select((F.col("doc_id") % 50).alias("question_id"), F.col("text").alias("answer"), F.col("n_chars").cast("double").alias("latency_ms"), (F.col("n_chars") / 1e6).alias("cost_usd"))
    q = v.base(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("ground_truth"))
    m = evaluate.metrics(a, q)
    return m.withColumns({**{c: F.round(c, 6) for c in ("accuracy", "hallucination_rate", "citation_rate", "cost_usd")}, "latency_ms": F.round("latency_ms", 4)})


_SC = "sc AS (SELECT 'p' || (l_orderkey % 12) AS pack, ['training', 'pack', 'enhanced'][l_linenumber % 3 + 1] AS condition, CAST(l_quantity AS INT) % 11 AS score FROM lineitem)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("training", "pack", "enhanced")))
    return v.base(spark, d, "lineitem").select(F.concat(F.lit("p"), (F.col("l_orderkey") % 12).cast("string")).alias("pack"), F.get(names, F.col("l_linenumber") % 3).alias("condition"), (F.col("l_quantity").cast("int") % 11).alias("score"))


@query(f"WITH {_SC} SELECT pack, condition, round(avg(score), 4) AS mean, round(avg(CASE WHEN score >= 7 THEN 100.0 ELSE 0 END)::DOUBLE, 4) AS accuracy, count(*) AS n FROM sc GROUP BY GROUPING SETS ((pack, condition), (condition))")
def score_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roll_up(_scores(spark, d))


@query(f"""WITH {_SC}, m AS (SELECT pack, avg(score) FILTER (condition = 'pack') AS a, avg(score) FILTER (condition = 'enhanced') AS b FROM sc GROUP BY pack)
  SELECT count(*) FILTER (a > b) AS first_wins, count(*) FILTER (b > a) AS second_wins, count(*) FILTER (a = b) AS ties, (SELECT round(avg(CASE WHEN score >= 8 THEN 100.0 ELSE 0 END)::DOUBLE, 4) FROM sc WHERE condition = 'pack') AS first_accuracy, (SELECT round(avg(CASE WHEN score >= 8 THEN 100.0 ELSE 0 END)::DOUBLE, 4) FROM sc WHERE condition = 'enhanced') AS second_accuracy FROM m""")
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.catalog_summary(_scores(spark, d), "pack", "enhanced")


@query("""WITH r AS (SELECT l_returnflag AS condition, CAST(l_quantity AS INT) % 11 AS judge, l_discount > 0.02 AS syntax_ok, l_tax AS required, l_discount AS forbidden, l_orderkey % 9 AS calls, l_extendedprice AS latency FROM lineitem)
  SELECT condition, round(avg(judge), 2) AS judge, round(avg(round(0.4::DOUBLE * judge / 10 + 0.15::DOUBLE * CASE WHEN syntax_ok THEN 1 ELSE 0 END + 0.15::DOUBLE * required + 0.1::DOUBLE * forbidden + 0.1::DOUBLE * 1 + 0.1::DOUBLE * (judge / 10), 4)), 2) AS composite, round(avg(CASE WHEN syntax_ok THEN 1.0 ELSE 0 END)::DOUBLE, 2) AS syntax_rate, round(avg(CASE WHEN judge >= 7 THEN 1.0 ELSE 0 END)::DOUBLE, 2) AS pass_rate, round(avg(latency), 0) AS latency, round(avg(calls), 1) AS tool_calls, count(*) AS n FROM r GROUP BY condition""")
def condition_summary(spark: SparkSession, d: str) -> DataFrame:
    r = v.base(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("condition"), (F.col("l_quantity").cast("int") % 11).alias("judge"), (F.col("l_discount") > 0.02).alias("syntax_ok"), "l_tax", "l_discount",
        (F.col("l_orderkey") % 9).alias("tool_calls"), F.col("l_extendedprice").alias("latency"), F.lit(0.0).alias("cost"),
    )
    score = evaluate.composite(F.col("judge"), F.when(F.col("syntax_ok"), 1).otherwise(0), F.col("l_tax"), F.col("l_discount"), F.lit(1), F.lit(None).cast("double"))
    return evaluate.condition_summary(r.withColumn("composite", score)).drop("cost").withColumn("composite", F.round("composite", 2))


_CHK = "c AS (SELECT 'p' || (page_id % 7) AS pack, page_id % 5 <> 0 AS ok, CASE WHEN page_id % 2 = 0 THEN page_id % 6 = 0 WHEN page_id % 3 = 0 THEN page_id % 9 = 0 ELSE false END AS changed FROM pages)"


@query(f"WITH {_CHK} SELECT pack, count(*) FILTER (ok) AS checked, count(*) FILTER (ok AND changed) AS changed, round(count(*) FILTER (ok AND changed) / greatest(count(*) FILTER (ok), 1), 6) AS rate, count(*) FILTER (ok AND changed) / greatest(count(*) FILTER (ok), 1) >= 0.2 AS needs_rebuild FROM c GROUP BY pack")
def pack_freshness(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    known = lambda c, x: F.when(c, x)
    p = v.base(spark, d, "pages").select(
        F.concat(F.lit("p"), (k % 7).cast("string")).alias("pack"), (k % 5 != 0).alias("ok"), known(k % 2 == 0, F.lit("h")).alias("old_hash"), known(k % 2 == 0, F.when(k % 6 == 0, "x").otherwise("h")).alias("new_hash"),
        known(k % 3 == 0, F.lit("e")).alias("old_etag"), known(k % 3 == 0, F.when(k % 9 == 0, "x").otherwise("e")).alias("new_etag"), F.lit(None).cast("string").alias("old_last_modified"), F.lit("d").alias("new_last_modified"),
    )
    return evaluate.freshness(p.withColumn("changed", evaluate.changed())).withColumn("rate", F.round("rate", 6))


# Two crawls of the pages, in expressions that both engines read: the second one misses some pages, fails on some and finds some changed.
_KEYS = {"pack": "concat('p', page_id % 7)", "url": "concat(url, '?', page_id)"}
_FIRST = _KEYS | {"status": "200", "error": "CAST(NULL AS STRING)", "etag": "CASE WHEN page_id % 2 = 0 THEN md5(url) END", "last_modified": "CASE WHEN page_id % 3 = 0 THEN 'Mon' END", "hash": "CASE WHEN page_id % 3 <> 1 THEN md5(html) END"}
_SECOND = _FIRST | {"status": "CASE WHEN page_id % 11 = 0 THEN 500 ELSE 200 END", "error": "CASE WHEN page_id % 13 = 0 THEN 'timeout' END", "etag": "CASE WHEN page_id % 4 = 0 THEN md5(concat(url, 'x')) WHEN page_id % 4 = 2 THEN md5(url) END", "hash": "CASE WHEN page_id % 3 <> 0 THEN md5(concat(html, CASE WHEN page_id % 6 = 2 THEN 'y' ELSE '' END)) END"}
_T1, _T2 = datetime(2024, 1, 1), datetime(2024, 1, 8)


def _crawls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = v.base(spark, d, "pages")
    shaped = lambda columns, kept: p.where(kept).select(*(F.expr(x).alias(c) for c, x in columns.items()))
    return shaped(_FIRST, "page_id % 5 <> 0"), shaped(_SECOND, "page_id % 7 <> 3")


_CRAWL_SQL = (
    ", ".join(f"{name} AS (SELECT {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM pages WHERE {kept})" for name, columns, kept in (("c1", _FIRST, "page_id % 5 <> 0"), ("c2", _SECOND, "page_id % 7 <> 3")))
    + """, j AS (SELECT coalesce(c1.pack, c2.pack) AS pack, coalesce(c1.url, c2.url) AS url, c1.etag AS e1, c1.last_modified AS m1, c1.hash AS h1, c2.etag AS e2, c2.last_modified AS m2, c2.hash AS h2, c1.url IS NOT NULL AS was, c2.url IS NOT NULL AS is_,
    coalesce(c2.error IS NULL AND c2.status < 400, false) AS ok FROM c1 FULL JOIN c2 ON c1.pack = c2.pack AND c1.url = c2.url),
  k AS (SELECT *, CASE WHEN NOT is_ THEN 'gone' WHEN NOT ok THEN 'error' WHEN NOT was THEN 'first' WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN CASE WHEN h1 <> h2 THEN 'changed' ELSE 'same' END
    WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN CASE WHEN e1 <> e2 THEN 'changed' ELSE 'same' END WHEN m1 IS NOT NULL AND m2 IS NOT NULL AND m1 <> m2 THEN 'changed' ELSE 'same' END AS kind FROM j)"""
)


@query(f"WITH {_CRAWL_SQL} SELECT pack, url, ok, kind = 'changed' AS changed, kind FROM k")
def url_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.compared(*_crawls(spark, d)).select("pack", "url", "ok", "changed", "kind")


@query(f"WITH {_CRAWL_SQL} SELECT pack, count(*) FILTER (ok) AS checked, count(*) FILTER (kind = 'changed') AS changed, round(count(*) FILTER (kind = 'changed') / greatest(count(*) FILTER (ok), 1), 6) AS rate, count(*) FILTER (kind = 'changed') / greatest(count(*) FILTER (ok), 1) >= 0.2 AS needs_rebuild FROM k WHERE is_ GROUP BY pack")
def snapshot_freshness(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.freshness(*_crawls(spark, d)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_CRAWL_SQL} SELECT pack, url, CASE WHEN kind = 'same' THEN coalesce(e2, e1) ELSE e1 END AS etag, CASE WHEN kind = 'same' THEN coalesce(m2, m1) ELSE m1 END AS last_modified, CASE WHEN kind = 'same' THEN coalesce(h2, h1) ELSE h1 END AS hash,
    TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN kind IN ('changed', 'gone') THEN TIMESTAMP '2024-01-08' END AS valid_to FROM k WHERE was
  UNION ALL SELECT pack, url, e2, m2, h2, TIMESTAMP '2024-01-08', NULL FROM k WHERE kind IN ('first', 'changed')""")
def url_history(spark: SparkSession, d: str) -> DataFrame:
    first, second = _crawls(spark, d)
    h = snapshots.after(spark.createDataFrame([], snapshots.HISTORY), first, _T1)
    return snapshots.after(h, second, _T2)


@query("""WITH q AS (SELECT 'Pack' || (conv_id % 3) AS pack, text AS question, conv_id * 1000 + turn AS ord FROM conversations), f AS (SELECT pack, arg_min(question, ord) AS question, min(ord) AS ord FROM q GROUP BY pack, lower(trim(question)))
  SELECT pack, lower(substring(pack, 1, 2)) || '_' || printf('%03d', row_number() OVER (PARTITION BY pack ORDER BY ord)) AS id, question FROM f""")
def question_ids(spark: SparkSession, d: str) -> DataFrame:
    q = v.base(spark, d, "conversations").select(F.concat(F.lit("Pack"), (F.col("conv_id") % 3).cast("string")).alias("pack"), F.col("text").alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return evaluate.question_ids(q)


@query("SELECT k AS total, CAST(round_even(k * 20 / 50, 0) AS INT) AS easy, CAST(k - round_even(k * 20 / 50, 0) - round_even(k * 10 / 50, 0) AS INT) AS medium, CAST(round_even(k * 10 / 50, 0) AS INT) AS hard FROM range(1, 101) t(k)")
def difficulty_counts(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 101).select(F.col("id").alias("total"), *(c.alias(n) for n, c in evaluate.difficulty_counts(F.col("id")).items()))


@query("""SELECT o_orderkey AS k, round(CASE WHEN o_orderkey % 10 = 0 THEN 0.5 WHEN dd <= 0 THEN 1.0 WHEN dd > 730 THEN 0 ELSE 1 - dd / 730 END, 6) AS recency, round(0.4::DOUBLE * (o_orderkey % 11) / 10 + 0.3::DOUBLE * CASE WHEN o_orderkey % 10 = 0 THEN 0.5 WHEN dd <= 0 THEN 1.0 WHEN dd > 730 THEN 0 ELSE 1 - dd / 730 END + 0.3::DOUBLE * 0.8::DOUBLE, 6) AS rank_score
  FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-01-01') AS dd FROM orders)""")
def url_ranking(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    fresh = X.recency(F.when(k % 10 != 0, F.col("o_orderdate")), F.lit("1997-01-01").cast("date"))
    return v.base(spark, d, "orders").select(k.alias("k"), F.round(fresh, 6).alias("recency"), F.round(X.url_rank((k % 11) / 10, fresh, F.lit(0.8)), 6).alias("rank_score"))


def _version(k: Column) -> Column:
    return F.concat_ws(".", (k % 3).cast("string"), (k % 12).cast("string"), F.concat((k % 4).cast("string"), F.when(k % 5 == 0, "-alpha").otherwise("")))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS ma, p_partkey % 12 AS mi, p_partkey % 4 AS pa, p_partkey % 5 = 0 AS pre FROM part)
  SELECT k, ma || '.' || mi || '.' || pa || CASE WHEN pre THEN '-alpha' ELSE '' END AS version, CAST(CASE WHEN (ma, mi, pa, CASE WHEN pre THEN 0 ELSE 1 END) < (1, 10, 0, 1) THEN -1 WHEN (ma, mi, pa, CASE WHEN pre THEN 0 ELSE 1 END) > (1, 10, 0, 1) THEN 1 ELSE 0 END AS INT) AS compared, NOT pre AND ma = 1 AND mi >= 10 AS compatible FROM p""")
def version_compatibility(spark: SparkSession, d: str) -> DataFrame:
    p = v.base(spark, d, "part").select(F.col("p_partkey").alias("k"), _version(F.col("p_partkey")).alias("version"))
    return p.withColumns({"compared": X.compare_versions(F.col("version"), F.lit("1.10.0")), "compatible": X.compatible_versions(F.lit("1.10.0"), F.col("version"))})


@query("""WITH e AS (SELECT event_id, value, user_id % 7 AS source, ['crawl', 'llm', 'rss', 'sitemap'][event_id % 4 + 1] AS method, 'https://x/' || (event_id % 500) AS url FROM events), p AS (SELECT *, CASE method WHEN 'sitemap' THEN 1 WHEN 'rss' THEN 2 WHEN 'crawl' THEN 3 ELSE 4 END AS place FROM e),
  o AS (SELECT source, url, arg_min((place, event_id, method), (place, event_id)) AS m FROM p GROUP BY ALL) SELECT source, url, m[3] AS method, CASE m[3] WHEN 'sitemap' THEN 0.8 WHEN 'rss' THEN 0.85 WHEN 'crawl' THEN 0.75 ELSE 0.9 END::DOUBLE AS content_score FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY m[1], m[2]) <= 40""")
def url_cascade(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("crawl", "llm", "rss", "sitemap")))
    e = v.base(spark, d, "events").select((F.col("user_id") % 7).alias("source"), F.get(names, (F.col("event_id") % 4).cast("int")).alias("method"), F.col("event_id").alias("ord"), F.concat(F.lit("https://x/"), (F.col("event_id") % 500).cast("string")).alias("url"))
    return files.cascade(e, 40)


_PACKS = """m AS (SELECT n_name AS pack, count(DISTINCT c_custkey) AS articles, count(DISTINCT s_suppkey) AS entities, CAST(any_value(n_nationkey) AS BIGINT) AS relationships
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name),
  s AS (SELECT n_name AS pack, CASE WHEN o_orderpriority < '3' THEN 'training' ELSE 'enhanced' END AS condition, o_orderkey % 11 AS score FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name < 'M'),
  t AS (SELECT pack, round(avg(CASE WHEN condition = 'training' THEN CASE WHEN score >= 8 THEN 100.0::DOUBLE ELSE 0 END END), 4) AS first_accuracy, round(avg(CASE WHEN condition = 'enhanced' THEN CASE WHEN score >= 8 THEN 100.0::DOUBLE ELSE 0 END END), 4) AS second_accuracy FROM s GROUP BY pack),
  e AS (SELECT * FROM m LEFT JOIN t USING (pack))"""


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    n, c, s = (v.base(spark, d, x) for x in ("nation", "customer", "supplier"))
    key, none = F.col("n_nationkey").cast("long").alias("relationships"), F.lit(None).cast("long")
    # customers and suppliers side by side: together they would be a product within each nation
    held = n.select(F.col("n_name").alias("pack"), key, none.alias("article"), none.alias("entity"))
    held = held.unionByName(n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("pack"), key, F.col("c_custkey").alias("article"), none.alias("entity")))
    held = held.unionByName(n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("pack"), key, none.alias("article"), F.col("s_suppkey").alias("entity")))
    packs = held.groupBy("pack").agg(F.countDistinct("article").alias("articles"), F.countDistinct("entity").alias("entities"), F.max("relationships").alias("relationships"))
    o = v.base(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).where("n_name < 'M'")
    scores = o.select(F.col("n_name").alias("pack"), F.when(F.col("o_orderpriority") < "3", "training").otherwise("enhanced").alias("condition"), (F.col("o_orderkey") % 11).alias("score"))
    return evaluate.catalogue(packs, scores)


@query(f"WITH {_PACKS} SELECT * FROM e")
def pack_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return _catalogue(spark, d)


@query(f"""WITH {_PACKS} SELECT count(*) AS packs, CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(relationships) AS BIGINT) AS relationships,
  count(*) FILTER (first_accuracy IS NOT NULL AND second_accuracy IS NOT NULL) AS evaluated, count(*) FILTER (second_accuracy > first_accuracy) AS wins, count(*) FILTER (second_accuracy = first_accuracy) AS ties FROM e""")
def catalogue_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.catalogue_totals(_catalogue(spark, d))


@query("SELECT round(avg(value), 4) AS authority FROM events")
def mean_authority(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mean_authority(v.base(spark, d, "events").select(F.col("value").alias("authority")))


@query("SELECT 1 AS test")
def health_probe(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT 1 AS test")
