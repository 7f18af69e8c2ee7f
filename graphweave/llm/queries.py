"""One query for each operator, over its whole table and with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import ann, bpe, hard_negatives, licenses, lblm, packing, pieces, pii, quality, secret_scan, sharding, simhash, spans, vector_codes
from graphweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _count(found: str, kind: str, field: str = "kind") -> Column:
    return F.size(F.filter(found, lambda x: x[field] == kind)).cast("long").alias(f"n_{kind}")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables name one origin only: a source is an owner, and its part in one language a repository."""
    repository = F.concat_ws("/", "source", "lang")
    found = secret_scan.scan(table(spark, sf_dir, "documents"), repository=repository, owner="source")
    verdicts = [_count("found", v, "verdict") for v in ("copied", "live")]
    return found.select("doc_id", *(_count("base", k) for k in ("assign", "access", "hex")), F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("all_spans")).alias("spans"), *verdicts)


def op2_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = sharding.with_slots(sharding.external_shuffle(table(spark, sf_dir, "documents")))
    text = F.coalesce("text", F.lit(""))
    return shuffled.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.lit("key").alias("law"),
        F.col("gw_shard").alias("shard"), F.col("gw_slot").alias("slot"), sharding.shard_of(F.col("doc_id"), 25, 42).alias("grown_shard"),
    )


def op3_quality_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "gw.*")


def op4_license_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "gw.*")
    base = F.filter("hits", lambda x: x["base"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("hits")).alias("labels"), F.coalesce(F.array_max(F.transform("hits", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def op5_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op6_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "gw.*")
    return found.select("doc_id", *(_count("base", k) for k in ("email", "ip", "card", "phone")), F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("all_spans")).alias("spans"))


def op8_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.score(table(spark, sf_dir, "documents"))


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id are moved on by one, as wrong labels would be; every hundredth id is an anchor."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(e, F.col("id") % 100 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    every = (
        op1_secret_ownership, op2_two_pass_shuffle, op3_quality_weak_supervision, op4_license_rare_tokens, op5_bm25_packing,
        op6_simhash_vptree, op7_pii_weak_supervision, op8_kmeans_tree_ann, op9_log_bilinear, op10_bpe_roundtrip,
        op11_piece_offsets, op12_hard_negatives, op13_vector_codes,
    )
    return {f.__name__: f for f in every}


def _license_sql() -> str:
    """All places of all templates by comparing words, without an index."""
    row = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    hits = []
    for t in licenses.TEMPLATES:
        (first, words), *rest = t.placed()
        start = f"(i - {first + 1})"
        tests = [f"word = '{words[0]}'", f"{start} >= 0", *(f"list_slice(w, {start} + {p + 1}, {start} + {p + len(x)}) = {row(x)}" for p, x in [(first, words), *rest])]
        share = f"list_sum(list_transform(range({len(t.words)}), lambda j: CASE WHEN w[{start} + 1 + j] = {row(t.words)}[j + 1] THEN 1 ELSE 0 END)) / {len(t.words)}::DOUBLE"
        hits.append(f"SELECT rid, '{t.label}' AS label, {str(t.base).lower()} AS base, {start} AS start, {share} AS share FROM p JOIN d USING (rid) WHERE {' AND '.join(tests)}")
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.NOT_WORD}'), lambda x: x <> '') AS w FROM documents),
      p AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d), hits AS ({" UNION ALL ".join(hits)}),
      g AS (SELECT rid, count(*) FILTER (base) AS n, min(start) FILTER (base) AS a, max(start) FILTER (base) AS z, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(share) AS score FROM hits GROUP BY rid)
      SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(bl, '') AS base_labels, coalesce(l, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN g USING (rid)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the one query whose whole result SQL can express; the others are tested against brute force."""
    return {"op4_license_rare_tokens": _license_sql()}
