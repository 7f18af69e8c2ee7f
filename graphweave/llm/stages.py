"""The operators as stages over a documents table: each takes documents and returns those it leaves, or pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm import near_copies, packing, pii, quality, spans
from graphweave.llm.common import components, discard, store, stored


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass the base rules and that the rules' posterior holds for good; columns as they were."""
    scored = quality.score(docs, keep=docs.columns)
    return scored.where("gw.kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id; columns as they were.

    A group is what links of five-word Jaccard similarity 0.8 or more join, whatever the ids: other
    texts under the same id stay. Rows without an id are in groups too, and kept only if no row of
    theirs has one. Of rows with the least id, the one of the smallest hash of all columns is kept.
    """
    before = stored()
    keyed = docs.withColumn("gw_key", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    rows, links = near_copies.near_copies(keyed.select(F.col("gw_key").alias("key"), "text"))
    joined = store(components(links), "components")
    ids = keyed.groupBy(F.col("gw_key").alias("key")).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    each = ids.join(rows.distinct(), "key").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("best"))
    told = store(each.join(best, "component").select("key", (F.col("key") == F.col("best.key")).alias("kept"), "n"), "told")
    discard(docs.sparkSession, [x for x in stored()[:-1] if x not in before])
    # most rows are kept: only those to drop, and whole rows that are repeated, are looked up
    apart = told.where("not kept or n > 1").select(F.col("key").alias("gw_key"))
    again = told.where("kept and n > 1").select(F.col("key").alias("gw_key"))
    once = keyed.join(near_copies.small(apart), "gw_key", "left_anti")
    repeated = keyed.join(near_copies.small(again), "gw_key", "left_semi").dropDuplicates(["gw_key"])
    return once.unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))


def mask_private(docs: DataFrame) -> DataFrame:
    """All documents with every personal-data span replaced by its kind in brackets, n_chars as the new length; null texts stay."""
    found = pii.scan(docs, keep=docs.columns).select("*", F.col("gw.all_spans").alias("gw_spans"))
    masked = spans.masked("text", "gw_spans")
    new = {"text": masked, "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length(masked)).cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents with their ids; a null text is the end id alone, repeated rows and ties are packed each, an empty table gives none."""
    return packing.pack(docs, tokenizer_path)
