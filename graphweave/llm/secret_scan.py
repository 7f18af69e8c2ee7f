"""Secret scan with ownership frequency, in DataFrame and SQL functions only.

Every candidate value is hashed and counted over the corpus: in how many repositories, for how many
owners and in how many rows it occurs. A value that many owners or repositories hold, or that stands
in very many rows, is a copied example; one that stays with few and looks random is taken for a live
credential, and gets a span of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm import spans
from graphweave.llm.common import store

# The base patterns. Hexadecimal runs and access keys match the same with their
# least length in the pattern; an assignment is matched first and its value measured after.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Candidates beyond the base: prefixed service tokens, signed web tokens, and long mixed-case runs.
SERVICE = r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+"
KINDS = ("assign", "access", "hex", "live")
#: Words that mark a value as an example.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0{8}|1234567"


def _tagged(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).cast("long").alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["part"].alias("value")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: str | Column = "source", owner: str | Column = "source", copied_from: int = 3, copied_repositories: int = 6, copied_rows: int = 100, salts: int = 64) -> DataFrame:
    """For every row: base spans, candidates with their ownership frequency, and all spans with the method's.

    Returns doc_id, base (array of kind, rank, start, end), found (array of start, end, value_hash,
    repositories, owners, rows, verdict) and all_spans. A candidate whose value has `copied_from`
    owners, `copied_repositories` repositories or `copied_rows` rows or more is "copied"; another is
    "live" if it looks random, else "dull". Live candidates add a span of kind live over the value.
    Rows with null repository or owner count under one unnamed owner; null texts have no spans;
    repeated rows are returned each; an empty table gives an empty table. Other columns are ignored.
    Verdicts go back to rows by value and one of `salts` salts, so a value of any share of all rows
    is that many keys.
    """
    place = lambda x: F.col(f"`{x}`") if isinstance(x, str) else x
    df = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("gw_text"),
        F.coalesce(place(repository).cast("string"), F.lit("")).alias("repo"), F.coalesce(place(owner).cast("string"), F.lit("")).alias("owner"),
    )
    assign = F.filter(spans.matches("gw_text", ASSIGN, 2), lambda x: F.length(x["part"]) >= 6)
    # the value stands at the end of an assignment
    value_at = lambda found: F.transform(found, lambda x: F.struct((x["end"] - F.length(x["part"])).alias("start"), x["end"].alias("end"), x["part"].alias("part")))
    df = df.select("doc_id", "repo", "owner", assign.alias("assign"), *(spans.matches("gw_text", p).alias(k) for k, p in (("access", ACCESS), ("hex", HEX), ("service", SERVICE), ("mixed", MIXED))))
    both = F.concat(_tagged(F.col("assign"), "assign"), _tagged(F.col("access"), "access"), _tagged(F.col("hex"), "hex"))
    plain = lambda found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["part"].alias("part")))
    candidates = F.array_distinct(F.concat(value_at(F.col("assign")), *(plain(F.col(k)) for k in ("access", "hex", "service", "mixed"))))
    df = df.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner",
        F.transform(both, lambda x: F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"))).alias("base"),
        F.transform(candidates, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.sha2(x["part"], 256).alias("hash"), _looks_live(x["part"]).alias("random"))).alias("candidates"),
    )
    seen = store(df, "secrets")
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    each = seen.where(F.size("candidates") > 0).select("row", "repo", "owner", salt.alias("salt"), F.explode("candidates").alias("c")).select("row", "repo", "owner", "salt", "c.*")
    held = each.groupBy("hash", "salt", "repo", "owner").agg(F.count_distinct("row").alias("rows"))
    frequency = held.groupBy("hash").agg(F.countDistinct("repo").alias("repositories"), F.countDistinct("owner").alias("owners"), F.sum("rows").alias("rows"))
    salted = held.select("hash", "salt").distinct().join(frequency, "hash")  # a hash has `salts` rows here at most
    copied = (F.col("owners") >= copied_from) | (F.col("repositories") >= copied_repositories) | (F.col("rows") >= copied_rows)
    verdict = F.when(copied, "copied").when(F.col("random"), "live").otherwise("dull")
    told = each.join(salted, ["hash", "salt"]).select("row", F.struct("start", "end", F.col("hash").alias("value_hash"), "repositories", "owners", "rows", verdict.alias("verdict")).alias("f"))
    told = told.groupBy("row").agg(F.sort_array(F.collect_list("f")).alias("found"))
    rank = F.lit(KINDS.index("live")).cast("long")
    live = F.transform(F.filter("found", lambda x: x["verdict"] == "live"), lambda x: F.struct(F.lit("live").alias("kind"), rank.alias("rank"), x["start"].alias("start"), x["end"].alias("end")))
    out = seen.select("row", "doc_id", "base").join(told, "row", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,value_hash:string,repositories:bigint,owners:bigint,rows:bigint,verdict:string>>")
    return out.select("doc_id", spans.by_start(F.col("base")).alias("base"), F.coalesce("found", none).alias("found"), spans.by_start(F.concat("base", F.coalesce(live, F.array().cast("array<struct<kind:string,rank:bigint,start:bigint,end:bigint>>")))).alias("all_spans"))


def _looks_live(value: Column) -> Column:
    """Ten different characters or more, a digit and a letter, and no word that marks an example."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 16) & (different >= 10) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
