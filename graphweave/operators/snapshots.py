"""What a crawl found against what was known: changes by URL, and a history of every page's validators.

A crawl gives (pack, url, status, error, etag, last_modified, hash). The history holds a row for each
time a page's validators stayed the same: valid from, and to, or nothing while they hold.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators import evaluate
from graphweave.sources.versions import Store, Transaction

VALIDATORS = ("etag", "last_modified", "hash")
KEY = ["pack", "url"]
HISTORY = "pack string, url string, etag string, last_modified string, hash string, valid_from timestamp, valid_to timestamp"


def answered(prefix: str = "") -> Column:
    """Whether a check of a URL counts: no error, and a status under 400."""
    return F.col(f"{prefix}error").isNull() & (F.col(f"{prefix}status") < 400)


def compared(known: DataFrame, crawl: DataFrame) -> DataFrame:
    """(pack, url, old_*, new_*, ok, changed, kind) of all URLs of known(pack, url, validators) and a crawl.

    kind: `first` (not known before), `same`, `changed`, `error` (the check doesn't count) or `gone`
    (known, but not in the crawl). First sight is no change.
    """
    old = known.select(*KEY, *(F.col(c).alias(f"old_{c}") for c in VALIDATORS), F.lit(True).alias("was"))
    new = crawl.select(*KEY, *(F.nullif(F.col(c), F.lit("")).alias(f"new_{c}") for c in VALIDATORS), answered().alias("ok"), F.lit(True).alias("is"))
    both = old.join(new, KEY, "full").withColumn("ok", F.coalesce("ok", F.lit(False)))
    change = F.col("was").isNotNull() & F.col("ok") & evaluate.changed()
    kind = F.when(F.col("is").isNull(), "gone").when(~F.col("ok"), "error").when(F.col("was").isNull(), "first").when(change, "changed").otherwise("same")
    return both.select(*KEY, *(f"{p}_{c}" for p in ("old", "new") for c in VALIDATORS), "ok", F.coalesce(change, F.lit(False)).alias("changed"), kind.alias("kind"))


def freshness(known: DataFrame, crawl: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(pack, checked, changed, rate, needs_rebuild) of a crawl against what was known."""
    return evaluate.freshness(compared(known, crawl).where("kind <> 'gone'").select("pack", "ok", "changed"), threshold)


def current(history: DataFrame) -> DataFrame:
    return history.where("valid_to IS NULL")


def as_of(history: DataFrame, at: datetime) -> DataFrame:
    """What was known at a time."""
    return history.where((F.col("valid_from") <= F.lit(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(at))))


def after(history: DataFrame, crawl: DataFrame, at: datetime) -> DataFrame:
    """The history after a crawl: changed and gone pages' rows end, changed and new pages get one.

    A page that stayed the same keeps its row, with validators that it lacked; a check that doesn't
    count leaves the row as it is. A crawl no later than the newest row of a page changes nothing of
    it, so a crawl that is recorded twice counts once. A URL that a crawl has twice counts by its
    first check that counts, in the order of its validators.
    """
    once = crawl.groupBy(*KEY).agg(F.min(F.struct((~answered()).alias("bad"), *VALIDATORS, "status", "error")).alias("c")).select(*KEY, "c.*")
    seen = history.groupBy(*KEY).agg(F.max(F.greatest("valid_from", F.coalesce("valid_to", "valid_from"))).alias("last"))
    due = once.join(seen, KEY, "left").where(F.col("last").isNull() | (F.col("last") < F.lit(at))).drop("last")
    late = once.join(seen, KEY, "left").where(F.col("last") >= F.lit(at)).select(*KEY)
    told = compared(current(history).join(late, KEY, "left_anti"), due)
    shape = [*KEY, *VALIDATORS, "valid_from", "valid_to"]
    rows = history.join(told.select(*KEY, "kind", *(f"new_{c}" for c in VALIDATORS)), KEY, "left")
    open_, ends = F.col("valid_to").isNull(), F.col("kind").isin("changed", "gone")
    filled = [F.when(open_ & (F.col("kind") == "same"), F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) for c in VALIDATORS]
    old = rows.select(*KEY, *filled, "valid_from", F.when(open_ & ends & (F.col("valid_from") < F.lit(at)), F.lit(at)).otherwise(F.col("valid_to")).alias("valid_to"))
    new = told.where("kind IN ('first', 'changed')").select(*KEY, *(F.col(f"new_{c}").alias(c) for c in VALIDATORS), F.lit(at).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return old.select(*shape).unionByName(new.select(*shape))


class UrlHistory:
    """The history as a versioned table: of two crawls recorded at once neither is lost."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Store(spark, path)

        def make(t: Transaction) -> None:
            if "history" not in t.base.tables:
                t.create("history", ["pack"], spark.createDataFrame([], HISTORY).schema)

        self.store.transact(make, "create")

    def read(self) -> DataFrame:
        return self.store.read("history")

    def record(self, crawl: DataFrame, at: datetime) -> None:
        """Records a crawl of whole packs: other packs' pages stay, those of its packs that it lacks are gone."""
        packs = crawl.select("pack").distinct()

        def run(t: Transaction) -> None:
            def step(rows: DataFrame) -> DataFrame:
                own = rows.join(packs, "pack", "left_semi")
                return rows.join(packs, "pack", "left_anti").unionByName(after(own, crawl, at))

            t.update("history", packs, step)

        self.store.transact(run, f"crawl at {at.isoformat()}")
