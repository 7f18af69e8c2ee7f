"""Documents to packed training sequences: quality rules, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but
the last return the columns of documents. A stage's result is written before the next one is called,
so the tables that it left in the shared folder go when the next one begins. Null texts count as
empty, columns that aren't named here pass through, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphweave.llm import stages
from graphweave.llm.common import discard, store, stored, table


#: Tables of the stage that was called last.
_left: list[str] = []


def _alone(spark: SparkSession, stage: Callable[[], DataFrame]) -> DataFrame:
    """The stage's result, after the tables of the stage before are deleted."""
    discard(spark, _left)
    before = stored()
    out = stage()
    _left[:] = [x for x in stored() if x not in before]
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior of all rules hold for good; null texts go, repeated rows stay."""
    return _alone(spark, lambda: stages.keep_good(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, then of the smallest hash of all columns."""
    return _alone(spark, lambda: stages.keep_one_of_each(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; a null text stays null."""
    return _alone(spark, lambda: stages.mask_private(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 ids; a null text is the end id alone, repeated rows are packed each."""
    return _alone(spark, lambda: stages.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Expectation-maximisation, fingerprints and retrieval are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread as the next one's input."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
        discard(spark, last)
        last = stored()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
