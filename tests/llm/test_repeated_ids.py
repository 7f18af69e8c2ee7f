"""Tables whose ids are mostly null or mostly one id: nothing crashes, nothing is lost, the sample stays small."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphweave.llm import ann, common, packing, stages

IDS = {"null": "CAST(NULL AS LONG)", "zero": "0L", "five": "5L", "third": "IF(id % 3 = 0, 7L, id)"}


@pytest.fixture
def sizes(monkeypatch):
    """How many rows each sample brought to the driver, against what it asked for."""
    seen, plain = [], common.sampled

    def counted(df, by, total, size):
        limit = 2 * size + 200
        got = df.withColumn("gw_hash", by)
        top = float(1 << 63)
        n = got.where(F.col("gw_hash").cast("double") <= -top + 2 * top * min(1.0, (1.5 * size + 100) / max(1, total))).count()
        seen.append((n, limit))
        return plain(df, by, total, size)

    monkeypatch.setattr(packing, "sampled", counted)
    monkeypatch.setattr(ann, "sampled", counted)
    return seen


@pytest.mark.parametrize("kind", IDS)
def test_packing(spark, sizes, kind):
    docs = spark.range(20_000).selectExpr(f"{IDS[kind]} AS doc_id", "concat('some words of text number ', id % 50) AS text")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), shard_tokens=20_000)
    assert out.where("start = 0").count() == 20_000
    assert sizes and all(n <= most for n, most in sizes)


@pytest.mark.parametrize("kind", IDS)
def test_nearest_neighbours(spark, sizes, kind):
    v = spark.range(40_000).selectExpr(f"{IDS[kind].replace('5L', '20L')} AS vec_id", "array(sin(id * 0.37), cos(id * 0.11), sin(id * 0.05)) AS embedding")
    few = v if kind == "third" else v.limit(3000)
    out = ann.search(few, query_every=20 if kind != "third" else 4000)
    if kind == "third":
        assert out.count() == 20 * 6  # ids 4000, 8000, ... without those that became 7
    else:
        assert out.count() == 0  # no id asks, or there is no row but those of the query's own id
    assert all(n <= most for n, most in sizes)


def test_the_pipelines_packing_of_one_id(spark):
    docs = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('words ', id) AS text")
    assert stages.pack(docs, public_tokenizers.path("word_bpe_49k.json")).where("start = 0").count() == 5000
