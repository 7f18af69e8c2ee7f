"""Two-pass external shuffle: scatter into memory-sized buckets by seeded hashes, shuffle each, write it.

The first pass sends every record to a bucket of its shard; the second takes one bucket at a time
into memory, puts it into a random order by Fisher-Yates and writes it. Buckets follow one another
within a shard in an order that is itself random, as the hashes are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.common import store


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is largest.

    One more shard only adds a candidate, so a key either stays or goes to the new shard.
    """
    weights = F.array(*(F.struct(F.xxhash64(F.lit(seed + s), key).alias("w"), F.lit(s).alias("s")) for s in range(shards)))
    return F.array_max(weights)["s"]


def fisher_yates(size: int, seed: int) -> np.ndarray:
    """A random order of size places: each place from the last swaps with one not after it."""
    rng = np.random.default_rng(seed)
    order = np.arange(size)
    picks = (rng.random(size) * np.arange(1, size + 1)).astype(np.int64)
    for i in range(size - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_buckets(batches: Iterator[pa.RecordBatch], seed: int, out_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gw_bucket, bucket by bucket in Fisher-Yates order, with their place gw_place in it."""

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts)
        bucket = whole.column("gw_bucket")[0].as_py()
        order = fisher_yates(whole.num_rows, zlib.crc32(f"{seed}:{bucket}".encode()))
        step = max(1, int(whole.num_rows * out_bytes / max(1, whole.nbytes)))
        for at in range(0, len(order), step):
            rows = whole.take(pa.array(order[at : at + step])).combine_chunks()
            place = pa.array(np.arange(at, at + rows.num_rows, dtype=np.int64))
            yield from rows.append_column("gw_place", place).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        buckets = batch.column("gw_bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column("gw_bucket")[0].as_py() != int(buckets[a]):
                yield from done(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from done(held)


def external_shuffle(docs: DataFrame, shards: int = 24, key_col: str = "doc_id", text_col: str = "text", seed: int = 42, bucket_bytes: int = 16 << 20) -> DataFrame:
    """All rows and columns of docs, with gw_shard, gw_bucket and gw_place, written bucket by bucket and reread.

    The key and the number of shards decide on the shard; rows with equal or null keys share one.
    Within a shard, rows are scattered over buckets of about `bucket_bytes` of text, equal rows over
    different ones, so that a shard of any size and any number of copies is shuffled within a task's
    memory. A null text has no bytes. An empty table gives an empty table. Columns of docs may have
    any names that don't begin with gw_. Shards depend on keys alone; the order within them also on
    how the table's files are split, since nothing else tells equal rows apart.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + 8
    key = F.col(f"`{key_col}`")
    shard = shard_of(key, shards, seed)
    held = {r[0]: r[1] for r in docs.select(shard.alias("s"), size.alias("b")).groupBy("s").agg(F.sum("b")).collect()}
    buckets = {s: max(1, -(-held.get(s, 0) // bucket_bytes)) for s in range(shards)}
    before = {s: sum(buckets[x] for x in range(s)) for s in range(shards)}
    total = sum(buckets.values())
    per_shard = F.array(*(F.lit(buckets[s]).cast("long") for s in range(shards)))
    first = F.array(*(F.lit(before[s]).cast("long") for s in range(shards)))
    spread = F.xxhash64(F.lit(seed), key, F.monotonically_increasing_id())
    df = docs.select("*", shard.alias("gw_shard"), spread.alias("gw_spread"))
    df = df.withColumn("gw_bucket", F.get(first, F.col("gw_shard")) + F.pmod(F.col("gw_spread"), F.get(per_shard, F.col("gw_shard"))))
    # one bucket, one partition: the largest task is a bucket
    scattered = df.repartitionById(total, F.col("gw_bucket").cast("int")).sortWithinPartitions("gw_bucket", "gw_spread").drop("gw_spread")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered.schema)
    return store(scattered.mapInArrow(lambda batches: shuffle_buckets(batches, seed), f"{fields}, gw_place long"), "shards")


def with_slots(shuffled: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """Adds gw_slot, the gapless place of a row in its shard: its place in the bucket after all rows of earlier buckets.

    Up to `most_broadcast` buckets (16 bytes each) their starts go to every task and the records stay
    where they are; more are joined by bucket.
    """
    counted = shuffled.groupBy("gw_shard", "gw_bucket").count()
    ahead = Window.partitionBy("gw_shard").orderBy("gw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(counted.select("gw_bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("gw_start")), "starts")
    few = starts.count() <= most_broadcast
    return shuffled.join(F.broadcast(starts) if few else starts, "gw_bucket").withColumn("gw_slot", F.col("gw_start") + F.col("gw_place")).drop("gw_start")

