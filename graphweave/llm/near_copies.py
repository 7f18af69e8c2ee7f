"""Near copies of texts: the links of all pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are the links of the SimHash operator, which finds about half of such pairs, and those of
minhashes in disjoint blocks (bands): two texts that agree in all minhashes of a band meet in a group.
The sets themselves are compared, so that no link is made below the similarity. A pair at exactly 0.8
shares none of the 20 bands of 5 with probability 0.0004, one at 0.9 with 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm import simhash
from graphweave.llm.common import batches_of, components, slices, store

SEED = 42
BANDS, EACH = 20, 5


_rng = np.random.default_rng(SEED)
_FLIPS = _rng.integers(0, 1 << 64, BANDS * EACH, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, BANDS * EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(those: np.ndarray) -> list[int]:
    """A hash of each band's minhashes; an empty set has none."""
    if not len(those):
        return []
    least = np.full(BANDS * EACH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(those), 4096):
        np.minimum(least, ((those[at : at + 4096, None] ^ _FLIPS) * _TIMES).min(axis=0), out=least)
    raw = least.astype("<u8").tobytes()
    return [int(np.uint64(xxhash.xxh64_intdigest(raw[8 * EACH * k : 8 * EACH * (k + 1)], k)).view(np.int64)) for k in range(BANDS)]


def node_of(those: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(those.astype("<u8").tobytes(), SEED)).view(np.int64))


def links(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of all pairs of the similarity: each set that is reached looks at those that aren't yet."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    unreached = np.ones(len(sets), dtype=bool)
    for seed in range(len(sets)):
        if not unreached[seed]:
            continue
        unreached[seed], waiting = False, [seed]
        while waiting and unreached.any():
            x = waiting.pop()
            first, after = np.searchsorted(flat, sets[x]), np.searchsorted(flat, sets[x], side="right")
            places = np.repeat(first - np.concatenate([[0], np.cumsum(after - first)[:-1]]), after - first) + np.arange((after - first).sum())
            both = np.bincount(owner[places], minlength=len(sets))
            near = np.flatnonzero(unreached & (both >= similarity * (sizes + sizes[x] - both) - 1e-9))
            unreached[near] = False
            waiting += near.tolist()
            yield from ((x, n) for n in near.tolist())


def agree(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose sets(node, shingles) have the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 2 << 20):
            first, second = (batch.column(c).to_pylist() for c in ("x", "y"))
            good = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(first, second)):
                least, most = sorted((len(x), len(y)))
                if least >= similarity * most - 1e-9:
                    both = len(np.intersect1d(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), assume_unique=True))
                    good[k] = both >= similarity * (len(x) // 8 + len(y) // 8 - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(good))

    x, y = (sets.select(F.col("node").alias(node), F.col("shingles").alias(name)) for node, name in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_copies(keyed: DataFrame, similarity: float = 0.8, words_each: int = 5, radius: int = 2, block: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Of keyed(key long, text): the (key, node) of every row and links (a, b) that join all near copies.

    A node is one set of shingles: rows with equal sets share it. Candidates are the links of the
    SimHash operator over fingerprints of the same shingles, and the nodes of a band with the band's
    smallest one. They are as many as there are nodes in bands; each is compared exactly. That joins
    nearly all; only bands whose nodes aren't in one component by then are compared node by node, in
    blocks of `block` nodes, so that no task holds a band of any size. What has the smallest node's
    component needs no comparison among itself. Every link has the similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes = [simhash.shingle_hashes(x, words_each) for x in batch.column("text").to_pylist()]
            sets, prints = [np.unique(x) for x in hashes], np.array([simhash.bits_of(x) for x in hashes], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([node_of(x) for x in sets], pa.int64()), pa.array(prints), pa.array([bands(x) for x in sets], pa.list_(pa.int64()))], ["key", "node", "fp", "bands"])

    prints = store(keyed.select("key", "text").mapInArrow(run, "key long, node long, fp long, bands array<long>"), "shingles")
    nodes = store(prints.groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")

    # candidates by fingerprint
    sharing = nodes.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    several = sharing.where("least <> most").select("fp", F.col("least").alias("b"))
    equal = nodes.select(F.col("node").alias("a"), "fp").join(several, "fp").select("a", "b")
    near = simhash.near_links(sharing.select("fp"), radius)
    ends = [sharing.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")) for c in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    # candidates by band
    each = nodes.select("node", F.explode("bands").alias("band"))
    groups = each.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "least")
    members = store(each.join(groups, "band"), "members")
    leading = members.select(F.col("node").alias("a"), F.col("least").alias("b"))
    every = equal.union(near).union(leading).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = store(every.distinct(), "pairs")

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct().join(nodes.select("node", "key"), "node").select("node", "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(simhash.shingle_hashes(x, words_each)).astype("<u8").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = keyed.join(small(store(asked, "asked")), "key").select("node", "text")
    sets = store(texts.mapInArrow(cut, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    with batches_of(keyed.sparkSession, 500):
        found = store(agree(sets, pairs, similarity), "links")

    # bands that are still in several components
    joined = components(found)
    told = members.join(joined, "node", "left").select("band", "node", F.coalesce("component", "node").alias("label"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same{k}") for k in (1, 2)]
    open_bands = told.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "node").alias("lead"), F.count("*").alias("n"), *same).where("low <> high")
    once = open_bands.groupBy("n", "same1", "same2").agg(F.min(F.struct("band", "lead")).alias("b")).select("b.*", "n")  # bands of equal nodes count once
    todo = store(told.join(once, "band"), "open")
    apart = todo.groupBy("band").agg(F.count_if(F.expr("label <> lead")).alias("others"))
    wide = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    todo = todo.join(apart, "band").select("band", "node", F.expr("label <> lead").alias("other"), F.when(F.col("n") <= block, 1).otherwise(wide(F.col("others"))).alias("rows"), wide(F.col("n")).alias("columns"))
    place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    # every node stands in its column against all rows; others stand in their row against all columns too
    across = todo.select("band", "node", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), place("columns", 3).alias("column"))
    down = todo.where("other and columns > 1").select("band", "node", place("rows", 4).alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    cells = across.union(down).distinct()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        ids = part["node"].to_numpy()
        pairs = [(ids[a], ids[b]) for a, b in links([np.frombuffer(x, dtype="<u8") for x in part["shingles"]], similarity)]
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    more = cells.join(sets, "node").groupBy("band", "row", "column").applyInPandas(compare, "a long, b long")
    return prints.select("key", "node"), found.union(more)


def small(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """keys, to be broadcast if they are few: then the texts that are joined to them aren't shuffled."""
    return F.broadcast(keys) if keys.count() <= most else keys
