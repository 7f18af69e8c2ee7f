"""SimHash fingerprints, and their exact pairs within a few bits by sharded vantage-point trees.

The upper tree, fitted on a sample, parts all fingerprints by their Hamming distance to a vantage
point at every node; its leaves are the shards. A fingerprint goes to its own shard, and as a visitor
to those whose boundary it is near, as far as the triangle bound leaves them open. Every shard builds
the lower levels of the tree over its own fingerprints and compares what meets in a leaf exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import components, renamed, sampled, slices, store

BITS = 64
SEED = 42


def shingle_hashes(text: str | None, words_each: int) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included: words split at ASCII white space, A-Z lower-cased; few words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([digest(join(words), SEED)], dtype=np.uint64)
    return np.array([digest(join(x), SEED) for x in zip(*(words[k:] for k in range(words_each)))], dtype=np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: the bits that over half of them have; zero of none."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """The 64-bit SimHash of a text."""
    return bits_of(shingle_hashes(text, words_each))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; a null or blank text has fingerprint zero."""
    df = renamed(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(x, words_each) for x in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long")


class Tree:
    """A vantage-point tree: every inner node has a vantage point and a Hamming distance that parts near from far.

    For two fingerprints within the radius, their distances to a vantage point differ by the radius at
    most (triangle bound). So of a pair that a node parts, the far one lies within the radius beyond
    the cut: it visits the near side too, and everything else is pruned without losing a pair.
    """

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, tries: int = 8) -> None:
        rng = np.random.default_rng(SEED)
        self.radius = radius
        self.vantage: list[np.uint64] = []
        self.cut: list[int] = []
        self.sides: list[tuple[int, int]] = []  # near and far: nodes, or leaves as -1 - leaf
        self.leaves = 0
        enough = max(2, len(sample) // max(1, leaves))
        waiting: list[tuple[np.ndarray, int, int]] = [(sample, -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop(0)
            best = parting(rows, radius, rng, tries) if len(rows) > enough else None
            if best is None:
                name = -1 - self.leaves
                self.leaves += 1
            else:
                name = len(self.vantage)
                self.vantage.append(best[0])
                self.cut.append(best[1])
                self.sides.append((0, 0))
                near = np.bitwise_count(rows ^ best[0]) <= best[1]
                waiting += [(rows[near], name, 0), (rows[~near], name, 1)]
            if parent >= 0:
                pair = [*self.sides[parent]]
                pair[side] = name
                self.sides[parent] = (pair[0], pair[1])

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, fingerprints at home there, fingerprints that visit it)."""
        waiting = [(0 if self.vantage else -1, fps, fps[:0])]
        while waiting:
            node, homes, visitors = waiting.pop()
            if not len(homes) and not len(visitors):
                continue
            if node < 0:
                yield -1 - node, homes, visitors
                continue
            near, far = parted(homes, visitors, self.vantage[node], self.cut[node], self.radius)
            waiting += [(self.sides[node][0], *near), (self.sides[node][1], *far)]


def parting(rows: np.ndarray, radius: int, rng: np.random.Generator, tries: int) -> tuple[np.uint64, int] | None:
    """The vantage point among rows, and the cut, with the fewest rows just beyond it; between a quarter and three quarters are near."""
    best = None
    for vantage in rows[rng.integers(0, len(rows), tries)]:
        share = np.cumsum(np.bincount(np.bitwise_count(rows ^ vantage), minlength=BITS + 1)) / len(rows)
        for cut in np.flatnonzero((share[:-1] >= 0.25) & (share[:-1] <= 0.75)).tolist():
            cost = share[min(BITS, cut + radius)] - share[cut]
            if best is None or cost < best[0]:
                best = (cost, vantage, cut)
    return best and best[1:]


def parted(homes: np.ndarray, visitors: np.ndarray, vantage: np.uint64, cut: int, radius: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(homes, visitors) of the near side and of the far side."""
    own, theirs = np.bitwise_count(homes ^ vantage).astype(np.int64), np.bitwise_count(visitors ^ vantage).astype(np.int64)
    crossing = homes[(own > cut) & (own <= cut + radius)]
    return (homes[own <= cut], np.concatenate([visitors[theirs <= cut + radius], crossing])), (homes[own > cut], visitors[theirs > cut - radius])


def pairs(homes: np.ndarray, visitors: np.ndarray, radius: int, leaf: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius between homes, and between a home and a visitor, by a tree over the homes, in parts."""
    rng = np.random.default_rng(SEED)
    waiting = [(homes, visitors)]
    while waiting:
        homes, visitors = waiting.pop()
        best = parting(homes, radius, rng, 4) if len(homes) * (len(homes) + len(visitors)) > leaf else None
        if best:
            waiting += parted(homes, visitors, *best, radius)
            continue
        everyone = np.concatenate([homes, visitors])
        step = max(1, 4_000_000 // max(1, len(everyone)))
        for at in range(0, len(homes), step):
            i, j = np.nonzero(np.bitwise_count(homes[at : at + step, None] ^ everyone[None, :]) <= radius)
            keep = j > i + at
            yield homes[at : at + step][i[keep]], everyone[j[keep]]


def join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of places a and b, pair by pair: labels hold the smallest place of each place's set."""
    while len(a):
        p, q = labels[a], labels[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(labels, np.maximum(p, q), np.minimum(p, q))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def near_links(distinct: DataFrame, radius: int = 2, shard_rows: int = 50_000, least_shards: int = 24) -> DataFrame:
    """Links (a, b) that join all fingerprints of distinct(fp) that chains of pairs within the radius connect.

    The upper tree is fitted on a sample, 64 fingerprints for each shard and at most a million; its
    leaves are the shards. Every fingerprint is searched. Each shard compares exactly and returns a
    spanning forest of its pairs, one link for a fingerprint at most, so that a dense cluster doesn't
    give all its pairs. A shard takes 8 bytes for each fingerprint in it.
    """
    total = distinct.count()
    leaves = max(-(-total // shard_rows), min(least_shards, -(-total // 1000)))
    sample = np.array([r["fp"] for r in sampled(distinct, F.xxhash64("fp"), total, min(1 << 20, max(4096, 64 * leaves)))], dtype=np.int64).view(np.uint64)
    tree = distinct.sparkSession.sparkContext.broadcast(Tree(np.sort(sample), leaves, radius))  # some bytes for each shard

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            routes = list(tree.value.route(fps))
            if routes:
                sizes = np.array([(len(homes), len(visitors)) for _, homes, visitors in routes])
                columns = [np.repeat([leaf for leaf, _, _ in routes], sizes.sum(axis=1)), np.concatenate([x for r in routes for x in r[1:]]).view(np.int64), np.repeat(np.tile([True, False], len(routes)), sizes.ravel())]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shard", "fp", "home"])

    def search(part: pd.DataFrame) -> pd.DataFrame:
        fps, home = part["fp"].to_numpy().view(np.uint64), part["home"].to_numpy()
        names = np.unique(fps)
        labels = np.arange(len(names))
        for a, b in pairs(np.sort(fps[home]), fps[~home], radius):
            join(labels, np.searchsorted(names, a), np.searchsorted(names, b))
        linked = np.flatnonzero(labels != np.arange(len(names)))
        return pd.DataFrame({"a": names[linked].view(np.int64), "b": names[labels[linked]].view(np.int64)})

    return distinct.select("fp").mapInArrow(scatter, "shard long, fp long, home boolean").groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Rows whose fingerprints are joined by a chain of links, each of `radius` differing bits at most,
    share a component; component_id is the smallest doc_id in it. Null, empty and blank texts have
    fingerprint zero and link like any other. Rows with the same id are all returned; a null id is
    returned and counts for no component_id (null if no row of the component has an id). Other
    columns are ignored, an empty table gives an empty table.
    """
    prints = store(fingerprints(docs, id_col, text_col, words_each), "fingerprints")
    nodes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = store(components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp"), "components")
    classes = nodes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
