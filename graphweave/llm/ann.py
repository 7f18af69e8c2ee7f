"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted in numpy on a bounded sample; every vector is then put into its leaf. A query
walks the tree through a priority queue, always opening the bin whose centre has the largest inner
product with it, until it has visited as many leaves as calibration found to be needed and these
hold k rows besides its own. Leaves are
searched where they lie, in blocks, and scored exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.common import row_hash, sampled, store

SEED = 42


def exact_scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows in double precision, summed from the first component on.

    The order of the sum is the same for every pair, so equal vectors have equal scores.
    """
    out = np.zeros(len(queries))
    for j in range(vectors.shape[1]):
        out += queries[:, j] * vectors[:, j]
    return out


class Tree:
    """Centres of all nodes; children of inner nodes are consecutive; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaves: int, branching: int = 8) -> None:
        rng = np.random.default_rng(SEED)
        self.children: list[range] = []
        centres: list[np.ndarray] = [sample.mean(axis=0)]
        waiting = [(0, np.arange(len(sample)))]
        enough = max(2 * branching, len(sample) // max(1, leaves))
        self.children.append(range(0))
        while waiting:
            node, rows = waiting.pop(0)
            if len(rows) <= enough:
                continue
            own, kinds = _k_means(sample[rows], branching, rng)
            used = [k for k in range(len(own)) if (kinds == k).any()]
            if len(used) < 2:
                continue
            first = len(centres)
            self.children[node] = range(first, first + len(used))
            for k in used:
                centres.append(own[k])
                self.children.append(range(0))
                waiting.append((len(centres) - 1, rows[kinds == k]))
        self.centres = np.array(centres)
        self.leaf = np.full(len(centres), -1, dtype=np.int64)
        bottom = [k for k, c in enumerate(self.children) if not c]
        self.leaf[bottom] = np.arange(len(bottom))
        self.leaves = len(bottom)
        self.norms = (self.centres**2).sum(axis=1)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree, to the nearest centre at every node."""
        at = np.zeros(len(vectors), dtype=np.int64)
        moving = [0] if self.children[0] else []
        while moving:
            node = moving.pop()
            rows = np.flatnonzero(at == node)
            if len(rows):
                c = self.children[node]
                gaps = self.norms[c.start : c.stop] - 2 * vectors[rows] @ self.centres[c.start : c.stop].T
                at[rows] = c.start + gaps.argmin(axis=1)
                moving += [k for k in c if self.children[k]]
        return self.leaf[at]

    def visits(self, query: np.ndarray, most: int, counts: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """Leaves in the order of best-bin-first search: `most`, and more until they hold `rows` rows by counts."""
        worth = self.centres @ query
        queue, out, held = [(-worth[0], 0)], [], 0
        while queue and (len(out) < most or counts is not None and held < rows):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                held += int(counts[out[-1]]) if counts is not None else 0
            for k in self.children[node]:
                heapq.heappush(queue, (-worth[k], k))
        return out

    def calibrate(self, sample: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
        """Leaves to visit so that the sample's own queries find `recall` of their k best, on average."""
        leaf = self.assign(sample)
        ranks = []
        for q in range(0, len(sample), max(1, len(sample) // queries)):
            scores = sample @ sample[q]
            scores[q] = -np.inf
            best = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
            order = np.full(self.leaves, self.leaves)
            seen = self.visits(sample[q], self.leaves)
            order[seen] = np.arange(1, len(seen) + 1)
            ranks.append(np.sort(order[leaf[best]]))
        if not ranks or not len(ranks[0]):
            return self.leaves
        every = np.concatenate(ranks)
        for most in range(1, self.leaves + 1):  # widen until the recall is reached
            if (every <= most).mean() >= recall:
                return most
        return self.leaves


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    kinds = np.zeros(len(rows), dtype=np.int64)
    for _ in range(rounds):
        kinds = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        for j in range(len(centres)):
            if (kinds == j).any():
                centres[j] = rows[kinds == j].mean(axis=0)
    return centres, kinds


def _first(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query: by falling score, then id."""
    order = np.lexsort((ids, -scores, queries))
    q = queries[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[place < k]


def first_copies(vectors: np.ndarray, ids: np.ndarray, leaf: np.ndarray, most: int) -> np.ndarray:
    """Places, by leaf then id, without the copies of a vector beyond the `most` of smallest ids: no query needs those."""
    raw = np.ascontiguousarray(vectors).view([("", vectors.dtype)] * vectors.shape[1]).ravel()
    kind = np.unique(raw, return_inverse=True)[1]
    order = np.lexsort((ids, kind))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(kind[order]) != 0]))
    turn = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    kept = order[turn < most]
    return kept[np.lexsort((ids[kept], leaf[kept]))]


def search_shard(candidates: pd.DataFrame, queries: pd.DataFrame, k: int, cells: int = 4_000_000) -> pd.DataFrame:
    """The k best of candidates(id, v, leaf) for each of queries(id, v, leaves), looking into the query's leaves only.

    Blocked matrix products find what is within rounding of the k best; these are scored exactly.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(candidates) and len(queries):
        ids, leaf, those = candidates["id"].to_numpy(), candidates["leaf"].to_numpy(), np.array(list(candidates["v"]))
        kept = first_copies(those, ids, leaf, k + 1)  # one may be the query itself
        ids, leaf, those = ids[kept], leaf[kept], those[kept]
        names, asked = queries["id"].to_numpy(), np.array(list(queries["v"]))
        rows = np.repeat(np.arange(len(queries)), queries["leaves"].map(len))
        into = queries["leaves"].explode().to_numpy(dtype=np.int64)
        kinds, first = np.unique(leaf, return_index=True)
        after = np.append(first[1:], len(leaf))
        widest, lengths = np.sqrt((those**2).sum(axis=1)).max(), np.sqrt((asked**2).sum(axis=1))
        slack = 4 * those.shape[1] * np.finfo(np.float64).eps * widest * lengths
        step = max(1, cells // len(ids))
        for at in range(0, len(asked), step):
            some = slice(at, min(at + step, len(asked)))
            scores = np.full((some.stop - at, len(ids)), -np.inf)
            inside = (rows >= at) & (rows < some.stop)
            here, there = rows[inside] - at, into[inside]
            for n, a, z in zip(kinds.tolist(), first.tolist(), after.tolist()):
                if len(who := here[there == n]):
                    scores[who, a:z] = asked[at + who] @ those[a:z].T
            scores[names[some][:, None] == ids[None, :]] = -np.inf
            least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(scores), -np.inf)
            q, c = np.nonzero((scores >= (least - slack[some])[:, None]) & np.isfinite(scores))
            exact = exact_scores(those[c], asked[at + q])
            best = _first(q, ids[c], exact, k)
            found.append((names[at + q[best]], ids[c[best]], exact[best]))
    q, i, s = (np.concatenate([x[j] for x in found]) if found else np.zeros(0) for j in range(3))
    return pd.DataFrame({"query_id": q.astype(np.int64), "vec_id": i.astype(np.int64), "score": s.astype(np.float64)})


def shards_of(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its first shard and how many it has: small leaves share one, large ones are cut into blocks."""
    first, parts = np.zeros(len(counts), dtype=np.int64), np.maximum(1, -(-counts // block))
    now, held = 0, 0
    for n, c in enumerate(counts.tolist()):
        if held and held + c > block:
            now, held = now + 1, 0
        first[n], held = now, held + c
        if parts[n] > 1:
            now, held = now + int(parts[n]), 0
    return first, parts


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_every: int = 20, recall: float = 0.97, leaf_rows: int = 256, sample_size: int = 16384, block: int | None = None, query_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose id `query_every` divides.

    Every row is indexed; the tree and the number of leaves to visit are fitted on about `sample_size`
    rows (those of the smallest hashes), or 16 for each leaf of about `leaf_rows` rows, 65,536 at most.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without an id; shorter vectors count as if filled up with zeros. A row is not its own neighbour.
    Repeated rows are candidates each. Leaves lie in shards of about `block` vectors (a sixteenth of
    them, 1,024 to 32,768), searched by `query_block` queries at a time, so a leaf of any size, such as
    one vector repeated, is spread over tasks; a task returns k rows of a query. Fewer than k
    candidates: all that were found. An empty table: no rows.
    """
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    df = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.where(sound & F.exists("v", lambda x: x != 0))
    total, width = df.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    df = df.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    leaves = min(4096, max(8, total // leaf_rows))
    block = block or min(32768, max(1024, total // 16))
    rows = np.array([r["v"] for r in sampled(df, row_hash("id"), total, max(sample_size, 16 * leaves))])
    tree = Tree(rows, leaves)
    most = tree.calibrate(rows, k, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("v").flatten().to_numpy().reshape(-1, width)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(tree.assign(flat))], ["id", "v", "leaf"])

    index = store(df.mapInArrow(place, "id long, v array<double>, leaf long"), "index")
    counts = np.zeros(tree.leaves, dtype=np.int64)
    for r in index.groupBy("leaf").count().collect():  # one row for each leaf of the bounded tree
        counts[r[0]] = r[1]
    first, parts = shards_of(counts, block)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, shards, leaves = [], [], []
            for n, q in enumerate(batch.column("v").flatten().to_numpy().reshape(-1, width)):
                by: dict[int, list[int]] = {}
                for leaf in tree.visits(q, most, counts, k + 1):  # itself and k others
                    for p in range(int(parts[leaf])):
                        by.setdefault(int(first[leaf]) + p, []).append(leaf)
                at += [n] * len(by)
                shards += by
                leaves += by.values()
            there = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([there.column("id"), there.column("v"), pa.array(shards, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["id", "v", "shard", "leaves"])

    asked = store(df.where(F.col("id") % query_every == 0).mapInArrow(walk, "id long, v array<double>, shard long, leaves array<long>"), "queries")
    asks = np.ones(int((first + parts).max()), dtype=np.int64)
    for r in asked.groupBy("shard").count().collect():  # one row for each block of vectors
        asks[r[0]] = -(-r[1] // query_block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            shard = first[leaf] + np.arange(turn, turn + len(leaf)) % parts[leaf]
            turn += len(leaf)
            times = asks[shard]
            there = batch.take(pa.array(np.repeat(np.arange(len(leaf)), times)))
            ask = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([*there.columns, pa.array(np.repeat(shard, times)), pa.array(ask)], ["id", "v", "leaf", "shard", "ask"])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            ask = np.arange(n, n + batch.num_rows) % asks[batch.column("shard").to_numpy()]
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ask)], [*batch.schema.names, "ask"])

    left = index.mapInArrow(deal, "id long, v array<double>, leaf long, shard long, ask long").groupBy("shard", "ask")
    right = asked.mapInArrow(turn, "id long, v array<double>, shard long, leaves array<long>, ask long").groupBy("shard", "ask")
    found = left.cogroup(right).applyInPandas(lambda c, q: search_shard(c, q, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
