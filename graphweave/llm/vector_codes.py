"""Vectors as short codes: each part of a vector is named by the nearest entry of that part's codebook.

Codebooks are learned in integers by rounds of assignment and averaging. In every round the driver
builds a kd-tree over each codebook and broadcasts them; tasks look up their parts by branch and
bound and add integer sums for each entry, which Spark adds up; the entries are the floors of the
means. A branch whose bound equals the best distance is still visited, so of equally near entries the
one of the lowest index is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm.common import renamed, store
from graphweave.llm.hard_negatives import integers, sound

#: Components beyond this are held at it, so that squared distances and their sums fit a long.
MOST = 1 << 24
#: Entries in a leaf of the tree.
LEAF = 2


@dataclass
class Node:
    """A cell of the tree: entries of a leaf, or a cut between two cells, which may share values at the cut."""

    entries: list[int] | None = None
    axis: int = 0
    left: Node | None = None
    right: Node | None = None
    left_most: int = 0
    right_least: int = 0


class KdTree:
    """Nearest entries of a codebook, [entries, width] of integers."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        self.root = self._built(np.arange(len(book)))

    def _built(self, own: np.ndarray) -> Node:
        if len(own) <= LEAF or self.book.shape[1] == 0:
            return Node(entries=sorted(own.tolist()))
        points = self.book[own]
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        order = own[np.argsort(points[:, axis], kind="stable")]
        low, high = order[: len(order) // 2], order[len(order) // 2 :]
        return Node(None, axis, self._built(low), self._built(high), int(self.book[low, axis].max()), int(self.book[high, axis].min()))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each point's nearest entry, the lowest of equally near ones, and the squared distance."""
        best, at = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), dtype=np.int64)

        def visit(node: Node, who: np.ndarray, bound: np.ndarray) -> None:
            open_ = bound <= best[who]  # an equal bound may hide an entry of a lower index
            who, bound = who[open_], bound[open_]
            if not len(who):
                return
            if node.entries is not None:
                own = points[who]
                for e in node.entries:
                    d = own - self.book[e]
                    d = np.einsum("ij,ij->i", d, d)
                    better = (d < best[who]) | (d == best[who]) & (e < at[who])
                    best[who[better]], at[who[better]] = d[better], e
                return
            x = points[who, node.axis]
            to_right, to_left = np.maximum(node.right_least - x, 0), np.maximum(x - node.left_most, 0)
            left = to_left <= to_right
            for mask, near, far, gap in ((left, node.left, node.right, to_right), (~left, node.right, node.left, to_left)):
                if mask.any():
                    visit(near, who[mask], bound[mask])
                    visit(far, who[mask], np.maximum(bound[mask], gap[mask] ** 2))

        visit(self.root, np.arange(len(points)), np.zeros(len(points), dtype=np.int64))
        return at, best


def _parts(batch: pa.RecordBatch, parts: int, wide: int) -> np.ndarray:
    """[part, row, component] of a batch of vectors of one length; a length that parts don't divide is filled up with zeros."""
    v = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, wide).astype(np.int64)
    each = -(-wide // parts)
    return np.pad(v, ((0, 0), (0, each * parts - wide))).reshape(batch.num_rows, parts, each).transpose(1, 0, 2)


def summed(rows: DataFrame, trees: Any, parts: int, wide: int) -> DataFrame:
    """(part, entry, place, total): sums of the components assigned to each entry, at place -1 their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        each = -(-wide // parts)
        total = np.zeros((parts, len(own[0].book), each + 1), dtype=np.int64)
        for batch in batches:
            for p, points in enumerate(_parts(batch, parts, wide)):
                at, _ = own[p].nearest(points)
                order = np.argsort(at, kind="stable")
                entries, first = np.unique(at[order], return_index=True)
                if len(entries):
                    total[p, entries, :each] += np.add.reduceat(points[order], first, axis=0) if each else 0
                    total[p, entries, each] += np.diff([*first, len(at)])
        p, e, j = np.nonzero(total)
        columns = [p, e, np.where(j == each, -1, j), total[p, e, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "total"])

    return rows.mapInArrow(run, "part long, entry long, place long, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def codebooks(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray | None:
    """[part, entry, component] of rows(id, vec) of one length: learned from the vectors of the smallest ids on; none without rows.

    What reaches the driver is `entries` rows at first, and one number for each component of each entry in a round.
    """
    first = rows.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).toArrow()
    if not first.num_rows:
        return None
    wide = len(first.column("vec")[0])
    books = np.ascontiguousarray(_parts(first.combine_chunks().to_batches()[0], parts, wide))
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        trees = context.broadcast([KdTree(b) for b in books])
        each = books.shape[2]
        total = np.zeros((parts, books.shape[1], each + 1), dtype=np.int64)
        for r in summed(rows, trees, parts, wide).collect():
            total[r["part"], r["entry"], r["place"]] = r["total"]  # place -1 is the last
        n = total[:, :, each]
        means = total[:, :, :each] // np.maximum(n, 1)[:, :, None]
        books = np.where((n > 0)[:, :, None], means, books)
        trees.unpersist()
    return books


def assigned(rows: DataFrame, trees: Any, parts: int, wide: int) -> DataFrame:
    """rows(id, label, vec) to (id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trees.value[p].nearest(points) for p, points in enumerate(_parts(batch, parts, wide))]
            code = [x.tobytes().hex() for x in np.stack([at for at, _ in found], axis=1).astype(np.uint8)]
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def _labelled(spark: SparkSession, coded: DataFrame, most: int = 10_000) -> DataFrame:
    """coded with the error summed over each label; few labels are broadcast, many are joined by label."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.limit(most + 1).count() <= most else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")


def compress(rows: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a sound vector.

    Rows whose vector is null or holds null or non-finite components are dropped. Repeated and null ids
    stay; among the first rows equal ids are taken by their vectors, null ids come last. Of vectors of
    differing lengths those as long as that of the smallest id take part. Fewer rows than entries give
    smaller codebooks, an empty table an empty result. Components beyond 2^24 are held there. Other
    columns are ignored. An entry that no part is nearest to stays as it is.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    spark = rows.sparkSession
    df = renamed(rows, id=id_col, vec=vector_col, label=label_col).where(sound(F.col("vec")))
    kept = store(df.select("id", "label", integers(F.col("vec"), scale, MOST).alias("vec")), "vectors")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec")).first()
    wide = first[0] if first else 0
    same = kept.where(F.size("vec") == wide)
    books = codebooks(same, parts, entries, rounds)
    if books is None:
        digest = hashlib.sha256(b"").hexdigest()
        return kept.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
    coded = store(assigned(same, trees, parts, wide), "codes")
    return _labelled(spark, coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
