"""Hard negatives for anchors: all scores of an anchor in order, and the rows of other labels just under its positives.

Scores are inner products of integer components. A task reads blocks of rows; for a block of anchors
it computes all integer scores, sorts them by score and id, and reads off what it needs: the first
rows of the anchor's label (positives), then, from the place that a binary search for a positive's
upper limit gives, the first rows of other labels down to the lower limit. Tasks keep the best few of
an anchor over all their blocks; the best of all tasks are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import discard, renamed, store, stored

#: Components beyond this are held at it, so that scores of up to 8,192 components fit a long.
MOST = 1 << 25
#: Bytes of the anchors' components in one block of anchors; that many go to every task at once.
ANCHOR_BYTES = 16 << 20
#: Rows and anchors whose scores are in memory at once.
ROWS, ANCHORS = 16_384, 256


def integers(vector: Column, scale: int, most: int = MOST) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))


def sound(vector: Column) -> Column:
    """Whether a vector is there, without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Entries:
    """Rows of one length of vector: ids (nulls last), labels, components, and how many equal rows each stands for."""

    def __init__(self, batch: pa.Table, wide: int) -> None:
        column = lambda name: batch.column(name).combine_chunks()
        self.lost = column("id").is_null().to_numpy(zero_copy_only=False)
        self.ids, self.labels, self.copies = (column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("id", "label", "copies"))
        self.vectors = column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, wide).astype(np.int64)

    def ordered(self) -> Entries:
        """The same by rising id, nulls last, so that a row's place decides ties."""
        order = np.lexsort((self.ids, self.lost))
        for name in ("ids", "lost", "labels", "copies", "vectors"):
            setattr(self, name, getattr(self, name)[order])
        return self


def by_width(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """Parts of a table by the length of their vectors."""
    sizes = table.column("vec").combine_chunks().value_lengths().to_numpy() if table.num_rows else np.zeros(0, dtype=np.int64)
    for wide in np.unique(sizes):
        yield int(wide), table.filter(pa.array(sizes == wide))


def blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[int, Entries]]:
    """Batches as entries of one length each, up to so many rows at once."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[tuple[int, Entries]]:
        for wide, part in by_width(pa.Table.from_batches(held)):
            for at in range(0, part.num_rows, rows):
                yield wide, Entries(part.slice(at, rows), wide).ordered()
        held.clear()

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from out()
            size = 0
    if held:
        yield from out()


def scores_in_order(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, its scores falling and the places of their rows, equal scores by place."""
    bound = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if bound < 1 << 53:  # exact in double precision
        scores = (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    elif bound < 1 << 63:
        scores = anchors @ rows.T
    else:
        raise OverflowError("inner products don't fit a long")
    bits = max(1, (rows.shape[0] - 1).bit_length())
    if bound < 1 << (62 - bits):  # score and place in one number
        keys = (-scores << bits) | np.arange(rows.shape[0])
        keys.sort(axis=1)
        return -(keys >> bits), keys & ((1 << bits) - 1)
    places = np.broadcast_to(np.arange(rows.shape[0]), scores.shape)
    order = np.lexsort((places, -scores), axis=1)
    return np.take_along_axis(scores, order, axis=1), order


class Best:
    """The k best (score, id) of each key over all blocks of a task, equal scores by id, nulls last."""

    def __init__(self, keys: int, k: int) -> None:
        self.score, self.id = np.zeros((keys, k), dtype=np.int64), np.zeros((keys, k), dtype=np.int64)
        self.lost, self.none = np.zeros((keys, k), dtype=bool), np.ones((keys, k), dtype=bool)

    def add(self, keys: np.ndarray, score: np.ndarray, ids: np.ndarray, lost: np.ndarray, none: np.ndarray) -> None:
        """Rows of k more for some keys, those of `none` being no rows."""
        k = self.score.shape[1]
        every = [np.concatenate([own[keys], new], axis=1) for own, new in ((self.score, score), (self.id, ids), (self.lost, lost), (self.none, none))]
        order = np.lexsort((every[1], every[2], -every[0], every[3]), axis=1)[:, :k]
        for own, new in zip((self.score, self.id, self.lost, self.none), every):
            own[keys] = np.take_along_axis(new, order, axis=1)


def first_where(fits: Callable[[np.ndarray, np.ndarray], np.ndarray], order: np.ndarray, anchor: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, in each anchor's order from `start` on, of the first k rows that fit; a row of n copies counts n times.

    fits(key, place) gives the copies that count of rows in the order, 0 for none, -1 where reading may
    stop. Looks at some rows of all keys, then at four times as many of those that still lack rows.
    """
    size = order.shape[1]
    out, lack = np.zeros((len(start), k), dtype=np.int64), np.full(len(start), k)
    open_, at, wide = np.arange(len(start)), start.copy(), 64
    while len(open_):
        step = max(1, (1 << 20) // wide)
        stay = []
        for part in (open_[i : i + step] for i in range(0, len(open_), step)):
            place = at[part][:, None] + np.arange(wide)
            there = place < size
            n = fits(part[:, None], np.minimum(place, size - 1))
            stop = ~there | (n < 0)
            n = np.where(np.logical_or.accumulate(stop, axis=1), 0, np.minimum(n, k))
            total = np.cumsum(n, axis=1)
            for j in range(k):  # the j-th row still to be found
                hit = (total > j).argmax(axis=1)
                got = (total[:, -1] > j) & (lack[part] > j)
                out[part[got], k - lack[part[got]] + j] = np.take_along_axis(place, hit[:, None], axis=1)[got, 0]
            lack[part] -= np.minimum(lack[part], total[:, -1])
            stay.append(part[(lack[part] > 0) & ~stop[:, -1]])
        open_ = np.concatenate(stay)
        at[open_] += wide
        wide = min(size, wide * 4)
    none = np.arange(k)[None, :] >= (k - lack)[:, None]
    return order[anchor[:, None], out], none


def emitted(block: int, best: Best, keys: int) -> Iterator[pa.RecordBatch]:
    """What a task found: (block, anchor, place, score, id)."""
    at, j = np.nonzero(~best.none)
    columns = [np.full(len(at), block), at // keys, at % keys, best.score[at, j]]
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(best.id[at, j], pa.int64(), mask=best.lost[at, j])], ["block", "anchor", "place", "score", "id"])


_SHAPE = "block long, anchor long, place long, score long, id long"


def positives(rows: DataFrame, block: int, shared: Any, k: int) -> DataFrame:
    """The k first rows of an anchor's own label, itself left out, as each task knows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        best = Best(every["count"], k)
        for wide, b in blocks(batches):
            if wide not in every["parts"]:
                continue
            own, number = every["parts"][wide]
            for at in range(0, len(own.ids), ANCHORS):
                v, labels, ids = own.vectors[at : at + ANCHORS], own.labels[at : at + ANCHORS], own.ids[at : at + ANCHORS]
                scores, order = scores_in_order(v, b.vectors)

                def fits(a: np.ndarray, place: np.ndarray) -> np.ndarray:
                    row = order[a, place]
                    n = np.where(b.labels[row] == labels[a], b.copies[row], 0)
                    self_ = (n > 0) & (b.ids[row] == ids[a]) & ~b.lost[row]
                    if self_.any():  # one copy of the anchor is the anchor; a row of its id may have another vector
                        i, j = np.nonzero(self_)
                        same = (b.vectors[row[i, j]] == v[np.broadcast_to(a, row.shape)[i, j]]).all(axis=1)
                        n[i[same], j[same]] -= 1
                    return n

                every_anchor = np.arange(len(v))
                row, none = first_where(fits, order, every_anchor, np.zeros(len(v), dtype=np.int64), k)
                score = np.einsum("ad,akd->ak", v, b.vectors[row])
                best.add(number[at : at + ANCHORS], score, b.ids[row], b.lost[row], none)
        yield from emitted(block, best, 1)

    return rows.mapInArrow(run, _SHAPE)


def negatives(rows: DataFrame, block: int, shared: Any, limits: Any, k: int, low: int) -> DataFrame:
    """For every positive of an anchor, the k first rows of other labels that score between low percent of it and all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, (known, limit) = shared.value, limits.value
        each = limit.shape[1]
        best = Best(every["count"] * each, k)
        for wide, b in blocks(batches):
            if wide not in every["parts"]:
                continue
            own, number = every["parts"][wide]
            for at in range(0, len(own.ids), ANCHORS):
                v, labels, who = own.vectors[at : at + ANCHORS], own.labels[at : at + ANCHORS], number[at : at + ANCHORS]
                scores, order = scores_in_order(v, b.vectors)
                anchor, place = np.nonzero(known[who])
                most = limit[who][anchor, place]
                start = np.array([np.searchsorted(-scores[a], -m) for a, m in zip(anchor, most)], dtype=np.int64)

                def fits(key: np.ndarray, spot: np.ndarray) -> np.ndarray:
                    a = anchor[key]
                    row = order[a, spot]
                    n = np.where(b.labels[row] != labels[a], b.copies[row], 0)
                    # 100 * score >= low * most, without leaving a long: score >= ceil(low * most / 100)
                    return np.where(scores[a, spot] >= least[key], n, -1)

                least = np.array([-(-low * int(m) // 100) for m in most], dtype=np.int64)
                row, none = first_where(fits, order, anchor, start, k)
                score = np.einsum("ad,akd->ak", v[anchor], b.vectors[row])
                best.add(who[anchor] * each + place, score, b.ids[row], b.lost[row], none)
        yield from emitted(block, best, each)

    return rows.mapInArrow(run, _SHAPE)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each (block, anchor, place), numbered from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("block", "anchor", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor is a condition on `id`.

    Rows with a null label, a null vector, or a null or non-finite component take no part; a null id
    does, and comes last in a tie. Equal rows (id, label, integer components) are worked on once and
    count each: an anchor that is there twice has its copy among its others, and its rows come twice.
    Vectors are compared with those of their own length. Components beyond 2^25 are held there.
    Columns besides the three named are ignored. An empty table, or one without anchors, gives an empty
    result. Anchors come in blocks of bounded size, each of which reads the rows twice.
    """
    spark = rows.sparkSession
    df = renamed(rows, id=id_col, vec=vector_col, label=label_col).where(F.col("label").isNotNull() & sound(F.col("vec")))
    whole = df.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), integers(F.col("vec"), scale).alias("vec"))
    before = stored()
    kept = store(whole.groupBy("id", "label", "vec").agg(F.count("*").alias("copies")), "entries")
    asked = kept.where(is_anchor)
    size, n, most = asked.agg(F.coalesce(F.sum(8 * F.size("vec") + 64), F.lit(0)), F.count("*"), F.coalesce(F.max("copies"), F.lit(0))).first()
    count = max(1, -(-size // ANCHOR_BYTES))
    found, close = [], []
    for block in range(count if n else 0):
        own = asked.where(F.pmod(F.xxhash64("id", "label", "vec"), F.lit(count)) == block).toArrow()
        parts, start, names = {}, 0, []
        for wide, part in by_width(own):
            e = Entries(part, wide)
            parts[wide] = e, np.arange(start, start + len(e.ids))
            names += [(block, start + k, int(i), int(c)) for k, (i, c) in enumerate(zip(e.ids, e.copies))]
            start += len(e.ids)
        shared = spark.sparkContext.broadcast({"parts": parts, "count": start})
        near = store(_first(positives(kept, block, shared, n_positives), n_positives), "positives")
        limit, known = np.zeros((start, n_positives), dtype=np.int64), np.zeros((start, n_positives), dtype=bool)
        own = near.select("anchor", "rank", "score").toArrow()  # n_positives for each anchor of the block
        at = own.column("anchor").to_numpy(), own.column("rank").to_numpy() - 1
        limit[at], known[at] = own.column("score").to_numpy(), True
        far = _first(negatives(kept, block, shared, spark.sparkContext.broadcast((known, limit)), n_negatives, low), n_negatives)
        who = spark.createDataFrame(pa.table({name: pa.array([x[k] for x in names], pa.int64()) for k, name in enumerate(("block", "anchor", "anchor_id", "copies"))}))
        close.append(near.select("block", "anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(who, ["block", "anchor"]))
        found.append(store(far.select("block", "anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives"))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    discard(spark, [x for x in stored() if x not in before and "/entries-" in x])
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    pairs, mined = close[0], found[0]
    for c, f in zip(close[1:], found[1:]):
        pairs, mined = pairs.unionByName(c), mined.unionByName(f)
    out = mined.join(pairs, ["block", "anchor", "place"])
    if most > 1:  # a row for each copy of the anchor, dealt out in runs so that no task makes all of them
        out = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000))))
        out = out.repartition("run", "block", "anchor", "place", "rank")
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000).cast("long"), F.col("copies") - 1000 * F.col("run")))))
    return out.select(*columns)
