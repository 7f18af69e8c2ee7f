"""A stored vector index: cells of near vectors in folders of their own, and their centres beside them.

Building takes centres from a bounded sample by spherical k-means, and deals every vector to the cell
of its nearest centre. A search finds the cells of each query on the driver, from centres alone, and
reads the folders of these cells only. How many it reads is calibrated while building; an exact search
goes on to every cell that can still hold something nearer, by the angle between query and centre less
the cell's radius. Rows are added without a rebuild, in one transaction; a search keeps the version
that it began with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators import vector
from graphweave.schema import top
from graphweave.sources.versions import Store, Version

#: Cells of an index, whose centres a search reads whole, and rows and bytes of the sample that they come from.
MOST_CELLS, SAMPLE, SAMPLE_BYTES = 4096, 16_384, 32 << 20
#: Share of a sampled query's ten nearest that the calibrated number of cells holds.
RECALL = 0.98
#: Room for rounding in angles.
SLACK = 1e-6
CELL, ANGLE = "gw_cell", "gw_angle"


@dataclass
class Centres:
    """What a search knows of an index: unit centres, radius of each cell (nothing where it is empty), cells to read.

    The last cell has no centre: it holds zero vectors, which are at distance 1 from everything.
    """

    centres: np.ndarray
    radius: np.ndarray
    probes: int

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[query, cell]: the angle to each centre, and the least angle that anything in the cell can have."""
        to = np.arccos(np.clip(unit @ self.centres.T, -1, 1))
        zero = ~unit.any(axis=1)
        least = np.concatenate([np.maximum(to - self.radius[:-1], 0), np.full((len(unit), 1), np.pi / 2)], axis=1)
        least[zero] = 0  # a zero query is equally far from all
        least[:, np.isnan(self.radius)] = np.inf
        return np.concatenate([to, np.full((len(unit), 1), np.pi / 2)], axis=1), least


def k_means(unit: np.ndarray, cells: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """Unit centres of unit vectors; an empty cell takes the vector that is worst off."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), cells, replace=False)]
    for _ in range(rounds):
        near = unit @ centres.T
        at = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, unit)
        n = np.bincount(at, minlength=cells)
        empty = np.nonzero(n == 0)[0]
        sums[empty] = unit[np.argsort(near.max(axis=1))[: len(empty)]]
        centres = vector.unit_rows(sums)
    return centres


def calibrated(unit: np.ndarray, centres: np.ndarray, k: int = 10, queries: int = 256, aim: float = RECALL) -> int:
    """Cells to read so that on average a share `aim` of the k nearest sampled vectors is among them."""
    mine = np.arange(0, len(unit), max(1, len(unit) // queries))
    own, k = unit[mine], min(k, len(unit) - 1)
    if k < 1:
        return 1
    close = own @ unit.T
    close[np.arange(len(mine)), mine] = -2  # a query is not its own neighbour
    near = np.argpartition(-close, k - 1, axis=1)[:, :k]
    cell = (unit @ centres.T).argmax(axis=1)
    order = np.argsort(-(own @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))) - 1)]) + 1


class VectorIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path, buckets=1)

    @classmethod
    def build(cls, items: DataFrame, path: str, key: str, cells: int | None = None, seed: int = 0) -> VectorIndex:
        """An index of items(key, embedding, ...), which keeps all their columns.

        Rows without a vector are left out; vectors of differing lengths or with null or non-finite
        components are an error. By default there are as many cells as the square root of the rows.
        """
        spark = items.sparkSession
        there = items.where("embedding is not null").withColumn("embedding", F.col("embedding").cast("array<double>"))
        n, wide, least = there.agg(F.count("*"), F.max(F.size("embedding")), F.min(F.size("embedding"))).first()
        if wide != least:
            raise ValueError(f"vectors have between {least} and {wide} components")
        rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, wide or 1))))
        some = there.select("embedding", F.xxhash64(key, F.lit(seed)).alias("h")).orderBy("h").limit(rows).select("embedding").toArrow()
        unit = _units(some.column("embedding").combine_chunks(), wide) if n else np.zeros((0, 1))
        unit = unit[unit.any(axis=1)]
        cells = max(1, min(MOST_CELLS, int(np.sqrt(n)) if cells is None else cells, len(unit)))
        centres = k_means(unit, cells, seed) if len(unit) else np.zeros((1, wide or 1))
        index = cls(spark, path)
        dealt = index._dealt(there, centres)
        about = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        probes = spark.createDataFrame([(calibrated(unit, centres) if len(unit) else 1, key)], "probes int, key string")

        def make(t) -> None:
            t.create("centres", ["cell"], about)
            t.create("about", ["key"], probes)
            t.create("vectors", [CELL], dealt, len(centres) + 1)
            t.create("extent", ["cell"], _extent(dealt))

        index.store.transact(make, "build")
        return index

    def append(self, items: DataFrame) -> None:
        """More rows, in the cells that there are; both they and what is known of the cells show at once."""
        version = self.store.version()
        known = self._centres(version)
        there = items.where("embedding is not null").withColumn("embedding", F.col("embedding").cast("array<double>"))
        wide = known.centres.shape[1]
        if odd := there.where(F.size("embedding") != wide).count():
            raise ValueError(f"{odd} vectors don't have {wide} components")
        dealt = self._dealt(there, known.centres)

        def add(t) -> None:
            t.append("vectors", dealt)
            t.append("extent", _extent(dealt))

        self.store.transact(add, "append")

    def compact(self) -> None:
        """Each cell's folders as one, and one row of extent for each cell."""

        def run(t) -> None:
            t.replace("vectors", t.read("vectors"))
            t.replace("extent", t.read("extent").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")))

        self.store.transact(run, "compact")

    def _dealt(self, items: DataFrame, centres: np.ndarray) -> DataFrame:
        """items with their cell and the angle to its centre."""
        wide, last, shared = centres.shape[1], len(centres), self.spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _units(batch.column("embedding"), wide)
                near = unit @ shared.value.T
                cell = near.argmax(axis=1) if len(near) else np.zeros(0, dtype=np.int64)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                zero = ~unit.any(axis=1)
                cell, angle = np.where(zero, last, cell), np.where(zero, np.pi / 2, angle)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], [*batch.schema.names, CELL, ANGLE])

        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
        return items.mapInArrow(run, f"{shape}, {CELL} int, {ANGLE} double")

    def _centres(self, version: Version) -> Centres:
        """Centres and extents, as many as there are cells."""
        rows = self.store.rows(version, "centres").orderBy("cell").collect()
        radius = np.full(len(rows) + 1, np.nan)
        for r in self.store.rows(version, "extent").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
            radius[r["cell"]] = r["radius"]
        return Centres(np.array([r["centre"] for r in rows], dtype=np.float64), radius, self.store.rows(version, "about").first()["probes"])

    def reading(self, cells: list[int], version: Version | None = None) -> DataFrame:
        """The rows of some cells, from their folders only."""
        return self.store.rows(version or self.store.version(), "vectors", cells)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(seed, ..., distance, near): the k rows nearest to each query(seed, query_vector) by cosine distance, then key.

        Reads the calibrated number of cells for each query, or `probes`, and more until they hold k
        rows. An exact search reads all cells that may matter once the k-th distance in those is known.
        """
        version = self.store.version()
        known, key = self._centres(version), self.store.rows(version, "about").first()["key"]
        asked = vector.few_queries(queries, known.centres.shape[1])
        if not asked[0]:
            return self._scan(queries, asked, known, np.zeros((0, len(known.radius)), dtype=bool), version, key, k)
        to, least = known.bounds(asked[1])
        sizes = np.zeros(len(known.radius), dtype=np.int64)
        for r in self.store.rows(version, "extent").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            sizes[r["cell"]] = r["n"]
        order = np.argsort(np.where(sizes > 0, to, np.inf), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        first = np.arange(len(sizes))[None, :] < np.maximum(probes or known.probes, 1 + (held < k).sum(axis=1))[:, None]
        read = np.zeros_like(first)
        np.put_along_axis(read, order, first, axis=1)
        read &= sizes > 0
        if exact:
            near = self._scan(queries, asked, known, read, version, key, k)
            last = {r["seed"]: r["distance"] for r in near.groupBy("seed").agg(F.max("distance").alias("distance")).collect()}
            far = np.array([np.arccos(np.clip(1 - last[s], -1, 1)) if s in last else np.inf for s in asked[0]])
            read = (read | (least <= far[:, None] + SLACK)) & (sizes > 0)
        return self._scan(queries, asked, known, read, version, key, k)

    def _scan(self, queries: DataFrame, asked: tuple[list, np.ndarray], known: Centres, read: np.ndarray, version: Version, key: str, k: int) -> DataFrame:
        """The k nearest of each query among the rows of the cells that it reads."""
        cells = np.nonzero(read.any(axis=0))[0].tolist()
        rows = self.reading(cells, version).drop(ANGLE)
        return vector.scan(queries, asked, rows, key, k, cell=(CELL, {c: np.nonzero(read[:, c])[0] for c in cells}))


def _units(column: pa.Array, wide: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide or 1)
    if not np.isfinite(v).all():
        raise ValueError("vectors must not hold null or non-finite components")
    return vector.unit_rows(v)


def _extent(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy(F.col(CELL).alias("cell")).agg(F.count("*").alias("n"), F.max(ANGLE).alias("radius"))
