"""Helpers shared by the training-data operators: tables in the shared folder, row checks, graph components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without one gets a temporary folder, which goes when Python ends.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="graphweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        place = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graphweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of the tables that store() made and nobody has discarded.
_stored: list[str] = []


def stored() -> list[str]:
    """Tables made so far; those made from here on come after them."""
    return list(_stored)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables made by store() that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        if path in _stored:
            _stored.remove(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While this lasts, what is run goes to Python in Arrow batches of so many rows: for tables of wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def renamed(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns named, under private names, so that other columns of df can never clash."""
    return df.select(*(F.col(f"`{source}`").alias(target) for target, source in wanted.items()))


def sampled(df: DataFrame, by: Column, total: int, size: int) -> list[Row]:
    """About `size` rows of df, those of the smallest hashes `by`, in the order of the hashes (column gw_hash).

    A hash limit from the known number of rows keeps every task's share in proportion, so that what
    reaches the driver is bounded by `size` and not by the number of tasks. That holds as far as the
    hashes differ: where ids may be repeated or null, `by` must hash something of each row besides.
    """
    top = float(1 << 63)
    limit = -top + 2 * top * min(1.0, 1.5 * size / max(1, total) + 100 / max(1, total))
    rows = df.withColumn("gw_hash", by).where(F.col("gw_hash").cast("double") <= limit).collect()
    return sorted(rows, key=lambda r: r["gw_hash"])[:size]


def row_hash(*columns: str) -> Column:
    """A hash of the columns and of the row's place in its table, so that repeated rows differ; stable over a stored table."""
    return F.xxhash64(*columns, F.monotonically_increasing_id())


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20, trim: bool = True) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` text bytes, so that memory doesn't follow the row count.

    At the end freed memory goes back to the system, that of Arrow alone without `trim`: for tasks that
    follow each other so closely that they would take it again at once.
    """
    for batch in batches:
        values = batch.column(column)
        start, held = 0, 0
        for k, size in enumerate(pc.binary_length(values).fill_null(0).to_pylist()):
            held += size
            if held >= most:
                yield batch.slice(start, k + 1 - start)
                start, held = k + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
    batch = values = None
    give_back(trim)


def give_back(trim: bool) -> None:
    """Returns freed memory to the system at the end of a task, as Python workers live on and their memory counts."""
    pa.default_memory_pool().release_unused()
    if not trim:
        return
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't that of Linux
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b) as (node, component): the smallest node that can be reached.

    Large-star and small-star rounds; every round is one table in the shared folder. Nodes without
    an edge to another node are absent. Minima are pre-aggregated on the map side and a hub's rows
    are split by the adaptive skew join, so no task holds a whole neighbourhood.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        """df as a table, with the number and sum of its rows' hashes, taken while it is written."""
        seen = Observation()
        rows = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")]
        return store(df.observe(seen, *rows), "edges"), (seen.get["n"], seen.get["s"])

    now, state = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        old, seen = stored()[-1:], state
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, state = kept(small.union(low).distinct())
        discard(spark, old)
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError("components did not settle")
