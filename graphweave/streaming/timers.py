"""The queue as a stream that wakes up by itself: claims that nobody renews are given back by a timer.

State changes come in as they happen. Each key has its state and, while it is claimed, one timer of
processing time in the state store, so a claim is given back though no event comes any more, also
after the stream was stopped and started again. What changes is written to versioned tables batch by
batch; a batch that is given again after a failure is known by its number and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from graphweave.sources.versions import Store, Transaction

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Claims(StatefulProcessor):
    """State of one key: what it is, when that was said, and how many changes there were."""

    def __init__(self, wait_ms: int) -> None:
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, at long, n long")

    def _told(self, key: tuple, state: str, at: int, n: int) -> Iterator[pd.DataFrame]:
        self.held.update((state, at, n))
        yield pd.DataFrame({"key": [key[0]], "state": [state], "at": [pd.Timestamp(at, unit="ms")], "n": [n]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, at, n = self.held.get() if self.held.exists() else ("", -(2**62), 0)
        for part in rows:
            for s, t in sorted(zip(part["state"], part["at"].astype("datetime64[ms]").astype("int64")), key=lambda x: x[1]):
                n += 1
                if t >= at:
                    state, at = s, int(t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == "claimed":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield from self._told(key, state, at, n)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, at, n = self.held.get()
        if state == "claimed":
            yield from self._told(key, "discovered", at + self.wait, n + 1)

    def close(self) -> None:
        pass


def states(events: DataFrame, stale_after: str = "5 minutes") -> DataFrame:
    """(key, state, at, n) of a stream events(key, state, at) whenever a key's state changes or its claim runs out.

    A claim runs out when `stale_after` has passed on the clock since it was last heard of; its row
    then says that it is discovered, at the claim's own time plus that. Of a key's changes the latest
    counts, whatever order they come in. State is one small row and one timer for each key. The
    session needs the RocksDB state store (PROVIDER).
    """
    wait = int(pd.Timedelta(stale_after).total_seconds() * 1000)
    kind = events.schema["key"].dataType.simpleString()
    return events.select("key", "state", "at").groupBy("key").transformWithStateInPandas(
        statefulProcessor=Claims(wait), outputStructType=f"key {kind}, state string, at timestamp, n long", outputMode="Update", timeMode="ProcessingTime",
    )


class StateTable:
    """The current states in versioned tables, and the number of the last batch that is in them, for each stream."""

    def __init__(self, spark: SparkSession, path: str, key: str = "string") -> None:
        self.store = Store(spark, path)

        def make(t: Transaction) -> None:
            if "states" not in t.base.tables:
                t.create("states", ["key"], spark.createDataFrame([], f"key {key}, state string, at timestamp, n long").schema)
                t.create("batches", ["stream"], spark.createDataFrame([], "stream string, batch long").schema)

        self.store.transact(make, "create")

    def read(self) -> DataFrame:
        return self.store.read("states")

    def apply(self, stream: str) -> Callable[[DataFrame, int], None]:
        """What foreachBatch calls: a batch's states in place of the keys' old ones, once."""

        def run(rows: DataFrame, number: int) -> None:
            last = rows.groupBy("key").agg(F.max_by(F.struct("state", "at", "n"), "n").alias("s")).select("key", "s.*")
            spark = self.store.spark

            def change(t: Transaction) -> None:
                seen = t.read("batches").where(F.col("stream") == stream).agg(F.max("batch")).first()[0]
                if seen is not None and seen >= number:
                    return
                t.upsert("states", t.once(last))
                t.upsert("batches", spark.createDataFrame([(stream, number)], "stream string, batch long"))

            self.store.transact(change, f"{stream} {number}")

        return run


def keep(events: DataFrame, table: StateTable, stream: str, checkpoint: str, stale_after: str = "5 minutes", every: str = "10 seconds") -> StreamingQuery:
    """Starts the stream into a table; started again with its name and checkpoint it goes on where it was."""
    writer = states(events, stale_after).writeStream.outputMode("update").foreachBatch(table.apply(stream))
    return writer.option("checkpointLocation", checkpoint).queryName(stream).trigger(processingTime=every).start()
