"""The queue's stream with timers, stopped and started again, into versioned tables."""

from __future__ import annotations

import time
from datetime import datetime

import pytest

from graphweave.streaming import timers

SHAPE = "key string, state string, at timestamp"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timers.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def held(table):
    return {r["key"]: (r["state"], r["n"]) for r in table.read().collect()}


def until(table, *wanted, seconds=120):
    end = time.time() + seconds
    while held(table) not in wanted and time.time() < end:
        time.sleep(0.5)
    assert held(table) in wanted
    return held(table)


def test_a_claim_runs_out_though_the_stream_was_stopped(rocks, tmp_path):
    spark, place = rocks, f"{tmp_path}/events"
    event = lambda *rows: spark.createDataFrame([(k, s, datetime(2024, 1, 1, h)) for k, s, h in rows], SHAPE).coalesce(1).write.mode("append").parquet(place)
    event(("a", "discovered", 1), ("a", "claimed", 2), ("b", "claimed", 2), ("c", "loaded", 3))
    table = timers.StateTable(spark, f"file://{tmp_path}/t")
    start = lambda: timers.keep(spark.readStream.schema(SHAPE).parquet(place), table, "queue", f"{tmp_path}/checkpoint", "20 seconds", "1 second")
    first = start()
    try:
        until(table, {"a": ("claimed", 2), "b": ("claimed", 1), "c": ("loaded", 1)})
    finally:
        first.stop()
    event(("b", "loaded", 4), ("c", "claimed", 1))  # c's is late and changes nothing but the count
    second = start()
    try:
        # b's claim may run out too, where starting again takes long
        end = until(table, *({"a": ("discovered", 3), "b": ("loaded", n), "c": ("loaded", 2)} for n in (2, 3)))
        time.sleep(3)
    finally:
        second.stop()
    assert held(table) == end
    # a batch that comes again
    number = table.store.version().number
    last = table.store.read("batches").first()["batch"]
    table.apply("queue")(spark.createDataFrame([("a", "failed", datetime(2024, 1, 1), 9)], "key string, state string, at timestamp, n long"), last)
    assert held(table)["a"] == ("discovered", 3) and table.store.version().number == number
