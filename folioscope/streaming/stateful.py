"""Streams with state of their own per key (RocksDB state store): decisions in event-time order, and the newest rows of a key.

A processor of events in order buffers a key's rows until the watermark has passed them (a timer wakes it), then takes them in the order of time
and id; rows that come later than the watermark are dropped by Spark, so nothing can precede what was decided. What a key remembers is bounded:
times within the quota's window, one row, or n rows; a key that remembers nothing leaves no state. Stream and batch form have equal results for
events that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .usage import LATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Within it, streams start with the state store that state per key needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class InOrder(StatefulProcessor):
    """Hands a key's rows (at, <fields>), in order, to ``step`` (remembered tuples, rows) -> (remembered tuples, results)."""

    def __init__(self, key: str, fields: list[str], row: str, memory: str, results: list[str], step: Callable):
        self.key, self.fields, self.row, self.memory_type, self.results, self.step = key, fields, row, memory, results, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.memory = handle.getListState("memory", self.memory_type)

    def _wake(self, rows: list[tuple]) -> None:
        """One timer, just after the earliest row."""
        due = min(r[0] for r in rows) // 1000 + 1
        timers = list(self.handle.listTimers())
        for t in timers:
            if t > due:
                self.handle.deleteTimer(t)
        if not timers or min(timers) > due:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for frame in rows for r in frame[["at", *self.fields]].itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            self._wake(new)
        yield pd.DataFrame(columns=[self.key, *self.results])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get())
        rows, later = sorted(r for r in waiting if r[0] <= passed), [r for r in waiting if r[0] > passed]
        memory, found = self.step(list(self.memory.get()), rows)
        self.waiting.put(later) if later else self.waiting.clear()
        self.memory.put(memory) if memory else self.memory.clear()
        if later:
            self._wake(later)
        yield pd.DataFrame([(key[0], *f) for f in found], columns=[self.key, *self.results])


def _ordered(events: DataFrame, key: str, fields: list[str], processor: InOrder, output: str) -> DataFrame:
    rows = events.filter(F.col(key).isNotNull()).withWatermark("created_at", LATE).select(key, "created_at", F.unix_micros("created_at").alias("at"), *fields)
    return rows.groupBy(key).transformWithStateInPandas(processor, output, "append", "eventTime")


def quota_decisions(events: DataFrame, limit: int, seconds: int = 600) -> DataFrame:
    """(user_id, event_id, allowed): refused events do not count against the limit. Only allowed times within the window are remembered."""

    def step(memory: list[tuple], rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        allowed, found = [m[0] for m in memory], []
        for at, event_id in rows:
            allowed = [t for t in allowed if t >= at - seconds * 1_000_000]
            found.append((event_id, len(allowed) < limit))
            if found[-1][1]:
                allowed.append(at)
        return [(t,) for t in allowed], found

    return _ordered(events, "user_id", ["event_id"], InOrder("user_id", ["event_id"], "at long, event_id long", "at long", ["event_id", "allowed"], step), "user_id long, event_id long, allowed boolean")


def visitor_state(events: DataFrame, least_seconds: int = 60) -> DataFrame:
    """(visitor_hash, first_at, last_at, user_id, events), one row whenever a visitor's state has moved on; the one with most events is the latest."""

    def step(memory: list[tuple], rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        state = memory[0] if memory else None
        for at, _, user_id in rows:
            if state is None:
                state = (at, at, user_id, 1)
            else:
                state = (state[0], at if at - state[1] >= least_seconds * 1_000_000 else state[1], user_id, state[3] + 1)
        return ([state], [state]) if state and rows else (memory, [])

    processor = InOrder("visitor_hash", ["event_id", "user"], "at long, event_id long, user string", "first long, last long, user string, events long", ["first_at", "last_at", "user", "events"], step)
    # ids as text: pandas has no whole numbers beside nulls
    rows = events.withColumn("user", F.col("user_id").cast("string"))
    found = _ordered(rows, "visitor_hash", ["event_id", "user"], processor, "visitor_hash string, first_at long, last_at long, user string, events long")
    return found.select("visitor_hash", "first_at", "last_at", F.col("user").cast("long").alias("user_id"), "events")


def status_changes(rows: DataFrame, requested: int = 0) -> DataFrame:
    """(scholar_id, event_id, version, status): what ``operators.usage.status_changes`` passes on, of rows (scholar_id, event_id, version, status, created_at).

    Remembered is what was passed on last.
    """

    def step(memory: list[tuple], rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        last, found = (memory[0] if memory else None), []
        for _, event_id, version, status in rows:
            if version >= requested and (version > requested or status != "ready"):
                if last != (version, status):
                    found.append((event_id, version, status))
                last = (version, status)
        return ([last] if last else []), found

    fields = ["event_id", "version", "status"]
    return _ordered(rows, "scholar_id", fields, InOrder("scholar_id", fields, "at long, event_id long, version int, status string", "version int, status string", fields, step), "scholar_id long, event_id long, version int, status string")


class Newest(StatefulProcessor):
    """Keeps the n newest rows of a key (by time, then id), and gives them anew, with ranks, whenever rows come."""

    def __init__(self, key: str, fields: list[str], row: str, n: int):
        self.key, self.fields, self.row, self.n = key, fields, row, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = [tuple(r) for r in self.rows.get()]
        for frame in rows:
            best += [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in frame[["at", *self.fields]].itertuples(index=False, name=None)]
            best = sorted(set(best), key=lambda r: (-r[0], -r[1]))[: self.n]
        self.rows.put(best)
        yield pd.DataFrame([(key[0], k, *r) for k, r in enumerate(best, 1)], columns=[self.key, "rank", "at", *self.fields])


def latest_n(events: DataFrame, key: str = "scholar_id", n: int = 8) -> DataFrame:
    """(key, rank, at, event_id, event_type): the n newest events of a key, given anew in each batch in which it has rows."""
    fields = ["event_id", "event_type"]
    rows = events.filter(F.col(key).isNotNull()).select(key, F.unix_micros("created_at").alias("at"), *fields)
    return rows.groupBy(key).transformWithStateInPandas(Newest(key, fields, "at long, event_id long, event_type string", n), f"{key} long, rank int, at long, event_id long, event_type string", "update", "none")
