"""Streams in several batches, stopped and started again, against the batch form over all events that the watermark has passed."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.operators import usage as U
from folioscope.streaming import stateful
from folioscope.streaming import usage as stream

SCHEMA = "event_id long, visitor_hash string, user_id long, event_type string, scholar_id long, created_at timestamp"
START = datetime(2024, 1, 1)


def events():
    """Six hours of events in nine files; times within a file, and by up to eight minutes over files, are in no order."""
    r = random.Random(6)
    rows = []
    for k in range(700):
        at = START + timedelta(seconds=31 * k + r.randint(-200, 200), microseconds=r.randrange(10**6))
        user = r.choice([None, 1, 2, 3, 2**60 + 1])
        rows.append((k, f"v{r.randrange(5)}", user, r.choice(["page_view", "search", "server_error"]), r.randrange(4), at))
    rows[9] = (9, "v0", 1, "search", None, rows[9][5])
    return [rows[k : k + 80] for k in range(0, 700, 80)]


@pytest.fixture()
def folder(spark, tmp_path):
    parts = events()

    def add(first, last):
        for n in range(first, last):
            spark.createDataFrame(parts[n], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{n}")

    add(0, 4)
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    every = spark.createDataFrame([row for p in parts for row in p], SCHEMA)
    passed = every.agg(F.max("created_at")).first()[0] - timedelta(minutes=10)
    return add, read, f"file://{tmp_path}/out", every.filter(F.col("created_at") <= F.lit(passed)), len(parts)


def in_two_runs(spark, folder, result, mode):
    """The first files, then, from the state of that run, the others."""
    add, read, path, closed, n = folder
    with stateful.keyed_state(spark):
        stream.to_table(result(read()), spark, mode, path)
        add(4, n)
        rows = stream.to_table(result(read()), spark, mode, path)
    batches = spark.read.parquet(f"{path}/rows").select("batch").distinct().count()
    assert batches >= 3
    return rows, closed


def test_quota_decisions(spark, folder):
    rows, closed = in_two_runs(spark, folder, lambda e: stateful.quota_decisions(e, 3, 900), "append")
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted((r.user_id, r.event_id, r.allowed) for r in U.quota_decisions(closed, 3, 900).collect())
    assert len({x[2] for x in got}) == 2


def test_visitor_state(spark, folder):
    rows, closed = in_two_runs(spark, folder, stateful.visitor_state, "append")
    got = {r.visitor_hash: max((x.events, x.first_at, x.last_at, x.user_id) for x in rows.collect() if x.visitor_hash == r.visitor_hash) for r in rows.select("visitor_hash").distinct().collect()}
    want = {r.visitor_hash: (r.events, r.first, r.last, r.user_id) for r in U.visitor_state(closed).select("*", F.unix_micros("first_seen").alias("first"), F.unix_micros("last_seen").alias("last")).collect()}
    assert got == want
    walked = {}
    for r in closed.orderBy("created_at", "event_id").collect():
        seen = walked.get(r.visitor_hash)
        walked[r.visitor_hash] = r.created_at if seen is None or r.created_at - seen >= timedelta(minutes=1) else seen
    assert {r.visitor_hash: r.last_seen for r in U.visitor_state(closed).collect()} == walked


def statuses(e):
    return e.select("scholar_id", "event_id", F.hour("created_at").alias("version"), F.when(F.col("event_type") == "search", "ready").otherwise(F.col("event_type")).alias("status"), "created_at")


def test_status_changes(spark, folder):
    rows, closed = in_two_runs(spark, folder, lambda e: stateful.status_changes(statuses(e), 1), "append")
    batch = statuses(closed).filter("scholar_id is not null").withColumns({"updated_at": F.lit(0), "seq": F.struct("created_at", "event_id")})
    want = sorted((r.scholar_id, r.event_id, r.version, r.status) for r in U.status_changes(batch, 1).collect())
    assert sorted(map(tuple, rows.collect())) == want and want


def test_latest_n(spark, folder):
    rows, _ = in_two_runs(spark, folder, lambda e: stateful.latest_n(e, n=5), "update")
    newest = defaultdict(list)
    for p in events():
        for event_id, _, _, kind, scholar, at in p:
            newest[scholar].append((at, event_id, kind))
    want = {(s, k, i, kind) for s, v in newest.items() if s is not None for k, (_, i, kind) in enumerate(sorted(v, reverse=True)[:5], 1)}
    assert {(r.scholar_id, r["rank"], r.event_id, r.event_type) for r in stream.latest_batch(rows, "scholar_id").collect()} == want


def test_users_of_a_window_are_counted_exactly(spark, folder):
    rows, closed = in_two_runs(spark, folder, stream.usage_trend, "append")
    hours = defaultdict(lambda: [0, 0, set()])
    for p in events():
        for _, _, user, kind, _, at in p:
            h = hours[at.replace(minute=0, second=0, microsecond=0)]
            h[0] += kind == "page_view"
            h[1] += kind == "search"
            h[2] |= {user} - {None}
    last = closed.agg(F.max("created_at")).first()[0]
    want = sorted((h, a, b, len(u)) for h, (a, b, u) in hours.items() if h + timedelta(hours=1) <= last)
    assert sorted(map(tuple, rows.collect())) == want and len(want) >= 4


def test_sessions(spark, folder):
    rows, closed = in_two_runs(spark, folder, lambda e: stream.sessions(e, "3 minutes"), "append")
    times = defaultdict(list)
    for p in events():
        for _, visitor, _, _, _, at in p:
            times[visitor].append(at)
    want = set()
    last = closed.agg(F.max("created_at")).first()[0]
    for visitor, v in times.items():
        v.sort()
        begin = n = 0
        for k, at in enumerate(v):
            n += 1
            if k + 1 == len(v) or v[k + 1] >= at + timedelta(minutes=3):
                if at + timedelta(minutes=3) <= last:
                    want.add((visitor, v[begin], at + timedelta(minutes=3), n))
                begin, n = k + 1, 0
    assert set(map(tuple, rows.collect())) == want


def test_registrations_are_throttled(spark):
    rows = [(k, "v", None, "signup", None, START + timedelta(minutes=5 * k)) for k in range(14)] + [(99, "w", None, "signup", None, START)]
    found = U.failure_throttle(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.event_id for r in found.collect()) == [10, 11, 12, 13]
