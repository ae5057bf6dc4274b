"""Usage analytics over event tables. ``as_of`` is a parameter everywhere (a timestamp literal or column); nothing asks the clock.

events: (event_id, visitor_hash, user_id, event_type, scholar_id, created_at).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rollups import top


def usage_trend(events: DataFrame, as_of: Column, step: str = "day", n: int = 30) -> DataFrame:
    """The last n calendar buckets with page views, searches and distinct users; buckets without events are there with zeros.

    Events meet their bucket by its truncated time (an equi-join), never by a range.
    """
    last = F.date_trunc(step, as_of)
    grid = events.sparkSession.range(1).select(F.explode(F.sequence(last - F.expr(f"interval {n - 1} {step}"), last, F.expr(f"interval 1 {step}"))).alias("bucket"))
    per = (
        events.filter((F.col("created_at") >= last - F.expr(f"interval {n - 1} {step}")) & (F.col("created_at") <= as_of))
        .groupBy(F.date_trunc(step, "created_at").alias("bucket"))
        .agg(F.count_if(F.col("event_type") == "page_view").alias("page_views"), F.count_if(F.col("event_type") == "search").alias("searches"), F.count_distinct("user_id").alias("active_users"))
    )
    return per.join(F.broadcast(grid), "bucket", "right").na.fill(0) if n <= 10_000 else grid.hint("merge").join(per, "bucket", "left").na.fill(0)


def usage_summary(events: DataFrame, as_of: Column, days: int = 7, online_minutes: int = 5) -> DataFrame:
    """One row: who is online, and what happened today and in the range, in one pass."""
    at = F.col("created_at")
    online = at >= as_of - F.expr(f"interval {online_minutes} minutes")
    today, ranged = at >= F.date_trunc("day", as_of), at >= as_of - F.expr(f"interval {days} days")
    kind = lambda name: F.col("event_type") == name
    return events.agg(
        F.count_distinct(F.when(online & F.col("user_id").isNotNull(), F.col("user_id"))).alias("online_users"),
        F.count_distinct(F.when(online & F.col("user_id").isNull(), F.col("visitor_hash"))).alias("online_anonymous"),
        F.count_if(today & kind("page_view")).alias("today_page_views"),
        F.count_distinct(F.when(today, F.col("user_id"))).alias("today_active_users"),
        F.count_if(ranged & kind("search")).alias("searches"),
        F.count_if(ranged & kind("profile_view")).alias("profile_views"),
    )


def popular_entities(events: DataFrame, as_of: Column, days: int = 7, k: int = 8) -> DataFrame:
    seen = events.filter((F.col("event_type") == "profile_view") & (F.col("created_at") >= as_of - F.expr(f"interval {days} days")) & F.col("scholar_id").isNotNull())
    return seen.groupBy("scholar_id").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "scholar_id").limit(k)


def anomaly_counts(events: DataFrame, as_of: Column, kinds: list[str], days: int = 7) -> DataFrame:
    return events.filter(F.col("event_type").isin(kinds) & (F.col("created_at") >= as_of - F.expr(f"interval {days} days"))).groupBy("event_type").agg(F.count("*").alias("n"))


def recent_feed(events: DataFrame, kinds: list[str], k: int = 50) -> DataFrame:
    return events.filter(F.col("event_type").isin(kinds)).orderBy(F.desc("created_at"), F.desc("event_id")).limit(k).select("event_id", "event_type", "user_id", "scholar_id", F.upper(F.substring("visitor_hash", 1, 6)).alias("visitor"))


def visitor_state(events: DataFrame, least_seconds: int = 60) -> DataFrame:
    """First and last activity and latest user of every visitor; the last activity moves on by ``least_seconds`` or more only.

    Behind an empty cell of that length it moves in any case, so every run of cells with events is read in order by itself.
    """
    at = F.struct("created_at", "event_id")
    span = least_seconds * 1_000_000
    rows = events.select("visitor_hash", F.unix_micros("created_at").alias("at")).withColumn("cell", F.expr(f"at div {span}"))
    cells = rows.select("visitor_hash", "cell").distinct()
    cells = cells.withColumn("run", F.col("cell") - F.row_number().over(Window.partitionBy("visitor_hash").orderBy("cell")))
    key = ["visitor_hash", "run"]
    dealt = rows.hint("merge").join(cells, ["visitor_hash", "cell"]).select(*key, "at").repartition(*key).sortWithinPartitions(*key, "at")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last move of every run."""
        before, last, schema = None, None, pa.schema([("visitor_hash", pa.string()), ("last_at", pa.int64())])
        for batch in batches:
            done = []
            for visitor, run, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (visitor, run) != before:
                    if before is not None:
                        done.append((before[0], last))
                    before, last = (visitor, run), t
                elif t - last >= span:
                    last = t
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(schema)], schema=schema)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([before[0]], pa.string()), pa.array([last], pa.int64())], schema=schema)

    moved = dealt.mapInArrow(move, "visitor_hash string, last_at long").groupBy("visitor_hash").agg(F.max("last_at").alias("last_at"))
    sums = events.groupBy("visitor_hash").agg(F.min("created_at").alias("first_seen"), F.max_by("user_id", at).alias("user_id"), F.count("*").alias("events"))
    return sums.join(moved.hint("merge"), "visitor_hash").select("visitor_hash", "first_seen", F.timestamp_micros("last_at").alias("last_seen"), "user_id", "events")


def session_activity(events: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Visitors active in the last minutes, with number and last kind of their events then."""
    near = events.filter(F.col("created_at") >= as_of - F.expr(f"interval {minutes} minutes"))
    return near.groupBy("visitor_hash").agg(F.count("*").alias("activity_count"), F.max_by("event_type", F.struct("created_at", "event_id")).alias("last_activity"), F.max_by("user_id", F.struct("created_at", "event_id")).alias("user_id"))


def online_sessions(events: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Those rolled up per user; anonymous visitors stay single."""
    s = session_activity(events, as_of, minutes)
    who = F.coalesce(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("visitor:"), F.col("visitor_hash")))
    return s.groupBy(who.alias("who")).agg(F.count("*").alias("sessions"), F.sum("activity_count").alias("activity_count"))


def window_counts(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Per event how many of its key's events lie in the ``seconds`` up to it; a null key has none."""
    micros = F.unix_micros("created_at")
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.filter(F.col(key).isNotNull()).withColumn("in_window", F.count("*").over(w))


def failure_throttle(attempts: DataFrame, per_user: int = 5, per_visitor: int = 20, seconds: int = 900, registrations: int = 10, registration_seconds: int = 3600) -> DataFrame:
    """Failed attempts that reach a limit of their user or their visitor, and registrations of a visitor that had its number of them in the time before."""
    failed = attempts.filter(F.col("event_type") == "server_error")
    by_user = window_counts(failed, "user_id", seconds).filter(F.col("in_window") >= per_user).select("event_id")
    by_visitor = window_counts(failed, "visitor_hash", seconds).filter(F.col("in_window") >= per_visitor).select("event_id")
    signed = attempts.filter(F.col("event_type") == "signup")
    registered = window_counts(signed, "visitor_hash", registration_seconds).filter(F.col("in_window") > registrations).select("event_id")
    return by_user.union(by_visitor).union(registered).distinct()


def quota_decisions(events: DataFrame, limit: int, seconds: int = 600) -> DataFrame:
    """(event_id, user_id, allowed): refused events do not count against the limit.

    Whether an event is refused depends on the decisions in the window before it. Time is cut into cells as long as the window; behind
    an empty cell nothing is left in the window, so every run of cells with events is dealt by itself. A run is read in order, and only
    the allowed times within the window, at most ``limit``, are carried on.
    """
    span = seconds * 1_000_000
    rows = events.filter(F.col("user_id").isNotNull()).select("event_id", "user_id", F.unix_micros("created_at").alias("at")).withColumn("cell", F.expr(f"at div {max(span, 1)}"))
    cells = rows.select("user_id", "cell").filter("cell is not null").distinct()
    cells = cells.withColumn("run", F.col("cell") - F.row_number().over(Window.partitionBy("user_id").orderBy("cell")))
    key = ["user_id", "run"]
    dealt = rows.join(cells, ["user_id", "cell"], "left").select("event_id", *key, "at").repartition(*key).sortWithinPartitions(*key, "at", "event_id")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, kept = None, deque()
        for batch in batches:
            allowed = []
            for user, run, at in zip(*(batch.column(c).to_pylist() for c in (*key, "at"))):
                if (user, run) != before:
                    before, kept = (user, run), deque()
                while kept and kept[0] < at - span:
                    kept.popleft()
                allowed.append(len(kept) < limit)
                if allowed[-1] and at is not None:
                    kept.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("user_id"), pa.array(allowed, pa.bool_())], names=["event_id", "user_id", "allowed"])

    return dealt.mapInArrow(decide, dealt.select("event_id", "user_id", F.lit(True).alias("allowed")).schema)


def retention(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return events.filter(F.col("created_at") >= as_of - F.expr(f"interval {days} days"))


def status_changes(rows: DataFrame, requested: int = 0) -> DataFrame:
    """Status rows (scholar_id, version, status, updated_at, seq) to pass on.

    Dropped are older versions than requested, immediate repeats of what was passed on last, and a bare "ready" of the requested version.
    """
    kept = rows.filter((F.col("version") >= requested) & ((F.col("version") > requested) | (F.col("status") != "ready")))
    key = F.struct("version", "status", "updated_at")
    before = F.lag(key).over(Window.partitionBy("scholar_id").orderBy("seq"))
    return kept.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != key)).drop("before")


def latest_n(rows: DataFrame, key: str, order: list[Column], n: int = 8) -> DataFrame:
    return top(rows, [key], order, n)


def latest_job(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every item's newest job and a refresh status derived from it."""
    newest = jobs.groupBy("scholar_id").agg(F.max_by(F.struct("job_id", "status"), F.struct("updated_at", "job_id")).alias("j"))
    status = F.when(F.col("j.status") == "pending", "refreshing").when(F.col("j.status") == "failed", "failed").when(F.col("j.status").isNotNull(), "idle").otherwise("none")
    return items.join(newest, "scholar_id", "left").select("scholar_id", F.col("j.job_id").alias("job_id"), status.alias("refresh_status"))


def history_rollup(events: DataFrame) -> DataFrame:
    """Per user and scholar the number of views and the last one."""
    seen = events.filter((F.col("event_type") == "page_view") & F.col("user_id").isNotNull())
    return seen.groupBy("user_id", "scholar_id").agg(F.count("*").alias("view_count"), F.max("created_at").alias("last_viewed_at"))


def tracking_deltas(favorites: DataFrame, totals: DataFrame) -> DataFrame:
    """New papers and citations since each baseline, never negative. favorites: (user_id, scholar_id, last_papers, last_citations); totals: (scholar_id, papers, citations)."""
    zero = lambda c: F.greatest(F.lit(0), c)
    x = favorites.join(totals, "scholar_id")
    return x.select("user_id", "scholar_id", zero(F.col("papers") - F.col("last_papers")).alias("new_papers"), zero(F.col("citations") - F.col("last_citations")).alias("new_citations"))


def due_for_refresh(tracked: DataFrame, visited: DataFrame, synced: DataFrame, active: DataFrame, as_of: Column) -> DataFrame:
    """(scholar_id, reason): tracked and older than a day, or visited within 30 days and older than 7; none with an active job.

    tracked: (scholar_id), visited: (scholar_id, last_accessed_at), synced: (scholar_id, last_synced_at), active: (scholar_id).
    """
    old = lambda days: F.col("last_synced_at").isNull() | (F.col("last_synced_at") < as_of - F.expr(f"interval {days} days"))
    x = synced.join(tracked.select("scholar_id").distinct().withColumn("tracked", F.lit(True)), "scholar_id", "left").join(visited, "scholar_id", "left")
    reason = F.when(F.col("tracked") & old(1), "tracked").when((F.col("last_accessed_at") >= as_of - F.expr("interval 30 days")) & old(7), "recent")
    return x.withColumn("reason", reason).filter("reason is not null").join(active.select("scholar_id").distinct(), "scholar_id", "left_anti").select("scholar_id", "reason")


def freshness(cache: DataFrame, as_of: Column, version: int, hours: int = 24) -> DataFrame:
    """cache: (key, created_at, version, results): fresh, stale or unsupported; an empty result lives 15 minutes."""
    ttl = F.when(F.col("results") == 0, F.expr("interval 15 minutes")).otherwise(F.expr(f"interval {hours * 60} minutes"))
    return cache.select("key", F.when(F.col("version") != version, "unsupported").when(F.col("created_at") + ttl >= as_of, "fresh").otherwise("stale").alias("freshness"))


def job_counts(tables: list[DataFrame], cutoff: Column) -> DataFrame:
    """Status counts over several job tables: pending always, finished ones since the cutoff."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.filter((F.col("status") == "pending") | (F.col("updated_at") >= cutoff)).groupBy("status").agg(F.count("*").alias("n"))


def users_page(users: DataFrame, q: str, limit: int, offset: int) -> DataFrame:
    """A page of users whose name holds q, with the total; users: (user_id, username)."""
    hit = users.filter(F.contains(F.lower("username"), F.lit(q.lower())))
    total = hit.agg(F.count("*").alias("total"))
    return hit.orderBy("username", "user_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one number
