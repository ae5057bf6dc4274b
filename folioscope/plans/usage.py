"""Registered queries of usage analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import rollups as R
from folioscope.operators import usage as U

from .fixtures import oracle, view

QUERIES: dict = {}
ORACLE: dict = {}
T = "timestamp '2024-01-30 23:00:00'"


def as_of():
    return F.lit("2024-01-30 23:00:00").cast("timestamp")


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = oracle(sql)


def _events(s, d):
    return view(s, d, "usage_events")


def _text_time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_add(
    "S1_usage_trend",
    lambda s, d: U.usage_trend(_events(s, d), as_of()).select(_text_time("bucket"), "page_views", "searches", "active_users"),
    f"""with g as (select unnest(generate_series(date_trunc('day', {T}) - interval 29 day, date_trunc('day', {T}), interval 1 day)) as bucket),
        p as (select date_trunc('day', created_at) as bucket, count(*) filter (event_type = 'page_view') as page_views, count(*) filter (event_type = 'search') as searches, count(distinct user_id) as active_users
              from usage_events where created_at <= {T} group by 1)
       select strftime(bucket, '%Y-%m-%d %H:%M:%S') as bucket, coalesce(page_views, 0) as page_views, coalesce(searches, 0) as searches, coalesce(active_users, 0) as active_users from g left join p using (bucket)""",
)
_add(
    "D13_events_to_buckets",
    lambda s, d: U.usage_trend(_events(s, d), as_of(), "hour", 48).select(_text_time("bucket"), "page_views", "searches", "active_users"),
    f"""with g as (select unnest(generate_series({T} - interval 47 hour, {T}, interval 1 hour)) as bucket)
       select strftime(bucket, '%Y-%m-%d %H:%M:%S') as bucket, count(*) filter (event_type = 'page_view') as page_views, count(*) filter (event_type = 'search') as searches, count(distinct user_id) as active_users
       from g left join usage_events on created_at >= bucket and created_at < bucket + interval 1 hour and created_at <= {T} group by 1""",
)
_add(
    "S2_usage_summary",
    lambda s, d: U.usage_summary(_events(s, d), as_of(), online_minutes=60),
    f"""select count(distinct user_id) filter (created_at >= {T} - interval 60 minute) as online_users, count(distinct visitor_hash) filter (created_at >= {T} - interval 60 minute and user_id is null) as online_anonymous,
        count(*) filter (created_at >= date_trunc('day', {T}) and event_type = 'page_view') as today_page_views, count(distinct user_id) filter (created_at >= date_trunc('day', {T})) as today_active_users,
        count(*) filter (created_at >= {T} - interval 7 day and event_type = 'search') as searches, count(*) filter (created_at >= {T} - interval 7 day and event_type = 'profile_view') as profile_views from usage_events""",
)
_add(
    "S3_popular_entities",
    lambda s, d: U.popular_entities(_events(s, d), as_of()),
    f"select scholar_id, count(*) as views from usage_events where event_type = 'profile_view' and created_at >= {T} - interval 7 day and scholar_id is not null group by 1 order by 2 desc, 1 limit 8",
)
_add(
    "S4_anomaly_counts",
    lambda s, d: U.anomaly_counts(_events(s, d), as_of(), ["rate_limit", "source_failure", "job_failure", "server_error"]),
    f"select event_type, count(*) as n from usage_events where event_type in ('rate_limit', 'source_failure', 'job_failure', 'server_error') and created_at >= {T} - interval 7 day group by 1",
)
_add(
    "S5_recent_feed",
    lambda s, d: U.recent_feed(_events(s, d), ["page_view", "search", "profile_view"]),
    "select event_id, event_type, user_id, scholar_id, upper(visitor_hash[1:6]) as visitor from usage_events where event_type in ('page_view', 'search', 'profile_view') order by created_at desc, event_id desc limit 50",
)
#: The walk over a visitor's events: seen moves on by a minute or more only.
VISITS = """e as (select visitor_hash, epoch_us(created_at) as t, row_number() over (partition by visitor_hash order by created_at, event_id) as rn from usage_events),
    walk as (select visitor_hash, rn, t as seen from e where rn = 1 union all select e.visitor_hash, e.rn, case when e.t - w.seen >= 60000000 then e.t else w.seen end from walk w join e on e.visitor_hash = w.visitor_hash and e.rn = w.rn + 1)"""
_add(
    "S6_visitor_state",
    lambda s, d: U.visitor_state(_events(s, d)).select("visitor_hash", _text_time("first_seen"), _text_time("last_seen"), "user_id", "events"),
    f"""with recursive {VISITS}
       select visitor_hash, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as first_seen, any_value(last_seen) as last_seen, last(user_id order by created_at, event_id) as user_id, count(*) as events
       from usage_events join (select visitor_hash, strftime(make_timestamp(max(seen)), '%Y-%m-%d %H:%M:%S') as last_seen from walk group by 1) using (visitor_hash) group by 1""",
)
NEAR = f"near as (select visitor_hash, count(*) as activity_count, last(event_type order by created_at, event_id) as last_activity, last(user_id order by created_at, event_id) as user_id from usage_events where created_at >= {T} - interval 120 minute group by 1)"
_add("D15_active_session_activity", lambda s, d: U.session_activity(_events(s, d), as_of(), 120), f"with {NEAR} select * from near")
_add(
    "S7_online_sessions",
    lambda s, d: U.online_sessions(_events(s, d), as_of(), 120),
    f"with {NEAR} select coalesce('user:' || user_id, 'visitor:' || visitor_hash) as who, count(*) as sessions, cast(sum(activity_count) as bigint) as activity_count from near group by 1",
)
_add(
    "S8_quota_window",
    lambda s, d: U.window_counts(_events(s, d), "user_id", 7200).select("event_id", "in_window"),
    "select event_id, count(*) over (partition by user_id order by epoch_us(created_at) range between 7200000000 preceding and current row) as in_window from usage_events where user_id is not null",
)
# the exact decisions are sequential: the oracle walks each user's events
_add(
    "S8_quota_decisions",
    lambda s, d: U.quota_decisions(_events(s, d), 2, 86400),
    """with recursive e as (select event_id, user_id, epoch_us(created_at) as t_us, row_number() over (partition by user_id order by epoch_us(created_at), event_id) as rn from usage_events where user_id is not null),
        walk as (select event_id, user_id, rn, true as allowed, [t_us] as kept from e where rn = 1
            union all select e.event_id, e.user_id, e.rn, len(list_filter(w.kept, lambda t: t >= e.t_us - 86400000000)) < 2,
                case when len(list_filter(w.kept, lambda t: t >= e.t_us - 86400000000)) < 2 then list_append(list_filter(w.kept, lambda t: t >= e.t_us - 86400000000), e.t_us) else list_filter(w.kept, lambda t: t >= e.t_us - 86400000000) end
            from walk w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
       select event_id, user_id, allowed from walk""",
)
_add(
    "S9_failure_throttle",
    lambda s, d: U.failure_throttle(_events(s, d), 3, 4, 86400, 2, 86400),
    """with f as (select * from usage_events where event_type = 'server_error'),
        u as (select event_id, count(*) over (partition by user_id order by epoch_us(created_at) range between 86400000000 preceding and current row) as n from f where user_id is not null),
        v as (select event_id, count(*) over (partition by visitor_hash order by epoch_us(created_at) range between 86400000000 preceding and current row) as n from f)
       ,g as (select event_id, count(*) over (partition by visitor_hash order by epoch_us(created_at) range between 86400000000 preceding and current row) as n from usage_events where event_type = 'signup')
       select event_id from u where n >= 3 union select event_id from v where n >= 4 union select event_id from g where n > 2""",
)
_add("S10_retention", lambda s, d: U.retention(_events(s, d), as_of(), 10).select("event_id", "event_type"), f"select event_id, event_type from usage_events where created_at >= {T} - interval 10 day")
_add(
    "S11_status_changes",
    lambda s, d: U.status_changes(
        view(s, d, "jobs").select("scholar_id", F.year("updated_at").alias("version"), F.when(F.col("status") == "succeeded", "ready").otherwise(F.col("status")).alias("status"), F.month("updated_at").alias("updated_at"), F.struct("updated_at", "job_id").alias("seq")), 1996
    ).select("scholar_id", "version", "status", F.col("updated_at").alias("month"), F.col("seq.job_id").alias("job_id")),
    """with k as (select scholar_id, year(updated_at) as version, case when status = 'succeeded' then 'ready' else status end as status, month(updated_at) as month, updated_at, job_id from jobs),
        f as (select *, lag((version, status, month)) over (partition by scholar_id order by updated_at, job_id) as before from k where version >= 1996 and (version > 1996 or status <> 'ready'))
       select scholar_id, cast(version as int) as version, status, cast(month as int) as month, job_id from f where before is null or before <> (version, status, month)""",
)
_add(
    "S12_latest_n_per_key",
    lambda s, d: U.latest_n(view(s, d, "jobs"), "scholar_id", [F.desc("updated_at"), F.desc("job_id")]).select("scholar_id", "job_id", "status", "rank"),
    "select scholar_id, job_id, status, cast(row_number() over (partition by scholar_id order by updated_at desc, job_id desc) as int) as rank from jobs qualify rank <= 8",
)
FAVS = """favs as (select distinct user_id, scholar_id from usage_events where event_type = 'profile_view' and user_id is not null),
    totals as (select scholar_id, count(*) as papers, sum(cited_by_count) as citations, count(*) filter (publication_year <= 1999) as last_papers, coalesce(sum(cited_by_count) filter (publication_year <= 1999), 0) as last_citations
               from authorships join works using (work_id) group by 1)"""


def _favorites(s, d):
    w, a = view(s, d, "works"), view(s, d, "authorships")
    seen = _events(s, d).filter("event_type = 'profile_view' and user_id is not null").select("user_id", "scholar_id").distinct()
    before = R.citation_summary(w.filter("publication_year <= 1999"), a).select("scholar_id", F.col("papers").alias("last_papers"), F.col("citations").alias("last_citations"))
    return seen.join(before, "scholar_id", "left").na.fill(0), R.citation_summary(w, a)


_add(
    "S13_tracking_deltas",
    lambda s, d: U.tracking_deltas(*_favorites(s, d)),
    f"with {FAVS} select user_id, scholar_id, greatest(0, papers - last_papers) as new_papers, cast(greatest(0, citations - last_citations) as bigint) as new_citations from favs join totals using (scholar_id)",
)
_add(
    "S15_history_rollup",
    lambda s, d: U.history_rollup(_events(s, d)).select("user_id", "scholar_id", "view_count", _text_time("last_viewed_at")),
    "select user_id, scholar_id, count(*) as view_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_viewed_at from usage_events where event_type = 'page_view' and user_id is not null group by 1, 2",
)


def _due(s, d):
    e, jobs = _events(s, d), view(s, d, "jobs")
    seen = e.groupBy("scholar_id").agg(F.max("created_at").alias("last_accessed_at"))
    synced = view(s, d, "scholars").select("scholar_id", F.when(F.col("scholar_id") % 3 > 0, as_of() - F.make_dt_interval((F.col("scholar_id") % 14).cast("int"))).alias("last_synced_at"))
    return U.due_for_refresh(e.filter("event_type = 'signup'").select("scholar_id"), seen, synced, jobs.filter("status = 'pending' and job_id % 9 = 0"), as_of())


_add(
    "S16_due_for_refresh",
    _due,
    f"""with s as (select scholar_id, case when scholar_id % 3 > 0 then {T} - to_days(cast(scholar_id % 14 as int)) end as synced_at, scholar_id in (select scholar_id from usage_events where event_type = 'signup') as tracked,
            (select max(created_at) from usage_events u where u.scholar_id = s.scholar_id) as seen from scholars s),
        r as (select scholar_id, case when tracked and (synced_at is null or synced_at < {T} - interval 1 day) then 'tracked' when seen >= {T} - interval 30 day and (synced_at is null or synced_at < {T} - interval 7 day) then 'recent' end as reason from s)
       select scholar_id, reason from r where reason is not null and scholar_id not in (select scholar_id from jobs where status = 'pending' and job_id % 9 = 0)""",
)
_add(
    "S17_freshness_class",
    lambda s, d: U.freshness(_events(s, d).select(F.col("event_id").alias("key"), "created_at", (F.col("event_id") % 3).alias("version"), (F.col("event_id") % 5).alias("results")), as_of(), 1),
    f"""select event_id as key, case when event_id % 3 <> 1 then 'unsupported' when created_at + case when event_id % 5 = 0 then interval 15 minute else interval 24 hour end >= {T} then 'fresh' else 'stale' end as freshness from usage_events""",
)
_add(
    "S18_feedback_latest",
    lambda s, d: _events(s, d).filter("user_id is not null").groupBy("user_id", "scholar_id").agg(F.max_by("event_type", F.struct("created_at", "event_id")).alias("verdict")).groupBy("scholar_id", "verdict").agg(F.count("*").alias("n")),
    """with l as (select user_id, scholar_id, last(event_type order by created_at, event_id) as verdict from usage_events where user_id is not null group by 1, 2) select scholar_id, verdict, count(*) as n from l group by 1, 2""",
)
_add(
    "S21_users_page",
    lambda s, d: U.users_page(view(s, d, "scholars").select(F.col("scholar_id").alias("user_id"), F.col("display_name").alias("username")), "0001", 5, 0),
    "select scholar_id as user_id, display_name as username, count(*) over () as total from scholars where contains(lower(display_name), '0001') order by username, user_id limit 5",
)
_add(
    "I1_union_status_counts",
    lambda s, d: U.job_counts([view(s, d, "jobs").filter("job_id % 2 = 0"), view(s, d, "jobs").filter("job_id % 2 = 1")], F.lit("1999-01-01").cast("timestamp")),
    "select status, count(*) as n from jobs where status = 'pending' or updated_at >= timestamp '1999-01-01' group by 1",
)
_add(
    "D11_latest_related_row",
    lambda s, d: U.latest_job(view(s, d, "scholars"), view(s, d, "jobs")),
    """with j as (select scholar_id, last(job_id order by updated_at, job_id) as job_id, last(status order by updated_at, job_id) as status from jobs group by 1)
       select s.scholar_id, job_id, case status when 'pending' then 'refreshing' when 'failed' then 'failed' when 'succeeded' then 'idle' else 'none' end as refresh_status from scholars s left join j on s.scholar_id = j.scholar_id""",
)
