"""Registered queries of baselines, revisions, budgets, progress, comparisons, and of the remaining text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import lookups as L
from folioscope.operators import portraits as P
from folioscope.operators import rollups as R
from folioscope.operators import scoring as S
from folioscope.operators import tracking as K
from folioscope.operators.graph import kept

from . import scoring as C
from .fixtures import oracle, view
from .rollups import BOTH

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = oracle(sql)


def _totals(s, d, where="true"):
    return R.citation_summary(view(s, d, "works").filter(where), view(s, d, "authorships"))


TOTALS = """tot as (select scholar_id, count(*) as papers, cast(sum(cited_by_count) as bigint) as citations, count(*) filter (cited_by_count >= rn) as h_index
    from (select scholar_id, cited_by_count, row_number() over (partition by scholar_id order by cited_by_count desc) as rn from authorships join works using (work_id)) group by 1)"""
PAIRS_OF = lambda s, d: view(s, d, "focus").select(F.col("scholar_id").alias("a"), (F.col("scholar_id") + 1).alias("b"))

_add(
    "S14_mark_seen",
    lambda s, d: K.mark_seen(
        view(s, d, "usage_events").filter("event_type = 'profile_view' and user_id is not null").select("user_id", "scholar_id").distinct().select("user_id", "scholar_id", (F.col("user_id") % 3).alias("seen_version"), F.lit(0).cast("long").alias("seen_papers"), F.lit(0).cast("long").alias("seen_citations")),
        view(s, d, "usage_events").filter("event_type = 'search' and user_id is not null").select("user_id", "scholar_id", (F.col("event_id") % 5).alias("version")),
        _totals(s, d).select("scholar_id", (F.col("scholar_id") % 4).alias("version"), "papers", "citations"),
    ),
    f"""with {TOTALS}, f as (select distinct user_id, scholar_id from usage_events where event_type = 'profile_view' and user_id is not null),
        q as (select user_id, scholar_id, max(event_id % 5) as asked from usage_events where event_type = 'search' and user_id is not null group by 1, 2)
       select f.user_id, f.scholar_id, case when asked is not null and t.scholar_id is not null then greatest(f.user_id % 3, least(asked, t.scholar_id % 4)) else f.user_id % 3 end as seen_version,
        case when t.scholar_id % 4 <= asked then papers else 0 end as seen_papers, case when t.scholar_id % 4 <= asked then citations else 0 end as seen_citations
       from f left join q using (user_id, scholar_id) left join tot t on t.scholar_id = f.scholar_id""",
)
_add(
    "S19_budget_state",
    lambda s, d: K.budget_state(
        view(s, d, "works").select(F.col("work_type").alias("provider"), F.col("work_id").alias("seq"), F.when(F.col("work_id") % 3 == 0, F.col("work_id")).alias("limit_credits"), F.when(F.col("work_id") % 2 == 0, F.col("cited_by_count") * 4).alias("remaining_credits"), F.when(F.col("work_id") % 5 == 0, F.col("publication_date").cast("timestamp")).alias("reset_at")),
        F.lit("1995-06-01").cast("timestamp"),
    ).withColumn("reset_at", F.date_format("reset_at", "yyyy-MM-dd")),
    """with r as (select work_type as provider, work_id as seq, case when work_id % 3 = 0 then work_id end as l, case when work_id % 2 = 0 then cited_by_count * 4 end as m, case when work_id % 5 = 0 then cast(publication_date as timestamp) end as t from works),
        x as (select provider, max_by(l, seq) filter (l is not null) as limit_credits, max_by(m, seq) filter (m is not null) as remaining_credits, max_by(t, seq) filter (t is not null) as reset_at from r group by 1)
       select provider, limit_credits, remaining_credits, strftime(reset_at, '%Y-%m-%d') as reset_at, case when remaining_credits <= 200 and reset_at > timestamp '1995-06-01' then cast(greatest(1, ceil(epoch(reset_at) - epoch(timestamp '1995-06-01'))) as bigint) end as retry_after from x""",
)


def _tokens(s, d, shift):
    scope = R.symmetrise(R.coauthor_pairs(view(s, d, "authorships"))).hint("merge").join(view(s, d, "focus"), "scholar_id", "left_semi").select(F.col("scholar_id").alias("focus_id"), F.col("other_id").alias("scholar_id"))
    own = view(s, d, "focus").select(F.col("scholar_id").alias("focus_id"), "scholar_id")
    states = view(s, d, "scholars").filter("scholar_id % 3 > 0").select("scholar_id", F.lit("ready").alias("status"), (F.col("scholar_id") % 5 + F.when(F.col("scholar_id") == 11, shift).otherwise(0)).alias("version"))
    return K.revision_tokens(scope.unionByName(own), states)


_add(
    "S20_changed_focus",
    lambda s, d: K.changed_focus(_tokens(s, d, 1), _tokens(s, d, 0)),
    "select distinct a.scholar_id as focus_id from authorships a join authorships b on a.work_id = b.work_id where a.scholar_id in (select scholar_id from focus) and b.scholar_id = 11",
)
_add(
    "D12_pick_requester",
    lambda s, d: K.pick_requester(*[view(s, d, "usage_events").filter(f"event_type = '{kind}' and user_id is not null {more}").select("scholar_id", "user_id", F.col("created_at").alias("at")) for kind, more in (("profile_view", "and scholar_id % 2 = 0"), ("page_view", ""))]),
    """with c as (select scholar_id, user_id, created_at, 0 as p from usage_events where event_type = 'profile_view' and user_id is not null and scholar_id % 2 = 0
            union all select scholar_id, user_id, created_at, 1 from usage_events where event_type = 'page_view' and user_id is not null)
       select scholar_id, user_id from c qualify row_number() over (partition by scholar_id order by p, created_at desc, user_id) = 1""",
)
_add(
    "F17_activity_matrix",
    lambda s, d: K.activity_matrix(view(s, d, "works"), view(s, d, "authorships"), view(s, d, "work_topics")),
    """with n as (select scholar_id, topic, publication_year as year, count(*) as papers from authorships join works using (work_id) join work_topics using (work_id) group by 1, 2, 3), l as (select scholar_id, max(year) as last from n group by 1),
        near as (select n.*, last from n join l using (scholar_id) where year > last - 6), b as (select scholar_id, topic, last from near group by 1, 2, 3 qualify row_number() over (partition by scholar_id order by sum(papers) desc, topic) <= 6),
        g as (select scholar_id, topic, cast(unnest(generate_series(last - 5, last)) as int) as year from b) select g.scholar_id, g.topic, g.year, coalesce(papers, 0) as papers from g left join near using (scholar_id, topic, year)""",
)
_add(
    "H17_compare_profiles",
    lambda s, d: K.compare_profiles(PAIRS_OF(s, d), _totals(s, d)),
    f"""with {TOTALS} select f.scholar_id as a, f.scholar_id + 1 as b, x.papers as a_papers, x.citations as a_citations, cast(x.h_index as int) as a_h_index, round(x.citations / x.papers::double, 2) as a_per_paper,
        y.papers as b_papers, y.citations as b_citations, cast(y.h_index as int) as b_h_index, round(y.citations / y.papers::double, 2) as b_per_paper
       from focus f left join tot x on x.scholar_id = f.scholar_id left join tot y on y.scholar_id = f.scholar_id + 1""",
)
_add(
    "H15_compare_scholars",
    lambda s, d: K.compare_dimensions(PAIRS_OF(s, d), kept(C._dimensions(s, d))),
    C.sql(
        f"""with {C.DIMS}, l as (select scholar_id, 'quality' as dimension, quality as i from dims union all select scholar_id, 'continuity', continuity from dims union all select scholar_id, 'impact', impact from dims)
       select f.scholar_id as a, f.scholar_id + 1 as b, x.dimension, x.i as a_index, y.i as b_index, case when x.i - y.i is null then 'insufficient' when abs(x.i - y.i) < 8 then 'close' when x.i > y.i then 'a' else 'b' end as outcome
       from focus f join l x on x.scholar_id = f.scholar_id join l y on y.scholar_id = f.scholar_id + 1 and y.dimension = x.dimension""",
        *C.CORPUS,
    ),
)


def _compared_topics(s, d):
    w, a, t, c = (view(s, d, n) for n in (*C.CORPUS, "work_citations"))
    w, a, t = (kept(x) for x in (w.select("work_id", "publication_year", "cited_by_count"), a, t.select("work_id", "topic")))  # each is read several times
    x = P.compare_topics(PAIRS_OF(s, d), kept(S.topic_profiles(w, a, t)), kept(S.representative_works(w, a, t, c, k=3).select("scholar_id", "rank", "work_id")))
    return x.withColumns({f"{k}_works": F.array_join(F.transform(f"{k}_works", lambda v: v.cast("string")), "|") for k in "ab"})


_add(
    "H15_compare_topics",
    _compared_topics,
    C.sql(
        f"""with {C.IMPACT}, {C.OWN}, {C.FIELD}, {C.LATER}, {C.REP}, pf as (select scholar_id, topic, count(*) as n from ot group by 1, 2), tn as (select scholar_id, sum(n) as n from pf group by 1),
        b3 as (select scholar_id, work_id, row_number() over (partition by scholar_id order by index desc, coalesce(year, 0) desc, work_id) as r from rep qualify r <= 3), ls as (select scholar_id, string_agg(cast(work_id as varchar), '|' order by r) as works from b3 group by 1),
        m as (select x.scholar_id as a, y.scholar_id as b, sum(least(x.n, y.n)) as l from pf x join pf y on y.topic = x.topic and y.scholar_id = x.scholar_id + 1 group by 1, 2)
       select f.scholar_id as a, f.scholar_id + 1 as b, round(coalesce(coalesce(l, 0) / nullif(coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(l, 0), 0)::double, 0), 3) as topic_overlap, p.works as a_works, q.works as b_works
       from focus f left join m on m.a = f.scholar_id left join tn x on x.scholar_id = f.scholar_id left join tn y on y.scholar_id = f.scholar_id + 1 left join ls p on p.scholar_id = f.scholar_id left join ls q on q.scholar_id = f.scholar_id + 1""",
        *C.CORPUS,
    ),
)
_add(
    "H17_compare_recent",
    lambda s, d: P.compare_recent(PAIRS_OF(s, d), R.yearly_trend(view(s, d, "works"), view(s, d, "authorships")), 1996),
    """with r as (select scholar_id, count(*) as papers, cast(sum(cited_by_count) as bigint) as citations, count(distinct publication_year) as years from authorships join works using (work_id) where publication_year >= 1996 group by 1)
       select f.scholar_id as a, f.scholar_id + 1 as b, coalesce(x.papers, 0) as a_recent_papers, coalesce(x.citations, 0) as a_recent_citations, coalesce(x.years, 0) as a_recent_years,
        coalesce(y.papers, 0) as b_recent_papers, coalesce(y.citations, 0) as b_recent_citations, coalesce(y.years, 0) as b_recent_years
       from focus f left join r x on x.scholar_id = f.scholar_id left join r y on y.scholar_id = f.scholar_id + 1""",
)


def _compared_sets(s, d):
    w, a, t, scholars, places = (view(s, d, n) for n in ("works", "authorships", "work_topics", "scholars", "institutions"))
    topics = R.field_topics(w, a, t).select("scholar_id", F.lit("topic").alias("kind"), F.upper("topic").alias("value"))
    people = R.coauthors(w, a, scholars, places).select("scholar_id", F.lit("coauthor").alias("kind"), F.col("name").alias("value"))
    x = P.compare_sets(PAIRS_OF(s, d), kept(topics.unionByName(people)))
    return x.withColumns({c: F.array_join(c, "|") for c in ("shared", "a_only", "b_only")})


_add(
    "H17_compare_sets",
    _compared_sets,
    f"""with {BOTH}, {C.OWN}, {C.FIELD}, n as (select scholar_id, other_id, count(*) as p from both_ways group by 1, 2), c as (select scholar_id, other_id from n qualify row_number() over (partition by scholar_id order by p desc, other_id) <= 30),
        v as (select scholar_id, 'topic' as kind, lower(topic) as value from field union select c.scholar_id, 'coauthor', lower(display_name) from c join scholars s on s.scholar_id = other_id),
        h as (select scholar_id, kind, list_sort(list(value)) as l from v group by 1, 2),
        g as (select f.scholar_id as a, f.scholar_id + 1 as b, k.kind, coalesce(x.l, []) as va, coalesce(y.l, []) as vb from focus f cross join (values ('topic'), ('coauthor')) k(kind) left join h x on x.scholar_id = f.scholar_id and x.kind = k.kind left join h y on y.scholar_id = f.scholar_id + 1 and y.kind = k.kind)
       select a, b, kind, coalesce(array_to_string(list_filter(va, lambda z: list_contains(vb, z)), '|'), '') as shared, coalesce(array_to_string(list_filter(va, lambda z: not list_contains(vb, z)), '|'), '') as a_only,
        coalesce(array_to_string(list_filter(vb, lambda z: not list_contains(va, z)), '|'), '') as b_only from g""".replace("{W}", "works").replace("{A}", "authorships").replace("{T}", "work_topics"),
)


def _candidates(s, d):
    found = R.dealt_coauthors(view(s, d, "authorships")).select("scholar_id", "other_id").distinct().select(F.col("scholar_id").alias("focus_id"), F.col("other_id").alias("candidate_id")).hint("merge").join(view(s, d, "focus").withColumnRenamed("scholar_id", "focus_id"), "focus_id", "left_semi")
    k = F.col("candidate_id") % 5
    return found.withColumn("status", F.when(k == 0, "failed").when(k == 1, "queued").when(k == 2, "updating").otherwise("never")).withColumn("usable", F.col("candidate_id") % 7 < 3)


CANDS = """cand as (select distinct a.scholar_id as focus_id, b.scholar_id as candidate_id, case b.scholar_id % 5 when 0 then 'failed' when 1 then 'queued' when 2 then 'updating' else 'never' end as status, b.scholar_id % 7 < 3 as usable
    from authorships a join authorships b on a.work_id = b.work_id and a.scholar_id <> b.scholar_id where a.scholar_id in (select scholar_id from focus))"""
_add(
    "F29_discovery_progress",
    lambda s, d: K.discovery_progress(_candidates(s, d)),
    f"""with {CANDS} select focus_id, count(*) as discovered, count(*) filter (usable) as ready, count(*) filter (status = 'failed' and not usable) as failed, count(*) filter (status in ('queued', 'updating')) as queued,
        count(*) filter (usable or status in ('queued', 'updating', 'failed')) as attempted, least(20, count(*)) as target,
        case when attempted >= least(20, count(*)) then case when failed > 0 or ready < least(20, count(*)) then 'partial' else 'ready' end when queued > 0 then 'enriching' else 'next_batch' end as final_status from cand group by 1""",
)


def _unsynced(s, d):
    even = F.col("focus_id") % 2 == 0
    failed = even & (F.col("candidate_id") % 50 == 0)
    return _candidates(s, d).select("focus_id", "candidate_id", F.when(failed, "failed").otherwise("never").alias("status"), (even & (F.col("candidate_id") % 50 == 7)).alias("usable"), (F.col("candidate_id") * 37 % 101).alias("discovery_rank"))


_add(
    "F29_next_batch",
    lambda s, d: K.next_batch(_unsynced(s, d)),
    f"""with {CANDS}, c as (select focus_id, candidate_id, focus_id % 2 = 0 and candidate_id % 50 = 0 as failed, focus_id % 2 = 0 and candidate_id % 50 = 7 as usable from cand),
        n as (select focus_id, count(*) filter (failed or usable) as attempted, least(20, count(*)) as target from c group by 1),
        r as (select focus_id, candidate_id, cast(row_number() over (partition by focus_id order by candidate_id * 37 % 101, candidate_id) as int) as place from c where not failed and not usable)
       select focus_id, place, candidate_id from r join n using (focus_id) where attempted < target and place <= least(case when attempted = 0 then 8 else 4 end, target - attempted)""",
)
_add(
    "C6_peer_page",
    lambda s, d: L.peer_page(_candidates(s, d).select("focus_id", "candidate_id", (F.col("candidate_id") * 37 % 101).alias("discovery_rank"), F.col("usable").cast("int").alias("ready")), limit=5, offset=5).select("focus_id", "candidate_id", "place", "next_offset"),
    f"""with {CANDS}, r as (select focus_id, candidate_id, cast(row_number() over (partition by focus_id order by usable::int desc, candidate_id * 37 % 101, candidate_id) as int) as place, count(*) over (partition by focus_id) as total from cand)
       select focus_id, candidate_id, place, cast(case when total > 10 then 10 end as int) as next_offset from r where place > 5 and place <= 10""",
)
_add(
    "C8_rank_search_hits",
    lambda s, d: K.rank_search_hits(view(s, d, "scholars").join(_totals(s, d), "scholar_id").select(F.col("name_key").alias("query"), F.col("scholar_id").alias("id"), F.when(F.col("scholar_id") % 3 > 0, F.col("institution_id")).alias("institution"), "citations", F.col("papers").alias("works")), 3).select("query", "id", "rank"),
    f"""with {TOTALS} select name_key as query, scholar_id as id, cast(row_number() over (partition by name_key order by (scholar_id % 3 > 0)::int desc, citations desc, papers desc, scholar_id) as int) as rank from scholars join tot using (scholar_id) qualify rank <= 3""",
)
_add(
    "G6_relative_position",
    lambda s, d: K.relative_position(view(s, d, "scholars").join(_totals(s, d), "scholar_id").select("scholar_id", "name_key", (F.col("papers") % 7).alias("v")), "name_key", "v").select("scholar_id", F.round("position", 6).alias("position")),
    f"""with {TOTALS}, m as (select scholar_id, name_key, papers % 7 as v from scholars join tot using (scholar_id))
       select scholar_id, round(case when count(*) over (partition by name_key) <= 1 then 0.5 else (rank() over (partition by name_key order by v) - 1 + (count(*) over (partition by name_key, v) - 1) / 2.0) / (count(*) over (partition by name_key) - 1) end, 6)::double as position from m""",
)


def _team_profiles(s, d):
    scholars, w, a, t = (view(s, d, n) for n in ("scholars", "works", "authorships", "work_topics"))
    x = P.team_profiles(K.team_view(scholars, w, a), kept(P.team_topics(scholars, a, t)), scholars.withColumn("graph_ready", F.col("scholar_id") % 7 != 0), t.filter("topic like '%Brand#1'"))
    return x.withColumn("topics", F.array_join(F.transform("topics", lambda r: F.concat_ws(":", r["topic"], r["n"])), "|")).withColumn("ready_share", F.round("ready_share", 6))


_add(
    "F21_team_view",
    _team_profiles,
    """with tm as (select institution_id, count(distinct s.scholar_id) as members, count(distinct work_id) as works, count(distinct publication_year) as active_years from scholars s left join authorships a on a.scholar_id = s.scholar_id left join works using (work_id) group by 1),
        tw as (select distinct institution_id, work_id from scholars join authorships using (scholar_id)), tt as (select institution_id, topic, count(*) as n from tw join work_topics using (work_id) group by 1, 2),
        b as (select *, row_number() over (partition by institution_id order by n desc, topic) as r from tt qualify r <= 6), l as (select institution_id, string_agg(topic || ':' || n, '|' order by r) as topics from b group by 1),
        o as (select institution_id, coalesce(sum(n) filter (topic like '%Brand#1'), 0) / sum(n)::double as share from tt group by 1), y as (select institution_id, count(*) filter (scholar_id % 7 <> 0) / count(*)::double as ready from scholars group by 1),
        z as (select tm.*, topics, round(coalesce(share, 0), 3) as field_overlap, ready, least(1.0::double, members / 4.0::double) * 0.35::double + least(1.0::double, works / 20.0::double) * 0.35::double + ready * 0.3::double as sc
              from tm left join l using (institution_id) left join o using (institution_id) left join y using (institution_id))
       select institution_id, members, works, active_years, topics, field_overlap, round(ready, 6) as ready_share, round(sc, 3) as confidence, case when sc >= 0.78 then 'high' when sc >= 0.55 then 'medium' else 'low' end as level from z""",
)
_add(
    "B12_abstract_from_inverted",
    lambda s, d: view(s, d, "work_topics").groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", F.array(F.col("score").cast("int") * 100 + F.length("topic"), F.lit(1000) + F.length("topic"))))).alias("m")).select("work_id", F.size(F.split(T.abstract_from_inverted(F.col("m")), " ")).cast("long").alias("words")),
    "select work_id, cast(sum(2 * len(string_split(topic, ' '))) as bigint) as words from work_topics group by 1",
)
_add(
    "B11_title_phrases",
    lambda s, d: view(s, d, "works").select(F.explode(T.title_phrases(F.concat("title", F.lit(" for a new method of "), "venue"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")),
    None,
)
_add(
    "B18_title_contains_match",
    lambda s, d: view(s, d, "works").select("work_id", T.title_contains_match(F.concat("title", F.lit(" one two three")), F.concat(F.lit("zero "), "title", F.lit(" One: two three! four"))).alias("match")).groupBy("match").agg(F.count("*").alias("n")),
    "select coalesce(len(string_split(title, ' ')) >= 3, false) as match, count(*) as n from works group by 1",
)
_add(
    "B19_institution_match_score",
    lambda s, d: view(s, d, "institutions").alias("a").join(view(s, d, "institutions").alias("b"), "country_code").select(T.institution_match_score(F.col("a.display_name"), F.col("b.display_name")).alias("score")).groupBy("score").agg(F.count("*").alias("n")),
    """with p as (select replace(lower(a.display_name), '_', ' ') as x, replace(lower(b.display_name), '_', ' ') as y from institutions a join institutions b using (country_code))
       select cast(case when contains(x, y) or contains(y, x) then 2 else 1 end as int) as score, count(*) as n from p group by 1""",
)
_add(
    "B21_band",
    lambda s, d: _totals(s, d).select(S.band((F.col("papers") % 100).cast("double")).alias("band"), T.heat_band(F.col("h_index") / 100).alias("heat")).groupBy("band", "heat").agg(F.count("*").alias("n")),
    f"""with {TOTALS} select case when papers % 100 >= 70 then 'strong' when papers % 100 >= 48 then 'moderate' else 'limited' end as band, cast(case when h_index / 100.0 > 0.78 then 4 when h_index / 100.0 > 0.5 then 3 when h_index / 100.0 > 0.25 then 2 else 1 end as int) as heat, count(*) as n from tot group by 1, 2""",
)
