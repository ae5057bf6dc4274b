"""Registered queries of the per-scholar aggregations, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import rollups as R

from .fixtures import oracle, view

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str, *views: str, finish=None, **options):
    """Registers operator(views..., **options), brought to plain columns by ``finish``."""

    def register(operator):
        def run(spark, sf_dir):
            df = operator(*[view(spark, sf_dir, v) for v in views], **options)
            return finish(df) if finish else df

        run.__name__ = name
        QUERIES[name], ORACLE[name] = run, oracle(sql)
        return operator

    return register


def joined(*columns: str):
    """Arrays as strings, for results that hold lists."""
    return lambda df: df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c in columns})


WAT = ("works", "authorships", "work_topics")
OWN_TOPICS = """own as (select a.scholar_id, a.work_id, w.publication_year as year, t.topic, w.cited_by_count
    from authorships a join works w on a.work_id = w.work_id join work_topics t on t.work_id = a.work_id)"""
PAIRS = """pairs as (select x.work_id, x.scholar_id as scholar_a, y.scholar_id as scholar_b
    from authorships x join authorships y on x.work_id = y.work_id and x.scholar_id < y.scholar_id)"""
BOTH = f"""{PAIRS}, both_ways as (select scholar_a as scholar_id, scholar_b as other_id, work_id from pairs union all select scholar_b, scholar_a, work_id from pairs)"""

query(
    "F1_citation_summary",
    """with ranked as (select scholar_id, cited_by_count as c, row_number() over (partition by scholar_id order by cited_by_count desc) as rn
        from authorships join works using (work_id))
       select scholar_id, count(*) as papers, cast(sum(c) as bigint) as citations, cast(count(*) filter (c >= rn) as int) as h_index from ranked group by scholar_id""",
    "works", "authorships",
)(R.citation_summary)
query(
    "F2_yearly_trend",
    """select scholar_id, publication_year as year, count(*) as papers, cast(sum(cited_by_count) as bigint) as citations
       from authorships join works using (work_id) where publication_year is not null group by 1, 2""",
    "works", "authorships",
)(R.yearly_trend)
query(
    "F3_coauthors",
    f"""with {BOTH}, n as (select scholar_id, other_id, count(*) as papers, string_agg(cast(work_id as varchar), '|' order by work_id) as works from both_ways group by 1, 2),
        r as (select *, cast(row_number() over (partition by scholar_id order by papers desc, other_id) as int) as rank from n)
       select r.scholar_id, rank, other_id, papers, s.display_name as name, i.display_name as institution, works
       from r left join scholars s on s.scholar_id = other_id left join institutions i on i.institution_id = s.institution_id where rank <= 30""",
    "works", "authorships", "scholars", "institutions", finish=joined("works"),
)(R.coauthors)
query(
    "F4_collaborations",
    f"""with {PAIRS} select scholar_a, scholar_b, min(publication_year) as first_year, max(publication_year) as last_year, count(*) as works_count,
        string_agg(distinct cast(publication_year as varchar), '|' order by cast(publication_year as varchar)) as years,
        array_to_string(list_transform(list_sort(list(work_id)), lambda x: cast(x as varchar)), '|') as works
       from pairs join works using (work_id) group by 1, 2""",
    "works", "authorships", finish=joined("years", "works"),
)(R.collaborations)
query(
    "F5_scholar_topics",
    f"""with {OWN_TOPICS} select scholar_id, topic, min(year) as first_year, max(year) as last_year, count(distinct work_id) as works_count,
        string_agg(distinct cast(year as varchar), '|' order by cast(year as varchar)) as years from own group by 1, 2""",
    *WAT, finish=joined("years"),
)(R.scholar_topics)
query(
    "F6_topic_year_series",
    f"""with {OWN_TOPICS}, n as (select scholar_id, topic, year, count(*) as papers from own group by 1, 2, 3)
       select scholar_id, topic, string_agg(cast(year as varchar) || ':' || cast(papers as varchar), '|' order by year) as series from n group by 1, 2""",
    *WAT, finish=lambda df: df.withColumn("series", F.array_join(F.transform("series", lambda x: F.concat_ws(":", x["year"], x["papers"])), "|")),
)(R.topic_year_series)
query(
    "F7_affiliation_history",
    """with every as (select scholar_id, institution_id, year, false as k from byline_institutions union all select scholar_id, institution_id, null, true from scholars)
       select scholar_id, institution_id, coalesce(string_agg(distinct cast(year as varchar), '|' order by cast(year as varchar) desc), '') as years, bool_or(k) as is_last_known
       from every group by 1, 2""",
    "byline_institutions", "scholars", finish=joined("years"),
)(R.affiliation_history)
query(
    "A12_merge_affiliations",
    """with every as (select scholar_id, institution_id, year, false as k from byline_institutions union all select scholar_id, institution_id, null, true from scholars)
       select scholar_id, institution_id, min(year) as start_year, max(year) as end_year, cast(count(distinct year) as int) as n_years, bool_or(k) as is_current
       from every group by 1, 2""",
    "byline_institutions", "scholars",
)(R.merged_affiliations)
query(
    "F9_primary_affiliation",
    """with y as (select distinct scholar_id, institution_id, year from byline_institutions), m as (select scholar_id, max(year) as newest from y group by 1),
        s as (select y.scholar_id, institution_id, count(*) filter (year > newest - 6) as recent, max(year) as latest, count(*) as n from y join m using (scholar_id) group by 1, 2),
        r as (select s.*, row_number() over (partition by scholar_id order by recent desc, latest desc, n desc, lower(display_name) desc) as rn, max(latest) over (partition by scholar_id) as latest_year
              from s join institutions using (institution_id))
       select scholar_id, institution_id, latest_year from r where rn = 1""",
    "byline_institutions", "institutions",
)(R.primary_affiliation)
query(
    "F11_timeline_events",
    f"""with {BOTH}, {OWN_TOPICS}, place as (select scholar_id, institution_id, min(year) as s, max(year) as e, bool_or(k) as cur from (
            select scholar_id, institution_id, year, false as k from byline_institutions union all select scholar_id, institution_id, null, true from scholars) group by 1, 2)
       select scholar_id, 'paper_published:' || work_id as event_key, 'paper_published' as event_type, publication_year as event_year from authorships join works using (work_id)
       union all select scholar_id, 'topic_started:' || topic, 'topic_started', min(year) from own group by scholar_id, topic
       union all select scholar_id, 'collaboration_started:' || other_id, 'collaboration_started', min(publication_year) from both_ways join works using (work_id) group by scholar_id, other_id
       union all select scholar_id, 'institution_started:' || institution_id, 'institution_started', s from place where s is not null
       union all select scholar_id, 'institution_ended:' || institution_id, 'institution_ended', e from place where e is not null and not cur""",
    *WAT, "byline_institutions", "scholars",
)(R.timeline_events)
query(
    "F14_representative_by_topic",
    f"""with {OWN_TOPICS}, t as (select scholar_id, topic, count(*) as n, count(distinct year) as y from own group by 1, 2),
        s as (select *, n >= 2 or y >= 2 as sus, bool_or(n >= 2 or y >= 2) over (partition by scholar_id) as any_sus from t),
        r as (select *, row_number() over (partition by scholar_id order by (y >= 2)::int desc, n desc, topic) as k from s where sus or not any_sus),
        b as (select own.scholar_id, own.topic, work_id, cited_by_count, cast(row_number() over (partition by own.scholar_id, own.topic order by cited_by_count desc, work_id) as int) as rank
              from own join r on own.scholar_id = r.scholar_id and own.topic = r.topic and k <= 8)
       select * from b where rank <= 3""",
    *WAT,
)(lambda w, a, t: R.representative_by_topic(w, a, t, R.field_topics(w, a, t)))
query(
    "F15_interest_timeline",
    f"""with {OWN_TOPICS}, n as (select scholar_id, topic, year, count(*) as papers from own group by 1, 2, 3),
        r as (select *, cast(row_number() over (partition by scholar_id, year order by papers desc, topic) as int) as rank from n) select * from r where rank <= 5""",
    *WAT,
)(R.interest_timeline)
query(
    "F16_direction_changes",
    f"""with {OWN_TOPICS}, l as (select scholar_id, max(year) as last from own group by 1),
        n as (select own.scholar_id, topic, count(*) filter (year > last - 3) as recent, count(*) filter (year <= last - 3) as earlier
              from own join l using (scholar_id) where year > last - 6 group by 1, 2),
        s as (select *, recent / nullif(sum(recent) over (partition by scholar_id), 0)::double as ns, earlier / nullif(sum(earlier) over (partition by scholar_id), 0)::double as os from n),
        d as (select *, coalesce(ns, 0) as n2, coalesce(os, 0) as o2, coalesce(ns, 0) - coalesce(os, 0) as delta from s),
        c as (select *, case when earlier = 0 and recent > 0 then 'emerging' when delta >= 0.04 or (delta >= 0.02 and n2 >= 1.5 * o2) then 'rising'
                             when delta <= -0.04 or (delta <= -0.02 and o2 >= 1.5 * n2) then 'falling' end as change from d),
        r as (select *, cast(row_number() over (partition by scholar_id order by greatest(recent, earlier) desc, topic) as int) as rank from c where change is not null)
       select scholar_id, rank, topic, change, recent, earlier, round(delta, 6) as delta from r where rank <= 5""",
    *WAT,
)(R.direction_changes)
PHASES = f"""{OWN_TOPICS}, papers_of as (select scholar_id, work_id, publication_year as year, cited_by_count from authorships join works using (work_id)),
    span as (select scholar_id, min(year) as f, max(year) as l, greatest(3, ceil((max(year) - min(year) + 1) / 5.0))::int as width from papers_of group by 1),
    placed as (select p.*, f, l, width, (year - f) // width as phase from papers_of p join span using (scholar_id)),
    sums as (select scholar_id, phase, min(f + phase * width) as start_year, least(min(l), min(f + (phase + 1) * width - 1)) as end_year, count(*) as papers, cast(sum(cited_by_count) as bigint) as citations
             from placed group by 1, 2),
    tn as (select p.scholar_id, phase, topic, count(distinct p.work_id) as n from placed p join work_topics t on t.work_id = p.work_id group by 1, 2, 3),
    best as (select *, row_number() over (partition by scholar_id, phase order by n desc, topic) as rank from tn qualify rank <= 5),
    listed as (select scholar_id, phase, list(topic order by rank) as topics from best group by 1, 2),
    phases as (select s.*, coalesce(topics, []) as topics from sums s left join listed using (scholar_id, phase))"""
query(
    "F18_research_phases",
    f"""with {PHASES} select scholar_id, phase, start_year, end_year, papers, citations, array_to_string(topics, '|') as topics from phases""",
    *WAT, finish=joined("topics"),
)(R.research_phases)
query(
    "F19_phase_transitions",
    f"""with {PHASES}, l as (select scholar_id, phase, topics, lag(phase) over w as from_phase, lag(topics) over w as before from phases window w as (partition by scholar_id order by phase))
       select scholar_id, from_phase, phase as to_phase,
              array_to_string(list_sort(list_filter(topics, lambda x: not list_contains(before, x))), '|') as emerged,
              array_to_string(list_sort(list_filter(topics, lambda x: list_contains(before, x))), '|') as continued,
              array_to_string(list_sort(list_filter(before, lambda x: not list_contains(topics, x))), '|') as faded
       from l where from_phase is not null""",
    *WAT, finish=joined("emerged", "continued", "faded"),
)(lambda w, a, t: R.phase_transitions(R.research_phases(w, a, t)))
query(
    "F23_topic_lineup",
    f"""with {OWN_TOPICS}, m as (select max(year) as as_of from own), t as (select scholar_id, topic, count(*) as n, count(distinct year) as y, count(*) filter (year > as_of - 4) as recent from own, m group by 1, 2),
        a as (select scholar_id, topic, 1 as long_term, 0 as is_recent, row_number() over (partition by scholar_id order by n desc, y desc, topic) as rn from t where n >= 2 or y >= 2),
        b as (select scholar_id, topic, 0 as long_term, 1 as is_recent, row_number() over (partition by scholar_id order by recent desc, n desc, topic) as rn from t where recent > 0)
       select scholar_id, topic, max(long_term) as long_term, max(is_recent) as is_recent from (select * from a union all select * from b) where rn <= 3 group by 1, 2""",
    *WAT,
)(R.topic_lineup)
query(
    "F25_field_topics",
    f"""with {OWN_TOPICS}, t as (select scholar_id, topic, count(distinct work_id) as works_count, cast(count(distinct year) as int) as active_years from own group by 1, 2),
        s as (select *, works_count >= 2 or active_years >= 2 as sus, bool_or(works_count >= 2 or active_years >= 2) over (partition by scholar_id) as any_sus from t),
        r as (select *, cast(row_number() over (partition by scholar_id order by (active_years >= 2)::int desc, works_count desc, topic) as int) as rank from s where sus or not any_sus)
       select scholar_id, rank, topic, works_count, active_years from r where rank <= 8""",
    *WAT,
)(R.field_topics)
query(
    "F26_citation_lineage",
    """with e as (select a.scholar_id, c.citing_work_id, c.cited_work_id, w.publication_year as year from work_citations c join authorships a on a.work_id = c.citing_work_id
            join authorships b on b.work_id = c.cited_work_id and b.scholar_id = a.scholar_id join works w on w.work_id = c.citing_work_id),
        r as (select *, cast(row_number() over (partition by scholar_id order by year desc nulls last, citing_work_id, cited_work_id) as int) as rank from e)
       select scholar_id, rank, citing_work_id, cited_work_id, year from r where rank <= 100""",
    "works", "authorships", "work_citations",
)(R.citation_lineage)
query(
    "D9_coauthor_pairs", f"with {PAIRS} select * from pairs", "authorships",
)(R.coauthor_pairs)
query(
    "D14_symmetrise_edges",
    f"with {BOTH} select scholar_id, other_id, count(*) as works_count from both_ways group by 1, 2",
    "works", "authorships",
)(lambda w, a: R.symmetrise(R.collaborations(w, a).select("scholar_a", "scholar_b", "works_count")))
query(
    "E18_ego_network",
    f"""with {BOTH}, n as (select scholar_id, other_id, count(*) as weight from both_ways group by 1, 2),
        r as (select *, row_number() over (partition by scholar_id order by weight desc, other_id) as rn from n)
       select distinct scholar_id, 'self' as kind, scholar_id as node_id, cast(null as bigint) as weight from authorships
       union all select scholar_id, 'coauthor', other_id, weight from r where rn <= 20""",
    "works", "authorships",
)(R.ego_network)


def _institution_counts(bylines, work_topics):
    hit = work_topics.filter("topic like '%Brand#1'").select("work_id").distinct()
    met = bylines.join(hit, "work_id", "left_semi")
    return met.groupBy("institution_id").agg(F.count_distinct("work_id").alias("historical_works"), F.count_distinct(F.when(F.col("year") >= 1999, F.col("work_id"))).alias("recent_works"))


TOPIC_COUNTS = """hit as (select distinct work_id from work_topics where topic like '%Brand#1'),
    counts as (select scholar_id, count(distinct work_id) as historical_works, count(distinct work_id) filter (publication_year >= 1999) as recent_works
               from authorships join hit using (work_id) join works using (work_id) group by 1)"""
query("A18_grouped_counts", f"with {TOPIC_COUNTS} select * from counts", *WAT)(
    lambda w, a, t: R.grouped_counts(w, t, a, t.select("topic").filter("topic like '%Brand#1'"), 1999)
)
query(
    "F24_discover_candidates",
    f"""with {TOPIC_COUNTS} select *, historical_works + 2 * recent_works as score, row_number() over (order by historical_works + 2 * recent_works desc, scholar_id) as discovery_rank
       from counts where historical_works <= 600 and scholar_id <> 7 qualify discovery_rank <= 60""",
    *WAT,
)(lambda w, a, t: R.discover_candidates(R.grouped_counts(w, t, a, t.select("topic").filter("topic like '%Brand#1'"), 1999), focus=7))
query(
    "F24_discover_institutions",
    """with c as (select institution_id, count(distinct work_id) as historical_works, count(distinct work_id) filter (year >= 1999) as recent_works from byline_institutions
            where work_id in (select work_id from work_topics where topic like '%Brand#1') group by 1),
        r as (select *, historical_works + 2 * recent_works as score, row_number() over (order by historical_works + 2 * recent_works desc, institution_id) as p from c),
        k as (select * exclude (p) from r where p <= 10 or institution_id = 3)
       select *, row_number() over (order by score desc, institution_id) as discovery_rank from k""",
    "byline_institutions", "work_topics",
)(lambda b, t: R.discover_institutions(_institution_counts(b, t), own=3, k=10))
