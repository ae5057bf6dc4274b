"""Registered queries of research directions and of the checks of labels, trends and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import rollups as R
from folioscope.operators import topics as P
from folioscope.operators.graph import kept

from .fixtures import oracle, view

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLE[name] = run, oracle(sql)


def _labels(t, w):
    named = lambda df, name, kind, score: df.select("work_id", name.alias("name"), F.lit(kind).alias("kind"), score.cast("double").alias("score"), F.lit(2).alias("level"))
    none = F.lit(None)
    return (
        named(t.filter("is_primary"), F.col("topic"), "primary", F.col("score"))
        .unionByName(named(t, F.col("topic"), "topic", F.col("score")))
        .unionByName(named(w, F.concat(F.lit("Machine learning "), "venue"), "keyword", none))
        .unionByName(named(w.filter("work_id % 2 = 0"), F.lit("data mining"), "concept", none))
        .unionByName(named(w.filter("work_id % 3 = 0"), F.lit("Computer Science"), "concept", none))
    )


def _candidates(s, d):
    works = kept(view(s, d, "works"))
    return P.topic_candidates(works, view(s, d, "authorships"), _labels(kept(view(s, d, "work_topics")), works))


SINGULAR = "array_to_string(list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: case when len(x) > 4 and ends_with(x, 'ies') then x[:-4] || 'y' when len(x) > 4 and ends_with(x, 's') and not ends_with(x, 'ss') then x[:-2] else x end), ' ')"
CANDIDATES = f"""own as (select distinct scholar_id, work_id, coalesce(title, '') as title, publication_year as year, cited_by_count as c from authorships join works using (work_id)),
    wd as (select *, (1 + 0.35::double * greatest(0, year - max(year) over (partition by scholar_id) + 5) / 5::double) * (1 + least(ln(1 + c) / 12, 0.45::double)) as w from own),
    lab as (select work_id, {SINGULAR.format('topic')} as key, 'topic' as source, score * (1.2::double + case when is_primary then 2.2::double else 0 end) as p, true as weighed from work_topics
        union all select work_id, {SINGULAR.format("'machine learning ' || venue")}, 'keyword', 2.4::double * 0.7::double, true from works
        union all select work_id, 'data mining', 'concept', 0.45::double * 0.5::double, false from works where work_id % 2 = 0),
    pts as (select scholar_id, work_id, key, source, case when weighed then p * w else p end as p from wd join lab using (work_id)),
    kw as (select scholar_id, key from pts where source = 'keyword' group by 1, 2 having count(distinct work_id) >= 2),
    tok as (select scholar_id, work_id, regexp_extract_all(lower(title), '[a-z0-9]+') as t from own),
    win as (select distinct scholar_id, work_id, {SINGULAR.format("array_to_string(p, ' ')")} as key from (select scholar_id, work_id, t[i:j] as p from tok, range(1, 5) a(i), range(2, 6) b(j) where j > i and j - i <= 3 and j <= len(t)) where p[1] <> 'new' and p[-1] <> 'new'),
    ph as (select w.* from win w join (select scholar_id, key from win group by 1, 2 having count(*) >= 3) using (scholar_id, key)),
    evy as (select scholar_id, work_id, key, source, p from pts where source <> 'keyword' or (scholar_id, key) in (select (scholar_id, key) from kw)
        union all select scholar_id, work_id, key, 'title_phrase', 2.4::double + 0.5::double * least(4, len(string_split(key, ' '))) from ph),
    cand as (select scholar_id, key, sum(p) * case when key = 'data mining' then 0.28::double when starts_with(key, 'machine learning ') then 0.55::double else 1 end as score, count(distinct work_id) as n_works, array_to_string(list_sort(list(distinct source)), '|') as sources from evy group by 1, 2)"""
_add(
    "F12_topic_candidates",
    lambda s, d: _candidates(s, d).select("scholar_id", "key", F.round("score", 4).alias("score"), F.col("n_works").cast("long").alias("n_works"), F.array_join("sources", "|").alias("sources")),
    f"with {CANDIDATES} select scholar_id, key, round(score, 4) as score, n_works, sources from cand",
)


def _scored_labels(s, d):
    """Candidates of which labels include one another: the words of the work's title, two words and one, and its topic."""
    own = view(s, d, "authorships").select("scholar_id", "work_id").join(view(s, d, "works").filter("title is not null"), "work_id")
    w = F.split(F.lower("title"), " ")
    keys = own.select("scholar_id", "work_id", F.explode(F.array(F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(2))), F.get(w, F.lit(2)))).alias("key"))
    return keys.groupBy("scholar_id", "key").agg((F.count("*") + F.size(F.split(F.first("key"), " ")) * 3).cast("double").alias("score"), F.array_sort(F.collect_set("work_id")).alias("works")).withColumn("n_works", F.size("works"))


#: The choice in SQL, one candidate after the other: a recursive walk along the ranks.
SELECTED = """base as (select scholar_id, unnest([w[2] || ' ' || w[3], w[3]]) as key, work_id from (select distinct scholar_id, work_id, string_split(lower(title), ' ') as w from authorships join works using (work_id) where title is not null)),
    cand as (select scholar_id, key, count(*) + len(string_split(key, ' ')) * 3 as score, list_sort(list(distinct work_id)) as works from base group by 1, 2),
    ranked as (select *, row_number() over (partition by scholar_id order by score desc, len(works) desc, len(string_split(key, ' ')) desc, key) as r from cand),
    walk as (select scholar_id, 0::bigint as r, []::struct(key varchar, works bigint[], score bigint)[] as chosen from (select distinct scholar_id from cand)
        union all select k.scholar_id, k.r, case when len(walk.chosen) >= 10 or len(list_filter(walk.chosen, lambda e: (list_has_all(string_split(e.key, ' '), string_split(k.key, ' ')) or list_has_all(string_split(k.key, ' '), string_split(e.key, ' ')))
                and len(list_intersect(e.works, k.works)) / greatest(1, least(len(e.works), len(k.works)))::double >= 0.7)) > 0 then walk.chosen else list_append(walk.chosen, {'key': k.key, 'works': k.works, 'score': k.score}) end
            from walk join ranked k on k.scholar_id = walk.scholar_id and k.r = walk.r + 1),
    done as (select scholar_id, chosen from walk qualify row_number() over (partition by scholar_id order by r desc) = 1),
    sel as (select scholar_id, i as rank, chosen[i].key as key, chosen[i].works as works, chosen[i].score / list_sum(list_transform(chosen, lambda e: e.score))::double as weight from (select scholar_id, chosen, unnest(range(1, len(chosen) + 1)) as i from done))"""
_add(
    "F13_select_topics",
    lambda s, d: P.select_topics(_scored_labels(s, d)).select("scholar_id", F.col("rank").cast("long").alias("rank"), "key", "weight", F.size("works").cast("long").alias("n_works")),
    f"with recursive {SELECTED} select scholar_id, rank, key, round(weight, 3) as weight, len(works) as n_works from sel",
)
_add(
    "F30_work_analysis_topics",
    lambda s, d: P.work_topics_of(P.select_topics(_scored_labels(s, d))).withColumn("topics", F.array_join("topics", "|")),
    f"with recursive {SELECTED} select scholar_id, work_id, string_agg(key, '|' order by rank) as topics from (select scholar_id, rank, key, unnest(works) as work_id from sel) group by 1, 2",
)


def _proposed(s, d):
    """Three directions of each scholar: a topic, a broad label, and one named like a title; every fifth scholar has one twice."""
    sc = view(s, d, "scholars")
    one = lambda name, source, zh, en: F.struct(name.alias("name"), F.array(source).alias("sources"), F.lit(zh).alias("description_zh"), F.lit(en).alias("description_en"))
    i = F.col("scholar_id")
    rows = F.array(
        one(F.concat(F.lit("Direction "), i.cast("string")), F.when(i % 2 == 0, "known").otherwise("other"), "一二三四五六七八", "twelve letters"),
        one(F.when(i % 3 == 0, "Business").when(i % 3 == 1, "machine learning").otherwise("some field here"), F.lit("known"), "一二三四五六七八", "twelve letters"),
        one(F.when(i % 5 == 0, F.concat(F.lit("direction  "), i.cast("string"))).when(i % 5 == 1, "old red gear").otherwise("nothing alike"), F.lit("known"), "一二三四五六七八", "twelve letters"),
    )
    short = F.array(one(F.lit("only one"), F.lit("known"), "short", "short"))
    labels = sc.select("scholar_id", F.explode(F.when(i % 7 == 6, short).otherwise(rows)).alias("l")).select("scholar_id", "l.*")
    titles = sc.select("scholar_id", F.lit("The Old Red Gears Return").alias("title"))
    return labels, sc.select("scholar_id", F.lit("known").alias("topic")), titles


_add(
    "Q5_validate_labels",
    lambda s, d: P.validate_labels(*_proposed(s, d)).withColumn("issues", F.array_join("issues", "|")),
    """select scholar_id, concat_ws('|', case when scholar_id % 7 <> 6 and scholar_id % 3 < 2 then 'broad_topic_label' end, case when scholar_id % 7 <> 6 and scholar_id % 5 = 0 then 'duplicate_topic_label' end,
        case when scholar_id % 7 <> 6 and scholar_id % 5 = 1 then 'paper_title_as_topic' end, case when scholar_id % 7 = 6 then 'topic_count_out_of_range' end, case when scholar_id % 7 = 6 then 'topic_description_too_short' end,
        case when scholar_id % 7 <> 6 and scholar_id % 3 = 0 then 'topic_name_word_count' end, case when scholar_id % 7 <> 6 and scholar_id % 2 = 1 then 'untraceable_source_topic' end) as issues from scholars""",
)


def _trends(s, d):
    sc, i = view(s, d, "scholars"), F.col("scholar_id")
    rows = kept(R.labels_of(view(s, d, "authorships"), view(s, d, "work_topics")))
    # the least topic with its least work, and the greatest topic
    x = kept(rows.groupBy("scholar_id").agg(F.min(F.struct(F.array_min("topics").alias("topic"), "work_id")).alias("f"), F.max(F.array_max("topics")).alias("last")).select("scholar_id", "f.topic", "last", F.col("f.work_id").alias("cited")))
    own = R.dealt(rows).select("scholar_id", "work_id", F.explode("topics").alias("topic"))
    text = lambda n: F.lit("x" * n)
    claim = lambda topic, kind, works, en: F.struct(topic.alias("topic"), F.lit(kind).alias("class"), works.alias("works"), text(12).alias("text_zh"), en.alias("text_en"))
    none = F.array().cast("array<long>")
    claims = x.select("scholar_id", F.explode(F.array(
        claim(F.col("topic"), "rising", none, text(1)), claim(F.when(i % 2 == 0, F.col("topic")).when(i % 3 == 0, F.lit("?")).otherwise(F.concat("last")), "steady", none, text(1)),
        claim(F.col("topic"), "insight", F.when(i % 5 == 0, none).when(i % 5 == 1, F.array(F.lit(-1).cast("long"))).otherwise(F.array("cited")), F.when(i % 4 == 0, text(19)).when(i % 4 == 1, F.lit("papers grew from 3 to 9 in total")).otherwise(text(20))),
    )).alias("c")).select("scholar_id", "c.*")
    reports = sc.join(x.select("scholar_id"), "scholar_id", "left_semi").select("scholar_id", F.when(i % 6 == 0, text(19)).otherwise(text(20)).alias("summary_zh"), text(30).alias("summary_en"))
    return reports, claims, None, own.select("scholar_id", "topic", "work_id")


_add(
    "Q6_validate_trends",
    lambda s, d: P.validate_trends(*_trends(s, d)).withColumn("issues", F.array_join("issues", "|")),
    """with f as (select scholar_id, min(topic) = max(topic) as single from authorships join work_topics using (work_id) group by 1)
       select scholar_id, concat_ws('|', case when scholar_id % 4 = 1 then 'count_only_trajectory' end, case when scholar_id % 2 = 0 or (scholar_id % 3 <> 0 and single) then 'duplicate_trajectory_classification' end,
        case when scholar_id % 4 = 0 then 'trajectory_insight_too_short' end, case when scholar_id % 6 = 0 then 'trajectory_summary_too_short' end, case when scholar_id % 5 < 2 then 'unknown_trajectory_evidence' end,
        case when scholar_id % 2 = 1 and scholar_id % 3 = 0 then 'unknown_trajectory_topic' end, case when scholar_id % 5 = 1 then 'unrelated_trajectory_evidence' end) as issues from f""",
)


def _reports(s, d):
    i = F.col("scholar_id")
    zh, en = "一二三四五六七八九十" * 6, "word " * 45
    sc = view(s, d, "scholars").select(
        "scholar_id", F.when(i % 4 == 0, F.lit(zh[:-9])).otherwise(F.concat(F.lit(zh), F.when(i % 3 == 0, F.lit("[1]")).otherwise(F.lit("")))).alias("summary_zh"), F.concat(F.lit(en), F.when(i % 5 == 0, F.lit("[1][2] [9]")).when(i % 5 == 1, F.lit("[2]")).otherwise(F.lit(""))).alias("summary_en"),
        F.when(i % 7 == 0, F.array(F.lit("1"), F.lit("2"), F.lit("8"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("declared"),
    )
    return sc, view(s, d, "scholars").select("scholar_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("evidence_id"))


_add(
    "Q7_validate_citation_markers",
    lambda s, d: P.validate_markers(*_reports(s, d)).withColumn("issues", F.array_join("issues", "|")),
    """select scholar_id, concat_ws('|', case when scholar_id % 7 = 0 or scholar_id % 5 = 0 or not (scholar_id % 5 = 1 or (scholar_id % 3 = 0 and scholar_id % 4 <> 0)) then 'invalid_report_citations' end,
        case when scholar_id % 4 = 0 then 'report_too_short' end) as issues from scholars""",
)
