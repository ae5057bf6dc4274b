"""Registered queries of text and style profiles, evidence, byline statements, lookups and ranked recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators import evidence as V
from folioscope.operators import rollups as R
from folioscope.operators import scoring as S
from folioscope.operators.graph import kept

from . import scoring as C
from .fixtures import oracle, view
from .text import KEYWORDS

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLE[name] = run, oracle(sql)


_add(
    "F8_affiliation_statements",
    lambda s, d: V.affiliation_statements(
        view(s, d, "byline_institutions").join(view(s, d, "institutions"), "institution_id").select("scholar_id", F.col("work_id").alias("seq"), F.concat(F.when(F.col("work_id") % 2 == 0, " Dept  of ").otherwise("Dept of "), F.when(F.col("work_id") % 3 == 0, F.lower("display_name")).otherwise(F.lower("display_name"))).alias("text"), F.when(F.col("work_id") % 17 == 0, 9999).otherwise(F.col("year")).alias("year"))
    ).withColumn("years", F.array_join("years", "|")),
    """with r as (select scholar_id, 'Dept of ' || lower(i.display_name) as text, list_sort(list(distinct year) filter (work_id % 17 <> 0), 'desc') as years from byline_institutions join institutions i using (institution_id) group by 1, 2)
       select scholar_id, cast(row_number() over (partition by scholar_id order by coalesce(years[1], 0) desc, lower(text) desc) as int) as place, text, coalesce(array_to_string(years, '|'), '') as years from r""",
)


def _lookups(s, d):
    w, sc = view(s, d, "works"), view(s, d, "scholars")
    asked = lambda df, kind, c: df.select(F.lit(kind).alias("object_type"), F.col(c).cast("string").alias("object_id"))
    requests = asked(w.filter("work_id % 3 = 0"), "paper", "work_id").unionByName(asked(sc, "author", "scholar_id")).unionByName(asked(w.filter("work_id % 50 = 0"), "institution", "work_id")).unionByName(asked(w, "journal", "work_id")).unionByName(asked(view(s, d, "work_topics").filter("is_primary"), "topic", "topic"))
    named = lambda df, c, *more: df.select(F.col(c).cast("string").alias("object_id"), *more)
    return V.lookup_objects(
        requests, named(sc, "scholar_id", "display_name", "orcid"), named(w, "work_id", F.col("title").alias("display_name"), "publication_year", F.when(F.col("work_id") % 2 == 0, "a").alias("abstract")), named(view(s, d, "institutions"), "institution_id", "display_name", "country_code"),
        view(s, d, "work_topics").select(F.col("topic").alias("object_id"), F.upper("topic").alias("display_name")).distinct(),
    )


_add(
    "C9_lookup_objects",
    _lookups,
    """select 'paper' as object_type, cast(work_id as varchar) as object_id, title as display_name, null as orcid, publication_year, case when work_id % 2 = 0 then 'a' end as abstract, case when work_id % 2 = 0 then '基于摘要' end as abstract_basis_label, null as country_code from works where work_id % 3 = 0
       union all select 'author', cast(scholar_id as varchar), display_name, orcid, null, null, null, null from scholars
       union all select 'institution', cast(institution_id as varchar), display_name, null, null, null, null, country_code from institutions where institution_id in (select work_id from works where work_id % 50 = 0)
       union all select distinct 'topic', topic, upper(topic), null, null, null, null, null from work_topics where is_primary""",
)


def _texts(s, d):
    w = view(s, d, "works").select("work_id", F.col("publication_year").alias("year"), F.lit(None).cast("string").alias("title"), F.col("title").alias("method"), F.col("venue").alias("problem"), "work_type")
    return V.text_profiles(w, view(s, d, "authorships"), KEYWORDS, since=1998)


WORDS = ", ".join(f"('{c}', '{w}')" for c, words in KEYWORDS.items() for w in words)
TEXTS = f"""k(category, word) as (values {WORDS}), hit as (select distinct scholar_id, work_id, category from authorships join works using (work_id) join k on contains(lower(coalesce(title, '') || ' ' || coalesce(venue, '') || ' ' || coalesce(work_type, '')), word)),
    categories as (select scholar_id, category as value, count(*) as n from hit group by 1, 2)"""
_add(
    "G8_text_profiles",
    _texts,
    f"""with {TEXTS}, t as (select scholar_id, 'method' as kind, unnest(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_-]{{2,}}')) as value from authorships join works using (work_id) where publication_year >= 1998
            union select scholar_id, 'problem', unnest(regexp_extract_all(lower(venue), '[a-z0-9][a-z0-9_-]{{2,}}')) from authorships join works using (work_id) where publication_year >= 1998)
       select scholar_id, kind, value, 1::bigint as n from t union all select scholar_id, 'category', value, n from categories""",
)


def _style(s, d):
    continuity = view(s, d, "scholars").select("scholar_id", (F.col("scholar_id") * 7 % 100).cast("double").alias("continuity"))
    return V.style_profile(view(s, d, "works"), view(s, d, "authorships"), view(s, d, "work_topics"), _texts(s, d).filter("kind = 'category'"), continuity)


STYLE = f"""{TEXTS}, sown as (select scholar_id, work_id, title, publication_year, author_count from authorships join works using (work_id)),
        sb as (select scholar_id, count(*) filter (title is not null) as evidence, median(author_count) as team from sown group by 1),
        sl as (select scholar_id, count(*) filter (n >= 3 and y >= 3) as sustained from (select scholar_id, topic, count(*) as n, count(distinct publication_year) as y from sown join work_topics using (work_id) group by 1, 2) group by 1),
        sr as (select scholar_id, count(*) filter (n >= 2) as repeated from (select a.scholar_id, o.scholar_id as other, count(*) as n from authorships a join authorships o on a.work_id = o.work_id and a.scholar_id <> o.scholar_id group by 1, 2) group by 1),
        sc as (select scholar_id, coalesce(sum(n) filter (value = 'method'), 0) as m, coalesce(sum(n) filter (value = 'system'), 0) as s, coalesce(sum(n) filter (value = 'data'), 0) as dt, coalesce(sum(n) filter (value = 'application'), 0) as a from categories group by 1),
        sx as (select sb.*, coalesce(sustained, 0) as sustained, coalesce(repeated, 0) as repeated, coalesce(m, 0) as m, coalesce(s, 0) as s, coalesce(dt, 0) as dt, coalesce(a, 0) as a, {{CONTINUITY}} as cont from sb left join sl using (scholar_id) left join sr using (scholar_id) left join sc using (scholar_id)),
    style as (select scholar_id, evidence, case when evidence >= 3 then case when s + a >= (m + dt) * 1.35 and s + a >= 2 then 'applied' when m + dt >= (s + a) * 1.35 and m + dt >= 2 then 'method' else 'mixed' end end as orientation,
        case when evidence >= 3 then case when cont >= 68 and sustained > 0 then 'sustained' when cont < 45 then 'changing' else 'coexisting' end end as pacing,
        case when evidence >= 3 then case when greatest(m, s, dt, a) < 2 then 'none' when m = greatest(m, s, dt, a) then 'method' when s = greatest(m, s, dt, a) then 'system' when dt = greatest(m, s, dt, a) then 'data' else 'application' end end as work_type,
        case when evidence >= 3 then case when repeated >= 3 then 'several_repeated' when repeated >= 1 then 'stable_core' else 'limited' end end as collaboration, case when evidence >= 3 then round(team, 1) end as typical_team, repeated from sx)"""
_add("H5_style_profile", _style, f"with {STYLE.replace('{CONTINUITY}', 'sb.scholar_id * 7 % 100')} select * from style")


def _whole_dimensions(s, d):
    confidence, quality, continuity, impact = C.index_tables(s, d)
    style = kept(V.style_profile(view(s, d, "works"), view(s, d, "authorships"), view(s, d, "work_topics"), kept(_texts(s, d).filter("kind = 'category'")), continuity))
    h = R.citation_summary(view(s, d, "works"), view(s, d, "authorships"))
    told = F.transform("evidence", lambda r: F.concat(r["dimension"], F.lit("."), r["code"], F.lit("="), F.round(r["value"] * 1000).cast("long").cast("string")))
    return S.scholar_dimensions(confidence, quality, continuity, impact, style, h).withColumn("evidence", F.array_join(told, "|"))


_told = " || '|' || ".join(
    f"'{code}=' || cast(cast(round(round({value}, 3) * 1000) as bigint) as varchar)"
    for code, value in [
        ("quality.representative_signal", "round(g.s, 6)"), ("quality.strong_contribution_share", "round(g.strong, 6)"), ("quality.field_normalized_impact", "round(g.u, 6)"), ("quality.internal_diffusion", "round(g.spread, 6)"),
        ("continuity.sustained_topics", "coalesce(ns, 0)::double"), ("continuity.longest_span", "longest::double"), ("continuity.sustained_share", "round(lasting / t.works::double, 6)"), ("continuity.recent_stability", "round(stab, 6)"),
        ("impact.field_normalized_impact", "round(g.u, 6)"), ("impact.cited_work_share", "round(i.cs, 6)"), ("impact.internal_diffusion", "round(g.spread, 6)"), ("impact.local_h_index", "h::double"),
        ("style.classified_works", "e.evidence::double"), ("style.typical_team_size", "e.typical_team::double"), ("style.repeated_collaborators", "e.repeated::double"),
    ]
)
_if = lambda c: f"case when level <> 'insufficient' then {c} end"
_add(
    "H6_scholar_dimensions",
    _whole_dimensions,
    C.sql(
        f"""with {C.DIMS}, {STYLE.replace('{CONTINUITY}', '(select continuity from cont where cont.scholar_id = sb.scholar_id)')},
        hx as (select scholar_id, max(least(c, r)) as h from (select scholar_id, c, row_number() over (partition by scholar_id order by c desc) as r from iw) group by 1), sn as (select scholar_id, count(*) as ns from sus group by 1)
       select scholar_id, level, d.quality, d.continuity, d.impact, {_if("case when d.quality >= 70 then 'strong' when d.quality >= 48 then 'moderate' else 'limited' end")} as quality_band,
        {_if("case when d.continuity >= 70 then 'strong' when d.continuity >= 48 then 'moderate' else 'limited' end")} as continuity_band,
        {_if("case when d.impact >= 70 and conc < 0.65 then 'distributed' when conc >= 0.65 then 'concentrated' else 'moderate' end")} as impact_note,
        {_if("orientation")} as orientation, {_if("pacing")} as pacing, {_if("work_type")} as work_type, {_if("collaboration")} as collaboration, case when level <> 'insufficient' then {_told} else '' end as evidence
       from dims d left join qual g using (scholar_id) left join cparts t using (scholar_id) left join impi i using (scholar_id) left join hx using (scholar_id) left join sn using (scholar_id) left join style e using (scholar_id)""",
        *C.CORPUS,
    ),
)


def _recommended(s, d):
    a = view(s, d, "authorships").select("work_id", "scholar_id")
    pairs = a.select("work_id", F.col("scholar_id").alias("focus_id")).join(a.select("work_id", F.col("scholar_id").alias("candidate_id")), "work_id").filter("focus_id <> candidate_id").groupBy("focus_id", "candidate_id").agg(F.count("*").alias("n"))
    rows = pairs.select("focus_id", "candidate_id", F.when(F.col("n") % 2 == 0, "peer").otherwise("reference").alias("category"), F.col("n").cast("double").alias("index"))
    return V.rank_recommendations(rows, pairs.filter("focus_id % 2 = 0 and candidate_id % 3 > 0"))


_add(
    "H12_rank_recommendations",
    _recommended,
    """with p as (select a.scholar_id as focus_id, b.scholar_id as candidate_id, count(*) as n from authorships a join authorships b on a.work_id = b.work_id and a.scholar_id <> b.scholar_id group by 1, 2), bound as (select distinct focus_id from p where focus_id % 2 = 0 and candidate_id % 3 > 0)
       select focus_id, case when n % 2 = 0 then 'peer' else 'reference' end as category, cast(row_number() over (partition by focus_id, n % 2 order by n desc, candidate_id) as int) as rank, candidate_id, n::double as index from p
       where focus_id not in (select focus_id from bound) or (focus_id % 2 = 0 and candidate_id % 3 > 0) qualify rank <= 20""",
)


def _evidence(s, d):
    # used by every kind of evidence: made once
    w, a, sc = kept(view(s, d, "works")), kept(view(s, d, "authorships")), view(s, d, "scholars")
    own = a.select("scholar_id", "work_id").join(w, "work_id")
    ranked = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy("scholar_id").orderBy(*order)))
    papers = ranked(own, F.desc("cited_by_count"), "work_id").select("scholar_id", "rank", "title", F.col("publication_year").alias("year"), F.col("cited_by_count").alias("citations"), F.when(F.col("work_id") % 4 == 0, "https://nowhere.org/x").when(F.col("doi").isNotNull(), F.upper("doi")).otherwise(F.concat(F.lit("w:"), F.col("work_id").cast("string"))).alias("url"))
    topics = ranked(R.dealt(R.labels_of(a, view(s, d, "work_topics"))).select("scholar_id", F.explode("topics").alias("name")).groupBy("scholar_id", "name").agg(F.count("*").alias("n")), F.desc("n"), "name")
    institutions = sc.filter("scholar_id % 3 > 0").join(view(s, d, "institutions").withColumnRenamed("display_name", "name"), "institution_id").select("scholar_id", F.lit(1).alias("rank"), "name")
    others = R.dealt_coauthors(a).groupBy("scholar_id", F.col("other_id").alias("other")).agg(F.count("*").alias("papers"))
    coauthors = ranked(others, F.desc("papers"), "other").select("scholar_id", "rank", F.concat(F.lit("S"), F.col("other").cast("string")).alias("name"), "papers")
    summary = R.citation_summary(w, a)
    summary = summary.withColumn("papers", F.col("papers") + F.when(F.col("scholar_id") % 5 == 0, 1).otherwise(0))
    return kept(V.build_evidence(summary, topics, institutions, papers, coauthors)), own.select("scholar_id", "work_id", F.concat(F.lit("w:"), F.col("work_id").cast("string")).alias("url"), "doi"), sc.select("scholar_id", F.when(F.col("scholar_id") % 2 == 0, "sufficient").otherwise("partial").alias("status"))


def _reviewed(s, d):
    evidence, works, audits = _evidence(s, d)
    return V.review_evidence(evidence, works, audits), audits


EVIDENCE = """own as (select scholar_id, work_id, title, doi, publication_year as year, cited_by_count as c from authorships join works using (work_id)),
    h as (select scholar_id, count(*) filter (c >= r) as h from (select *, row_number() over (partition by scholar_id order by c desc, work_id) as r from own) group by 1),
    f as (select scholar_id, count(*) + case when scholar_id % 5 = 0 then 1 else 0 end as papers, count(*) as real, sum(c) as cites from own group by 1),
    tp as (select scholar_id, topic, count(*) as n from own join work_topics using (work_id) group by 1, 2 qualify row_number() over (partition by scholar_id order by n desc, topic) <= 5),
    co as (select a.scholar_id, b.scholar_id as other, count(*) as n from authorships a join authorships b on a.work_id = b.work_id and a.scholar_id <> b.scholar_id group by 1, 2 qualify row_number() over (partition by a.scholar_id order by n desc, other) <= 3),
    every as (select scholar_id, 0 as place, 'metric' as type, papers || ' papers, ' || cites || ' citations, h-index ' || h as text, null as url, papers as value, papers = real as ok from f join h using (scholar_id)
        union all select scholar_id, 1, 'topic', string_agg(topic, ', ' order by n desc, topic), null, null, true from tp group by 1
        union all select scholar_id, 2, 'institution', i.display_name, null, null, true from scholars join institutions i using (institution_id) where scholar_id % 3 > 0
        union all select scholar_id, 10 + r, 'paper', coalesce(title, '') || ' (' || coalesce(cast(year as varchar), 'year unknown') || '), cited ' || c || ' times', case when work_id % 4 = 0 then 'https://nowhere.org/x' when doi is not null then upper(doi) else 'w:' || work_id end, null, work_id % 4 <> 0
            from (select *, row_number() over (partition by scholar_id order by c desc, work_id) as r from own) where r <= 3
        union all select scholar_id, 20, 'coauthor', string_agg('S' || other || ' (' || n || ')', ', ' order by n desc, other), null, null, true from co group by 1),
    ev as (select *, row_number() over (partition by scholar_id order by place) as evidence_id from every where scholar_id in (select scholar_id from f)),
    rv as (select *, case when ok then case when type = 'metric' and scholar_id % 2 = 0 then 'high' else 'medium' end end as confidence, case when not ok then case type when 'paper' then 'untraceable_paper_evidence' else 'metric_recalculation_mismatch' end end as flag from ev)"""
_add("Q2_build_evidence", lambda s, d: _evidence(s, d)[0], f"with {EVIDENCE} select scholar_id, cast(evidence_id as int) as evidence_id, type, text, url, value from ev")
_add("Q3_review_evidence", lambda s, d: _reviewed(s, d)[0].select("scholar_id", "evidence_id", "type", "approved", "confidence", "flag"), f"with {EVIDENCE} select scholar_id, cast(evidence_id as int) as evidence_id, type, ok as approved, confidence, flag from rv")
_add(
    "Q3_review_summary",
    lambda s, d: V.review_summary(*_reviewed(s, d)).select("scholar_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) for c in ("approved", "rejected", "flags")], "publishable", "confidence"),
    f"""with {EVIDENCE} select scholar_id, coalesce(string_agg(evidence_id, '|' order by evidence_id) filter (ok), '') as approved, coalesce(string_agg(evidence_id, '|' order by evidence_id) filter (not ok), '') as rejected,
        coalesce(array_to_string(list_sort(list(distinct flag) filter (flag is not null)), '|'), '') as flags, bool_or(ok and type = 'metric') as publishable,
        case when bool_or(ok and type = 'metric') and bool_and(ok) and scholar_id % 2 = 0 then 'high' when bool_or(ok and type = 'metric') then 'medium' else 'low' end as confidence from rv group by 1""",
)
