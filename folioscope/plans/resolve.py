"""Registered queries of sources, adjudication, entity resolution, gates and streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from folioscope.operators import resolve as E
from folioscope.operators import rollups as R
from folioscope.operators.graph import kept, shared_dir
from folioscope.sources import records as A
from folioscope.sources import stored
from folioscope.streaming import stateful
from folioscope.streaming import usage as stream
from folioscope.tables import read

from .fixtures import VIEWS, _spelled, oracle, view

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = oracle(sql)


def _records(s, d, k, r):
    """Records of another source about every k-th work: some titles, years and DOIs changed."""
    w = view(s, d, "works").filter(f"work_id % {k} = {r}")
    return w.select(
        F.when(F.col("work_id") % 13 != 0, F.col("doi")).alias("doi"),
        F.when(F.col("work_id") % 7 == 0, F.concat("title", F.lit(" revised"))).otherwise(F.col("title")).alias("title"),
        (F.col("publication_year") + F.when(F.col("work_id") % 11 == 0, 1).otherwise(0)).cast("int").alias("publication_year"),
        F.concat(F.lit("J "), "venue").alias("journal"),
        F.col("work_id").alias("seq"),
    )


def _adjudicated(s, d):
    w = view(s, d, "works").withColumn("venue", F.when(F.col("work_id") % 2 == 0, F.col("venue")))
    return E.adjudicate(w, _records(s, d, 3, 0), _records(s, d, 4, 1), _records(s, d, 5, 2))


def _source(name: str, k: int, r: int) -> str:
    return f"""{name} as (select case when work_id % 13 <> 0 then lower(replace(doi, 'https://doi.org/', '')) end as doi, case when work_id % 7 = 0 then title || ' revised' else title end as title,
        publication_year + case when work_id % 11 = 0 then 1 else 0 end as publication_year, 'J ' || venue as journal, work_id as seq from works where work_id % {k} = {r}),
    {name}_d as (select doi, max_by(title, seq) as title, max_by(publication_year, seq) as publication_year, max_by(journal, seq) as journal from {name} where doi is not null group by 1),
    {name}_t as (select {{N}} as nt, coalesce(publication_year, 0) as y, max_by(journal, seq) as journal from {name} where {{N}} <> '' group by 1, 2)""".replace("{N}", "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9一-鿿]+', ' ', 'g'))")


NT = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9一-鿿]+', ' ', 'g'))"
ADJ = f"""{_source('pub', 3, 0)}, {_source('bib', 4, 1)}, {_source('sea', 5, 2)},
    w as (select work_id, lower(replace(doi, 'https://doi.org/', '')) as doi, title, publication_year, case when work_id % 2 = 0 then venue end as venue, {NT.format('title')} as nt, coalesce(publication_year, 0) as y from works),
    adj as (select w.work_id, w.doi, coalesce(p.title, w.title) as title, coalesce(p.publication_year, w.publication_year) as publication_year,
        coalesce(p.journal, w.venue, bd.journal, bt.journal) as journal, case when p.title is not null then 'publisher' else 'catalogue' end as title_source,
        case when p.journal is not null then 'publisher' when w.venue is not null then 'catalogue' when coalesce(bd.journal, bt.journal) is not null then 'bibliography' end as journal_source,
        case when p.doi is not null or bd.doi is not null or bt.nt is not null or sd.doi is not null or st.nt is not null then 'verified' when w.doi is not null then 'doi_unverified' else 'no_doi' end as verification_status,
        p.doi is not null as publisher_verified, w.title as old_title, p.title as new_title, w.publication_year as old_year, p.publication_year as new_year,
        p.title is not null and w.title is not null and {NT.format('p.title')} <> w.nt as tc, coalesce(p.publication_year <> w.publication_year, false) as yc
      from w left join pub_d p on p.doi = w.doi left join bib_d bd on bd.doi = w.doi left join bib_t bt on bt.nt = w.nt and bt.y = w.y left join sea_d sd on sd.doi = w.doi left join sea_t st on st.nt = w.nt and st.y = w.y)"""
_add(
    "D1_adjudicate_sources",
    lambda s, d: _adjudicated(s, d).drop("conflicts"),
    f"with {ADJ} select work_id, doi, title, publication_year, journal, title_source, journal_source, verification_status, publisher_verified from adj",
)
_add(
    "D2_source_conflicts",
    lambda s, d: E.source_conflicts(_adjudicated(s, d)),
    f"with {ADJ} select work_id, 'title' as field, old_title as catalogue, new_title as publisher from adj where tc union all select work_id, 'publication_year', cast(old_year as varchar), cast(new_year as varchar) from adj where yc",
)
_add(
    "F10_data_audit",
    lambda s, d: E.data_audit(_adjudicated(s, d), view(s, d, "authorships")),
    f"""with {ADJ}, n as (select scholar_id, count(*) as works, count(doi) as with_doi, count(*) filter (publisher_verified) as publisher_verified, count(*) filter (verification_status = 'verified') as multi_source,
        cast(sum(tc::int + yc::int) as bigint) as conflicts from authorships join adj using (work_id) group by 1)
       select *, round(multi_source / works::double, 4) as ratio, case when multi_source / works::double >= 0.7 then 'sufficient' when multi_source > 0 then 'partial' else 'attention' end as status from n""",
)
_add(
    "D7_match_known_works",
    lambda s, d: E.match_known(_records(s, d, 4, 1), view(s, d, "works").filter("work_id % 3 <> 0")).select("seq", "title"),
    f"""with {_source('bib', 4, 1)}, k as (select lower(replace(doi, 'https://doi.org/', '')) as doi, {NT.format('title')} as nt, coalesce(publication_year, 0) as y from works where work_id % 3 <> 0)
       select distinct seq, title from bib b where exists (select 1 from k where k.doi = b.doi) or exists (select 1 from k where k.nt <> '' and k.nt = {NT.format('b.title')} and k.y = coalesce(b.publication_year, 0))""",
)


def _ids(s, d):
    w = view(s, d, "works").filter("work_id % 6 <> 0")
    from folioscope.functions.text import normalize_doi

    doi = w.filter("doi is not null").select(F.lit("doi").alias("identifier_type"), normalize_doi(F.col("doi")).alias("identifier_value"), "work_id")
    return doi.unionByName(w.select(F.lit("catalogue").alias("identifier_type"), F.concat(F.lit("W"), "work_id").alias("identifier_value"), "work_id"))


_add(
    "D3_resolve_external_ids",
    lambda s, d: E.resolve_ids(view(s, d, "works").select(F.col("work_id").alias("seq"), F.when(F.col("work_id") % 4 > 0, F.col("doi")).alias("doi"), F.concat(F.lit("W"), F.col("work_id") + F.col("work_id") % 2).alias("catalogue_id")), _ids(s, d)),
    """with b as (select work_id as seq, case when work_id % 4 > 0 then replace(doi, 'https://doi.org/', '') end as doi, 'W' || (work_id + work_id % 2) as cid from works), k as (select work_id, replace(doi, 'https://doi.org/', '') as doi from works where work_id % 6 <> 0)
       select seq, coalesce(cast(d.work_id as varchar), cast(c.work_id as varchar), 'new:' || coalesce(b.doi, cid)) as work_id from b left join k d on d.doi = b.doi left join k c on 'W' || c.work_id = cid""",
)
_add(
    "D4_backfill_citations",
    lambda s, d: E.backfill_citations(view(s, d, "work_citations").select("citing_work_id", F.concat(F.lit("W"), "cited_work_id").alias("cited_source_id")), _ids(s, d).filter("identifier_type = 'catalogue'")),
    "select citing_work_id, 'W' || cited_work_id as cited_source_id, case when cited_work_id % 6 <> 0 then cited_work_id end as cited_work_id from work_citations",
)


def _profiles(s, d):
    """Every scholar split in three, with the facts of each part."""
    own = kept(view(s, d, "authorships").select("scholar_id", "work_id").withColumn("profile_id", F.col("scholar_id") * 10 + F.col("work_id") % 3))
    n = own.groupBy("profile_id", "scholar_id").agg(F.count("*").alias("works_count"))
    names = view(s, d, "scholars").select("scholar_id", "name_key", "orcid")
    profiles = n.join(names, "scholar_id").select("profile_id", "name_key", F.when(F.col("profile_id") % 3 != 0, F.col("orcid")).alias("orcid"), "works_count")
    # a row a work and scholar is sent, with all that it tells of the profile; facts are made and told apart where a profile's rows lie
    listed = own.groupBy("work_id").agg(F.collect_set("scholar_id").alias("authors"))
    topics = view(s, d, "work_topics").groupBy("work_id").agg(F.collect_set("topic").alias("topics"))
    places = kept(view(s, d, "byline_institutions").groupBy("work_id", "scholar_id").agg(F.collect_set("institution_id").alias("places")))
    rows = listed.hint("merge").join(topics, "work_id", "left").select("work_id", F.explode("authors").alias("scholar_id"), "authors", "topics").hint("merge").join(places, ["work_id", "scholar_id"], "left")
    rows = R.dealt(kept(rows.withColumn("profile_id", F.col("scholar_id") * 10 + F.col("work_id") % 3)), "profile_id")
    kinds = {"institution": F.col("places"), "work": F.array("work_id"), "coauthor": F.array_remove("authors", F.col("scholar_id")), "topic": F.col("topics")}
    fact = lambda kind: lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    told = [F.transform(F.coalesce(v.cast("array<string>"), F.array().cast("array<string>")), fact(k)) for k, v in kinds.items()]
    return profiles, rows.select("profile_id", F.explode(F.concat(*told)).alias("f")).select("profile_id", "f.kind", "f.value").distinct()


IDENT = """po as (select scholar_id * 10 + work_id % 3 as profile_id, scholar_id, work_id from authorships),
    prof as (select profile_id, name_key, case when profile_id % 3 <> 0 then orcid end as orcid, count(*) as works_count from po join scholars using (scholar_id) group by 1, 2, 3),
    facts as (select distinct profile_id, 'institution' as kind, cast(institution_id as varchar) as value from po join byline_institutions using (work_id, scholar_id)
        union select profile_id, 'work', cast(work_id as varchar) from po union select profile_id, 'coauthor', cast(a.scholar_id as varchar) from po join authorships a on a.work_id = po.work_id and a.scholar_id <> po.scholar_id
        union select profile_id, 'topic', topic from po join work_topics using (work_id)),
    pairs as (select a.profile_id as left_id, b.profile_id as right_id, a.orcid as lo, b.orcid as ro, least(a.works_count, b.works_count) as fewest from prof a join prof b on a.profile_id < b.profile_id and (a.name_key = b.name_key or a.orcid = b.orcid)),
    cnt as (select profile_id, kind, count(*) as n from facts group by 1, 2),
    sh as (select left_id, right_id, x.kind, count(*) as s from pairs join facts x on x.profile_id = left_id join facts y on y.profile_id = right_id and y.kind = x.kind and y.value = x.value group by 1, 2, 3),
    ev as (select p.*, k.kind, coalesce(s, 0) as s, coalesce(a.n, 0) as an, coalesce(b.n, 0) as bn, coalesce(s, 0) / greatest(1, least(coalesce(a.n, 0), coalesce(b.n, 0)))::double as c
        from pairs p cross join (values ('institution'), ('work'), ('coauthor'), ('topic')) k(kind) left join sh on sh.left_id = p.left_id and sh.right_id = p.right_id and sh.kind = k.kind
        left join cnt a on a.profile_id = p.left_id and a.kind = k.kind left join cnt b on b.profile_id = p.right_id and b.kind = k.kind),
    wide as (select left_id, right_id, lo, ro, fewest, max(s) filter (kind = 'institution') as si, max(s) filter (kind = 'work') as sw, max(s) filter (kind = 'coauthor') as sc, max(s) filter (kind = 'topic') as st,
        max(c) filter (kind = 'work') as cw, max(c) filter (kind = 'coauthor') as cc, max(c) filter (kind = 'topic') as ct, max(greatest(an, bn)) filter (kind = 'institution') <= 12 as compact from ev group by 1, 2, 3, 4, 5),
    dec as (select left_id, right_id, si, sw, sc, st, case when lo = ro then 'same_orcid' when sw >= 2 and cw >= 0.25 and (si > 0 or sc >= 2) then 'shared_works' when lo <> ro then 'orcid_conflict'
        when si > 0 and compact and sc >= 3 and st >= 2 and ((cc >= 0.4 and ct >= 0.35) or (cc >= 0.25 and ct >= 0.45)) then 'shared_context'
        when si > 0 and compact and fewest <= 3 and sc >= 2 and cc >= 0.5 and st >= 1 then 'small_split_profile' else 'insufficient_evidence' end as reason from wide where {MET})""".replace("{MET}", "(coalesce(lo = ro, false) or sw > 0 or sc > 0)")
MET = "(coalesce(lo = ro, false) or sw > 0 or sc > 0)"


def _undecided(s, d):
    p, f = _profiles(s, d)
    return E.undecided_pairs(p, E.pair_evidence(p, f))


_add(
    "E2_identity_pair_evidence",
    # pairs without a work or co-author in common are counted by E3_undecided_pairs, not made
    lambda s, d: E.pair_evidence(*_profiles(s, d)).select("left_id", "right_id", "shared_institution", "shared_work", "shared_coauthor", "shared_topic", F.round("coauthor_containment", 6).alias("coauthor_containment"), "compact_history"),
    f"with {IDENT} select left_id, right_id, si as shared_institution, sw as shared_work, sc as shared_coauthor, st as shared_topic, round(cc, 6) as coauthor_containment, compact as compact_history from wide where {MET}",
)
_add("E3_identity_decision", lambda s, d: E.identity_decision(E.pair_evidence(*_profiles(s, d))).select("left_id", "right_id", "reason"), f"with {IDENT} select left_id, right_id, reason from dec")
_add("E3_undecided_pairs", _undecided, f"""with {IDENT}, met as (select a.name_key, count(*) as m from dec join prof a on a.profile_id = left_id join prof b on b.profile_id = right_id where a.name_key = b.name_key group by 1)
       select name_key, count(*) as profiles, count(*) * (count(*) - 1) // 2 as pairs, coalesce(any_value(m), 0) as with_evidence, count(*) * (count(*) - 1) // 2 - coalesce(any_value(m), 0) as without from prof left join met using (name_key) group by 1""")


def _groups(s, d):
    p, f = _profiles(s, d)
    return E.author_groups(p, E.identity_decision(E.pair_evidence(p, f)))


#: The walk in order of ids: whoever is linked to none of those that take others takes others too.
GROUPS = f"""{IDENT}, link as (select left_id as a, right_id as b from dec where reason in ('same_orcid', 'shared_works', 'shared_context', 'small_split_profile')),
    near as (select b, list(a) as smaller from link group by 1), seat as (select profile_id, row_number() over (order by profile_id) as k, coalesce(smaller, []) as smaller from prof left join near on b = profile_id),
    walk as (select 0::bigint as k, []::bigint[] as heads union all select w.k + 1, case when list_has_any(heads, s.smaller) then heads else list_append(heads, s.profile_id) end from walk w join seat s on s.k = w.k + 1),
    heads as (select unnest(heads) as h from (select heads from walk order by k desc limit 1)),
    groups as (select profile_id, coalesce(min(a), profile_id) as group_id from prof left join (select a, b from link join heads on h = a) on b = profile_id group by profile_id)"""
_add("E4_greedy_author_groups", _groups, f"with recursive {GROUPS} select * from groups")


def _combined(s, d):
    own = view(s, d, "authorships").join(view(s, d, "works"), "work_id").withColumn("profile_id", F.col("scholar_id") * 10 + F.col("work_id") % 3)
    sums = own.groupBy("profile_id").agg(F.count("*").alias("works_count"), F.sum("cited_by_count").alias("citations"))
    return E.combine_groups(_groups(s, d), sums.join(R.h_index(own, "profile_id", "cited_by_count"), "profile_id")).withColumn("merged_ids", F.array_join(F.transform("merged_ids", lambda x: x.cast("string")), "|"))


_add(
    "E5_combine_author_group",
    _combined,
    f"""with recursive {GROUPS}, mine as (select scholar_id * 10 + work_id % 3 as profile_id, cited_by_count as c from authorships join works using (work_id)),
        hs as (select profile_id, max(least(c, r)) as h from (select profile_id, c, row_number() over (partition by profile_id order by c desc) as r from mine) group by 1),
        sums as (select profile_id, count(*) as works_count, cast(sum(c) as bigint) as citations from mine group by 1)
       select group_id, first(profile_id order by citations desc, works_count desc, profile_id) as main_id, cast(sum(works_count) as bigint) as works_count, cast(sum(citations) as bigint) as citations, cast(max(h) as int) as h_index,
        string_agg(cast(profile_id as varchar), '|' order by profile_id) as merged_ids from groups join sums using (profile_id) join hs using (profile_id) group by 1""",
)
_add(
    "E6_canonicalise_authors",
    lambda s, d: E.canonicalise(view(s, d, "authorships"), view(s, d, "scholars").filter("scholar_id % 3 = 1").select(F.col("scholar_id").alias("alias_id"), (F.col("scholar_id") - 1).alias("main_id"))),
    "select work_id, case when scholar_id % 3 = 1 then scholar_id - 1 else scholar_id end as scholar_id, min(position_index) as position_index from authorships group by 1, 2",
)
_add(
    "E8_dedup_works_bridge",
    lambda s, d: E.dedup_bridge(view(s, d, "works").select(F.col("work_id").alias("id"), F.array(F.concat(F.lit("a"), F.when(F.col("work_id") % 9 < 2, F.floor(F.col("work_id") / 9)).cast("string")), F.concat(F.lit("b"), F.when(F.col("work_id") % 9 == 1, F.col("work_id") + 4).when(F.col("work_id") % 9 == 5, F.col("work_id")).cast("string"))).alias("keys"))),
    # records 9q and 9q + 1 share one key, 9q + 1 and 9q + 5 another: the second bridges the first and third
    "select work_id as id, case when work_id % 9 in (1, 5) then work_id - work_id % 9 else work_id end as work_id from works",
)
_add("E9_work_components", lambda s, d: E.work_components(view(s, d, "works"), view(s, d, "authorships")), None)
_add(
    "Q1_assess_quality",
    lambda s, d: E.assess_quality(
        R.citation_summary(view(s, d, "works"), view(s, d, "authorships")).select(
            "scholar_id", (F.col("papers") + F.col("scholar_id") % 9 * 20).alias("expected"), F.col("papers").alias("fetched"), (F.col("scholar_id") % 4).alias("excluded"), F.lit(0).alias("collected"), (F.col("scholar_id") % 8 > 0).alias("complete"),
            (F.col("scholar_id") % 11 == 1).cast("int").alias("errors"), F.lit(True).alias("has_payload"), (F.col("scholar_id") % 13 > 0).alias("evidence_ok"), (F.col("scholar_id") % 3).alias("n_countries"), (F.col("scholar_id") % 10).alias("n_topics"),
            (F.col("scholar_id") % 7 / 10).alias("top_weight"), (F.col("scholar_id") % 17 == 2).alias("name_collision"),
        ),
        R.citation_summary(view(s, d, "works").filter("publication_year <= 2000"), view(s, d, "authorships")).select("scholar_id", (F.col("papers") * 2 - F.col("scholar_id") % 5 * 100).alias("papers")),
    ).withColumn("flags", F.array_join("flags", "|")),
    """with n as (select scholar_id, count(*) as fetched, count(*) + scholar_id % 9 * 20 as expected, scholar_id % 4 as excluded from authorships join works using (work_id) group by 1),
        b as (select scholar_id, count(*) * 2 - scholar_id % 5 * 100 as before from authorships join works using (work_id) where publication_year <= 2000 group by 1),
        x as (select n.*, coalesce(before, 0) as before, greatest(0, expected - excluded) as e from n left join b using (scholar_id)),
        f as (select scholar_id, list_filter([case when scholar_id % 8 = 0 then 'partial_works_fetch' end, case when scholar_id % 11 = 1 then 'workflow_errors' end, case when scholar_id % 13 = 0 then 'evidence_review_failed' end,
            case when e > 0 and e - fetched > greatest(5, floor(e * 0.2)) then 'catalogue_count_mismatch' end, case when before >= 10 and fetched < before * 0.8 and excluded = 0 then 'suspicious_paper_drop' end], lambda v: v is not null) as bl,
            list_filter([case when excluded > 0 then 'identity_conservative_exclusion' end, case when scholar_id % 3 > 1 then 'institution_country_conflict' end, case when scholar_id % 10 >= 8 and scholar_id % 7 / 10.0 < 0.25 then 'broad_topic_span' end,
            case when scholar_id % 17 = 2 then 'coauthor_name_collision' end], lambda v: v is not null) as ad from x)
       select scholar_id, len(bl) = 0 as publishable, array_to_string(list_concat(bl, ad), '|') as flags from f""",
)


def _raw_works(s, d):
    """The works as nested catalogue documents, one JSON text each."""
    entity = lambda i, n: F.struct(i.alias("id"), n.alias("display_name"))
    bylines = view(s, d, "byline_institutions").groupBy("work_id", "scholar_id").agg(F.min("institution_id").alias("institution_id"))
    authors = view(s, d, "authorships").join(bylines, ["work_id", "scholar_id"], "left").groupBy("work_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position_index", "author_position", "is_corresponding", "scholar_id", "institution_id"))),
            lambda a: F.struct(a["author_position"].alias("author_position"), a["is_corresponding"].alias("is_corresponding"), entity(F.concat(F.lit("https://x.org/A"), a["scholar_id"].cast("string")), F.concat(F.lit("Name "), a["scholar_id"].cast("string"))).alias("author"), F.array(entity(F.concat(F.lit("https://x.org/I"), a["institution_id"].cast("string")), F.lit("n"))).alias("institutions")),
        ).alias("authorships")
    )
    topics = view(s, d, "work_topics").groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "topic"))).alias("t"))
    # some topics have no id
    named = lambda t: entity(F.when(F.length(t) % 3 != 0, F.replace(t, F.lit(" "), F.lit("_"))), t)
    topics = topics.select("work_id", named(F.get("t", F.lit(0))["topic"]).alias("primary_topic"), F.transform("t", lambda x: named(x["topic"])).alias("topics"))
    refs = view(s, d, "work_citations").groupBy(F.col("citing_work_id").alias("work_id")).agg(F.collect_list(F.concat(F.lit("https://x.org/W"), F.col("cited_work_id").cast("string"))).alias("referenced_works"))
    w = view(s, d, "works").join(authors, "work_id", "left").join(topics, "work_id", "left").join(refs, "work_id", "left")
    w = w.withColumn("id", F.concat(F.lit("https://x.org/W"), F.col("work_id").cast("string"))).withColumn("publication_date", F.col("publication_date").cast("string"))
    return w.select(F.to_json(F.struct("id", "doi", "title", "publication_year", "publication_date", "cited_by_count", F.col("work_type").alias("type"), "venue", "authorships", "primary_topic", "topics", "referenced_works")).alias("json"))


_add(
    "A1_works_from_json",
    lambda s, d: A.works_from_json(_raw_works(s, d)).select("work_id", "doi", "title", "publication_year", F.col("publication_date").cast("string").alias("publication_date"), "cited_by_count", "work_type", "venue"),
    "select 'W' || work_id as work_id, lower(replace(doi, 'https://doi.org/', '')) as doi, title, publication_year, cast(publication_date as varchar) as publication_date, cited_by_count, work_type, venue from works",
)
_add(
    "A2_explode_authorships",
    lambda s, d: A.explode_authorships(_raw_works(s, d)).select("work_id", "scholar_id", "position_index", "author_position", "is_corresponding", F.array_join("institution_ids", "|").alias("institution_ids")),
    """with b as (select work_id, scholar_id, min(institution_id) as i from byline_institutions group by 1, 2)
       select 'W' || work_id as work_id, 'A' || scholar_id as scholar_id, position_index, author_position, is_corresponding, coalesce('I' || i, '') as institution_ids from authorships left join b using (work_id, scholar_id)""",
)
_add(
    "A3_explode_topics",
    lambda s, d: A.explode_topics(_raw_works(s, d)),
    "select 'W' || work_id as work_id, topic, is_primary and length(topic) % 3 <> 0 as is_primary, case when length(topic) % 3 <> 0 then 0.9 else 0.7 end::double as confidence from work_topics",
)
_add("A4_citation_edges", lambda s, d: A.citation_edges(_raw_works(s, d)), "select distinct 'W' || citing_work_id as citing_work_id, 'W' || cited_work_id as cited_work_id from work_citations")
_add(
    "A10_incremental_slice",
    lambda s, d: A.incremental_slice(view(s, d, "authorships").join(view(s, d, "works").select("work_id", "publication_date"), "work_id"), view(s, d, "scholars").filter("scholar_id % 2 = 0").select("scholar_id", F.lit("1999-06-30").cast("date").alias("last_success"))).select("scholar_id", "work_id"),
    "select scholar_id, work_id from authorships join works using (work_id) where scholar_id % 2 = 1 or publication_date >= date '1999-06-30' - 30",
)


def _merge_input(s, d, k, r, verified):
    w = view(s, d, "works").filter(f"work_id % {k} = {r}")
    return w.select("work_id", F.concat("title", F.lit(f" {k}")).alias("title"), F.date_add("publication_date", k).alias("publication_date"), "publication_year", "venue", F.concat("work_type", F.lit(f" {k}")).alias("work_type"), F.when(F.col("work_id") % 2 == 0, F.lit(f"abstract {k}")).alias("abstract"), (F.col("cited_by_count") + F.lit(k)).alias("cited_by_count"), (F.col("work_id") % verified == 0).alias("verified"), (F.col("work_id") % 10 / 10).alias("confidence"))


MERGED = """with c as (select work_id, title || ' 2' as title, publication_date + 2 as publication_date, publication_year, venue, work_type || ' 2' as work_type, case when work_id % 2 = 0 then 'abstract 2' end as abstract, cited_by_count + 2 as n, work_id % 3 = 0 as v, work_id % 10 / 10.0 as conf from works where work_id % 2 = 0),
        b as (select work_id, title || ' 3' as title, publication_date + 3 as publication_date, publication_year, venue, work_type || ' 3' as work_type, case when work_id % 2 = 0 then 'abstract 3' end as abstract, cited_by_count + 3 as n, work_id % 5 = 0 as v, work_id % 10 / 10.0 as conf from works where work_id % 3 = 0)
       select coalesce(b.work_id, c.work_id) as work_id, case when coalesce(c.v, false) and not coalesce(b.v, false) then coalesce(c.title, b.title) else coalesce(b.title, c.title) end as title,
        case when coalesce(c.v, false) and not coalesce(b.v, false) then coalesce(c.publication_date, b.publication_date) else coalesce(b.publication_date, c.publication_date) end as publication_date,
        case when coalesce(c.v, false) and not coalesce(b.v, false) then coalesce(c.work_type, b.work_type) else coalesce(b.work_type, c.work_type) end as work_type, coalesce(b.publication_year, c.publication_year) as publication_year, coalesce(b.venue, c.venue) as venue, coalesce(b.abstract, c.abstract) as abstract, greatest(coalesce(c.n, 0), coalesce(b.n, 0)) as cited_by_count,
        coalesce(c.v, false) or coalesce(b.v, false) as verified, greatest(c.conf, b.conf)::double as confidence from c full join b on c.work_id = b.work_id"""
_add(
    "A11_merge_works",
    lambda s, d: A.merge_works(_merge_input(s, d, 2, 0, 3), _merge_input(s, d, 3, 0, 5)),
    MERGED,
)


def _place(s, name):
    return f"{shared_dir(s)}/{name}-{uuid4().hex}"


def _merged_in_place(s, d):
    """The batch comes in two parts, the second one twice."""
    table = stored.Bucketed(s, _place(s, "works"), ["work_id"]).create(_merge_input(s, d, 2, 0, 3))
    batch = _merge_input(s, d, 3, 0, 5)
    for part in ("work_id % 2 = 0", "work_id % 2 = 1", "work_id % 2 = 1"):
        table.upsert(batch.filter(part), A.merge_works)
    return table.read()


def _replaced_in_place(s, d):
    a = view(s, d, "authorships").select("scholar_id", "work_id")
    table = stored.Bucketed(s, _place(s, "scope"), ["scholar_id"]).create(a)
    table.replace(view(s, d, "scholars").filter("scholar_id % 5 = 0"), a.filter("scholar_id % 5 = 0 and work_id % 2 = 0"))
    return table.read()


def _sliced(s, d):
    rows = view(s, d, "authorships").select("scholar_id", "work_id").join(view(s, d, "works").select("work_id", "publication_date"), "work_id")
    table = stored.ByPeriod(s, _place(s, "dated"), "publication_date", "month").create(rows)
    since = view(s, d, "scholars").select("scholar_id", F.date_sub(F.lit("1999-06-30").cast("date"), 30 + (F.col("scholar_id") % 3).cast("int")).alias("since"))
    return table.read_since(since, "scholar_id", F.lit("2002-01-01")).select("scholar_id", "work_id")


def _retained(s, d):
    table = stored.ByPeriod(s, _place(s, "events"), "created_at").create(view(s, d, "usage_events"))
    table.drop_before("2024-01-20 12:00:00")
    return table.read().select("event_id", "event_type")


def _refreshed(s, d):
    """Co-authors by focus, kept from before works were added, and swapped for the scholars of the added works only."""
    a = view(s, d, "authorships")
    added = F.col("work_id") % 100 == 7
    of = lambda rows: R.symmetrise(R.coauthor_pairs(rows)).groupBy("scholar_id", "other_id").agg(F.count("*").alias("works"))
    table = stored.Bucketed(s, _place(s, "coauthors"), ["scholar_id"]).create(of(a.filter(~added)))
    changed = a.filter(added).select("scholar_id").distinct()
    mine = lambda keys: of(a.join(a.hint("merge").join(keys, "scholar_id", "left_semi").select("work_id").distinct(), "work_id", "left_semi")).hint("merge").join(keys, "scholar_id", "left_semi")
    stored.refresh(table, changed, mine)
    return table.read()


_add("A11_upsert_works_in_place", _merged_in_place, MERGED)
_add("A13_replace_scope_in_place", _replaced_in_place, "select scholar_id, work_id from authorships where scholar_id % 5 <> 0 or work_id % 2 = 0")
_add("A10_pruned_slice", _sliced, "select scholar_id, work_id from authorships join works using (work_id) where publication_date >= date '1999-06-30' - 30 - cast(scholar_id % 3 as int)")
_add("S10_retention_by_partition", _retained, "select event_id, event_type from usage_events where created_at >= timestamp '2024-01-20 12:00:00'")
_add("S20_refreshed_results", _refreshed, "select a.scholar_id, b.scholar_id as other_id, count(*) as works from authorships a join authorships b on a.work_id = b.work_id and a.scholar_id <> b.scholar_id group by 1, 2")
_add(
    "A13_replace_scholar_scope",
    lambda s, d: A.replace_scope(view(s, d, "authorships").select("scholar_id", "work_id"), view(s, d, "authorships").filter("scholar_id % 5 = 0 and work_id % 2 = 0").select("scholar_id", "work_id"), view(s, d, "scholars").filter("scholar_id % 5 = 0")),
    "select scholar_id, work_id from authorships where scholar_id % 5 <> 0 or work_id % 2 = 0",
)
_add(
    "A16_upsert_topics",
    lambda s, d: A.upsert_topics(*[view(s, d, "work_topics").filter(f"work_id % 2 = {r}").select(F.when(F.col("work_id") % 3 == 0, F.upper("topic")).otherwise(F.col("topic")).alias("name"), F.when(F.col("work_id") % 5 == 0, F.col("work_id").cast("string")).alias("description"), F.struct("work_id", F.lit(r).alias("r")).alias("seq")) for r in (0, 1)]),
    """with t as (select case when work_id % 3 = 0 then upper(topic) else topic end as name, case when work_id % 5 = 0 then cast(work_id as varchar) end as description, work_id from work_topics)
       select lower(name) as normalized_name, max_by(name, work_id) as name, max_by(description, work_id) filter (description is not null) as description from t group by 1""",
)
_add(
    "A17_publish_profiles",
    lambda s, d: A.publish_profiles(
        view(s, d, "scholars").filter("scholar_id % 2 = 0").select("scholar_id", F.lit("old").alias("payload"), F.lit("f").alias("fingerprint"), (F.col("scholar_id") + 1).cast("long").alias("version")),
        view(s, d, "scholars").select("scholar_id", F.col("display_name").alias("payload"), (F.col("scholar_id") % 3 > 0).alias("publishable")),
    ),
    """select scholar_id, case when scholar_id % 3 > 0 then display_name else 'old' end as payload, case when scholar_id % 3 > 0 then sha256(display_name) else 'f' end as fingerprint,
        case when scholar_id % 3 = 0 then scholar_id + 1 when scholar_id % 2 = 0 then scholar_id + 2 else 1 end as version from scholars where scholar_id % 3 > 0 or scholar_id % 2 = 0""",
)


def _stream(s, d):
    raw = read(s, d, "events")
    events = stream.read_events(s, d, raw.schema)
    return s.sql(_spelled(VIEWS["usage_events"], 0), events=events)


#: What the watermark has passed when all events are read, to the millisecond.
CLOSED = "(select (max(epoch_us(created_at)) // 1000 - 600000) * 1000 from usage_events)"
_time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
_add(
    "S1_stream_usage_trend",
    lambda s, d: stream.to_table(stream.usage_trend(_stream(s, d)), s, "append").select(_time("bucket"), "page_views", "searches", "users"),
    f"""select strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') as bucket, count(*) filter (event_type = 'page_view') as page_views, count(*) filter (event_type = 'search') as searches, count(distinct user_id) as users
       from usage_events where epoch_us(date_trunc('hour', created_at) + interval 1 hour) <= {CLOSED} group by 1""",
)
_add(
    "S7_stream_sessions",
    lambda s, d: stream.to_table(stream.sessions(_stream(s, d), "2 hours"), s, "append").select("visitor_hash", _time("started"), _time("ended"), "events"),
    f"""with e as (select visitor_hash, created_at, lag(created_at) over (partition by visitor_hash order by created_at) as before from usage_events),
        n as (select *, sum(case when before is null or created_at >= before + interval 2 hour then 1 else 0 end) over (partition by visitor_hash order by created_at rows between unbounded preceding and current row) as k from e)
       select visitor_hash, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as started, strftime(max(created_at) + interval 2 hour, '%Y-%m-%d %H:%M:%S') as ended, count(*) as events from n group by visitor_hash, k
       having epoch_us(max(created_at) + interval 2 hour) <= {CLOSED}""",
)


def _keyed(s, result, mode="append"):
    with stateful.keyed_state(s):
        return stream.to_table(result, s, mode)


_add(
    "S6_stream_visitor_state",
    lambda s, d: _keyed(s, stateful.visitor_state(_stream(s, d)))
    .groupBy("visitor_hash").agg(F.max_by(F.struct("first_at", "last_at", "user_id"), "events").alias("x"), F.max("events").alias("events"))
    .select("visitor_hash", "x.first_at", "x.last_at", "x.user_id", "events"),
    f"""with recursive c as (select * from usage_events where epoch_us(created_at) <= {CLOSED}),
        e as (select visitor_hash, epoch_us(created_at) as t, user_id, row_number() over (partition by visitor_hash order by created_at, event_id) as rn from c),
        walk as (select visitor_hash, rn, t as first_at, t as seen, user_id from e where rn = 1
            union all select e.visitor_hash, e.rn, w.first_at, case when e.t - w.seen >= 60000000 then e.t else w.seen end, e.user_id from walk w join e on e.visitor_hash = w.visitor_hash and e.rn = w.rn + 1)
       select visitor_hash, first_at, seen as last_at, user_id, rn as events from walk qualify row_number() over (partition by visitor_hash order by rn desc) = 1""",
)
_add(
    "S8_stream_quota_decisions",
    lambda s, d: _keyed(s, stateful.quota_decisions(_stream(s, d), 2, 86400)),
    f"""with recursive e as (select event_id, user_id, epoch_us(created_at) as t_us, row_number() over (partition by user_id order by epoch_us(created_at), event_id) as rn from usage_events where user_id is not null and epoch_us(created_at) <= {CLOSED}),
        walk as (select event_id, user_id, rn, true as allowed, [t_us] as kept from e where rn = 1
            union all select e.event_id, e.user_id, e.rn, len(list_filter(w.kept, lambda t: t >= e.t_us - 86400000000)) < 2,
                case when len(list_filter(w.kept, lambda t: t >= e.t_us - 86400000000)) < 2 then list_append(list_filter(w.kept, lambda t: t >= e.t_us - 86400000000), e.t_us) else list_filter(w.kept, lambda t: t >= e.t_us - 86400000000) end
            from walk w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
       select event_id, user_id, allowed from walk""",
)


def _statuses(events):
    kind = F.when(F.col("event_type") == "server_error", "failed").when(F.col("event_type") == "search", "pending").otherwise("ready")
    return events.select("scholar_id", "event_id", F.dayofmonth("created_at").alias("version"), kind.alias("status"), "created_at")


_add(
    "S11_stream_status_changes",
    lambda s, d: _keyed(s, stateful.status_changes(_statuses(_stream(s, d)), 3)),
    f"""with k as (select scholar_id, event_id, cast(day(created_at) as int) as version, case event_type when 'server_error' then 'failed' when 'search' then 'pending' else 'ready' end as status, created_at from usage_events where epoch_us(created_at) <= {CLOSED} and scholar_id is not null),
        f as (select *, lag((version, status)) over (partition by scholar_id order by created_at, event_id) as before from k where version >= 3 and (version > 3 or status <> 'ready'))
       select scholar_id, event_id, version, status from f where before is null or before <> (version, status)""",
)
_add(
    "S12_stream_latest_n",
    lambda s, d: stream.latest_batch(_keyed(s, stateful.latest_n(_stream(s, d)), "update"), "scholar_id").select("scholar_id", "rank", "event_id", "event_type"),
    "select scholar_id, cast(row_number() over (partition by scholar_id order by created_at desc, event_id desc) as int) as rank, event_id, event_type from usage_events where scholar_id is not null qualify rank <= 8",
)
_add(
    "S15_stream_history_rollup",
    lambda s, d: stream.to_table(stream.history(_stream(s, d)), s).select("user_id", "scholar_id", "view_count", F.date_format("last_viewed_at", "yyyy-MM-dd HH:mm:ss").alias("last_viewed_at")),
    "select user_id, scholar_id, count(*) as view_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_viewed_at from usage_events where event_type = 'page_view' and user_id is not null group by 1, 2",
)
_add(
    "S9_stream_failure_windows",
    lambda s, d: stream.to_table(stream.failure_windows(_stream(s, d), limit=2, length="1 day", slide="1 day"), s).select("user_id", F.date_format("started", "yyyy-MM-dd").alias("day"), "failures"),
    "select user_id, strftime(created_at, '%Y-%m-%d') as day, count(*) as failures from usage_events where event_type = 'server_error' and user_id is not null group by 1, 2 having count(*) >= 2",
)
