"""Registered queries of other sources' records and of candidate identities."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from folioscope.operators import candidates as C
from folioscope.operators.graph import kept, shared_dir
from folioscope.operators.rollups import top
from folioscope.sources import external as X

from .fixtures import oracle, view

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLE[name] = run, oracle(sql)


def _own(s, d):
    return view(s, d, "authorships").select("scholar_id", "work_id").join(view(s, d, "works"), "work_id")


def _persons(s, d):
    """Each scholar's publications as a bibliography document."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    odd = F.col("work_id") % 2 == 1
    body = F.concat(
        F.lit("<author>Ada  Byron</author><author/>"), tag("title", F.concat(F.lit("On <i>"), F.coalesce("title", F.lit("none")), F.lit("</i>."))), tag("year", F.when(F.col("work_id") % 7 == 0, F.lit("soon")).otherwise(F.col("publication_year").cast("string"))),
        tag("ee", F.lit("https://x.org/a")), F.coalesce(tag("ee", F.upper("doi")), F.lit("")),
    )
    entry = F.when(odd, F.concat(F.lit("<article key='k"), F.col("work_id").cast("string"), F.lit("'>"), body, tag("journal", F.col("venue")), F.lit("</article>"))).otherwise(
        F.concat(F.lit("<inproceedings key='k"), F.col("work_id").cast("string"), F.lit("'>"), body, tag("booktitle", F.concat(F.lit("Proc "), F.col("venue"))), F.lit("</inproceedings>"))
    )
    return _own(s, d).groupBy("scholar_id").agg(F.array_join(F.collect_list(F.concat(F.lit("<r>"), entry, F.lit("</r>\n"))), "").alias("x")).select(F.concat(F.lit("<dblpperson><person/>"), "x", F.lit("<r/></dblpperson>")).alias("xml"))


_add(
    "A7_person_records_xml",
    lambda s, d: X.person_records_xml(_persons(s, d)).select("key", "doi", "title", "year", "venue", F.array_join("authors", "|").alias("authors")),
    """select 'k' || work_id as key, coalesce(lower(replace(doi, 'https://doi.org/', '')), '') as doi, 'On ' || coalesce(title, 'none') || '.' as title, case when work_id % 7 <> 0 then publication_year end as year,
        case when work_id % 2 = 1 then venue else 'Proc ' || venue end as venue, 'Ada Byron' as authors from authorships join works using (work_id)""",
)


DTD = '<!ENTITY uuml "&#252;" >\n<!ENTITY szlig "&#223;"><!ENTITY reg "&#174;">\n'


def _person_files(s, d):
    """The same documents as files that use entities of a DTD."""
    at = f"{shared_dir(s)}/persons-{uuid4().hex}"
    head = '<?xml version="1.0"?><!DOCTYPE dblpperson SYSTEM "dblp.dtd">'
    named = F.replace("xml", F.lit("On <i>"), F.lit("&uuml;ber <i>"))
    _persons(s, d).select(F.concat(F.lit(head), named)).write.text(at)
    s.createDataFrame([(DTD,)], "t string").write.text(f"{at}-dtd")
    return X.person_record_files(s, at, X.declared_entities(s, f"{at}-dtd"))


_add(
    "A7_person_record_files",
    lambda s, d: _person_files(s, d).select("key", "doi", "title", "year", "venue", F.array_join("authors", "|").alias("authors")),
    """select 'k' || work_id as key, coalesce(lower(replace(doi, 'https://doi.org/', '')), '') as doi, 'über ' || coalesce(title, 'none') || '.' as title, case when work_id % 7 <> 0 then publication_year end as year,
        case when work_id % 2 = 1 then venue else 'Proc ' || venue end as venue, 'Ada Byron' as authors from authorships join works using (work_id)""",
)


def _orcid_json(s, d):
    value = lambda c: F.struct(c.alias("value"))
    ids = F.array(F.struct(F.lit("issn").alias("external-id-type"), F.lit("1").alias("external-id-value")), F.struct(F.lit("DOI").alias("external-id-type"), F.col("doi").alias("external-id-value")))
    summary = F.struct(F.struct(value(F.concat(F.lit(" "), "title")).alias("title")).alias("title"), F.struct(value(F.col("publication_year").cast("string")).alias("year")).alias("publication-date"), F.struct(ids.alias("external-id")).alias("external-ids"))
    own = _own(s, d).join(view(s, d, "scholars").filter("orcid is not null").select("scholar_id", "orcid"), "scholar_id")
    groups = own.groupBy("orcid").agg(F.collect_list(F.struct(F.array(summary, F.struct(F.struct(value(F.lit("another")).alias("title")).alias("title"), summary["publication-date"].alias("publication-date"), summary["external-ids"].alias("external-ids"))).alias("work-summary"))).alias("group"))
    return groups.select("orcid", F.to_json(F.struct("group")).alias("json"))


_add(
    "A8_orcid_works",
    lambda s, d: X.orcid_works(_orcid_json(s, d)),
    """select distinct orcid, coalesce(lower(replace(doi, 'https://doi.org/', '')), '') as doi, coalesce(title, '') as title, publication_year as year from authorships join works using (work_id) join scholars using (scholar_id)
       where orcid is not null and (doi is not null or title is not null)""",
)


def _hits(s, d):
    w = view(s, d, "works")
    info = F.struct(F.concat(F.lit("A Byron - Journal 2001, "), F.col("publication_year").cast("string"), F.lit(" - x123456.org")).alias("summary"), F.array(F.struct(F.lit(" A Byron ").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"))
    hit = F.struct(F.concat(F.lit("r"), F.col("work_id").cast("string")).alias("result_id"), "title", F.lit("u").alias("link"), info.alias("publication_info"), F.struct(F.struct(F.col("cited_by_count").alias("total")).alias("cited_by")).alias("inline_links"))
    article = F.struct(F.concat(F.lit("c"), F.col("work_id").cast("string")).alias("citation_id"), "title", F.when(F.col("work_id") % 3 > 0, F.col("publication_year").cast("string")).otherwise("18999").alias("year"), F.struct((F.col("cited_by_count") - 50).alias("value")).alias("cited_by"))
    return w.select(F.to_json(F.struct(F.array(hit).alias("organic_results"), F.array(article).alias("articles"))).alias("json"))


_add(
    "A9_search_hits",
    lambda s, d: X.search_hits(_hits(s, d)).withColumn("authors", F.array_join("authors", "|")),
    """select 'hit' as kind, 'r' || work_id as id, coalesce(title, '') as title, publication_year as year, cited_by_count as cited_by, 'A Byron' as authors, 'u' as url from works
       union all select 'article', 'c' || work_id, title, case when work_id % 3 > 0 then publication_year end, greatest(0, cited_by_count - 50), '', '' from works where title is not null""",
)


def _insights(s, d, k):
    return view(s, d, "works").filter(f"work_id % {k} = 0").select("work_id", F.concat("title", F.lit(f" {k}")).alias("problem"), (F.col("work_id") % (k + 3) == 0).alias("based_on_abstract"))


_add(
    "A14_upsert_insights",
    lambda s, d: X.upsert_insights(_insights(s, d, 2), _insights(s, d, 3)),
    """with c as (select work_id, title || ' 2' as problem, work_id % 5 = 0 as b from works where work_id % 2 = 0), n as (select work_id, title || ' 3' as problem, work_id % 6 = 0 as b from works where work_id % 3 = 0)
       select coalesce(c.work_id, n.work_id) as work_id, case when c.work_id is null or n.b then n.problem else c.problem end as problem, case when c.work_id is null or n.b then n.b else c.b end as based_on_abstract from c full join n on c.work_id = n.work_id""",
)
_add(
    "A15_upsert_scholars",
    lambda s, d: X.upsert_scholars(
        view(s, d, "scholars").filter("scholar_id % 2 = 0").select("scholar_id", "display_name", "orcid", F.lit(5).alias("works_count"), F.lit(6).alias("cited_by_count"), F.lit(7).alias("h_index")),
        view(s, d, "scholars").filter("scholar_id % 3 = 0").select("scholar_id", F.upper("display_name").alias("display_name"), F.lit(None).cast("string").alias("orcid"), (F.col("scholar_id") - 50).cast("int").alias("works_count"), F.lit(1).alias("cited_by_count"), F.lit(None).cast("int").alias("h_index"), (F.col("scholar_id") % 4 == 0).alias("is_detail")),
    ),
    """select scholar_id, case when scholar_id % 3 = 0 then upper(display_name) else display_name end as display_name, case when scholar_id % 2 = 0 then orcid end as orcid,
        cast(case when scholar_id % 3 = 0 and (scholar_id % 4 = 0 or scholar_id % 2 = 1) then greatest(0, scholar_id - 50) else 5 end as int) as works_count, cast(case when scholar_id % 3 = 0 and (scholar_id % 4 = 0 or scholar_id % 2 = 1) then 1 else 6 end as int) as cited_by_count,
        cast(case when scholar_id % 3 = 0 and (scholar_id % 4 = 0 or scholar_id % 2 = 1) then 0 else 7 end as int) as h_index from scholars where scholar_id % 2 = 0 or scholar_id % 3 = 0""",
)
_add(
    "A15_scholar_aliases",
    lambda s, d: X.scholar_aliases(
        view(s, d, "scholars").filter("scholar_id % 2 = 0").select("scholar_id", F.upper("display_name").alias("alias")),
        view(s, d, "scholars").select("scholar_id", "display_name", F.array(F.lit(" "), F.col("name_key"), F.upper("name_key")).alias("alternatives")),
    ),
    "select scholar_id, case when scholar_id % 2 = 0 then upper(display_name) else display_name end as alias from scholars union all select scholar_id, name_key from scholars",
)


def _long_titles(s, d):
    own = _own(s, d).filter("title is not null")
    known = own.select("scholar_id", F.concat(F.lit("A long study of "), F.lower("title")).alias("title"), "publication_year")
    record = F.when(F.col("work_id") % 3 == 0, F.concat(F.lit("A LONG study: of "), "title")).when(F.col("work_id") % 3 == 1, F.concat(F.lit("(1) A long study of "), "title", F.lit(", part two"))).otherwise(F.col("title"))
    year = F.when(F.col("work_id") % 5 != 0, F.col("publication_year") + F.when(F.col("work_id") % 7 == 0, 90).otherwise(0)).cast("int")
    return own.select("scholar_id", F.col("work_id").alias("record_id"), record.alias("title"), year.alias("year")), known


_add(
    "D8_match_by_title_containment",
    lambda s, d: C.match_containment(*_long_titles(s, d)),
    "select scholar_id, work_id as record_id from authorships join works using (work_id) where title is not null and work_id % 3 <> 2 and (work_id % 5 = 0 or work_id % 7 <> 0)",
)
_add(
    "E1_identity_fingerprints",
    lambda s, d: C.fingerprints(view(s, d, "works"), view(s, d, "authorships"), view(s, d, "work_topics"), view(s, d, "byline_institutions")),
    """with t as (select scholar_id, work_id, doi, publication_year from authorships join works using (work_id) qualify row_number() over (partition by scholar_id order by cited_by_count desc, work_id) <= 100),
        f as (select scholar_id, work_id, 'work' as kind, coalesce(doi, cast(work_id as varchar)) as value from t
            union all select t.scholar_id, t.work_id, 'coauthor', cast(a.scholar_id as varchar) from t join authorships a on a.work_id = t.work_id and a.scholar_id <> t.scholar_id
            union all select scholar_id, work_id, 'topic', topic from t join work_topics using (work_id)
            union all select scholar_id, work_id, 'institution', cast(institution_id as varchar) from t join byline_institutions using (scholar_id, work_id)
            union all select scholar_id, work_id, 'year', cast(publication_year as varchar) from t)
       select scholar_id, kind, value, count(distinct work_id) as works from f where value is not null group by 1, 2, 3""",
)


_add(
    "E1_fingerprint_affiliations",
    lambda s, d: C.fingerprint_affiliations(view(s, d, "works"), view(s, d, "authorships"), view(s, d, "byline_institutions").join(view(s, d, "institutions").select("institution_id", F.col("display_name").alias("name")), "institution_id")).withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), "|")),
    """with t as (select scholar_id, work_id, doi, publication_year from authorships join works using (work_id) qualify row_number() over (partition by scholar_id order by cited_by_count desc, work_id) <= 100),
        f as (select scholar_id, institution_id, display_name as name, list_reverse_sort(list(distinct publication_year)) as years, count(distinct coalesce(doi, cast(work_id as varchar))) as work_count
              from t join byline_institutions using (scholar_id, work_id) join institutions using (institution_id) group by 1, 2, 3)
       select scholar_id, cast(row_number() over (partition by scholar_id order by years[1] desc, work_count desc, lower(name) desc) as int) as place, institution_id, name, list_aggregate(years, 'string_agg', '|') as years, work_count from f""",
)


def _clusters(s, d):
    a = view(s, d, "authorships")
    team = a.groupBy("work_id").agg((F.count("*") - 1).alias("coauthors"))
    x = a.join(view(s, d, "works"), "work_id").join(team, "work_id")
    target = F.when(F.col("scholar_id") % 3 == 0, F.col("cited_by_count") % 4 == 0).otherwise(False)
    evidence = x.select("scholar_id", "work_id", F.col("publication_year").alias("year"), "coauthors", target.alias("at_target"))
    components = a.select("scholar_id", "work_id", (F.col("work_id") % 7).alias("component"))
    return C.primary_cluster(components, evidence, a.filter("scholar_id % 5 = 0 and work_id % 21 = 0").select("scholar_id", "work_id"), view(s, d, "scholars").filter("scholar_id % 3 = 0"))


CLUSTERS = """x as (select a.scholar_id, a.work_id, a.work_id % 7 as component, publication_year as year, author_count - 1 as coauthors, a.scholar_id % 3 = 0 and cited_by_count % 4 = 0 as at_target, a.scholar_id % 5 = 0 and a.work_id % 21 = 0 as anchored from authorships a join works using (work_id)),
    per as (select scholar_id, component, count(*) filter (at_target) as t, sum(coauthors) as mass, count(*) filter (year >= latest - 5) as recent, count(*) as size, bool_or(anchored) as anchored
            from x join (select scholar_id, max(year) as latest from x group by 1) using (scholar_id) group by 1, 2),
    pers as (select *, row_number() over (partition by scholar_id order by t desc, mass desc, recent desc, size desc, component) = 1 as best, bool_or(anchored) over (partition by scholar_id) as any_anchor,
            sum(size) over (partition by scholar_id) < 20 and max(size) over (partition by scholar_id) < 3 and scholar_id % 3 <> 0 as thin from per),
    clusters as (select x.scholar_id, x.work_id, x.component, case when any_anchor then p.anchored else thin or best end as kept, case when any_anchor then 'orcid_anchor' when thin then 'insufficient_evidence' else 'institution_collaborator_cluster' end as method
            from x join pers p using (scholar_id, component))"""
_add("E10_primary_work_cluster", _clusters, f"with {CLUSTERS} select * from clusters")
_add(
    "E11_cluster_summary",
    lambda s, d: C.cluster_summary(_clusters(s, d), view(s, d, "works"), view(s, d, "work_topics")).withColumn("top_topics", F.array_join("top_topics", "|")),
    f"""with {CLUSTERS}, o as (select * from clusters where not kept), t as (select scholar_id, component, topic, count(*) as n from o join (select distinct work_id, topic from work_topics) using (work_id) group by 1, 2, 3 qualify row_number() over (partition by scholar_id, component order by n desc, topic) <= 3),
        tt as (select scholar_id, component, string_agg(topic, '|' order by n desc, topic) as top_topics from t group by 1, 2), n as (select scholar_id, count(*) as total from clusters group by 1),
        z as (select scholar_id, component, count(*) as size, min(publication_year) as year_start, max(publication_year) as year_end from o join works using (work_id) group by 1, 2)
       select scholar_id, cast(row_number() over (partition by scholar_id order by size desc, component) as int) as rank, component, size, year_start, year_end, coalesce(top_topics, '') as top_topics, size >= greatest(5, ceil(total * 0.1)) as large from z join n using (scholar_id) left join tt using (scholar_id, component)""",
)


def _people(s, d):
    sc = view(s, d, "scholars")
    x = sc.alias("a").join(sc.alias("b"), F.col("a.name_key") == F.col("b.name_key"))
    return x.select(
        F.col("a.scholar_id").alias("profile_id"), F.concat(F.lit("p"), F.col("b.scholar_id").cast("string")).alias("pid"), F.col("b.scholar_id").alias("seq"), (F.col("b.scholar_id") % 3 == F.col("a.scholar_id") % 3).alias("exact_name"),
        F.when(F.col("a.institution_id") % 5 == F.col("b.institution_id") % 5, F.col("b.scholar_id") % 6).otherwise(0).alias("institution_matches"), ((F.col("a.scholar_id") == F.col("b.scholar_id")) & F.col("a.orcid").isNotNull()).alias("has_orcid"),
    )


_add(
    "E13_choose_person_record",
    lambda s, d: C.choose_person(_people(s, d)),
    """with c as (select a.scholar_id as profile_id, 'p' || b.scholar_id as pid, b.scholar_id as seq, b.scholar_id % 3 = a.scholar_id % 3 as exact, case when a.institution_id % 5 = b.institution_id % 5 then b.scholar_id % 6 else 0 end as inst, a.scholar_id = b.scholar_id and a.orcid is not null as hit
            from scholars a join scholars b using (name_key)),
        r as (select *, row_number() over (partition by profile_id order by least(inst, 3) desc, seq) as place, count(*) over (partition by profile_id) as n from c where exact),
        h as (select profile_id, pid, 'orcid' as method, place from r where hit and place <= 5 union all select profile_id, pid, case when inst > 0 then 'affiliation' when n = 1 then 'unique_name' end, 100 from r where place = 1),
        b as (select * from h where method is not null qualify row_number() over (partition by profile_id order by place) = 1)
       select profile_id, b.pid, coalesce(b.method, 'identity_unresolved') as method from (select distinct profile_id from c) left join b using (profile_id)""",
)


def _anchored(s, d):
    own = kept(_own(s, d).filter("title is not null").select("scholar_id", "work_id", "title", "publication_year", "cited_by_count", (F.col("scholar_id") * 10 + F.col("work_id") % 3).alias("author_id")))
    other = F.when(F.col("work_id") % 4 == 0, F.concat("title", F.lit(" elsewhere"))).otherwise(F.col("title"))
    articles = own.select("scholar_id", "author_id", F.col("work_id").alias("record_id"), other.alias("title"), F.col("publication_year").alias("year"))
    return C.choose_anchored(own, own.select("scholar_id", "title", "author_id"), articles, own.select("scholar_id", "author_id", ((F.col("scholar_id") + F.col("author_id")) % 3).alias("score")).distinct())


_add(
    "E14_choose_anchored_profile",
    lambda s, d: _anchored(s, d),
    """with own as (select scholar_id, work_id, lower(title) as t, cited_by_count as c, scholar_id * 10 + work_id % 3 as author_id from authorships join works using (work_id) where title is not null),
        a as (select scholar_id, t from (select scholar_id, t, max(c) as c from own group by 1, 2) qualify row_number() over (partition by scholar_id order by c desc, t) <= 2),
        m as (select scholar_id, author_id, count(*) as matched from own where work_id % 4 > 0 and (scholar_id, author_id) in (select (scholar_id, author_id) from own join a using (scholar_id, t)) group by 1, 2)
       select * from m qualify row_number() over (partition by scholar_id order by matched desc, (scholar_id + author_id) % 3 desc, author_id) = 1""",
)


def _affiliation_rows(s, d):
    names = view(s, d, "institutions").select("institution_id", "display_name")
    b = view(s, d, "byline_institutions").join(names, "institution_id")
    worked = b.groupBy(F.col("scholar_id").alias("profile_id"), F.col("display_name").alias("name")).agg(F.collect_set("year").alias("years"), F.count_distinct("work_id").cast("int").alias("work_count")).withColumn("is_current", F.lit(False))
    last = view(s, d, "scholars").join(names.withColumnRenamed("display_name", "name"), "institution_id").select(F.col("scholar_id").alias("profile_id"), F.lower("name").alias("name"), F.array().cast("array<int>").alias("years"), F.lit(0).alias("work_count"), F.lit(True).alias("is_current"))
    return worked.unionByName(last)


AFFILIATED = """b as (select scholar_id as profile_id, lower(i.display_name) as folded, i.display_name as name, year, work_id from byline_institutions join institutions i using (institution_id)),
    l as (select scholar_id as profile_id, lower(i.display_name) as folded from scholars join institutions i using (institution_id)),
    y as (select profile_id, folded, min(name) as name, list_sort(list(distinct year)) as years, count(distinct work_id) as n from b group by 1, 2),
    r as (select profile_id, folded, coalesce(least(name, case when l.folded is not null then folded end), name, folded) as name, coalesce(years, []) as years, coalesce(n, 0) as n, l.folded is not null as cur from y full join l using (profile_id, folded)),
    e as (select *, coalesce(list_max(years), 0) as latest, len(years) as span, n >= 2 or len(list_filter(years, lambda v: list_contains(years, v + 1))) > 0 as ok from r),
    p as (select profile_id, folded from e where ok qualify row_number() over (partition by profile_id order by cur desc, latest desc, n desc, span desc, folded desc) = 1),
    aff as (select e.profile_id, e.name, p.folded is not null as is_primary, e.latest, e.n, e.span, e.folded from e left join p using (profile_id, folded))"""
_add(
    "E15_candidate_affiliations",
    lambda s, d: C.candidate_affiliations(_affiliation_rows(s, d)),
    f"with {AFFILIATED} select profile_id, name, is_primary, cast(case when not is_primary then row_number() over (partition by profile_id, is_primary order by latest desc, n desc, span desc, folded) end as int) as place from aff",
)


def _scored(s, d):
    sc = view(s, d, "scholars")
    i = F.col("scholar_id")
    signal = lambda k: F.struct((i % k).cast("int").alias("shared_works"), (i % 9).cast("int").alias("shared_coauthors"), (i % 4).cast("int").alias("shared_topics"), F.lit(3).alias("shared_institutions"))
    return C.candidate_scores(
        sc.select(
            F.col("name_key").alias("query"), i.alias("id"), i.alias("seq"), "orcid", F.when(i % 3 > 0, "x").alias("primary_institution"), F.when(i % 7 == 0, "high").when(i % 7 < 3, "medium").otherwise("single").alias("confidence"), (i % 10 == 9).alias("provisional"),
            F.when(i % 20 == 9, "t").alias("anchor"), (i % 3).cast("int").alias("published_merged"), F.when(i % 6 == 0, F.array(signal(5))).when(i % 6 == 1, F.array(signal(5), signal(2))).alias("signals"),
        )
    )


SCORES = """b as (select name_key as query, scholar_id as id, orcid, scholar_id as i, case when scholar_id % 7 = 0 then 'high' when scholar_id % 7 < 3 or orcid is not null then 'medium' else 'review' end as g from scholars),
    sc as (select *, case g when 'high' then 90 when 'medium' then 65 else 35 end + case when orcid is not null then 10 else 0 end
            + case when i % 6 < 2 then least(16, i % 5 * 4) + least(12, i % 9 * 2) + least(10, i % 4 * 2) + 8 else 0 end + case when i % 6 = 1 then least(16, i % 2 * 4) + least(12, i % 9 * 2) + least(10, i % 4 * 2) + 8 else 0 end
            + case when i % 6 >= 2 and i % 3 = 2 then 8 else 0 end as raw from b),
    scored as (select query, id, orcid, case when i % 10 = 9 then 'review' else g end as identity_group, cast(case when i % 10 = 9 then least(45, least(100, raw)) else least(100, raw) end as int) as identity_score,
            concat_ws('|', case when orcid is not null then 'orcid' end, case when i % 3 > 0 then 'primary_institution' end, case when i % 20 = 9 then 'publication_anchor' end,
                case when i % 6 = 0 then 'merged_profile' when i % 6 = 1 then 'merged_profile|merged_profile' when i % 3 = 2 then 'published_profile' else 'independent_profile' end) as reasons from sc)"""
_add("E16_candidate_identity_score", lambda s, d: _scored(s, d).drop("seq").withColumn("reasons", F.array_join("reasons", "|")), f"with {SCORES} select * from scored")
_add(
    "E17_rank_candidates",
    lambda s, d: C.rank_candidates(_scored(s, d)).select("query", "id", "place"),
    f"with {SCORES} select query, id, cast(row_number() over (partition by query order by case identity_group when 'high' then 0 when 'medium' then 1 else 2 end, identity_score desc, orcid is null, len(string_split(reasons, '|')) desc, id) as int) as place from scored",
)


def _requests(s, d):
    sc = view(s, d, "scholars")
    # all of one name ask for the same profiles in the same order, and only the first ``most`` of a list are read: these are told per name, before pairs are made
    asked = top(sc, ["name_key"], [F.col("scholar_id")], C.MOST_REQUESTED)
    r = sc.alias("a").hint("merge").join(asked.alias("b"), F.col("a.name_key") == F.col("b.name_key")).select(F.col("a.scholar_id").alias("scholar_id"), F.col("b.scholar_id").alias("requested_id"), F.col("b.scholar_id").alias("seq"), (F.col("b.scholar_id") % 3 == F.col("a.scholar_id") % 3).alias("accepted"))
    counts = view(s, d, "authorships").groupBy(F.col("scholar_id").alias("id")).agg(F.count("*").alias("works_count"))
    return r, sc.filter("scholar_id % 13 > 0").select(F.col("scholar_id").alias("id"), "display_name", "institution_id").join(counts, "id", "left")


_add(
    "E20_identity_audit",
    lambda s, d: (lambda x: x.select("scholar_id", "merged_count", "works_count", *[F.array_join(F.transform(c, lambda v: v.cast("string")), "|").alias(c) for c in ("requested_ids", "merged_ids", "rejected_ids", "institution_ids", "names")]))(C.identity_audit(*_requests(s, d))),
    """with r as (select a.scholar_id, b.scholar_id as rid, b.scholar_id % 3 = a.scholar_id % 3 and b.scholar_id % 13 > 0 as ok, b.display_name, b.institution_id, n from scholars a join scholars b using (name_key) left join (select scholar_id, count(*) as n from authorships group by 1) w on w.scholar_id = b.scholar_id
            qualify row_number() over (partition by a.scholar_id order by b.scholar_id) <= 8)
       select scholar_id, count(*) filter (ok) as merged_count, cast(coalesce(sum(n) filter (ok), 0) as bigint) as works_count, string_agg(rid, '|' order by rid) as requested_ids, coalesce(string_agg(rid, '|' order by rid) filter (ok), '') as merged_ids, coalesce(string_agg(rid, '|' order by rid) filter (not ok), '') as rejected_ids,
        coalesce(array_to_string(list_sort(list(distinct institution_id) filter (ok)), '|'), '') as institution_ids, coalesce(array_to_string(list_sort(list(distinct display_name) filter (ok)), '|'), '') as names from r group by 1""",
)
