"""Registered queries of the scalar functions, filters, top-k and set operations: each applied to a whole column and summed up per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import lookups as L
from folioscope.operators import rollups as R

from .fixtures import oracle, view

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = oracle(sql)


def _counted(df, c, name="value"):
    return df.select(c.alias(name)).groupBy(name).agg(F.count("*").alias("n"))


_add(
    "B1_normalize_doi",
    lambda s, d: _counted(view(s, d, "works").withColumn("doi", F.when(F.col("work_id") % 3 == 0, F.concat(F.lit(" DOI: "), F.substring("doi", 17, 50))).otherwise(F.col("doi"))), T.normalize_doi(F.col("doi")), "doi"),
    """with w as (select case when work_id % 3 = 0 then ' DOI: ' || substring(doi, 17, 50) else doi end as doi from works)
       select trim(regexp_replace(regexp_replace(lower(trim(coalesce(doi, ''))), '^https?://(?:dx\\.)?doi\\.org/', ''), '^doi:\\s*', '')) as doi, count(*) as n from w group by 1""",
)
_add("B2_normalize_orcid", lambda s, d: _counted(view(s, d, "scholars").withColumn("u", F.concat(F.lit("https://orcid.org/"), "orcid")), T.normalize_orcid(F.col("u")), "orcid"), "select coalesce(orcid, '') as orcid, count(*) as n from scholars group by 1")
_add("B3_normalize_title", lambda s, d: _counted(view(s, d, "works").withColumn("t", F.concat(F.lit("«"), "title", F.lit("»: "), "venue")), T.normalize_title(F.col("t")), "title"), """select trim(regexp_replace(lower(coalesce('«' || title || '»: ' || venue, '')), '[^a-z0-9一-鿿]+', ' ', 'g')) as title, count(*) as n from works group by 1""")
_add(
    "B4_name_keys",
    lambda s, d: view(s, d, "scholars").select("scholar_id", F.explode(T.name_keys(F.concat_ws(" ", "display_name", "name_key"))).alias("key")).groupBy("key").agg(F.count("*").alias("n")),
    """with t as (select scholar_id, regexp_extract_all(lower(display_name || ' ' || name_key), '[a-z0-9㐀-鿿]+') as t from scholars),
        k as (select scholar_id, unnest(list_distinct([array_to_string(t, ' '), array_to_string(list_sort(t), ' '), array_to_string(t, '')])) as key from t) select key, count(*) as n from k group by 1""",
)
_add(
    "B5_topic_key",
    lambda s, d: _counted(view(s, d, "works").withColumn("t", F.concat("title", F.lit(" Studies Glasses boxes ties"))), T.topic_key(F.col("t")), "key"),
    """with t as (select regexp_extract_all(lower(coalesce(title || ' Studies Glasses boxes ties', '')), '[a-z0-9]+') as t from works)
       select array_to_string(list_transform(t, lambda x: case when len(x) > 4 and ends_with(x, 'ies') then x[:-4] || 'y' when len(x) > 4 and ends_with(x, 's') and not ends_with(x, 'ss') then x[:-2] else x end), ' ') as key, count(*) as n from t group by 1""",
)
_add("B6_normalize_topic", lambda s, d: _counted(view(s, d, "work_topics").withColumn("t", F.concat(F.lit("  "), F.upper("topic"), F.lit(" \t x "))), T.normalize_topic(F.col("t")), "topic"), "select lower(topic) || ' x' as topic, count(*) as n from work_topics group by 1")
_add("B7_entity_id", lambda s, d: _counted(view(s, d, "works").withColumn("u", F.concat("doi", F.lit("/"))), T.entity_id(F.col("u")), "id"), "select coalesce(string_split(doi, '/')[-1], '') as id, count(*) as n from works group by 1")
_add(
    "B8_years",
    lambda s, d: view(s, d, "byline_institutions").groupBy("scholar_id", "institution_id").agg(F.collect_list(F.when(F.col("work_id") % 11 == 0, F.lit(9999)).otherwise(F.col("year"))).alias("y")).select("scholar_id", "institution_id", F.array_join(T.clean_years(F.col("y")), "|").alias("years"), T.has_consecutive_years(T.clean_years(F.col("y"))).alias("consecutive")),
    """with y as (select scholar_id, institution_id, case when work_id % 11 = 0 then 9999 else year end as y from byline_institutions),
        l as (select scholar_id, institution_id, coalesce(list(distinct y) filter (y between 1800 and 2100), []) as ys from y group by 1, 2)
       select scholar_id, institution_id, array_to_string(list_reverse_sort(ys), '|') as years, len(list_filter(ys, lambda a: list_contains(ys, a + 1))) > 0 as consecutive from l""",
)
_add(
    "B10_tokens",
    lambda s, d: view(s, d, "abstracts").select(F.explode(T.tokens(F.col("abstract"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")),
    "with t as (select unnest(list_distinct(regexp_extract_all(lower(abstract), '[a-z0-9][a-z0-9_-]{2,}'))) as token from abstracts) select token, count(*) as n from t group by 1",
)
_add(
    "B13_sentences",
    lambda s, d: view(s, d, "abstracts").select("work_id", F.size(T.sentences(F.col("abstract"))).cast("long").alias("n"), F.coalesce(F.get(T.sentences(F.col("abstract")), F.lit(0)), F.lit("")).alias("first")),
    None,
)
CUES = (["the "], ["ing "], ["tion "])
_add(
    "B14_abstract_insight",
    lambda s, d: view(s, d, "abstracts").select("work_id", T.abstract_insight(F.col("abstract"), *CUES).alias("i")).select("work_id", "i.*"),
    None,
)
KEYWORDS = {"method": ["ring", "green"], "system": ["economy", "widget"], "data": ["promo", "red"], "application": ["standard", "blue"]}
_add(
    "B15_work_categories",
    lambda s, d: view(s, d, "authorships").select("scholar_id", "work_id").join(view(s, d, "works"), "work_id").select("scholar_id", F.explode(T.categories(F.col("title"), KEYWORDS)).alias("category")).groupBy("scholar_id", "category").agg(F.count("*").alias("n")),
    "with k(category, word) as (values "
    + ", ".join(f"('{c}', '{w}')" for c, words in KEYWORDS.items() for w in words)
    + "), h as (select distinct scholar_id, work_id, category from authorships join works using (work_id) join k on contains(lower(title), word)) select scholar_id, category, count(*) as n from h group by 1, 2",
)
_add(
    "B16_contribution_score",
    lambda s, d: view(s, d, "authorships").select("scholar_id", L.contribution_score(F.col("author_count"), F.col("author_position"), F.col("position_index"), F.col("is_corresponding")).alias("score")).groupBy("scholar_id", "score").agg(F.count("*").alias("n")),
    """select scholar_id, cast(case when author_count <= 1 or is_corresponding then 1 when author_position = 'first' then 0.95 when author_position = 'last' then 0.9 else 0.45 end as double) as score, count(*) as n from authorships group by 1, 2""",
)
_add(
    "B22_fingerprint",
    lambda s, d: L.fingerprint(view(s, d, "authorships"), "scholar_id", "work_id", "author_position"),
    "select scholar_id, sha256(array_to_string(list_sort(list(work_id || '~' || author_position)), '|')) as fingerprint from authorships group by 1",
)
_add("B23_visitor_hash", lambda s, d: view(s, d, "events").select("event_id", T.visitor_hash(F.col("user_id")).alias("hash")).withColumn("label", T.visitor_label(F.col("hash"))), "select event_id, sha256(cast(user_id as varchar)) as hash, upper(sha256(cast(user_id as varchar))[1:6]) as label from events")
_add(
    "B25_work_matches_topic",
    lambda s, d: view(s, d, "works").join(view(s, d, "work_topics").groupBy("work_id").agg(F.collect_set("topic").alias("labels")), "work_id").filter(T.work_matches_topic(F.col("title"), F.col("labels"), "Red Widget")).select("work_id", "title"),
    "select distinct work_id, title from works join work_topics using (work_id) where contains(lower(title), 'red widget') or lower(topic) = 'red widget'",
)
_add("B26_entity_display_name", lambda s, d: _counted(view(s, d, "works").withColumn("t", F.concat(F.lower("title"), F.lit(" nlp"))), T.entity_display_name(F.col("t")), "name"), "select array_to_string(list_transform(string_split(lower(title) || ' nlp', ' '), lambda t: case when t = 'nlp' then 'NLP' else upper(t[1]) || t[2:] end), ' ') as name, count(*) as n from works group by 1")
_add(
    "C1_list_works",
    lambda s, d: L.list_works(view(s, d, "works"), view(s, d, "authorships"), 3, sort="year", year=None, limit=20, offset=10),
    """select work_id, title, publication_year, cited_by_count, count(*) over () as total from works where work_id in (select work_id from authorships where scholar_id = 3) order by publication_year desc nulls last, work_id limit 20 offset 10""",
)
_add(
    "C2_search_scholars_by_name",
    lambda s, d: L.search_scholars(view(s, d, "scholars"), R.citation_summary(view(s, d, "works"), view(s, d, "authorships")), view(s, d, "scholars").filter("scholar_id < 5").select(F.upper("name_key").alias("name"))),
    """with c as (select scholar_id, sum(cited_by_count) as citations from authorships join works using (work_id) group by 1), q as (select distinct name_key from scholars where scholar_id < 5)
       select name_key, scholar_id, cast(coalesce(citations, 0) as bigint) as citations, cast(row_number() over (partition by name_key order by coalesce(citations, 0) desc, scholar_id) as int) as rank from scholars join q using (name_key) left join c using (scholar_id) qualify rank <= 50""",
)
_add(
    "C4_top_cited_works",
    lambda s, d: R.top(view(s, d, "authorships").select("scholar_id", "work_id").join(view(s, d, "works").select("work_id", "cited_by_count"), "work_id"), ["scholar_id"], [F.desc("cited_by_count"), F.col("work_id")], 50),
    "select scholar_id, work_id, cited_by_count, cast(row_number() over (partition by scholar_id order by cited_by_count desc, work_id) as int) as rank from authorships join works using (work_id) qualify rank <= 50",
)
_add(
    "C5_works_per_scholar_cap",
    lambda s, d: R.top(view(s, d, "authorships").select("scholar_id", "work_id").join(view(s, d, "works").select("work_id", "publication_year", "cited_by_count"), "work_id"), ["scholar_id"], [F.desc_nulls_last("publication_year"), F.desc("cited_by_count"), F.col("work_id")], 300),
    "select scholar_id, work_id, publication_year, cited_by_count, cast(row_number() over (partition by scholar_id order by publication_year desc nulls last, cited_by_count desc, work_id) as int) as rank from authorships join works using (work_id) qualify rank <= 300",
)
_add(
    "C7_internal_citation_sample",
    lambda s, d: L.citation_sample(R.citation_lineage(view(s, d, "works"), view(s, d, "authorships"), view(s, d, "work_citations"), k=1_000_000)),
    """with e as (select distinct a.scholar_id, citing_work_id, cited_work_id from work_citations join authorships a on a.work_id = citing_work_id join authorships b on b.work_id = cited_work_id and a.scholar_id = b.scholar_id),
        p as (select *, row_number() over (partition by scholar_id, citing_work_id order by cited_work_id) as k from e), r as (select scholar_id, citing_work_id, cited_work_id, cast(row_number() over (partition by scholar_id order by citing_work_id, cited_work_id) as int) as rank from p where k <= 2)
       select * from r where rank <= 12""",
)
_add(
    "I2_related_scope",
    lambda s, d: view(s, d, "focus").select("scholar_id").union(R.symmetrise(R.coauthor_pairs(view(s, d, "authorships"))).hint("merge").join(view(s, d, "focus").withColumnRenamed("scholar_id", "other_id"), "other_id", "left_semi").select("scholar_id")).distinct(),
    "select scholar_id from focus union select b.scholar_id from authorships a join authorships b on a.work_id = b.work_id and a.scholar_id <> b.scholar_id where a.scholar_id in (select scholar_id from focus)",
)
_add(
    "I3_set_compare",
    lambda s, d: L.set_compare(view(s, d, "focus").select(F.col("scholar_id").alias("a"), (F.col("scholar_id") + 1).alias("b")), R.dealt(R.labels_of(view(s, d, "authorships"), view(s, d, "work_topics"))).select("scholar_id", F.explode("topics").alias("value"))),
    """with p as (select scholar_id as a, scholar_id + 1 as b from focus), v as (select distinct scholar_id, topic as value from authorships join work_topics using (work_id)),
        x as (select a, b, value, true as l, false as r from p join v on v.scholar_id = a union all select a, b, value, false, true from p join v on v.scholar_id = b)
       select a, b, value, case when bool_or(l) and bool_or(r) then 'shared' when bool_or(l) then 'left_only' else 'right_only' end as side from x group by 1, 2, 3""",
)
_add(
    "E7_dedup_works_first",
    lambda s, d: L.dedup_first(view(s, d, "works").select(F.when(F.col("work_id") % 4 == 0, F.concat(F.lit("k"), F.col("work_id") % 97)).otherwise(F.col("doi")).alias("doi"), F.col("work_id").alias("id"), F.col("work_id").alias("seq"))),
    "with w as (select case when work_id % 4 = 0 then 'k' || (work_id % 97) else doi end as doi, work_id as id, work_id as seq from works) select doi, id from w qualify row_number() over (partition by coalesce(doi, cast(id as varchar)) order by seq) = 1",
)
_add(
    "Q4_check_constraints",
    lambda s, d: L.check_constraints(view(s, d, "works"), view(s, d, "authorships"), view(s, d, "work_citations"), R.collaborations(view(s, d, "works"), view(s, d, "authorships"))),
    """select 'work_key' as rule, (select count(*) from (select work_id from works group by 1 having count(*) > 1)) as violations union all select 'authorship_key', (select count(*) from (select work_id, scholar_id from authorships group by 1, 2 having count(*) > 1))
       union all select 'self_citation', (select count(*) from work_citations where citing_work_id = cited_work_id) union all select 'pair_order', 0 union all select 'year_order', 0""",
)
_add(
    "D5_restrict_to_published",
    lambda s, d: view(s, d, "authorships").join(view(s, d, "works").filter("publication_year >= 1998").select("work_id"), "work_id", "left_semi").select("work_id", "scholar_id"),
    "select work_id, scholar_id from authorships where work_id in (select work_id from works where publication_year >= 1998)",
)
_add(
    "D6_drop_vanished_authorships",
    lambda s, d: view(s, d, "authorships").join(view(s, d, "works").filter("work_id % 7 = 0").select("work_id"), "work_id", "left_anti").select("work_id", "scholar_id"),
    "select work_id, scholar_id from authorships where work_id not in (select work_id from works where work_id % 7 = 0)",
)
