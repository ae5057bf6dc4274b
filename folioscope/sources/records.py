"""Typed tables from nested catalogue records (one JSON document per row) and the rules that merge batches into tables."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T

ENTITY = "struct<id:string,display_name:string>"
WORK = (
    "id string, doi string, title string, display_name string, publication_year int, publication_date string, cited_by_count int, type string, language string, "
    f"venue string, referenced_works array<string>, primary_topic {ENTITY}, topics array<{ENTITY}>, "
    f"authorships array<struct<author_position:string,is_corresponding:boolean,author:{ENTITY},institutions:array<{ENTITY}>>>, "
    "abstract_inverted_index map<string,array<int>>"
)
AUTHOR = f"id string, affiliations array<struct<institution:{ENTITY},years:array<int>>>, last_known_institutions array<{ENTITY}>"


def parsed(raw: DataFrame, schema: str = WORK, column: str = "json") -> DataFrame:
    return raw.select(F.from_json(column, schema).alias("r")).filter("r.id is not null").select("r.*")


def works_from_json(raw: DataFrame) -> DataFrame:
    """Typed works: title or display name, plausible year, citations of 0 or more, abstract rebuilt from its index."""
    r = parsed(raw)
    return r.select(
        T.entity_id(F.col("id")).alias("work_id"),
        F.when(T.normalize_doi(F.col("doi")) != "", T.normalize_doi(F.col("doi"))).alias("doi"),
        F.coalesce("title", "display_name").alias("title"),
        F.when(F.col("publication_year").between(1000, 3000), F.col("publication_year")).alias("publication_year"),
        F.col("publication_date").try_cast("date").alias("publication_date"),
        F.greatest(F.lit(0), F.coalesce("cited_by_count", F.lit(0))).alias("cited_by_count"),
        F.col("type").alias("work_type"),
        "language",
        "venue",
        T.abstract_from_inverted(F.col("abstract_inverted_index")).alias("abstract"),
    )


def _institutions(c: Column) -> Column:
    """Distinct ids of the institutions that have one, in their order."""
    ids = F.filter(F.transform(c, lambda i: T.entity_id(i["id"])), lambda i: i != "")
    return F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))


def explode_authorships(raw: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row per work and author with the institutions of the byline; authors without an id are dropped, alias ids (alias_id, scholar_id) replaced, the first of repeated ones kept."""
    rows = parsed(raw).select(T.entity_id(F.col("id")).alias("work_id"), F.posexplode("authorships").alias("position_index", "a")).filter("a.author.id is not null")
    rows = rows.select("work_id", T.entity_id(F.col("a.author.id")).alias("scholar_id"), "position_index", F.col("a.author_position").alias("author_position"), F.coalesce("a.is_corresponding", F.lit(False)).alias("is_corresponding"), _institutions(F.col("a.institutions")).alias("institution_ids"))
    if aliases is not None:
        rows = rows.hint("merge").join(aliases.select(F.col("alias_id").alias("scholar_id"), F.col("scholar_id").alias("main_id")), "scholar_id", "left").withColumn("scholar_id", F.coalesce("main_id", "scholar_id")).drop("main_id")
    best = F.min_by(F.struct("position_index", "author_position", "is_corresponding", "institution_ids"), "position_index")
    return rows.groupBy("work_id", "scholar_id").agg(best.alias("b")).select("work_id", "scholar_id", "b.*")


def explode_topics(raw: DataFrame) -> DataFrame:
    """The primary topic first, then the others, each once per work by id or else by name; confidence 0.9 with an id and 0.7 without one.

    A topic is primary if it has the primary topic's id.
    """
    listed = F.concat(F.array("primary_topic"), F.coalesce("topics", F.array().cast(f"array<{ENTITY}>")))
    r = parsed(raw).select(T.entity_id(F.col("id")).alias("work_id"), T.entity_id(F.col("primary_topic.id")).alias("primary_id"), F.posexplode(listed).alias("pos", "t"))
    named = r.select("work_id", "primary_id", "pos", T.entity_id(F.col("t.id")).alias("topic_id"), F.trim(F.col("t.display_name")).alias("topic")).filter("topic <> ''")
    key = F.when(F.col("topic_id") != "", F.concat(F.lit("id:"), "topic_id")).otherwise(F.concat(F.lit("name:"), F.lower("topic")))
    first = named.groupBy("work_id", key.alias("key")).agg(F.min_by(F.struct("topic", "topic_id", "primary_id"), "pos").alias("f"))
    known = F.col("f.topic_id") != ""
    return first.select("work_id", F.col("f.topic").alias("topic"), (known & (F.col("f.topic_id") == F.col("f.primary_id"))).alias("is_primary"), F.when(known, 0.9).otherwise(0.7).alias("confidence"))


def citation_edges(raw: DataFrame) -> DataFrame:
    """Distinct referenced ids of each work, without itself."""
    r = parsed(raw).select(T.entity_id(F.col("id")).alias("citing_work_id"), F.explode("referenced_works").alias("ref"))
    return r.select("citing_work_id", T.entity_id(F.col("ref")).alias("cited_work_id")).filter("citing_work_id <> cited_work_id").distinct()


def author_affiliations(raw: DataFrame) -> DataFrame:
    """Years, first and last year of every author and institution, current where last known."""
    r = parsed(raw, AUTHOR).select(T.entity_id(F.col("id")).alias("scholar_id"), "affiliations", "last_known_institutions")
    history = r.select("scholar_id", F.explode("affiliations").alias("a")).select("scholar_id", F.col("a.institution.id").alias("institution_id"), F.coalesce("a.years", F.array().cast("array<int>")).alias("years"), F.lit(False).alias("last"))
    last = r.select("scholar_id", F.explode("last_known_institutions").alias("i")).select("scholar_id", F.col("i.id").alias("institution_id"), F.array().cast("array<int>").alias("years"), F.lit(True).alias("last"))
    merged = history.unionByName(last).filter("institution_id is not null").groupBy("scholar_id", T.entity_id(F.col("institution_id")).alias("institution_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))).alias("years"), F.max("last").alias("is_current"))
    return merged.select("scholar_id", "institution_id", "years", F.array_min("years").alias("start_year"), F.array_max("years").alias("end_year"), "is_current")


def _unescaped(c: Column) -> Column:
    """Character references decoded. Spark SQL has no table of the named ones, so this is an Arrow-batched function."""

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if "&" in t else t)

    return decoded(c)


def crossref_records(raw: DataFrame) -> DataFrame:
    """Publisher records: doi, title with character references decoded and then without markup, year by print, online, published, issued, journal, authors, type."""
    date = "struct<`date-parts`:array<array<int>>>"
    schema = (
        f"DOI string, title array<string>, `container-title` array<string>, type string, `published-print` {date}, `published-online` {date}, published {date}, issued {date}, "
        "author array<struct<given:string,family:string>>"
    )
    r = raw.select(F.from_json("json", schema).alias("r")).select("r.*")
    year = F.coalesce(*[F.get(F.get(F.col(f"`{c}`.`date-parts`"), F.lit(0)), F.lit(0)) for c in ("published-print", "published-online", "published", "issued")])
    plain = F.regexp_replace(_unescaped(F.coalesce(F.get("title", F.lit(0)), F.lit(""))), "<[^>]+>", " ")
    names = F.filter(F.transform("author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda n: n != "")
    return r.select(T.normalize_doi(F.col("DOI")).alias("doi"), F.trim(F.regexp_replace(plain, r"[\s\u00A0]+", " ")).alias("title"), year.alias("year"), F.get("container-title", F.lit(0)).alias("journal"), names.alias("authors"), "type")


def incremental_slice(works: DataFrame, state: DataFrame, overlap_days: int = 30) -> DataFrame:
    """Works published since each scholar's last success less the overlap; all where there was none. works: (scholar_id, publication_date, ...)."""
    s = state.select("scholar_id", F.date_sub("last_success", overlap_days).alias("since"))
    return works.join(s, "scholar_id", "left").filter("since is null or publication_date >= since").drop("since")


def merge_works(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by work_id: title, date, year, venue and type keep a verified value unless the batch is verified too; an abstract is never erased; confidence only rises."""
    c, b = current.alias("c"), batch.alias("b")
    j = c.join(b, F.col("c.work_id") == F.col("b.work_id"), "full_outer")
    keep = F.coalesce(F.col("c.verified"), F.lit(False)) & ~F.coalesce(F.col("b.verified"), F.lit(False))
    pick = lambda n: F.when(keep, F.coalesce(f"c.{n}", f"b.{n}")).otherwise(F.coalesce(f"b.{n}", f"c.{n}")).alias(n)
    return j.select(
        F.coalesce("b.work_id", "c.work_id").alias("work_id"), pick("title"), pick("publication_date"), pick("publication_year"), pick("venue"), pick("work_type"), F.coalesce("b.abstract", "c.abstract").alias("abstract"),
        F.greatest(F.coalesce("c.cited_by_count", F.lit(0)), F.coalesce("b.cited_by_count", F.lit(0))).alias("cited_by_count"),
        (F.coalesce("c.verified", F.lit(False)) | F.coalesce("b.verified", F.lit(False))).alias("verified"), F.greatest("c.confidence", "b.confidence").alias("confidence"),
    )


def replace_scope(current: DataFrame, batch: DataFrame, keys: DataFrame, key: str = "scholar_id") -> DataFrame:
    """Rows of the scholars being rebuilt (keys) come from the batch only; all others stay."""
    return current.join(keys.select(key).distinct(), key, "left_anti").unionByName(batch)


def upsert_topics(current: DataFrame, batch: DataFrame) -> DataFrame:
    """One topic per normalised name: the latest display name, the latest known description. Both: (name, description, seq)."""
    every = current.unionByName(batch).withColumn("normalized_name", T.normalize_topic(F.col("name")))
    return every.groupBy("normalized_name").agg(F.max_by("name", "seq").alias("name"), F.max_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("description"))


def publish_profiles(current: DataFrame, new: DataFrame) -> DataFrame:
    """The new profiles (scholar_id, payload, publishable) that may be published, with the next version; the rest of the current ones."""
    ok = new.filter("publishable").join(current.select("scholar_id", F.col("version").alias("last")), "scholar_id", "left")
    fresh = ok.select("scholar_id", "payload", F.sha2("payload", 256).alias("fingerprint"), (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("version"))
    return current.join(fresh.select("scholar_id"), "scholar_id", "left_anti").select("scholar_id", "payload", "fingerprint", "version").unionByName(fresh)


