"""Records of other sources as they come: bibliography XML, researcher-id works, web-search hits; and the upserts of insights and scholars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


RECORD = "_key string, " + ", ".join(f"{name} array<string>" for name in ("author", "title", "year", "ee", "journal", "booktitle"))


def _without_sections(xml: Column) -> Column:
    """CDATA sections as escaped text, comments removed."""
    parts = F.split(xml, r"<!\[CDATA\[", -1)
    section = lambda p: F.replace(F.replace(F.substring_index(p, "]]>", 1), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rest = lambda p: F.substr(p, F.locate("]]>", p) + 3)
    plain = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(section(p), rest(p))), ""))
    plain = F.when(F.contains(xml, F.lit("<![CDATA[")), plain).otherwise(xml)
    return F.when(F.contains(plain, F.lit("<!--")), F.regexp_replace(plain, r"(?s)<!--.*?-->", "")).otherwise(plain)


def _records(entries: Column) -> Column:
    """The first element of each text as a struct, parsed once; within texts & and < stay escaped, so that inner markup can be told from them."""
    twice = F.when(F.contains(entries, F.lit("&#")), F.regexp_replace(F.regexp_replace(entries, r"&#(?:0*38|x0*26);", "&amp;"), r"&#(?:0*60|x0*3[cC]);", "&lt;")).otherwise(entries)
    twice = F.replace(F.replace(twice, F.lit("&amp;"), F.lit("&amp;amp;")), F.lit("&lt;"), F.lit("&amp;lt;"))
    return F.from_xml(twice, RECORD, {"mode": "FAILFAST"})


def _plain(c: Column) -> Column:
    """The text of an element without the markup within it."""
    bare = F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, r"""<(?:[^>"']|"[^"]*"|'[^']*')*>""", "")).otherwise(c)
    return _clean(F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&")))


def _entries(r: DataFrame) -> DataFrame:
    """Publications of records r, the text between <r> and </r>."""
    entry = r.select(_without_sections(F.col("r")).alias("r")).filter(F.rlike("r", F.lit("<[^!?/]"))).select(F.substr("r", F.locate("<", F.col("r"))).alias("r"))
    rows = entry.select(_records(F.col("r")).alias("e")).select("e.*")
    first = lambda c: _plain(F.get(c, F.lit(0)))
    every = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    links = F.filter(F.transform(every(F.col("ee")), lambda x: T.normalize_doi(_plain(x))), lambda x: F.startswith(x, F.lit("10.")))
    authors = F.filter(F.transform(every(F.col("author")), _plain), lambda a: a != "")
    return rows.select(
        _plain(F.col("_key")).alias("key"),
        F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("doi"),
        first(F.col("title")).alias("title"),
        first(F.col("year")).try_cast("int").alias("year"),
        F.when(first(F.col("journal")) != "", first(F.col("journal"))).otherwise(first(F.col("booktitle"))).alias("venue"),
        authors.alias("authors"),
    )


def person_records_xml(raw: DataFrame, column: str = "xml") -> DataFrame:
    """The publications of bibliography persons (one well-formed document per row): (key, doi, title, year, venue, authors).

    The venue is the journal, else the book; the DOI the first link that is one; a record without an entry gives no row. A record that isn't well formed fails.
    """
    return _entries(raw.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<r>(.*?)</r>"), 1)).alias("r")))


def declared_entities(spark: SparkSession, path: str) -> dict[str, str]:
    """The character entities that a DTD declares (some hundred lines): name to text, in which character references may stand."""
    lines = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"<!ENTITY\s+\w+\s+[\"'][^\"']*[\"']\s*>"), 0)).alias("e"))
    return {r.n: r.v for r in lines.select(F.regexp_extract("e", r"ENTITY\s+(\w+)", 1).alias("n"), F.regexp_extract("e", r"[\"']([^\"']*)[\"']", 1).alias("v")).collect()}


def with_entities(text: Column, entities: dict[str, str]) -> Column:
    """Named references of the table replaced; the five of XML, and unknown ones as text, stay."""
    if not entities:
        return text
    table = F.create_map(*[F.lit(x) for pair in entities.items() for x in pair])
    known = "|".join(("amp", "lt", "gt", "quot", "apos"))

    def told(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(\w+);", 1)
        value = F.try_element_at(table, name)
        kept = F.rlike(part, F.lit(rf"^(?:{known}|#\d+|#x[0-9A-Fa-f]+);"))
        return F.when(kept, F.concat(F.lit("&"), part)).when(value.isNotNull(), F.concat(value, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&amp;"), part))

    parts = F.split(text, "&", -1)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), told), ""))


def person_record_files(spark: SparkSession, path: str, entities: dict[str, str] | None = None) -> DataFrame:
    """The publications in bibliography files of any size: a file is read in splits, record by record, so that no document is one row.

    entities: the table of the files' DTD (``declared_entities``). Columns as in ``person_records_xml``; text outside of records is passed over.
    """
    split = spark.read.option("lineSep", "</r>").text(path).filter(F.contains("value", F.lit("<r>")))
    return _entries(split.select(with_entities(F.substring_index("value", "<r>", -1), entities or {}).alias("r")))


def orcid_works(raw: DataFrame) -> DataFrame:
    """(orcid, doi, title, year): the first summary of every group, each (doi, title, year) once per person. raw: (orcid, json)."""
    summary = (
        "struct<title:struct<title:struct<value:string>>,`publication-date`:struct<year:struct<value:string>>,"
        "`external-ids`:struct<`external-id`:array<struct<`external-id-type`:string,`external-id-value`:string>>>>"
    )
    r = raw.select("orcid", F.posexplode(F.from_json("json", f"group array<struct<`work-summary`:array<{summary}>>>")["group"]).alias("pos", "g"))
    s = r.select("orcid", "pos", F.get("g.work-summary", F.lit(0)).alias("s")).filter("s is not null")
    ids = F.transform(
        F.filter(F.col("s.external-ids.external-id"), lambda x: F.lower(x["external-id-type"]) == "doi"), lambda x: T.normalize_doi(x["external-id-value"])
    )
    rows = s.select(
        "orcid", "pos", F.coalesce(F.get(F.filter(ids, lambda d: d != ""), F.lit(0)), F.lit("")).alias("doi"), F.trim(F.coalesce("s.title.title.value", F.lit(""))).alias("title"), F.col("s.publication-date.year.value").try_cast("int").alias("year")
    ).filter("doi <> '' or title <> ''")
    first = rows.groupBy("orcid", "doi", "year", F.lower(_clean(F.col("title"))).alias("folded")).agg(F.min_by("title", "pos").alias("title"))
    return first.select("orcid", "doi", "title", "year")


def search_hits(raw: DataFrame) -> DataFrame:
    """Hits and profile articles of a web search in one form: (kind, id, title, year, cited_by, authors, url); the year is the last one in the free text."""
    hit = "struct<result_id:string,title:string,link:string,publication_info:struct<summary:string,authors:array<struct<name:string>>>,inline_links:struct<cited_by:struct<total:string>>>"
    article = "struct<citation_id:string,title:string,link:string,year:string,cited_by:struct<value:string>>"
    r = raw.select(F.from_json("json", f"organic_results array<{hit}>, articles array<{article}>").alias("r"))
    year = lambda c: F.try_element_at(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), 1), F.lit(-1)).cast("int")
    count = lambda c: F.greatest(F.lit(0), F.coalesce(c.try_cast("int"), F.lit(0)))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    h = r.select(F.explode("r.organic_results").alias("h")).select(
        F.lit("hit").alias("kind"), text(F.col("h.result_id")).alias("id"), text(F.col("h.title")).alias("title"), year(F.col("h.publication_info.summary")).alias("year"), count(F.col("h.inline_links.cited_by.total")).alias("cited_by"),
        F.filter(F.transform(F.coalesce("h.publication_info.authors", F.array().cast("array<struct<name:string>>")), lambda a: text(a["name"])), lambda n: n != "").alias("authors"), text(F.col("h.link")).alias("url"),
    )
    a = r.select(F.explode("r.articles").alias("a")).filter("a.title <> ''").select(
        F.lit("article").alias("kind"), text(F.col("a.citation_id")).alias("id"), text(F.col("a.title")).alias("title"), year(F.col("a.year")).alias("year"), count(F.col("a.cited_by.value")).alias("cited_by"), F.array().cast("array<string>").alias("authors"), text(F.col("a.link")).alias("url")
    )
    return h.unionByName(a)


def upsert_insights(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Insights by work_id: a new one comes in; a known one is replaced only by one that rests on an abstract."""
    names = [c for c in current.columns if c != "work_id"]
    c, b = current.select("work_id", F.struct(*names).alias("old")), batch.select("work_id", F.struct(*names).alias("new"))
    j = c.join(b, "work_id", "full_outer")
    kept = F.when(F.col("new").isNotNull() & (F.col("old").isNull() | F.coalesce("new.based_on_abstract", F.lit(False))), F.col("new")).otherwise(F.col("old"))
    return j.select("work_id", kept.alias("v")).select("work_id", "v.*")


def upsert_scholars(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Scholars by id; counts come from detail rows only (is_detail), never below 0; a known ORCID is not erased. batch: one row per scholar."""
    counts = ("works_count", "cited_by_count", "h_index")
    j = current.alias("c").join(batch.alias("b"), F.col("c.scholar_id") == F.col("b.scholar_id"), "full_outer")
    known, detail = F.col("c.scholar_id").isNotNull(), F.coalesce(F.col("b.is_detail"), F.lit(False))
    new = lambda n: F.greatest(F.coalesce(F.col(f"b.{n}"), F.lit(0)), F.lit(0))
    return j.select(
        F.coalesce("b.scholar_id", "c.scholar_id").alias("scholar_id"), F.coalesce("b.display_name", "c.display_name").alias("display_name"), F.coalesce("b.orcid", "c.orcid").alias("orcid"),
        *[F.when(known & ~detail, F.col(f"c.{n}")).otherwise(new(n)).alias(n) for n in counts],
    )


def scholar_aliases(current: DataFrame, batch: DataFrame) -> DataFrame:
    """(scholar_id, alias): the known aliases and the batch's names and alternatives, each once whatever its case; known spellings stay."""
    new = batch.select("scholar_id", F.posexplode(F.concat(F.array("display_name"), F.coalesce("alternatives", F.array().cast("array<string>")))).alias("pos", "alias"))
    every = current.select("scholar_id", F.lit(-1).alias("pos"), "alias").unionByName(new).withColumn("alias", F.trim("alias")).filter("alias <> ''")
    return every.groupBy("scholar_id", F.lower("alias").alias("folded")).agg(F.min_by("alias", F.struct("pos", "alias")).alias("alias")).select("scholar_id", "alias")
