"""Filters, paging, top-k, first-row rules, fingerprints and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import kept
from .rollups import top
from .scoring import contribution_score  # noqa: F401  the role score is listed with the scalar functions


def list_works(works: DataFrame, authorships: DataFrame, scholar_id: int, sort: str = "citations", year: int | None = None, topic: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a scholar's works with the number of all that pass the filters."""
    own = works.join(authorships.filter(F.col("scholar_id") == scholar_id).select("work_id"), "work_id", "left_semi")
    if year is not None:
        own = own.filter(F.col("publication_year") == year)
    if topic:
        own = own.filter(F.contains(F.lower("title"), F.lit(topic.lower())))
    order = [F.desc_nulls_last("publication_year" if sort == "year" else "cited_by_count"), F.col("work_id")]
    total = own.agg(F.count("*").alias("total"))
    page = own.orderBy(*order).offset(offset).limit(limit).select("work_id", "title", "publication_year", "cited_by_count")
    return page.crossJoin(F.broadcast(total))  # one number


def search_scholars(scholars: DataFrame, totals: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """For each name (case and white space aside) the scholars of that name, most cited first."""
    folded = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    asked = names.select(folded(F.col("name")).alias("name_key")).distinct()
    found = scholars.withColumn("name_key", folded(F.col("name_key"))).join(asked, "name_key").join(totals.select("scholar_id", "citations"), "scholar_id", "left").na.fill(0, ["citations"])
    return top(found, ["name_key"], [F.desc("citations"), F.col("scholar_id")], limit).select("name_key", "scholar_id", "citations", "rank")


def citation_sample(lineage: DataFrame, per_source: int = 2, total: int = 12) -> DataFrame:
    """At most per_source cited works of each citing one, and total of each scholar."""
    few = top(lineage.select("scholar_id", "citing_work_id", "cited_work_id").distinct(), ["scholar_id", "citing_work_id"], [F.col("cited_work_id")], per_source, "k").drop("k")
    return top(few, ["scholar_id"], [F.col("citing_work_id"), F.col("cited_work_id")], total)


def dedup_first(works: DataFrame) -> DataFrame:
    """The first row (by seq) of each doi, or id where there is none."""
    key = F.coalesce("doi", F.col("id").cast("string"))
    return works.groupBy(key.alias("key")).agg(F.min_by(F.struct("doi", "id"), "seq").alias("r")).select("r.*")


def set_compare(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, value, side): shared, left_only or right_only. values: (scholar_id, value)."""
    # a scholar's distinct values go to its pairs as one row
    held = values.distinct().groupBy("scholar_id").agg(F.collect_list(F.struct("value")).alias("v"))
    x = pairs.select("a", "b").distinct()
    for s in ("a", "b"):
        x = x.join(held.select(F.col("scholar_id").alias(s), F.col("v.value").alias(f"v{s}")).hint("merge"), s, "left")
    none = F.array().cast(dict(x.dtypes)["va"])
    a, b = (F.coalesce(c, none) for c in ("va", "vb"))
    sided = lambda found, side: F.transform(found, lambda r: F.struct(r.alias("value"), F.lit(side).alias("side")))
    every = F.concat(sided(F.array_intersect(a, b), "shared"), sided(F.array_except(a, b), "left_only"), sided(F.array_except(b, a), "right_only"))
    return x.select("a", "b", F.explode(every).alias("r")).select("a", "b", "r.value", "r.side")


def fingerprint(rows: DataFrame, key: str, *facts: str) -> DataFrame:
    """SHA-256 over the sorted facts of each key."""
    fact = F.concat_ws("~", *[F.col(c).cast("string") for c in facts])
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(fact)), "|"), 256).alias("fingerprint"))


def check_constraints(works: DataFrame, authorships: DataFrame, citations: DataFrame, collaborations: DataFrame) -> DataFrame:
    """(rule, violations) of keys, ordered pairs, year order and self-citation."""
    repeated = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1")
    checks = {
        "work_key": repeated(works, "work_id"),
        "authorship_key": repeated(authorships, "work_id", "scholar_id"),
        "self_citation": citations.filter("citing_work_id = cited_work_id"),
        "pair_order": collaborations.filter("scholar_a >= scholar_b"),
        "year_order": collaborations.filter("first_year > last_year"),
    }
    out = None
    for rule, bad in checks.items():
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def peer_page(candidates: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of each focus's candidates (focus_id, candidate_id, discovery_rank, ready): ready ones first, and the next offset."""
    # there is a next page if one more candidate is, so no more than that are kept of a focus
    rows = top(candidates, ["focus_id"], [F.desc("ready"), F.col("discovery_rank"), F.col("candidate_id")], offset + limit + 1, "place")
    following = F.when(F.max("place").over(Window.partitionBy("focus_id")) > offset + limit, offset + limit)
    rows = rows.withColumn("next_offset", following)
    return rows.filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def filter_candidates(candidates: DataFrame, institution: str = "", topic: str = "", orcid_only: bool = False) -> DataFrame:
    """Candidates (query, seq, group_rank, institution, topics, orcid, papers, citations) that pass the filters, numbered per query: by identity group, then papers, citations and input order."""
    x = candidates
    if institution:
        x = x.filter(F.contains(F.lower("institution"), F.lit(institution.lower())))
    if topic:
        x = x.filter(F.contains(F.lower("topics"), F.lit(topic.lower())))
    if orcid_only:
        x = x.filter("orcid is not null")
    w = Window.partitionBy("query").orderBy("group_rank", F.desc("papers"), F.desc("citations"), "seq")
    return x.withColumn("place", F.row_number().over(w))


def profile_documents(totals: DataFrame, trend: DataFrame, topics: DataFrame, coauthors: DataFrame, **more: DataFrame) -> DataFrame:
    """(scholar_id, document): one nested JSON profile per scholar from its parts; ``more`` are further parts by name, in order of their columns."""
    listed = lambda df, name, *cols: df.groupBy("scholar_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    x = totals.select("scholar_id", F.struct("papers", "citations", "h_index").alias("metrics"))
    parts = [listed(trend, "trend", "year", "papers", "citations"), listed(topics, "topics", "rank", "topic", "works_count"), listed(coauthors, "coauthors", "rank", "other_id", "name", "papers")]
    parts += [listed(df, name, *[c for c in df.columns if c != "scholar_id"]) for name, df in more.items()]
    x = kept(x)
    for part in parts:  # each is written, so that its shuffle files don't stay while the next one is made
        x = x.join(kept(part).hint("merge"), "scholar_id", "left")
    return x.select("scholar_id", F.to_json(F.struct("metrics", "trend", "topics", "coauthors", *more)).alias("document"))
