"""Who is who, and which records are one work: evidence, decisions, grouping, adjudication of several sources.

Accuracy comes before recall: without evidence nothing is merged, and identity goes by id, never by name alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T

from . import overlaps as O
from .graph import components_of, first_independent, kept

KINDS = ("institution", "work", "coauthor", "topic")


#: Facts without one of which no rule ever merges two profiles.
DECISIVE = ("work", "coauthor")


def pair_evidence(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence for each pair of profiles (profile_id, name_key, orcid, works_count) that have an ORCID, or a name and a work or co-author, in common.

    facts: distinct (profile_id, kind, value), kind one of KINDS. Profiles of one name meet by (name, fact), not by the name: pairs that
    share neither a work nor a co-author are ``insufficient_evidence`` (or ``orcid_conflict``) by every rule; ``undecided_pairs`` counts them
    without making them. Pairs are made in tiles of blocks in order of names (``overlaps``), left_id < right_id.
    """
    named = profiles.select("profile_id", "name_key", F.lower("orcid").alias("orcid"), F.coalesce("works_count", F.lit(0)).cast("string").alias("works"))
    sets = facts.groupBy("profile_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in KINDS])
    x = named.join(sets.hint("merge"), "profile_id", "left").na.fill("", ["name_key"])
    by_name = [F.transform(F.coalesce(F.col(k), F.array().cast("array<string>")), _tagged(k)) for k in DECISIVE]
    by_orcid = F.array_compact(F.array(F.concat(F.lit("o:"), "orcid")))
    meet = F.concat(F.when(F.col("name_key") != "", F.concat(*by_name)).otherwise(F.array().cast("array<string>")), by_orcid)
    parts = {name: [] for name in ("meet", *KINDS)}
    blocks = O.blocked(x.withColumn("meet", meet).withColumnRenamed("profile_id", "id").withColumn("main", F.col("name_key")), parts, ["name_key", "orcid", "works"])
    tiles = O.bounded_tiles(blocks, parts, "meet", {"": 0.0})
    # keys to meet by tell which blocks do; pairs are told by name and facts, so these keys, the longest of all, are not sent
    del parts["meet"]
    blocks = blocks.drop("meet", "meet_ends", "meet_at")

    def kernel(left: dict, right: dict, same: bool) -> pd.DataFrame:
        common = {k: O.shared_counts(left[k], right[k]) for k in KINDS}
        equals = lambda c, none: (left[c][:, None] == right[c][None, :]) & np.array([v != none for v in left[c]], bool)[:, None]
        met = equals("name_key", "") & (sum(common[k] for k in DECISIVE) > 0) | equals("orcid", None)
        i, j = np.nonzero(np.triu(met, 1) if same else met)
        ids, others = left["id"][i], right["id"][j]
        rows = {"left_id": np.minimum(ids, others), "right_id": np.maximum(ids, others)}
        for k in KINDS:
            shared, n, m = common[k][i, j], left[k].sizes[i], right[k].sizes[j]
            rows |= {f"shared_{k}": shared, f"{k}_containment": shared / np.maximum(1, np.minimum(n, m))}
            if k == "institution":
                rows["compact_history"] = np.maximum(n, m) <= 12
        a, b = (np.array(list(s["orcid"]), object)[k] for s, k in ((left, i), (right, j)))
        both = np.array([p is not None and q is not None for p, q in zip(a, b)], bool)
        equal = np.array([p == q for p, q in zip(a, b)], bool)
        works = [np.array(list(s["works"]), np.int64)[k] for s, k in ((left, i), (right, j))]
        return pd.DataFrame(rows | {"same_orcid": both & equal, "orcid_conflict": both & ~equal, "fewest_works": np.minimum(*works)})

    columns = [f"shared_{k} long" for k in KINDS] + [f"{k}_containment double" for k in KINDS] + ["compact_history boolean", "same_orcid boolean", "orcid_conflict boolean", "fewest_works long"]
    return O.in_tiles(blocks, tiles, parts, kernel, "left_id long, right_id long, " + ", ".join(columns))


def _tagged(kind: str):
    """A fact as a meeting key of the profiles of one name."""
    return lambda value: F.concat(F.lit(f"n:{kind}:"), F.col("name_key"), F.lit("|"), value)


def undecided_pairs(profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(name_key, profiles, pairs, with_evidence, without): how many pairs of a name have evidence, and how many are left without, by count alone."""
    named = profiles.filter("name_key is not null").select("profile_id", "name_key")
    n = named.groupBy("name_key").agg(F.count("*").alias("profiles"))
    side = lambda s: named.select(F.col("profile_id").alias(f"{s}_id"), F.col("name_key").alias(f"{s}_name"))
    met = evidence.select("left_id", "right_id").hint("merge").join(side("left"), "left_id").hint("merge").join(side("right"), "right_id")
    met = met.filter("left_name = right_name").groupBy(F.col("left_name").alias("name_key")).agg(F.count("*").alias("with_evidence"))
    pairs = (F.col("profiles") * (F.col("profiles") - 1) / 2).cast("long")
    return n.join(met.hint("merge"), "name_key", "left").na.fill(0, ["with_evidence"]).withColumn("pairs", pairs).withColumn("without", F.col("pairs") - F.col("with_evidence")).select("name_key", "profiles", "pairs", "with_evidence", "without")


def identity_decision(evidence: DataFrame) -> DataFrame:
    """Adds reason, confidence and merge by rules in order of strength."""
    c = F.col
    works = (c("shared_work") >= 2) & (c("work_containment") >= 0.25) & ((c("shared_institution") > 0) | (c("shared_coauthor") >= 2))
    context = (
        (c("shared_institution") > 0) & c("compact_history") & (c("shared_coauthor") >= 3) & (c("shared_topic") >= 2)
        & (((c("coauthor_containment") >= 0.40) & (c("topic_containment") >= 0.35)) | ((c("coauthor_containment") >= 0.25) & (c("topic_containment") >= 0.45)))
    )
    small = (c("shared_institution") > 0) & c("compact_history") & (c("fewest_works") <= 3) & (c("shared_coauthor") >= 2) & (c("coauthor_containment") >= 0.50) & (c("shared_topic") >= 1)
    reason = (
        F.when(c("same_orcid"), "same_orcid").when(works, "shared_works").when(c("orcid_conflict"), "orcid_conflict").when(context, "shared_context")
        .when(small, "small_split_profile").otherwise("insufficient_evidence")
    )
    strong = c("reason").isin("same_orcid", "shared_works", "shared_context")
    return evidence.withColumn("reason", reason).withColumn("confidence", F.when(strong, "high").when(c("reason") == "small_split_profile", "medium").otherwise("low")).withColumn("merge", strong | (c("reason") == "small_split_profile"))


def author_groups(profiles: DataFrame, decisions: DataFrame) -> DataFrame:
    """(profile_id, group_id): in the order of profile_id, each profile not yet taken takes the later ones that match it.

    A match of a match is not taken: this is a star, not a component. The profiles that take are the first independent set of the merges,
    found in rounds (``graph.first_independent``); every other one goes to the least of them that it matches.
    """
    merges = kept(decisions.filter("merge").select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).distinct())
    heads = first_independent(merges)
    taken = merges.hint("merge").join(heads.filter("first").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("profile_id")).agg(F.min("a").alias("group_id"))
    return profiles.select("profile_id").hint("merge").join(taken, "profile_id", "left").select("profile_id", F.coalesce("group_id", "profile_id").alias("group_id"))


def combine_groups(groups: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per group its main profile (most citations, then works), sums, greatest h-index and ordered ids. profiles: (profile_id, citations, works_count, h_index)."""
    x = groups.join(profiles, "profile_id")
    return x.groupBy("group_id").agg(
        F.max_by("profile_id", F.struct("citations", "works_count", (-F.col("profile_id")).alias("first"))).alias("main_id"), F.sum("works_count").alias("works_count"), F.sum("citations").alias("citations"),
        F.max("h_index").alias("h_index"), F.array_sort(F.collect_list("profile_id")).alias("merged_ids"),
    )


def canonicalise(authorships: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias ids (alias_id, main_id) replaced; of one author's rows within a work the first position stays."""
    x = authorships.join(aliases.withColumnRenamed("alias_id", "scholar_id"), "scholar_id", "left").withColumn("scholar_id", F.coalesce("main_id", "scholar_id"))
    return x.groupBy("work_id", "scholar_id").agg(F.min("position_index").alias("position_index"))


def dedup_bridge(records: DataFrame) -> DataFrame:
    """(id, work_id): records (id, keys) that are connected through any shared key are one work, named by its least id."""
    keys = records.select("id", F.explode("keys").alias("key")).filter("key is not null")
    return components_of(records, keys).select("id", F.col("component").alias("work_id"))


def _latest(records: DataFrame, key: Column) -> DataFrame:
    """Of each key the record with the greatest seq."""
    rest = [c for c in records.columns]
    return records.withColumn("key", key).filter("key is not null").groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("r"))


def _title_year(title: str, year: str) -> Column:
    t = T.normalize_title(F.col(title))
    return F.when(t != "", F.concat_ws("|", t, F.coalesce(F.col(year), F.lit(0)).cast("string")))


def _doi(c: str) -> Column:
    d = T.normalize_doi(F.col(c))
    return F.when(d != "", d)


def adjudicate(works: DataFrame, publisher: DataFrame, bibliography: DataFrame, search: DataFrame) -> DataFrame:
    """Works with the fields of the other sources, where each field comes from, and whether any source confirms them.

    The publisher is found by DOI; the others by DOI, else by title and year. Publisher title, year and journal win; the bibliography fills a
    missing journal. Of repeated records the last (greatest seq) counts.
    """
    w = works.withColumn("doi_key", _doi("doi")).withColumn("title_key", _title_year("title", "publication_year"))

    def found(df: DataFrame, records: DataFrame, name: str, by_title: bool) -> DataFrame:
        by_doi = _latest(records, _doi("doi")).select(F.col("key").alias("doi_key"), F.col("r").alias(f"{name}_doi"))
        df = df.join(by_doi, "doi_key", "left")
        if not by_title:
            return df.withColumnRenamed(f"{name}_doi", name)
        titles = _latest(records, _title_year("title", "publication_year")).select(F.col("key").alias("title_key"), F.col("r").alias(f"{name}_title"))
        return df.join(titles, "title_key", "left").withColumn(name, F.coalesce(f"{name}_doi", f"{name}_title")).drop(f"{name}_doi", f"{name}_title")

    x = found(found(found(w, publisher, "p", False), bibliography, "b", True), search, "s", True)
    known = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    publisher_title, journal = known("p.title"), known("p.journal")
    title_conflict = publisher_title & known("title") & (T.normalize_title(F.col("p.title")) != T.normalize_title(F.col("title")))
    year_conflict = F.coalesce(F.col("p.publication_year") != F.col("publication_year"), F.lit(False))
    return x.select(
        "work_id",
        F.col("doi_key").alias("doi"),
        F.when(publisher_title, F.col("p.title")).otherwise(F.col("title")).alias("title"),
        F.coalesce("p.publication_year", "publication_year").alias("publication_year"),
        F.when(journal, F.col("p.journal")).when(known("venue"), F.col("venue")).otherwise(F.col("b.journal")).alias("journal"),
        F.when(publisher_title, "publisher").otherwise("catalogue").alias("title_source"),
        F.when(journal, "publisher").when(known("venue"), "catalogue").when(known("b.journal"), "bibliography").alias("journal_source"),
        F.when(F.col("p").isNotNull() | F.col("b").isNotNull() | F.col("s").isNotNull(), "verified").when(F.col("doi_key").isNotNull(), "doi_unverified").otherwise("no_doi").alias("verification_status"),
        F.col("p").isNotNull().alias("publisher_verified"),
        F.array_compact(
            F.array(
                F.when(title_conflict, F.struct(F.lit("title").alias("field"), F.col("title").alias("catalogue"), F.col("p.title").alias("publisher"))),
                F.when(year_conflict, F.struct(F.lit("publication_year").alias("field"), F.col("publication_year").cast("string").alias("catalogue"), F.col("p.publication_year").cast("string").alias("publisher"))),
            )
        ).alias("conflicts"),
    )


def source_conflicts(adjudicated: DataFrame) -> DataFrame:
    return adjudicated.select("work_id", F.explode("conflicts").alias("c")).select("work_id", "c.*")


def data_audit(adjudicated: DataFrame, authorships: DataFrame) -> DataFrame:
    """Per scholar: works with a DOI, verified by the publisher and by any source, conflicts, ratio and status."""
    own = authorships.select("scholar_id", "work_id").distinct().join(adjudicated, "work_id")
    n = own.groupBy("scholar_id").agg(
        F.count("*").alias("works"), F.count("doi").alias("with_doi"), F.count_if("publisher_verified").alias("publisher_verified"),
        F.count_if(F.col("verification_status") == "verified").alias("multi_source"), F.sum(F.size("conflicts")).alias("conflicts"),
    )
    ratio = F.col("multi_source") / F.col("works")
    return n.withColumn("ratio", F.round(ratio, 4)).withColumn("status", F.when(ratio >= 0.7, "sufficient").when(F.col("multi_source") > 0, "partial").otherwise("attention"))


def match_known(records: DataFrame, works: DataFrame) -> DataFrame:
    """External records that match a known work by DOI, or by title and year: two equi-joins, not one join with OR."""
    w = works.select(_doi("doi").alias("doi_key"), _title_year("title", "publication_year").alias("title_key"))
    r = records.withColumn("doi_key", _doi("doi")).withColumn("title_key", _title_year("title", "publication_year"))
    return r.join(w.select("doi_key").distinct(), "doi_key", "left_semi").unionByName(r.join(w.select("title_key").distinct(), "title_key", "left_semi")).drop("doi_key", "title_key").distinct()


def resolve_ids(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Batch rows (seq, doi, catalogue_id) with their work id: by DOI first, else by catalogue id, else new. known: (identifier_type, identifier_value, work_id)."""
    ids = known.groupBy("identifier_type", "identifier_value").agg(F.min("work_id").alias("work_id"))
    of = lambda kind, key: ids.filter(F.col("identifier_type") == kind).select(F.col("identifier_value").alias(key), F.col("work_id").alias(f"by_{kind}"))
    x = batch.withColumn("doi_key", _doi("doi")).join(of("doi", "doi_key"), "doi_key", "left").join(of("catalogue", "catalogue_id"), "catalogue_id", "left")
    new = F.concat(F.lit("new:"), F.coalesce("doi_key", F.col("catalogue_id")))
    return x.select("seq", F.coalesce(F.col("by_doi").cast("string"), F.col("by_catalogue").cast("string"), new).alias("work_id"))


def backfill_citations(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (citing_work_id, cited_source_id) with the cited work where it is known by now, never the citing one."""
    ids = known.select(F.col("identifier_value").alias("cited_source_id"), F.col("work_id").alias("cited_work_id"))
    x = edges.join(ids, "cited_source_id", "left")
    return x.select("citing_work_id", "cited_source_id", F.when(F.col("cited_work_id") != F.col("citing_work_id"), F.col("cited_work_id")).alias("cited_work_id"))


def work_components(works: DataFrame, authorships: DataFrame) -> DataFrame:
    """(scholar_id, work_id, component): per scholar, works linked by one DOI, one title (and year, where both are known), or a common co-author."""
    own = kept(authorships.select("scholar_id", "work_id").distinct())
    titled = works.select("work_id", "publication_year", F.explode(F.array_compact(F.array(F.concat(F.lit("d:"), _doi("doi")), F.when(T.normalize_title(F.col("title")) != "", F.concat(F.lit("t:"), T.normalize_title(F.col("title"))))))).alias("k"))
    # all authors of a work in one row: co-authors are made from it, no row meets another
    listed = own.groupBy("work_id").agg(F.collect_list("scholar_id").alias("s"))
    pairs = listed.filter("size(s) > 1").select("work_id", F.explode("s").alias("scholar_id"), "s").select("scholar_id", "work_id", F.explode("s").alias("other"))
    others = pairs.filter("scholar_id <> other").select("scholar_id", F.col("work_id").alias("id"), F.concat(F.lit("c:"), "other").alias("key"))
    # titles link within a year; a work of unknown year links all of its title
    undated = F.max(F.col("publication_year").isNull()).over(Window.partitionBy("scholar_id", "k"))
    named = own.join(titled.hint("merge"), "work_id").withColumn("undated", undated)
    yearly = F.when(F.startswith("k", F.lit("t:")) & ~F.col("undated"), F.concat_ws(":", "k", F.col("publication_year").cast("string"))).otherwise(F.col("k"))
    keys = kept(named.select("scholar_id", F.col("work_id").alias("id"), yearly.alias("key")).unionByName(others))
    # a node is a work as seen by one scholar, so scholars are scopes and works ids
    found = components_of(own.select("scholar_id", F.col("work_id").alias("id")), keys, "scholar_id")
    return found.select("scholar_id", F.col("id").alias("work_id"), "component")


def assess_quality(profiles: DataFrame, previous: DataFrame) -> DataFrame:
    """Flags of each profile and whether it may be published.

    profiles: (scholar_id, expected, fetched, excluded, collected, complete, errors, has_payload, evidence_ok, n_countries, n_topics, top_weight, name_collision);
    previous: (scholar_id, papers).
    """
    x = profiles.join(previous.select("scholar_id", F.col("papers").alias("before")), "scholar_id", "left").na.fill(0, ["before"])
    c = F.col
    collected = F.when(c("collected") > 0, c("collected")).otherwise(c("expected"))
    expected = F.greatest(F.lit(0), F.least("expected", collected) - c("excluded"))
    gap = F.greatest(F.lit(5), F.floor(expected * 0.2).cast("long"))
    blocking = F.array_compact(
        F.array(
            F.when(~c("complete"), "partial_works_fetch"), F.when(c("errors") > 0, "workflow_errors"), F.when(~c("has_payload"), "missing_payload"), F.when(~c("evidence_ok"), "evidence_review_failed"),
            F.when((expected > 0) & (expected - c("fetched") > gap), "catalogue_count_mismatch"), F.when((c("before") >= 10) & (c("fetched") < c("before") * 0.8) & (c("excluded") == 0), "suspicious_paper_drop"),
        )
    )
    advisory = F.array_compact(
        F.array(
            F.when(c("excluded") > 0, "identity_conservative_exclusion"), F.when(c("n_countries") > 1, "institution_country_conflict"),
            F.when((c("n_topics") >= 8) & (c("top_weight") < 0.25), "broad_topic_span"), F.when(c("name_collision"), "coauthor_name_collision"),
        )
    )
    return x.select("scholar_id", (F.size(blocking) == 0).alias("publishable"), F.concat(blocking, advisory).alias("flags"))
