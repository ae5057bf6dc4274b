"""Candidates of a name: what identifies an author, which works are theirs, where they work, and in which order candidates are shown.

The bases, bonuses and limits of scores are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T

from .graph import kept
from .rollups import dealt


def fingerprints(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, bylines: DataFrame, k: int = 100) -> DataFrame:
    """(scholar_id, kind, value, works): what the k most cited works of each scholar have: works, co-authors, topics, institutions, years."""
    own = authorships.select("scholar_id", "work_id").distinct().join(works, "work_id")
    order = Window.partitionBy("scholar_id").orderBy(F.desc("cited_by_count"), "work_id")
    top = own.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("scholar_id", "work_id", "doi", "publication_year")
    fact = lambda df, kind, value: df.select("scholar_id", "work_id", F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    others = authorships.select("work_id", F.col("scholar_id").alias("other"))
    facts = (
        fact(top, "work", F.coalesce("doi", F.col("work_id").cast("string")))
        .unionByName(fact(top.join(others, "work_id").filter("other <> scholar_id"), "coauthor", F.col("other")))
        .unionByName(fact(top.join(work_topics, "work_id"), "topic", F.col("topic")))
        .unionByName(fact(top.join(bylines.select("scholar_id", "work_id", "institution_id"), ["scholar_id", "work_id"]), "institution", F.col("institution_id")))
        .unionByName(fact(top, "year", F.col("publication_year")))
    )
    return facts.filter("value is not null").groupBy("scholar_id", "kind", "value").agg(F.count_distinct("work_id").alias("works"))


def fingerprint_affiliations(works: DataFrame, authorships: DataFrame, bylines: DataFrame, k: int = 100) -> DataFrame:
    """(scholar_id, place, institution_id, name, years, work_count): where the k most cited works of each scholar were written, latest first.

    bylines: (scholar_id, work_id, institution_id, name); one row per institution id (or name, where it has no id), years newest first; those without a name are left
    out. Order: latest year, number of works, name, all descending.
    """
    own = authorships.select("scholar_id", "work_id").distinct().join(works.select("work_id", "doi", "publication_year", "cited_by_count"), "work_id")
    order = Window.partitionBy("scholar_id").orderBy(F.desc("cited_by_count"), "work_id")
    top = own.withColumn("sample", F.row_number().over(order)).filter(F.col("sample") <= k)
    rows = top.join(bylines.hint("merge"), ["scholar_id", "work_id"]).withColumn("name", F.trim(F.coalesce("name", F.lit("")))).filter("name <> ''")
    key = F.lower(F.trim(F.coalesce(F.col("institution_id").cast("string"), F.col("name"))))
    found = rows.groupBy("scholar_id", key.alias("key")).agg(
        F.min_by("institution_id", "sample").alias("institution_id"), F.min_by("name", "sample").alias("name"), T.clean_years(F.collect_set("publication_year")).alias("years"),
        F.count_distinct(F.coalesce("doi", F.col("work_id").cast("string"))).alias("work_count"),
    )
    latest = Window.partitionBy("scholar_id").orderBy(F.desc(F.coalesce(F.array_max("years"), F.lit(0))), F.desc("work_count"), F.desc(F.lower("name")))
    return found.select("scholar_id", F.row_number().over(latest).alias("place"), "institution_id", "name", "years", "work_count")


def primary_cluster(components: DataFrame, evidence: DataFrame, anchors: DataFrame, targets: DataFrame | None = None, least: int = 20) -> DataFrame:
    """(scholar_id, work_id, component, kept, method): which works of each scholar belong to the person.

    components: (scholar_id, work_id, component); evidence: (scholar_id, work_id, year, coauthors, at_target); anchors: (scholar_id, work_id), works of the person's
    own list; targets: (scholar_id), those whose institutions are known, whether a work is at one or not. Components with an anchor are kept; without any, the one
    with most works at the target, co-authors, works of the last five years and works; but fewer than ``least`` works without a component of three or known
    institutions are kept whole.
    """
    if targets is None:
        targets = evidence.filter("at_target").select("scholar_id")
    known = targets.select("scholar_id", F.lit(True).alias("placed")).distinct()
    x = components.join(evidence, ["scholar_id", "work_id"]).join(anchors.select("scholar_id", "work_id", F.lit(True).alias("anchored")), ["scholar_id", "work_id"], "left")
    latest = x.groupBy("scholar_id").agg(F.coalesce(F.max("year"), F.lit(0)).alias("latest"))
    per = x.join(latest, "scholar_id").groupBy("scholar_id", "component").agg(
        F.count_if("at_target").alias("at_target"), F.sum("coauthors").alias("mass"), F.count_if(F.coalesce("year", F.lit(0)) >= F.col("latest") - 5).alias("recent"), F.count("*").alias("size"), F.max(F.coalesce("anchored", F.lit(False))).alias("anchored")
    )
    score = F.struct("at_target", "mass", "recent", "size", -F.col("component"))
    whole = per.groupBy("scholar_id").agg(F.max_by("component", score).alias("best"), F.max("anchored").alias("any_anchor"), F.sum("size").alias("total"), (F.max("size") >= 3).alias("joined"))
    whole = whole.join(known.hint("merge"), "scholar_id", "left").na.fill(False, ["placed"])
    method = F.when(F.col("any_anchor"), "orcid_anchor").when((F.col("total") < least) & ~F.col("joined") & ~F.col("placed"), "insufficient_evidence").otherwise("institution_collaborator_cluster")
    kept = F.when(F.col("any_anchor"), F.col("anchored")).when(F.col("method") == "insufficient_evidence", F.lit(True)).otherwise(F.col("component") == F.col("best"))
    judged = per.select("scholar_id", "component", "anchored").join(whole.withColumn("method", method), "scholar_id").select("scholar_id", "component", kept.alias("kept"), "method")
    return components.join(judged, ["scholar_id", "component"]).select("scholar_id", "work_id", "component", "kept", "method")


def cluster_summary(clusters: DataFrame, works: DataFrame, work_topics: DataFrame) -> DataFrame:
    """Size, years and three topics of each excluded component, ranked by size; large: a tenth of the scholar's works, five at least.

    clusters: as ``primary_cluster`` gives them.
    """
    # tables are written step by step, so that the shuffle files of one don't stay while the next one is made
    clusters = kept(clusters)
    out = clusters.filter("not kept")
    size = out.join(works.select("work_id", "publication_year"), "work_id").groupBy("scholar_id", "component").agg(F.count("*").alias("size"), F.min("publication_year").alias("year_start"), F.max("publication_year").alias("year_end"))
    # topics are sent as one row a work and scholar and counted where a scholar's rows lie
    listed = work_topics.groupBy("work_id").agg(F.collect_set(F.struct("topic")).alias("t"))
    own = dealt(kept(out.select("work_id", "scholar_id", "component").hint("merge").join(listed, "work_id").select("scholar_id", "component", F.col("t.topic").alias("topics"))))
    counts = own.select("scholar_id", "component", F.explode("topics").alias("topic")).groupBy("scholar_id", "component", "topic").agg(F.count("*").alias("n"))
    order = Window.partitionBy("scholar_id", "component").orderBy(F.desc("n"), "topic")
    three = counts.withColumn("place", F.row_number().over(order)).filter("place <= 3").groupBy("scholar_id", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "topic"))), lambda t: t["topic"]).alias("top_topics"))
    total = clusters.groupBy("scholar_id").agg(F.count("*").alias("total"))
    x = size.join(total, "scholar_id").hint("merge").join(kept(three), ["scholar_id", "component"], "left")
    rank = F.row_number().over(Window.partitionBy("scholar_id").orderBy(F.desc("size"), "component"))
    return x.select("scholar_id", rank.alias("rank"), "component", "size", "year_start", "year_end", F.coalesce("top_topics", F.array().cast("array<string>")).alias("top_topics"), (F.col("size") >= F.greatest(F.lit(5), F.ceil(F.col("total") * 0.1))).alias("large"))


def choose_person(candidates: DataFrame) -> DataFrame:
    """(profile_id, pid, method): the external person of each profile, null where it stays open.

    candidates: (profile_id, pid, seq, exact_name, institution_matches, has_orcid): of those with the exact name, best institutions first, one of the first five with the
    profile's ORCID; else the first, if an institution matches or no other has the name.
    """
    exact = candidates.filter("exact_name")
    by_score = Window.partitionBy("profile_id").orderBy(F.desc(F.least("institution_matches", F.lit(3))), "seq")
    x = exact.withColumn("place", F.row_number().over(by_score))
    hit = F.when(F.col("has_orcid") & (F.col("place") <= 5), F.struct("place", "pid"))
    best = x.groupBy("profile_id").agg(F.min(hit).alias("orcid"), F.min(F.struct("place", "pid", "institution_matches")).alias("first"), F.count("*").alias("n"))
    method = F.when(F.col("orcid").isNotNull(), "orcid").when(F.col("first.institution_matches") > 0, "affiliation").when(F.col("n") == 1, "unique_name")
    chosen = best.select("profile_id", F.when(F.col("orcid").isNotNull(), F.col("orcid.pid")).when(method.isNotNull(), F.col("first.pid")).alias("pid"), method.alias("method"))
    return candidates.select("profile_id").distinct().join(chosen, "profile_id", "left").withColumn("method", F.coalesce("method", F.lit("identity_unresolved")))


#: Most words by which a record's title may exceed a known one that it contains.
MOST_WORDS = 16


def match_containment(records: DataFrame, works: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(scholar_id, record_id): the records whose title equals or contains that of a work of the scholar, of the same year or without one.

    records: (scholar_id, record_id, title, year); works: (scholar_id, title, publication_year). A contained title has six words or more and ``most`` fewer than the
    record's at most, so it is one of the record's runs of words: whole titles meet whole runs, of lengths that some known title has, and no pair is compared.
    """
    return _contained(records, works.select("scholar_id", T.normalize_title(F.col("title")).alias("key"), F.coalesce("publication_year", F.lit(0)).alias("year")).filter("key <> ''"), most)


def _contained(records: DataFrame, titled: DataFrame, most: int) -> DataFrame:
    """``match_containment`` with known titles that are normalised already: (scholar_id, key, year)."""
    # a record without a year fits every known one, so each title is kept once more under no year
    known = titled.select("scholar_id", "key", F.explode(F.array("year", F.lit(None).cast("int"))).alias("year")).distinct()
    lengths = titled.select(F.size(F.split("key", " ")).alias("n")).filter("n >= 6").agg(F.collect_set("n").alias("lengths"))  # one row, the distinct numbers of words
    asked = records.select("scholar_id", "record_id", T.normalize_title(F.col("title")).alias("whole"), F.nullif(F.col("year"), F.lit(0)).alias("year")).filter("whole <> ''")
    asked = asked.withColumn("w", F.split("whole", " ")).crossJoin(F.broadcast(lengths))
    m = F.size("w")
    fit = F.filter("lengths", lambda n: (n <= m) & (m - n <= most))
    runs = F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), m - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    found = asked.select("scholar_id", "record_id", "year", F.explode_outer(F.array_distinct(F.concat(F.array("whole"), runs))).alias("key"))  # never empty; explode would make the array once more to test it
    met = found.hint("merge").join(known, (found.scholar_id == known.scholar_id) & (found.key == known.key) & found.year.eqNullSafe(known.year), "left_semi")
    return met.select("scholar_id", "record_id").distinct()


def choose_anchored(works: DataFrame, hits: DataFrame, articles: DataFrame, institutions: DataFrame, anchors: int = 2) -> DataFrame:
    """(scholar_id, author_id, matched): the search profile of each scholar that an author of one of the scholar's ``anchors`` most cited titles has.

    works: (scholar_id, title, publication_year, cited_by_count); hits: (scholar_id, title, author_id), found papers and those of their authors whose name fits;
    articles: (scholar_id, author_id, record_id, title, year), what is listed in these profiles; institutions: (scholar_id, author_id, score). Of the profiles reached the one
    with most articles that are the scholar's works is taken, then the better institution, then the smaller id; one without any such article is none.
    """
    # titles are normalised once, for the anchors and for what the articles are held against
    titled = kept(works.select("scholar_id", T.normalize_title(F.col("title")).alias("key"), F.coalesce("publication_year", F.lit(0)).alias("year"), F.coalesce("cited_by_count", F.lit(0)).alias("cited")).filter("key <> ''"))
    best = titled.groupBy("scholar_id", "key").agg(F.max("cited").alias("cited"))
    order = Window.partitionBy("scholar_id").orderBy(F.desc("cited"), "key")
    top = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= anchors).select("scholar_id", F.col("key").alias("anchor"))
    # a scholar's few anchors and profiles go to the many rows, which are neither sorted nor told apart before
    seen = hits.select("scholar_id", "author_id", T.normalize_title(F.col("title")).alias("seen"))
    reached = seen.join(top.hint("shuffle_hash"), "scholar_id").filter(T.folded_contains_match(F.col("anchor"), F.col("seen"))).select("scholar_id", "author_id").distinct()
    listed = kept(articles.select("scholar_id", "author_id", "record_id", "title", "year").join(reached.hint("shuffle_hash"), ["scholar_id", "author_id"], "left_semi"))
    own = _contained(listed.select("scholar_id", "record_id", "title", "year"), titled.select("scholar_id", "key", "year"), MOST_WORDS)
    counts = listed.join(own, ["scholar_id", "record_id"], "left_semi").groupBy("scholar_id", "author_id").agg(F.count_distinct("record_id").alias("matched"))
    x = counts.join(institutions, ["scholar_id", "author_id"], "left")
    place = F.row_number().over(Window.partitionBy("scholar_id").orderBy(F.desc("matched"), F.desc(F.coalesce("score", F.lit(0))), "author_id"))
    return x.withColumn("place", place).filter("place = 1").select("scholar_id", "author_id", "matched")


def candidate_affiliations(rows: DataFrame) -> DataFrame:
    """(profile_id, name, is_primary, place): the affiliations of each profile; place orders those that are history.

    rows: (profile_id, name, years, work_count, is_current). The primary one has two works or two consecutive years; current ones, later years, more works, more years
    come first.
    """
    named = rows.withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " "))).filter("name <> ''")
    every = named.groupBy("profile_id", F.lower("name").alias("folded")).agg(
        F.min("name").alias("name"), T.clean_years(F.flatten(F.collect_list(F.coalesce("years", F.array().cast("array<int>"))))).alias("years"), F.greatest(F.lit(0), F.coalesce(F.max("work_count"), F.lit(0))).alias("work_count"), F.max(F.coalesce("is_current", F.lit(False))).alias("is_current")
    )
    x = every.withColumn("latest", F.coalesce(F.array_max("years"), F.lit(0))).withColumn("span", F.size("years"))
    eligible = (F.col("work_count") >= 2) | T.has_consecutive_years(F.col("years"))
    score = F.struct("is_current", "latest", "work_count", "span", "folded")
    best = F.max(F.when(eligible, score)).over(Window.partitionBy("profile_id"))
    x = x.withColumn("is_primary", F.coalesce(score == best, F.lit(False)))
    order = Window.partitionBy("profile_id", "is_primary").orderBy(F.desc("latest"), F.desc("work_count"), F.desc("span"), "folded")
    return x.select("profile_id", "name", "is_primary", F.when(~F.col("is_primary"), F.row_number().over(order)).alias("place"))


def _bonus(c: Column, each: int, most: int) -> Column:
    return F.least(F.coalesce(c, F.lit(0)) * each, F.lit(most))


def candidate_scores(candidates: DataFrame) -> DataFrame:
    """(query, id, seq, orcid, identity_group, identity_score, reasons) of each candidate.

    candidates: (query, id, seq, orcid, primary_institution, confidence, provisional, anchor, published_merged, signals), signals an array of
    struct<shared_works, shared_coauthors, shared_topics, shared_institutions> of merged profiles.
    """
    c = F.col
    has = lambda name: F.coalesce(c(name), F.lit("")) != ""
    group = F.when(c("confidence") == "high", "high").when((c("confidence") == "medium") | has("orcid"), "medium").otherwise("review")
    base = F.when(group == "high", 90).when(group == "medium", 65).otherwise(35)
    signals = F.coalesce(c("signals"), F.array().cast("array<struct<shared_works:int,shared_coauthors:int,shared_topics:int,shared_institutions:int>>"))
    shared = F.aggregate(signals, F.lit(0), lambda n, s: n + _bonus(s["shared_works"], 4, 16) + _bonus(s["shared_coauthors"], 2, 12) + _bonus(s["shared_topics"], 2, 10) + _bonus(s["shared_institutions"], 4, 8))
    merged, published = F.size(signals) > 0, (F.size(signals) == 0) & (F.coalesce(c("published_merged"), F.lit(0)) > 1)
    score = F.greatest(F.lit(0), F.least(F.lit(100), base + F.when(has("orcid"), 10).otherwise(0) + shared + F.when(published, 8).otherwise(0)))
    provisional = F.coalesce(c("provisional"), F.lit(False))
    reasons = F.concat(
        F.array_compact(F.array(F.when(has("orcid"), "orcid"), F.when(has("primary_institution"), "primary_institution"), F.when(provisional & has("anchor"), "publication_anchor"))),
        F.transform(signals, lambda _: F.lit("merged_profile")), F.when(merged, F.array().cast("array<string>")).when(published, F.array(F.lit("published_profile"))).otherwise(F.array(F.lit("independent_profile"))),
    )
    return candidates.select(
        "query", "id", "seq", "orcid", F.when(provisional, "review").otherwise(group).alias("identity_group"), F.when(provisional, F.least(score, F.lit(45))).otherwise(score).alias("identity_score"), reasons.alias("reasons")
    )


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Adds place: identity group, score, an ORCID, more reasons, then the order in which they came."""
    group = F.when(F.col("identity_group") == "high", 0).when(F.col("identity_group") == "medium", 1).otherwise(2)
    order = Window.partitionBy("query").orderBy(group, F.desc("identity_score"), (F.coalesce("orcid", F.lit("")) == "").cast("int"), F.desc(F.size("reasons")), "seq")
    return scored.withColumn("place", F.row_number().over(order))


#: Fixed value: so many of a scholar's requested profiles are read.
MOST_REQUESTED = 8


def identity_audit(requests: DataFrame, profiles: DataFrame, most: int = MOST_REQUESTED) -> DataFrame:
    """Per scholar which requested profiles were merged or rejected, and what the merged ones hold together.

    requests: (scholar_id, requested_id, seq, accepted), the first ``most`` count; profiles: (id, display_name, institution_id, works_count).
    """
    order = Window.partitionBy("scholar_id").orderBy("seq")
    r = requests.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    x = r.join(profiles, r["requested_id"] == profiles["id"], "left")
    ids = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", "requested_id")))), lambda v: v["requested_id"])
    good = F.col("accepted") & F.col("id").isNotNull()
    return x.groupBy("scholar_id").agg(
        ids(F.lit(True)).alias("requested_ids"), ids(good).alias("merged_ids"), ids(~good).alias("rejected_ids"), F.count_if(good).alias("merged_count"), F.coalesce(F.sum(F.when(good, F.col("works_count"))), F.lit(0)).alias("works_count"),
        F.array_sort(F.collect_set(F.when(good, F.col("institution_id")))).alias("institution_ids"), F.array_sort(F.collect_set(F.when(good, F.col("display_name")))).alias("names"),
    )
