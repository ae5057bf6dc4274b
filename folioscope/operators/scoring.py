"""Impact, quality and recommendation scores of every scholar at once.

Weights and thresholds are those of the scoring model; every index lies in 0..100. "Insufficient" is null, never 0.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import overlaps as O
from .graph import kept
from .rollups import dealt_coauthors, dealt_topics, field_topics_of, symmetrise, top, with_topics

PAIR_FEATURES = (
    "focus_id long, candidate_id long, topic_overlap double, recent_overlap double, temporal double, direct_count long, shared_collaborators long, method_similarity double, "
    "problem_similarity double, complementarity double, same_institution boolean, shared_topics array<string>, has_institution boolean, graph_ready boolean"
)


def contribution_score(author_count: Column, position: Column, index: Column, corresponding: Column) -> Column:
    """1 for sole or corresponding authors, 0.95 first, 0.9 last, 0.45 in between."""
    return (
        F.when(F.coalesce(author_count, F.lit(0)) <= 1, 1.0)
        .when(F.coalesce(corresponding, F.lit(False)), 1.0)
        .when((F.lower(position) == "first") | (index == 0), 0.95)
        .when((F.lower(position) == "last") | (index == author_count - 1), 0.9)
        .otherwise(0.45)
    )


def band(index: Column) -> Column:
    return F.when(index >= 70, "strong").when(index >= 48, "moderate").when(index.isNotNull(), "limited")


def _index(x: Column) -> Column:
    """Within 0..100 to one digit; the inner rounding lets ties not depend on the order of a sum."""
    return F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 9), 1)


def raw_impact(works: DataFrame) -> DataFrame:
    """(work_id, impact): ln(1 + citations) / sqrt(age), age counted to the newest year of all works."""
    newest = works.agg(F.max("publication_year").alias("as_of"))  # one number
    age = F.coalesce(F.greatest(F.lit(1), F.col("as_of") - F.col("publication_year") + 1), F.lit(3))
    impact = F.log1p(F.greatest(F.lit(0), F.coalesce("cited_by_count", F.lit(0))).cast("double")) / F.sqrt(age.cast("double"))
    # equal values of different terms (ln 4 / sqrt 4 = ln 2 / sqrt 1) shall tie
    return works.crossJoin(F.broadcast(newest)).select("work_id", F.round(impact, 12).alias("impact"))


def impact_percentile(works: DataFrame, work_topics: DataFrame, least: int = 3) -> DataFrame:
    """(work_id, percentile): midpoint percentile within each topic of ``least`` works or more, averaged; else among all works.

    Values are counted before they are ranked, and ranked within ranges of a thousandth of impact. Only the ranges' sums are ordered as
    a whole: ln(1 + citations) is under 44, so a pool has fewer than 44,000 of them, however many works it has.
    """
    impact = raw_impact(works)

    def ranked(pool: DataFrame, keys: list[str]) -> DataFrame:
        levels = pool.groupBy(*keys, "impact").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("impact") * 1000))
        every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per range
        ranges = levels.groupBy(*keys, "range").agg(F.sum("n").alias("inside"))
        ranges = ranges.select(*keys, "range", (F.sum("inside").over(every.orderBy("range")) - F.col("inside")).alias("lower"), F.sum("inside").over(every).alias("size"))
        within = F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("impact")) - F.col("n")
        below = F.col("lower") + F.col("within")
        return levels.withColumn("within", within).join(ranges, [*keys, "range"]).withColumn("p", (below + 0.5 * F.col("n")) / F.col("size")).drop("within", "lower", "range")

    topical = work_topics.select("work_id", "topic").distinct().join(impact, "work_id")
    per_topic = topical.join(ranked(topical, ["topic"]).filter(F.col("size") >= least), ["topic", "impact"]).groupBy("work_id").agg(F.avg("p").alias("topical"))
    everywhere = impact.join(ranked(impact, []).select("impact", F.col("p").alias("overall")), "impact")
    return everywhere.join(per_topic, "work_id", "left").select("work_id", F.coalesce("topical", "overall").alias("percentile"))


def incoming_internal(citations: DataFrame, works: DataFrame) -> DataFrame:
    """(work_id, incoming): citations of each work by works of the corpus."""
    known = works.select("work_id")
    inside = citations.join(known.withColumnRenamed("work_id", "citing_work_id"), "citing_work_id", "left_semi").join(known.withColumnRenamed("work_id", "cited_work_id"), "cited_work_id", "left_semi")
    return inside.groupBy(F.col("cited_work_id").alias("work_id")).agg(F.count("*").alias("incoming"))


def later_same_topic(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, enough: int | None = None) -> DataFrame:
    """(scholar_id, work_id, later): later works of the scholar that share a topic; with ``enough`` no more than that are told apart (all that a score can use).

    A work's later works on one topic are the next ones in that topic's order, so the next ``enough`` of each topic hold them. Without
    it the works of one topic are joined in order.
    """
    own = authorships.select("scholar_id", "work_id").distinct().join(works.select("work_id", F.coalesce("publication_year", F.lit(0)).alias("year")), "work_id")
    if enough is None:
        on = own.join(work_topics.select("work_id", "topic").distinct(), "work_id")
        after = on.select("scholar_id", "topic", F.col("year").alias("y"), F.col("work_id").alias("w"))
        pairs = on.join(after, ["scholar_id", "topic"]).filter("y > year or (y = year and w > work_id)")
        found = pairs.groupBy("scholar_id", "work_id").agg(F.count_distinct("w").alias("later"))
        return own.select("scholar_id", "work_id").join(found, ["scholar_id", "work_id"], "left").na.fill(0, ["later"])
    return own.select("scholar_id", "work_id").join(_later_of(with_topics(works, authorships, work_topics), enough), ["scholar_id", "work_id"], "left").na.fill(0, ["later"])


def _later_of(own: DataFrame, enough: int) -> DataFrame:
    """(scholar_id, work_id, later), ``enough`` at most, of the works with topics; own: the rows of ``with_topics``."""
    w = Window.partitionBy("scholar_id", "topic").orderBy("year", "work_id")
    on = own.repartition("scholar_id").select("scholar_id", "work_id", F.coalesce("publication_year", F.lit(0)).alias("year"), F.explode(F.array_compact("topics")).alias("topic"))
    ahead = on.withColumn("next", F.array_compact(F.array(*[F.lead("work_id", k).over(w) for k in range(1, enough + 1)])))
    return ahead.groupBy("scholar_id", "work_id").agg(F.least(F.lit(enough), F.size(F.array_distinct(F.flatten(F.collect_list("next"))))).alias("later"))


def topic_profiles(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, recent: int = 3) -> DataFrame:
    """(scholar_id, topic, n, n_recent): works per topic, and those since the newest year of the corpus less ``recent``."""
    newest = works.agg(F.max("publication_year").alias("as_of"))
    # rows are sent once, a work and scholar each, and counted by topic where they lie
    own = dealt_topics(works, authorships, work_topics, "publication_year").crossJoin(F.broadcast(newest))
    dated = own.select("scholar_id", F.explode("topics").alias("topic"), (F.coalesce("publication_year", F.lit(0)) >= F.col("as_of") - recent).alias("recent"))
    return dated.groupBy("scholar_id", "topic").agg(F.count("*").alias("n"), F.count_if("recent").alias("n_recent"))


def representative_works(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, citations: DataFrame, k: int | None = 5) -> DataFrame:
    """The k most representative works of each scholar for its own field topics, with the parts of the score."""
    # each table is written, so that no step's shuffle files stay while the next ones are made
    topical = kept(with_topics(works, authorships, work_topics))
    field = kept(field_topics_of(topical).groupBy("scholar_id").agg(F.collect_list("topic").alias("field"), F.count("*").alias("n_field")))  # k rows a scholar
    later = kept(_later_of(topical, 3))
    of_works = kept(impact_percentile(works, work_topics).hint("merge").join(incoming_internal(citations, works), "work_id", "left").na.fill(0, ["incoming"]))
    own = authorships.select("scholar_id", "work_id", "author_count", "author_position", "position_index", "is_corresponding")
    shared = F.size(F.array_intersect(F.array_compact("topics"), "field"))
    counted = topical.hint("merge").join(field, "scholar_id", "left").select("scholar_id", "work_id", "publication_year", F.coalesce(F.size("topics"), F.lit(0)).alias("n_topics"), shared.alias("shared"), "n_field")
    counted = kept(counted.withColumn("n_topics", F.greatest("n_topics", F.lit(0))))
    x = kept(own.hint("merge").join(counted.hint("merge").join(later, ["scholar_id", "work_id"], "left"), ["scholar_id", "work_id"]))
    x = x.na.fill(0, ["n_topics", "shared", "n_field", "later"]).hint("merge").join(of_works, "work_id")
    union = F.col("n_topics") + F.col("n_field") - F.col("shared")
    x = (
        x.withColumn("relevance", F.when(union > 0, F.col("shared") / union).otherwise(0.0))
        .withColumn("contribution", contribution_score(F.col("author_count"), F.col("author_position"), F.col("position_index"), F.col("is_corresponding")))
        .withColumn("downstream", F.least(F.lit(1.0), F.col("incoming") / 3))
        .withColumn("continuation", F.least(F.lit(1.0), F.col("later") / 3))
    )
    score = F.col("relevance") * 0.28 + F.col("percentile") * 0.30 + F.col("contribution") * 0.18 + F.col("downstream") * 0.14 + F.col("continuation") * 0.10
    x = x.withColumn("index", _index(score * 100))
    order = [F.desc("index"), F.desc(F.coalesce("publication_year", F.lit(0))), F.col("work_id")]
    return x if k is None else top(x, ["scholar_id"], order, k)


def data_confidence(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, abstracts: DataFrame, scholars: DataFrame) -> DataFrame:
    """Coverage score and level of every scholar; scholars: (scholar_id, graph_ready)."""
    own = authorships.select("scholar_id", "work_id").distinct().join(works.select("work_id", "publication_year"), "work_id")
    own = own.join(work_topics.select("work_id").distinct().withColumn("topical", F.lit(1)), "work_id", "left").join(abstracts.filter("abstract <> ''").select("work_id").distinct().withColumn("abstracted", F.lit(1)), "work_id", "left")
    n = own.groupBy("scholar_id").agg(
        F.count("*").alias("works"), F.coalesce(F.max("publication_year") - F.min("publication_year") + 1, F.lit(0)).alias("year_span"), F.count("topical").alias("topic_covered"), F.count("abstracted").alias("abstract_covered")
    )
    n = scholars.select("scholar_id", "graph_ready").join(n, "scholar_id", "left").na.fill(0, ["works", "year_span", "topic_covered", "abstract_covered"])
    ratio = lambda c: F.when(F.col("works") > 0, F.col(c) / F.col("works")).otherwise(0.0)
    score = F.least(F.lit(1.0), F.col("works") / 12) * 0.35 + F.least(F.lit(1.0), F.col("year_span") / 6) * 0.2 + ratio("topic_covered") * 0.25 + ratio("abstract_covered") * 0.15 + F.when(F.col("graph_ready"), 0.05).otherwise(0.0)
    level = F.when(~F.col("graph_ready") | (F.col("works") < 3) | (F.col("topic_covered") < 2), "insufficient").when(score >= 0.8, "high").when(score >= 0.58, "medium").otherwise("low")
    return n.select("scholar_id", "works", "year_span", F.round(ratio("topic_covered"), 3).alias("topic_coverage"), F.round(ratio("abstract_covered"), 3).alias("abstract_coverage"), F.round(score, 3).alias("score"), level.alias("level"))


def continuity_index(works: DataFrame, authorships: DataFrame, work_topics: DataFrame) -> DataFrame:
    """Sustained share 0.45, longest span of 8 years 0.25, repeated topics 0.20, early against recent topics 0.10."""
    newest = works.agg(F.max("publication_year").alias("as_of"))  # one number
    recent = F.coalesce("publication_year", F.lit(0)) >= F.col("as_of") - 3
    # rows are sent once, a work and scholar each; all else, by topic, by work and by scholar, is made where they lie
    own = dealt_topics(works, authorships, work_topics, "publication_year").crossJoin(F.broadcast(newest))
    rows = own.select("scholar_id", "work_id", "publication_year", recent.alias("recent"), F.explode_outer("topics").alias("topic"))
    w = Window.partitionBy("scholar_id", "topic")
    known, c = F.col("topic").isNotNull(), F.col
    x = rows.withColumns({
        "n": F.count("*").over(w), "n_recent": F.count_if("recent").over(w), "n_years": F.size(F.collect_set("publication_year").over(w)),
        "span": (F.max("publication_year").over(w) - F.min("publication_year").over(w) + 1), "leads": known & (c("work_id") == F.min("work_id").over(w)),
    })
    x = x.withColumns({"sustained": known & (c("n") >= 3) & (c("n_years") >= 3), "n_early": c("n") - c("n_recent")})
    # a topic counts once, in the row of its least work
    led = lambda v: F.sum(F.when(c("leads"), v).otherwise(0))
    x = x.groupBy("scholar_id", "work_id").agg(
        F.max("sustained").alias("lasts"), F.max(F.when(c("sustained"), c("span"))).alias("longest"), led(c("sustained").cast("long")).alias("sustained_topics"), led(F.when(c("n") >= 2, c("n")).otherwise(0)).alias("repeated"),
        led(c("n")).alias("all"), led(F.least("n_early", "n_recent")).alias("less"), led(F.greatest("n_early", "n_recent")).alias("more"),
    )
    x = x.groupBy("scholar_id").agg(
        F.count("*").alias("works"), F.count_if("lasts").alias("lasting"), F.max("longest").alias("longest"), F.sum("sustained_topics").alias("sustained_topics"),
        F.try_divide(F.sum("repeated"), F.sum("all")).alias("repeat"), F.try_divide(F.sum("less"), F.sum("more")).alias("stability"),
    )
    x = x.na.fill(0, ["lasting", "longest", "sustained_topics"]).na.fill(0.0, ["repeat", "stability"])
    index = 100 * (F.col("lasting") / F.col("works") * 0.45 + F.least(F.lit(1.0), F.col("longest") / 8) * 0.25 + F.col("repeat") * 0.20 + F.col("stability") * 0.10)
    return x.select(
        "scholar_id", _index(index).alias("continuity"), F.col("longest").cast("int").alias("longest_span"), F.round("repeat", 6).alias("topic_repeat"), F.round("stability", 6).alias("stability"),
        "sustained_topics", F.round(F.col("lasting") / F.col("works"), 6).alias("sustained_share"),
    )


def impact_index(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, citations: DataFrame) -> DataFrame:
    """Mean of the 5 greatest percentiles 0.5, share of works cited in the corpus 0.3, of cited works 0.2. Paper counts do not enter."""
    own = authorships.select("scholar_id", "work_id").distinct().join(works.select("work_id", F.coalesce("cited_by_count", F.lit(0)).alias("c")), "work_id")
    own = own.join(impact_percentile(works, work_topics), "work_id").join(incoming_internal(citations, works), "work_id", "left")
    upper = top(own, ["scholar_id"], [F.desc("percentile"), F.col("work_id")], 5).groupBy("scholar_id").agg(F.avg("percentile").alias("upper_impact"))
    n = own.groupBy("scholar_id").agg(
        (F.count_if(F.coalesce("incoming", F.lit(0)) > 0) / F.count("*")).alias("spread"), (F.count_if(F.col("c") > 0) / F.count("*")).alias("cited_share"), (F.max("c") / F.greatest(F.lit(1), F.sum("c"))).alias("concentration")
    )
    index = 100 * (F.col("upper_impact") * 0.5 + F.col("spread") * 0.3 + F.col("cited_share") * 0.2)
    note = F.when((_index(index) >= 70) & (F.col("concentration") < 0.65), "distributed").when(F.col("concentration") >= 0.65, "concentrated").otherwise("moderate")
    return n.join(upper, "scholar_id").select("scholar_id", _index(index).alias("impact"), F.round("upper_impact", 6).alias("upper_impact"), F.round("spread", 6).alias("spread"), F.round("cited_share", 6).alias("cited_share"), note.alias("note"))


def quality_index(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, citations: DataFrame) -> DataFrame:
    """Signal of the 3 most representative works 0.4, strong roles 0.25, upper impact 0.2, spread 0.15."""
    every = kept(representative_works(works, authorships, work_topics, citations, k=None).select("scholar_id", "work_id", "publication_year", "index", "percentile", "contribution", "incoming"))
    order = [F.desc("index"), F.desc(F.coalesce("publication_year", F.lit(0))), F.col("work_id")]
    signal = top(every, ["scholar_id"], order, 3).groupBy("scholar_id").agg((F.avg("index") / 100).alias("signal"))
    upper = top(every, ["scholar_id"], [F.desc("percentile"), F.col("work_id")], 5).groupBy("scholar_id").agg(F.avg("percentile").alias("upper_impact"))
    n = every.groupBy("scholar_id").agg((F.count_if(F.col("contribution") >= 0.9) / F.count("*")).alias("strong"), (F.count_if(F.col("incoming") > 0) / F.count("*")).alias("spread"))
    index = _index(100 * (F.col("signal") * 0.4 + F.col("strong") * 0.25 + F.col("upper_impact") * 0.2 + F.col("spread") * 0.15))
    x = n.join(signal, "scholar_id").join(upper, "scholar_id").withColumn("quality", index)
    return x.select("scholar_id", "quality", band(F.col("quality")).alias("band"), F.round("signal", 6).alias("signal"), F.round("strong", 6).alias("strong_role_share"), F.round("upper_impact", 6).alias("upper_impact"), F.round("spread", 6).alias("spread"))


def scholar_dimensions(confidence: DataFrame, quality: DataFrame, continuity: DataFrame, impact: DataFrame, style: DataFrame | None = None, h_indices: DataFrame | None = None) -> DataFrame:
    """The dimensions of every scholar of ``confidence``: indices with what they conclude and rest on; all null and without evidence where the data are insufficient.

    quality, continuity, impact, style: the tables of ``quality_index``, ``continuity_index``, ``impact_index`` and ``style_profile``; h_indices: (scholar_id, h_index).
    evidence: array of (dimension, code, value), in the order of the dimensions.
    """
    x = confidence.select("scholar_id", "level").join(quality.hint("merge"), "scholar_id", "left").join(continuity.hint("merge"), "scholar_id", "left")
    x = x.join(impact.select("scholar_id", "impact", "cited_share", "note").hint("merge"), "scholar_id", "left")
    codes = [
        ("quality", "representative_signal", "signal"), ("quality", "strong_contribution_share", "strong_role_share"), ("quality", "field_normalized_impact", "upper_impact"), ("quality", "internal_diffusion", "spread"),
        ("continuity", "sustained_topics", "sustained_topics"), ("continuity", "longest_span", "longest_span"), ("continuity", "sustained_share", "sustained_share"), ("continuity", "recent_stability", "stability"),
        ("impact", "field_normalized_impact", "upper_impact"), ("impact", "cited_work_share", "cited_share"), ("impact", "internal_diffusion", "spread"),
    ]
    shown = ["orientation", "pacing", "work_type", "collaboration"]
    if h_indices is not None:
        x = x.join(h_indices.select("scholar_id", "h_index").hint("merge"), "scholar_id", "left")
        codes.append(("impact", "local_h_index", "h_index"))
    if style is not None:
        x = x.join(style.hint("merge"), "scholar_id", "left")
        codes += [("style", "classified_works", "evidence"), ("style", "typical_team_size", "typical_team"), ("style", "repeated_collaborators", "repeated")]
    enough = F.col("level") != "insufficient"
    known = lambda c: F.when(enough, F.col(c)).alias(c)
    rows = [F.struct(F.lit(d).alias("dimension"), F.lit(code).alias("code"), F.round(F.col(c).cast("double"), 3).alias("value")) for d, code, c in codes]
    evidence = F.when(enough, F.filter(F.array(*rows), lambda r: r["value"].isNotNull())).otherwise(F.array().cast("array<struct<dimension: string, code: string, value: double>>"))
    return x.select(
        "scholar_id", "level", *[known(c) for c in ("quality", "continuity", "impact")], F.when(enough, F.col("band")).alias("quality_band"), F.when(enough, band(F.col("continuity"))).alias("continuity_band"),
        F.when(enough, F.col("note")).alias("impact_note"), *([known(c) for c in shown] if style is not None else []), evidence.alias("evidence"),
    )


def shared_collaborators(collaborations: DataFrame, focus: DataFrame) -> DataFrame:
    """(focus_id, other_id, shared): number of common collaborators of each focus scholar and any other. collaborations: (scholar_id, other_id), both directions.

    Pairs with a collaborator in common are made in tiles (``overlaps``), once each: ways over a third scholar are counted, not made.
    """
    sets = collaborations.select(F.col("scholar_id").alias("id"), F.col("other_id").cast("string").alias("key")).distinct()
    both = symmetrise(O.set_pairs(sets).select("a", "b", "common"), "a", "b")
    met = both.hint("merge").join(focus.select("scholar_id").distinct(), "scholar_id", "left_semi")
    return met.select(F.col("scholar_id").alias("focus_id"), "other_id", F.col("common").alias("shared"))


def pair_features(
    works: DataFrame, authorships: DataFrame, work_topics: DataFrame, scholars: DataFrame, focus: DataFrame, categories: DataFrame, method_tokens: DataFrame, problem_tokens: DataFrame,
    collaborations: DataFrame | None = None, least_overlap: float = 0.15, least_recent: float = 0.25, best: tuple[str, ...] = (), points: DataFrame | None = None, k: int = 20,
) -> DataFrame:
    """Features of each focus scholar and every other scholar whose topics overlap by ``least_overlap``, or recent topics by ``least_recent``.

    No list of recommendations takes a pair below both; with bounds of 0 all pairs that share a topic are given. With ``best`` (names of LISTS) only the rows
    that can be among the first k of one of these lists are put out, without shared topics: the lists are the same, and need not all pairs.
    points: (scholar_id, points) of those who can be a reference, what they add to the index by themselves. scholars: (scholar_id, institution_id, graph_ready); categories, method_tokens, problem_tokens:
    (scholar_id, value), distinct; collaborations: (scholar_id, other_id, direct_count), from all authorships if not given.
    Pairs are made in tiles of blocks of scholars that can reach the bounds (``overlaps``), each pair once for both directions.
    """
    p = topic_profiles(works, authorships, work_topics)
    if collaborations is None:
        collaborations = dealt_coauthors(authorships).groupBy("scholar_id", "other_id").agg(F.count("*").alias("direct_count"))
    if best and not {"potential_collaborator", "potential_competitor"} & set(best):
        collaborations = collaborations.limit(0)  # no other list uses them
    sorted_by = lambda c, *fields: F.array_sort(F.collect_list(F.struct(c, *fields)))
    topics = p.groupBy("scholar_id").agg(sorted_by("topic", "n", "n_recent").alias("x")).select("scholar_id", F.col("x.topic").alias("topics"), F.col("x.n").alias("topics_n"), F.col("x.n_recent").alias("topics_n_recent"))
    near = collaborations.groupBy("scholar_id").agg(sorted_by(F.col("other_id").cast("string").alias("other_id"), "direct_count").alias("x")).select("scholar_id", F.col("x.other_id").alias("near"), F.col("x.direct_count").alias("near_n"))
    years = authorships.select("scholar_id", "work_id").join(works.filter("publication_year is not null"), "work_id").select("scholar_id", F.col("publication_year").cast("string").alias("value"))
    kinds = {"temporal": years, "method_similarity": method_tokens, "problem_similarity": problem_tokens, "categories": categories}
    valued = reduce(DataFrame.unionByName, [df.select("scholar_id", F.lit(name).alias("kind"), "value") for name, df in kinds.items()])
    sets = valued.groupBy("scholar_id").agg(*[F.collect_set(F.when(F.col("kind") == name, F.col("value"))).alias(name) for name in kinds])
    focal = focus.select("scholar_id", F.lit(1).alias("focal")).distinct()
    members = topics.join(near.hint("merge"), "scholar_id", "left").join(sets.hint("merge"), "scholar_id", "left").join(scholars.select("scholar_id", "institution_id", "graph_ready"), "scholar_id", "left").join(focal, "scholar_id", "left")
    members = members.withColumn("points", F.lit(None).cast("double")) if points is None else members.join(points.select("scholar_id", "points").hint("merge"), "scholar_id", "left")

    parts = {"topics": ["n", "n_recent"], "near": ["n"]} | {name: [] for name in kinds}
    blocks = O.blocked(members.withColumnRenamed("scholar_id", "id").withColumn("main", O.main_key(F.col("topics"), F.col("topics_n"))), parts, ["institution_id", "graph_ready", "focal", "points"])
    tiles = O.bounded_tiles(blocks, parts, "topics", {"n": least_overlap, "n_recent": least_recent})
    asks = lambda side: blocks.select(F.col("block").alias(side), F.exists("focal", lambda f: f.isNotNull()).alias(f"{side}_asks"))
    tiles = tiles.join(asks("a").hint("merge"), "a").join(asks("b").hint("merge"), "b").filter("a_asks or b_asks").select("a", "b")

    def kernel(x: dict, y: dict, same: bool) -> pd.DataFrame:
        least, recent = O.least_sums(x["topics"], y["topics"], ("n", "n_recent"))
        of = lambda part, w, sums: O.ratio(sums, x[part].totals(w)[:, None] + y[part].totals(w)[None, :] - sums)
        overlap, recently = of("topics", "n", least), of("topics", "n_recent", recent)
        wanted = ((overlap >= least_overlap) | (recently >= least_recent)) & (least > 0)
        asks, answers = (np.array([f is not None for f in s["focal"]], bool) for s in (x, y))
        wanted &= asks[:, None] | answers[None, :]
        i, j = np.nonzero(np.triu(wanted, 1) if same else wanted)

        def jaccard(part: str) -> tuple[np.ndarray, np.ndarray]:
            common, n, m = O.shared_counts(x[part], y[part])[i, j], x[part].sizes[i], y[part].sizes[j]
            return O.ratio(common, n + m - common), (n > 0) & (m > 0)

        ids, others = x["id"], y["id"]
        category, known = jaccard("categories")
        place = x["near"].places([str(o) for o in others])  # the others among the collaborators of x
        direct = np.where(place >= 0, x["near"].dense(np.arange(len(x["near"].words)), len(x["near"].words), "n")[:, place], 0)[i, j] if len(x["near"].words) else np.zeros(len(i), np.int64)
        at, to = x["institution_id"], y["institution_id"]
        at_known, to_known = (np.array([v is not None for v in c], bool) for c in (at, to))
        same_place = ((at[:, None] == to[None, :]) & at_known[:, None])[i, j]
        pairs = {
            "topic_overlap": overlap[i, j], "recent_overlap": recently[i, j], "temporal": jaccard("temporal")[0], "direct_count": direct, "shared_collaborators": O.shared_counts(x["near"], y["near"])[i, j],
            "method_similarity": jaccard("method_similarity")[0], "problem_similarity": jaccard("problem_similarity")[0], "complementarity": np.where(known, 1 - category, 0.0), "same_institution": same_place,
            "shared_topics": None if best else O.greatest_common(x["topics"], y["topics"], "n", (i, j), 2),
        }
        ready = lambda s, k: (s["graph_ready"] == "true")[k]
        own = lambda s, k: np.array([np.nan if v is None else float(v) for v in s["points"]])[k]
        there = pd.DataFrame({"focus_id": ids[i], "candidate_id": others[j], **pairs, "has_institution": to_known[j], "graph_ready": ready(y, j), "points": own(y, j)})[asks[i]]
        back = pd.DataFrame({"focus_id": others[j], "candidate_id": ids[i], **pairs, "has_institution": at_known[i], "graph_ready": ready(x, i), "points": own(x, i)})[answers[j]]
        return pd.concat([there, back], ignore_index=True)

    return O.in_tiles(blocks, tiles, parts, kernel, PAIR_FEATURES, (lambda: _Best(best, k)) if best else None)


def _eligible(f: pd.DataFrame, name: str) -> np.ndarray:
    """Which rows a list takes; these are the filters of the functions below."""
    if name == "peer":
        return (f.graph_ready & (f.topic_overlap >= 0.18) & (f.temporal >= 0.15)).to_numpy()
    if name == "reference":
        return (f.graph_ready & (f.topic_overlap >= 0.15) & f.points.notna()).to_numpy()
    lead = f.graph_ready & (f.direct_count <= 1) & (f.shared_collaborators >= 1) & (f.topic_overlap >= 0.15) & (f.complementarity >= 0.15)
    if name == "potential_collaborator":
        return lead.to_numpy()
    return (f.graph_ready & (f.direct_count < 2) & (f.recent_overlap >= 0.25) & (f.problem_similarity >= 0.08) & (f.method_similarity >= 0.08) & (f.temporal >= 0.15) & ~lead).to_numpy()


def _score(f: pd.DataFrame, name: str) -> np.ndarray:
    """A list's score, but for the last bits."""
    if name == "peer":
        score = f.topic_overlap * 0.45 + f.temporal * 0.20 + f.recent_overlap * 0.25 + f.has_institution * 0.1
    elif name == "reference":
        score = f.topic_overlap * 0.30 + f.points
    elif name == "potential_collaborator":
        score = f.topic_overlap * 0.25 + f.complementarity * 0.25 + np.minimum(1, f.shared_collaborators / 3) * 0.20 + np.minimum(1, f.direct_count / 4) * 0.20 + f.temporal * 0.10
    else:
        score = f.recent_overlap * 0.35 + f.problem_similarity * 0.25 + f.method_similarity * 0.20 + f.temporal * 0.15 + (f.direct_count == 0) * 0.05
    return np.clip(score.to_numpy(np.float64) * 100, 0, 100)


#: Lists of recommendations that ``pair_features`` can look ahead to.
LISTS = ("peer", "potential_collaborator", "potential_competitor", "reference")


class _Best:
    """Keeps, of the rows of many tiles, those that can be among the first k of a focus on one of the lists.

    The index is rounded to a digit, and on which side of a midpoint a score falls is left to Spark: each row has a least and a greatest
    index, and only rows are dropped whose greatest is behind the least of k others (ties by candidate).
    """

    def __init__(self, names: tuple[str, ...], k: int, most: int = 200_000):
        self.names, self.k, self.most, self.held, self.rows = names, k, most, [], 0
        self.floors: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, rows: pd.DataFrame | None) -> pd.DataFrame | None:
        if rows is not None:
            keep = np.zeros(len(rows), bool)
            for name in self.names:
                own = _eligible(rows, name)
                top = np.floor(_score(rows, name) * 10 + 0.5 + 1e-7)
                if name in self.floors and len(self.floors[name][0]):
                    ids, floor = self.floors[name]
                    at = np.minimum(np.searchsorted(ids, rows.focus_id.to_numpy()), len(ids) - 1)
                    own &= (ids[at] != rows.focus_id.to_numpy()) | (top >= floor[at])
                keep |= own
            self.held.append(rows[keep])
            self.rows += int(keep.sum())
            if self.rows > self.most:
                kept_ = self._first()
                self.held, self.rows = [kept_], len(kept_)
                self.most = max(self.most, 2 * self.rows)
            return None
        return self._first() if self.held else None

    def _first(self) -> pd.DataFrame:
        rows = pd.concat(self.held, ignore_index=True)
        keep = np.zeros(len(rows), bool)
        focus, candidate = rows.focus_id.to_numpy(), rows.candidate_id.to_numpy()
        for name in self.names:
            at = np.nonzero(_eligible(rows, name))[0]
            if not len(at):
                continue
            score = _score(rows, name)[at] * 10 + 0.5
            least, greatest = np.floor(score - 1e-7), np.floor(score + 1e-7)
            order = np.lexsort((candidate[at], -least, focus[at]))
            at, least, greatest = at[order], least[order], greatest[order]
            begins = np.nonzero(np.diff(focus[at], prepend=focus[at][0] - 1))[0]
            sizes = np.diff(np.append(begins, len(at)))
            last = begins + np.minimum(self.k, sizes) - 1
            bar, tie = np.repeat(least[last], sizes), np.repeat(candidate[at][last], sizes)
            keep[at[(greatest > bar) | ((greatest == bar) & (candidate[at] <= tie)) | np.repeat(sizes <= self.k, sizes)]] = True
            full = sizes > self.k - 1
            self.floors[name] = (focus[at][begins][full], least[last][full])
        return rows[keep]


def ranked(rows: DataFrame, k: int = 20) -> DataFrame:
    """Per focus the k rows of greatest index, ties by candidate."""
    return top(rows, ["focus_id"], [F.desc("index"), F.col("candidate_id")], k)


def recommend_peers(features: DataFrame, k: int = 20) -> DataFrame:
    x = features.filter("graph_ready and topic_overlap >= 0.18 and temporal >= 0.15")
    score = F.col("topic_overlap") * 0.45 + F.col("temporal") * 0.20 + F.col("recent_overlap") * 0.25 + F.when(F.col("has_institution"), 0.1).otherwise(0.0)
    return ranked(x.select("focus_id", "candidate_id", _index(score * 100).alias("index")), k)


def collaborator_leads(features: DataFrame) -> DataFrame:
    x = features.filter("graph_ready and direct_count <= 1 and shared_collaborators >= 1 and topic_overlap >= 0.15 and complementarity >= 0.15")
    score = (
        F.col("topic_overlap") * 0.25 + F.col("complementarity") * 0.25 + F.least(F.lit(1.0), F.col("shared_collaborators") / 3) * 0.20
        + F.least(F.lit(1.0), F.col("direct_count") / 4) * 0.20 + F.col("temporal") * 0.10
    )
    return x.select("focus_id", "candidate_id", _index(score * 100).alias("index"))


def recommend_collaborators(features: DataFrame, k: int = 20) -> DataFrame:
    return ranked(collaborator_leads(features), k)


def recommend_competitors(features: DataFrame, k: int = 20) -> DataFrame:
    """Not those who are collaborator leads, however low these rank."""
    x = features.join(collaborator_leads(features).select("focus_id", "candidate_id"), ["focus_id", "candidate_id"], "left_anti")
    x = x.filter("graph_ready and direct_count < 2 and recent_overlap >= 0.25 and problem_similarity >= 0.08 and method_similarity >= 0.08 and temporal >= 0.15")
    score = (
        F.col("recent_overlap") * 0.35 + F.col("problem_similarity") * 0.25 + F.col("method_similarity") * 0.20 + F.col("temporal") * 0.15
        + F.when(F.col("direct_count") == 0, 0.05).otherwise(0.0)
    )
    return ranked(x.select("focus_id", "candidate_id", _index(score * 100).alias("index")), k)


def activity(works: DataFrame, authorships: DataFrame, citations: DataFrame) -> DataFrame:
    """(scholar_id, works, recent_works, downstream): works, those since the newest year less 3, and the share cited within the corpus."""
    newest = works.agg(F.max("publication_year").alias("as_of"))
    own = authorships.select("scholar_id", "work_id").distinct().join(works.select("work_id", F.coalesce("publication_year", F.lit(0)).alias("year")), "work_id").crossJoin(F.broadcast(newest)).join(incoming_internal(citations, works), "work_id", "left")
    return own.groupBy("scholar_id").agg(
        F.count("*").alias("works"), F.count_if(F.col("year") >= F.col("as_of") - 3).alias("recent_works"), (F.count_if(F.coalesce("incoming", F.lit(0)) > 0) / F.count("*")).alias("downstream")
    )


def recommend_references(features: DataFrame, works: DataFrame, authorships: DataFrame, dimensions: DataFrame, citations: DataFrame, k: int = 20) -> DataFrame:
    """dimensions: (scholar_id, quality, continuity, impact); a null quality fails, a null continuity or impact counts as 0. ``reference_points`` tells what of the index rests on the candidate alone."""
    n = activity(works, authorships, citations).withColumnRenamed("scholar_id", "candidate_id")
    x = features.join(n, "candidate_id").join(dimensions.withColumnRenamed("scholar_id", "candidate_id"), "candidate_id").filter("graph_ready and topic_overlap >= 0.15 and quality is not null and works >= 4")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = (
        F.col("topic_overlap") * 0.30 + F.col("quality") / 100 * 0.20 + zero("continuity") / 100 * 0.15 + zero("impact") / 100 * 0.15
        + F.least(F.lit(1.0), F.col("recent_works") / 4) * 0.10 + F.col("downstream") * 0.10
    )
    return ranked(x.select("focus_id", "candidate_id", _index(score * 100).alias("index")), k)


def reference_points(works: DataFrame, authorships: DataFrame, dimensions: DataFrame, citations: DataFrame) -> DataFrame:
    """(scholar_id, points) of all who can be a reference: the part of its score that doesn't depend on who asks."""
    x = activity(works, authorships, citations).join(dimensions.hint("merge"), "scholar_id").filter("quality is not null and works >= 4")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    points = F.col("quality") / 100 * 0.20 + zero("continuity") / 100 * 0.15 + zero("impact") / 100 * 0.15 + F.least(F.lit(1.0), F.col("recent_works") / 4) * 0.10 + F.col("downstream") * 0.10
    return x.select("scholar_id", points.alias("points"))


def merge_recommendations(categories: dict[str, DataFrame]) -> DataFrame:
    """One row per focus and candidate: its categories, the best one (ties by name) and the greatest index."""
    parts = [df.select("focus_id", "candidate_id", "index", F.lit(name).alias("category")) for name, df in categories.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min_by("category", F.struct((-F.col("index")).alias("i"), F.col("category").alias("c")))
    return every.groupBy("focus_id", "candidate_id").agg(F.array_sort(F.collect_set("category")).alias("categories"), best.alias("best_category"), F.max("index").alias("index"))
