"""Baselines, revisions, budgets, progress and comparisons of scholars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rollups import dealt_topics, top


def mark_seen(favorites: DataFrame, requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Favourites (user_id, scholar_id, seen_version, seen_papers, seen_citations) after requests (user_id, scholar_id, version).

    The version seen only grows and never passes the current one; totals move only if the request knew the current version.
    profiles: (scholar_id, version, papers, citations).
    """
    asked = requests.groupBy("user_id", "scholar_id").agg(F.max("version").alias("asked"))
    x = favorites.join(asked, ["user_id", "scholar_id"], "left").join(profiles.withColumnRenamed("version", "current"), "scholar_id", "left")
    known = F.col("asked").isNotNull() & F.col("current").isNotNull()
    caught_up = known & (F.col("current") <= F.col("asked"))
    return x.select(
        "user_id", "scholar_id", F.when(known, F.greatest("seen_version", F.least("asked", "current"))).otherwise(F.col("seen_version")).alias("seen_version"),
        F.when(caught_up, F.col("papers")).otherwise(F.col("seen_papers")).alias("seen_papers"), F.when(caught_up, F.col("citations")).otherwise(F.col("seen_citations")).alias("seen_citations"),
    )


def budget_state(readings: DataFrame, as_of: Column, reserve: int = 200) -> DataFrame:
    """The last known limit, remaining and reset of each provider, and the seconds to wait where remaining has come down to the reserve.

    readings: (provider, seq, limit_credits, remaining_credits, reset_at).
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    x = readings.groupBy("provider").agg(last("limit_credits"), last("remaining_credits"), last("reset_at"))
    wait = F.greatest(F.lit(1), F.ceil(F.unix_micros("reset_at") / 1e6 - F.unix_micros(as_of) / 1e6)).cast("long")
    return x.withColumn("retry_after", F.when((F.col("remaining_credits") <= reserve) & (F.col("reset_at") > as_of), wait))


def revision_tokens(scopes: DataFrame, states: DataFrame) -> DataFrame:
    """(focus_id, token): a digest of the states (scholar_id, status, version) of a focus and its candidates; scopes: (focus_id, scholar_id)."""
    x = scopes.select("focus_id", "scholar_id").distinct().join(states, "scholar_id", "left")
    fact = F.concat_ws("~", F.col("scholar_id").cast("string"), F.coalesce("status", F.lit("")), F.coalesce("version", F.lit(0)).cast("string"))
    return x.groupBy("focus_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(fact)), "|"), 256).alias("token"))


def changed_focus(tokens: DataFrame, stored: DataFrame) -> DataFrame:
    """The focus scholars whose token differs from the stored one or has none."""
    return tokens.join(stored.withColumnRenamed("token", "before"), "focus_id", "left").filter("before is null or before <> token").select("focus_id")


def pick_requester(favorites: DataFrame, history: DataFrame) -> DataFrame:
    """Per scholar one user: favourites before history, the latest first. Both: (scholar_id, user_id, at)."""
    every = favorites.select("scholar_id", "user_id", "at", F.lit(0).alias("priority")).unionByName(history.select("scholar_id", "user_id", "at", F.lit(1).alias("priority")))
    return every.groupBy("scholar_id").agg(F.min_by("user_id", F.struct("priority", (-F.unix_micros("at")).alias("late"), "user_id")).alias("user_id"))


def activity_matrix(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, topics: int = 6, years: int = 6) -> DataFrame:
    """Papers of each scholar's most frequent topics in its latest years, zeros included."""
    own = dealt_topics(works.filter("publication_year is not null"), authorships, work_topics, "publication_year").filter(F.size("topics") > 0)
    last = own.groupBy("scholar_id").agg(F.max("publication_year").alias("last"))
    near = own.hint("merge").join(last, "scholar_id").filter(F.col("publication_year") > F.col("last") - years)
    counted = near.select("scholar_id", "last", "copies", F.col("publication_year").alias("year"), F.explode("topics").alias("topic")).groupBy("scholar_id", "last", "topic", "year").agg(F.sum("copies").alias("papers"))
    series = counted.groupBy("scholar_id", "last", "topic").agg(F.sum("papers").alias("n"), F.map_from_entries(F.collect_list(F.struct("year", "papers"))).alias("by_year"))  # ``years`` entries at most
    best = top(series, ["scholar_id"], [F.desc("n"), F.col("topic")], topics)
    grid = best.select("scholar_id", "topic", "by_year", F.explode(F.sequence(F.col("last") - (years - 1), F.col("last"))).alias("year"))
    return grid.select("scholar_id", "topic", "year", F.coalesce(F.try_element_at("by_year", F.col("year")), F.lit(0)).alias("papers"))


def compare_profiles(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Both sides' totals and citations per paper; pairs: (a, b), totals: (scholar_id, papers, citations, h_index)."""
    per = F.when(F.col("papers") > 0, F.round(F.col("citations") / F.col("papers"), 2)).otherwise(0.0)
    side = lambda s: totals.select(F.col("scholar_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("papers", "citations", "h_index")], per.alias(f"{s}_per_paper"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")


def compare_dimensions(pairs: DataFrame, dimensions: DataFrame, close: float = 8.0) -> DataFrame:
    """(a, b, dimension, a_index, b_index, outcome): close if less than ``close`` apart, insufficient if either has none. dimensions: (scholar_id, <name>...)."""
    names = [c for c in dimensions.columns if c != "scholar_id"]
    long = dimensions.unpivot("scholar_id", names, "dimension", "index")
    x = pairs.join(long.select(F.col("scholar_id").alias("a"), "dimension", F.col("index").alias("a_index")), "a").join(long.select(F.col("scholar_id").alias("b"), "dimension", F.col("index").alias("b_index")), ["b", "dimension"])
    gap = F.col("a_index") - F.col("b_index")
    outcome = F.when(gap.isNull(), "insufficient").when(F.abs(gap) < close, "close").when(gap > 0, "a").otherwise("b")
    return x.select("a", "b", "dimension", "a_index", "b_index", outcome.alias("outcome"))


def discovery_progress(candidates: DataFrame, most: int = 20) -> DataFrame:
    """Per focus how many candidates (focus_id, candidate_id, status, usable) are ready, failed, queued and attempted, and the target."""
    waiting = F.col("status").isin("queued", "updating")
    x = candidates.groupBy("focus_id").agg(
        F.count("*").alias("discovered"), F.count_if("usable").alias("ready"), F.count_if((F.col("status") == "failed") & ~F.col("usable")).alias("failed"), F.count_if(waiting).alias("queued"),
        F.count_if(F.col("usable") | waiting | (F.col("status") == "failed")).alias("attempted"),
    )
    x = x.withColumn("target", F.least(F.lit(most).cast("long"), "discovered"))
    done = F.when((F.col("failed") > 0) | (F.col("ready") < F.col("target")), "partial").otherwise("ready")
    return x.withColumn("final_status", F.when(F.col("attempted") >= F.col("target"), done).when(F.col("queued") > 0, "enriching").otherwise("next_batch"))


def next_batch(candidates: DataFrame, most: int = 20, initial: int = 8, later: int = 4) -> DataFrame:
    """(focus_id, place, candidate_id): the never synced candidates to sync next, by discovery_rank, of each focus that waits for a batch.

    The first batch has ``initial`` candidates, others ``later``; no more than are missing to the target.
    """
    waits = discovery_progress(candidates, most).filter("final_status = 'next_batch'")
    size = F.least(F.when(F.col("attempted") == 0, initial).otherwise(later).cast("long"), F.col("target") - F.col("attempted"))
    new = top(candidates.filter("status = 'never' and not usable"), ["focus_id"], [F.col("discovery_rank"), F.col("candidate_id")], max(initial, later), "place")
    return new.hint("merge").join(waits.select("focus_id", size.alias("size")), "focus_id").filter("place <= size").select("focus_id", "place", "candidate_id")


def rank_search_hits(hits: DataFrame, k: int = 100) -> DataFrame:
    """Per query the hits (query, id, institution, citations, works), each id once: those with an institution first, then by citations and works."""
    best = hits.groupBy("query", "id").agg(F.max(F.struct("citations", "works", "institution")).alias("h")).select("query", "id", "h.*")
    return top(best, ["query"], [F.desc(F.col("institution").isNotNull().cast("int")), F.desc("citations"), F.desc("works"), F.col("id")], k)


def relative_position(metrics: DataFrame, key: str, feature: str) -> DataFrame:
    """Adds the tie-aware rank of a feature within its key, between 0 and 1; 0.5 where there is one row."""
    w = Window.partitionBy(key)
    below = F.rank().over(w.orderBy(feature)) - 1
    ties, n = F.count("*").over(Window.partitionBy(key, feature)), F.count("*").over(w)
    return metrics.withColumn("position", F.when(n <= 1, 0.5).otherwise((below + (ties - 1) / 2) / (n - 1)))


def team_view(scholars: DataFrame, works: DataFrame, authorships: DataFrame) -> DataFrame:
    """Per institution (scholars: scholar_id, institution_id) its members, distinct works and active years."""
    own = authorships.select("scholar_id", "work_id").join(works.select("work_id", "publication_year"), "work_id")
    x = scholars.filter("institution_id is not null").join(own, "scholar_id", "left")
    return x.groupBy("institution_id").agg(F.count_distinct("scholar_id").alias("members"), F.count_distinct("work_id").alias("works"), F.count_distinct("publication_year").alias("active_years"))
