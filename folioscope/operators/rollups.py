"""Per-scholar aggregations: every function takes and returns DataFrames and works on all scholars at once.

works: (work_id, publication_year, cited_by_count, ...); authorships: (work_id, scholar_id, ...); work_topics: (work_id, topic, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def h_index(df: DataFrame, key: str, citations: str) -> DataFrame:
    """(key, h_index): the greatest h with h rows of h or more citations."""
    # per (key, citations) one row, so that a prolific scholar's works need not be sorted one by one
    levels = df.groupBy(key, F.greatest(F.coalesce(F.col(citations), F.lit(0)), F.lit(0)).alias("c")).agg(F.count("*").alias("n"))
    at_least = F.sum("n").over(Window.partitionBy(key).orderBy(F.desc("c")))
    return levels.withColumn("m", F.least(F.col("c"), at_least)).groupBy(key).agg(F.max("m").cast("int").alias("h_index"))


def citation_summary(works: DataFrame, authorships: DataFrame) -> DataFrame:
    """Papers, citations and h-index of every scholar."""
    own = authorships.select("scholar_id", "work_id").join(works.select("work_id", "cited_by_count"), "work_id")
    sums = own.groupBy("scholar_id").agg(F.count("*").alias("papers"), F.sum(F.coalesce("cited_by_count", F.lit(0))).alias("citations"))
    return sums.join(h_index(own, "scholar_id", "cited_by_count"), "scholar_id")


def yearly_trend(works: DataFrame, authorships: DataFrame) -> DataFrame:
    """Papers and citations of every scholar and year; works without a year are left out."""
    own = authorships.select("scholar_id", "work_id").join(works.filter("publication_year is not null"), "work_id")
    return own.groupBy("scholar_id", F.col("publication_year").alias("year")).agg(F.count("*").alias("papers"), F.sum("cited_by_count").alias("citations"))


def coauthor_pairs(authorships: DataFrame) -> DataFrame:
    """(work_id, scholar_a, scholar_b) with scholar_a < scholar_b: every pair of authors of a work."""
    # authors are listed per work first: one row per work is shuffled, and pairs are made within the row
    listed = authorships.groupBy("work_id").agg(F.array_sort(F.collect_set("scholar_id")).alias("s"))
    first = listed.select("work_id", "s", F.posexplode("s").alias("i", "scholar_a"))
    return first.select("work_id", "scholar_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("scholar_b"))


def dealt_coauthors(authorships: DataFrame) -> DataFrame:
    """(scholar_id, other_id, work_id): each work of each pair of scholars, both directions, dealt by scholar_id.

    A row a work and scholar is sent, with all authors of the work; the pairs are made where it lies, so counts by scholar need no other shuffle.
    """
    listed = authorships.groupBy("work_id").agg(F.collect_set("scholar_id").alias("s"))
    rows = dealt(listed.select("work_id", F.explode("s").alias("scholar_id"), "s").filter("size(s) > 1"))
    return rows.select("scholar_id", F.explode("s").alias("other_id"), "work_id").filter("other_id <> scholar_id")


def symmetrise(pairs: DataFrame, a: str = "scholar_a", b: str = "scholar_b") -> DataFrame:
    """Both directions of unordered pairs, as (scholar_id, other_id, ...)."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    both = F.explode(F.array(F.struct(F.col(a).alias("scholar_id"), F.col(b).alias("other_id")), F.struct(F.col(b).alias("scholar_id"), F.col(a).alias("other_id"))))
    return pairs.select(both.alias("p"), *rest).select("p.*", *rest)


def collaborations(works: DataFrame, authorships: DataFrame) -> DataFrame:
    """Per pair of scholars first and last year, number of joint works, years and works."""
    pairs = coauthor_pairs(authorships).hint("merge").join(works.select("work_id", "publication_year"), "work_id")
    return pairs.groupBy("scholar_a", "scholar_b").agg(
        F.min("publication_year").alias("first_year"),
        F.max("publication_year").alias("last_year"),
        F.count("*").alias("works_count"),
        F.array_sort(F.collect_set("publication_year")).alias("years"),
        F.array_sort(F.collect_set("work_id")).alias("works"),
    )


def coauthors(works: DataFrame, authorships: DataFrame, scholars: DataFrame, institutions: DataFrame, k: int = 30) -> DataFrame:
    """Per scholar the k co-authors with most joint papers (ties by id), with name, institution and papers."""
    both = dealt_coauthors(authorships).groupBy("scholar_id", "other_id").agg(F.count("*").alias("papers"), F.array_sort(F.collect_list("work_id")).alias("works"))
    best = top(both, ["scholar_id"], [F.desc("papers"), F.col("other_id")], k)
    names = scholars.join(institutions.select("institution_id", F.col("display_name").alias("institution")), "institution_id", "left")
    named = names.groupBy("scholar_id").agg(F.min("display_name").alias("name"), F.min("institution").alias("institution"))
    return best.hint("merge").join(named.withColumnRenamed("scholar_id", "other_id"), "other_id", "left").select("scholar_id", "rank", "other_id", "papers", "name", "institution", "works")


def ego_network(works: DataFrame, authorships: DataFrame, k: int = 20) -> DataFrame:
    """Nodes and weighted edges of each scholar's k strongest co-authors, as (scholar_id, kind, node_id, weight)."""
    both = dealt_coauthors(authorships).groupBy("scholar_id", "other_id").agg(F.count("*").alias("weight"))
    best = top(both, ["scholar_id"], [F.desc("weight"), F.col("other_id")], k)
    self_nodes = authorships.select("scholar_id").distinct().select("scholar_id", F.lit("self").alias("kind"), F.col("scholar_id").alias("node_id"), F.lit(None).cast("long").alias("weight"))
    return self_nodes.unionByName(best.select("scholar_id", F.lit("coauthor").alias("kind"), F.col("other_id").alias("node_id"), "weight"))


def dealt(own: DataFrame, key: str = "scholar_id") -> DataFrame:
    """Rows dealt by scholar (or another key) into four times the usual number of partitions, since each row is exploded into several where it lies; Spark doesn't merge them again."""
    return own.repartition(4 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def dealt_topics(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, *columns: str) -> DataFrame:
    """(scholar_id, work_id, copies, columns of works, topics): each work of each scholar once, dealt by scholar, with its distinct topics in one row (null without any).

    copies is the number of its rows in authorships. All that follows by scholar and topic is made where the rows lie: topics are exploded after the shuffle and not sent.
    """
    listed = work_topics.groupBy("work_id").agg(F.array_sort(F.collect_set(F.struct("topic"))).alias("t")).select("work_id", F.col("t.topic").alias("topics"))
    own = authorships.groupBy("scholar_id", "work_id").agg(F.count("*").alias("copies")).hint("merge").join(works.select("work_id", *columns), "work_id")
    return dealt(own.hint("merge").join(listed, "work_id", "left").select("scholar_id", "work_id", "copies", *columns, "topics"))


def labels_of(authorships: DataFrame, work_topics: DataFrame) -> DataFrame:
    """(scholar_id, work_id, topics): each work with topics of each scholar once, its distinct topics in one row."""
    listed = work_topics.groupBy("work_id").agg(F.collect_set(F.struct("topic")).alias("t")).select("work_id", F.col("t.topic").alias("topics"))
    return authorships.select("scholar_id", "work_id").distinct().hint("merge").join(listed, "work_id")


def scholar_topics(works: DataFrame, authorships: DataFrame, work_topics: DataFrame) -> DataFrame:
    """Per scholar and topic first and last year, number of works and years."""
    own = dealt_topics(works, authorships, work_topics, "publication_year").select("scholar_id", "publication_year", F.explode("topics").alias("topic"))
    # counted by year first, by hash: a set per topic would be sorted and spilled row by row
    yearly = own.groupBy("scholar_id", "topic", "publication_year").agg(F.count("*").alias("n"))
    return yearly.groupBy("scholar_id", "topic").agg(
        F.min("publication_year").alias("first_year"),
        F.max("publication_year").alias("last_year"),
        F.sum("n").alias("works_count"),
        F.array_sort(F.collect_list("publication_year")).alias("years"),
    )


def topic_years(works: DataFrame, authorships: DataFrame, work_topics: DataFrame) -> DataFrame:
    """(scholar_id, topic, year, papers), works without a year left out; dealt by scholar."""
    return _topic_years(dealt_topics(works.filter("publication_year is not null"), authorships, work_topics, "publication_year"))


def _topic_years(rows: DataFrame) -> DataFrame:
    own = rows.select("scholar_id", "copies", F.col("publication_year").alias("year"), F.explode("topics").alias("topic"))
    return own.groupBy("scholar_id", "topic", "year").agg(F.sum("copies").alias("papers"))


def topic_year_series(works: DataFrame, authorships: DataFrame, work_topics: DataFrame) -> DataFrame:
    """Per scholar and topic the series of (year, papers), ascending."""
    counted = topic_years(works, authorships, work_topics)
    return counted.groupBy("scholar_id", "topic").agg(F.array_sort(F.collect_list(F.struct("year", "papers"))).alias("series"))


def affiliation_history(bylines: DataFrame, scholars: DataFrame) -> DataFrame:
    """Years (newest first) of every scholar and institution of bylines or last known."""
    last = scholars.filter("institution_id is not null").select("scholar_id", "institution_id", F.lit(None).cast("int").alias("year"), F.lit(True).alias("is_last_known"))
    every = bylines.select("scholar_id", "institution_id", "year", F.lit(False).alias("is_last_known")).unionByName(last)
    return every.groupBy("scholar_id", "institution_id").agg(F.sort_array(F.collect_set("year"), asc=False).alias("years"), F.max("is_last_known").alias("is_last_known"))


def merged_affiliations(bylines: DataFrame, scholars: DataFrame) -> DataFrame:
    """(scholar, institution, first and last year, number of years, is_current)."""
    return affiliation_history(bylines, scholars).select(
        "scholar_id", "institution_id", F.array_min("years").alias("start_year"), F.array_max("years").alias("end_year"), F.size("years").alias("n_years"), F.col("is_last_known").alias("is_current")
    )


def primary_affiliation(bylines: DataFrame, institutions: DataFrame, window: int = 6) -> DataFrame:
    """The institution with most years in the scholar's latest ``window`` years, then the latest, most years in all, greatest folded name."""
    years = bylines.filter("year is not null").select("scholar_id", "institution_id", "year").distinct()
    newest = years.groupBy("scholar_id").agg(F.max("year").alias("newest"))
    scored = (
        years.join(newest, "scholar_id")
        .groupBy("scholar_id", "institution_id")
        .agg(F.count_if(F.col("year") > F.col("newest") - window).alias("recent"), F.max("year").alias("latest"), F.count("*").alias("n"))
        .join(institutions.select("institution_id", F.lower("display_name").alias("folded")), "institution_id")
    )
    return scored.groupBy("scholar_id").agg(F.max_by("institution_id", F.struct("recent", "latest", "n", "folded")).alias("institution_id"), F.max("latest").alias("latest_year"))


def timeline_events(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, bylines: DataFrame, scholars: DataFrame) -> DataFrame:
    """Papers, topic, collaboration and institution events with a stable key."""
    event = lambda kind, subject, year: [
        "scholar_id", F.concat_ws(":", F.lit(kind), subject.cast("string")).alias("event_key"), F.lit(kind).alias("event_type"), year.cast("int").alias("event_year")
    ]
    paper = authorships.select("scholar_id", "work_id").join(works.filter("publication_year is not null"), "work_id")
    topic = scholar_topics(works, authorships, work_topics).filter("first_year is not null")
    pair = symmetrise(collaborations(works, authorships).select("scholar_a", "scholar_b", "first_year").filter("first_year is not null"))
    place = merged_affiliations(bylines, scholars)
    parts = [
        paper.select(*event("paper_published", F.col("work_id"), F.col("publication_year"))),
        topic.select(*event("topic_started", F.col("topic"), F.col("first_year"))),
        pair.select(*event("collaboration_started", F.col("other_id"), F.col("first_year"))),
        place.filter("start_year is not null").select(*event("institution_started", F.col("institution_id"), F.col("start_year"))),
        place.filter("end_year is not null and not is_current").select(*event("institution_ended", F.col("institution_id"), F.col("end_year"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def interest_timeline(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, k: int = 5) -> DataFrame:
    """Per scholar and year the k most frequent topics."""
    return top(topic_years(works, authorships, work_topics), ["scholar_id", "year"], [F.desc("papers"), F.col("topic")], k)


def direction_changes(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, w: int = 3, k: int = 5) -> DataFrame:
    """Topics whose share changes between the scholar's last w years and the w before: emerging, rising or falling, the k with most papers.

    Emerging: no paper before; rising or falling: a share delta of 0.04, or of 0.02 with a ratio of 1.5.
    """
    counted = topic_years(works, authorships, work_topics)
    last = counted.groupBy("scholar_id").agg(F.max("year").alias("last"))
    windows = counted.join(last, "scholar_id").filter(F.col("year") > F.col("last") - 2 * w)
    recent = F.col("year") > F.col("last") - w
    n = windows.groupBy("scholar_id", "topic").agg(F.sum(F.when(recent, F.col("papers")).otherwise(0)).alias("recent"), F.sum(F.when(~recent, F.col("papers")).otherwise(0)).alias("earlier"))
    totals = n.groupBy("scholar_id").agg(F.sum("recent").alias("all_recent"), F.sum("earlier").alias("all_earlier"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    s = n.join(totals, "scholar_id").withColumn("new_share", share("recent", "all_recent")).withColumn("old_share", share("earlier", "all_earlier"))
    delta = F.col("new_share") - F.col("old_share")
    up = (delta >= 0.04) | ((delta >= 0.02) & (F.col("new_share") >= 1.5 * F.col("old_share")))
    down = (delta <= -0.04) | ((delta <= -0.02) & (F.col("old_share") >= 1.5 * F.col("new_share")))
    kind = F.when((F.col("earlier") == 0) & (F.col("recent") > 0), "emerging").when(up, "rising").when(down, "falling")
    changed = s.withColumn("change", kind).filter("change is not null")
    return top(changed, ["scholar_id"], [F.desc(F.greatest("recent", "earlier")), F.col("topic")], k).select("scholar_id", "rank", "topic", "change", "recent", "earlier", F.round(delta, 6).alias("delta"))


def research_phases(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, most: int = 5, k: int = 5) -> DataFrame:
    """Phases of equal width (the span by ``most``, 3 years at least) with papers, citations and the k most frequent topics."""
    own = dealt_topics(works.filter("publication_year is not null"), authorships, work_topics, "publication_year", "cited_by_count")
    span = own.groupBy("scholar_id").agg(F.min("publication_year").alias("first"), F.max("publication_year").alias("last"))
    span = span.withColumn("width", F.greatest(F.lit(3), F.ceil((F.col("last") - F.col("first") + 1) / most)).cast("int"))
    placed = own.hint("merge").join(span, "scholar_id").withColumn("phase", F.floor((F.col("publication_year") - F.col("first")) / F.col("width")).cast("int"))
    sums = placed.groupBy("scholar_id", "phase").agg(
        F.min(F.col("first") + F.col("phase") * F.col("width")).alias("start_year"),
        F.least(F.min("last"), F.min(F.col("first") + (F.col("phase") + 1) * F.col("width") - 1)).alias("end_year"),
        F.sum("copies").alias("papers"),
        F.sum(F.col("cited_by_count") * F.col("copies")).alias("citations"),
    )
    topics = placed.select("scholar_id", "phase", F.explode("topics").alias("topic")).groupBy("scholar_id", "phase", "topic").agg(F.count("*").alias("n"))
    best = top(topics, ["scholar_id", "phase"], [F.desc("n"), F.col("topic")], k)
    listed = best.groupBy("scholar_id", "phase").agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("t"))
    return sums.join(listed, ["scholar_id", "phase"], "left").withColumn("topics", F.coalesce(F.transform("t", lambda x: x["topic"]), F.array().cast("array<string>"))).drop("t")


def phase_transitions(phases: DataFrame) -> DataFrame:
    """Topics that emerged, continued or faded between phases that follow one another (phases without papers have no row)."""
    w = Window.partitionBy("scholar_id").orderBy("phase")
    pairs = phases.select("scholar_id", "phase", "topics", F.lag("phase").over(w).alias("from_phase"), F.lag("topics").over(w).alias("before")).filter("from_phase is not null")
    return pairs.select(
        "scholar_id",
        "from_phase",
        F.col("phase").alias("to_phase"),
        F.array_sort(F.array_except("topics", "before")).alias("emerged"),
        F.array_sort(F.array_intersect("topics", "before")).alias("continued"),
        F.array_sort(F.array_except("before", "topics")).alias("faded"),
    )


def with_topics(works: DataFrame, authorships: DataFrame, work_topics: DataFrame) -> DataFrame:
    """(scholar_id, work_id, publication_year, topics): each work of each scholar once, its distinct topics in one row (null without any).

    Topics are shuffled as one row a work and scholar; who needs them by topic deals these rows by scholar and explodes them there.
    """
    listed = work_topics.groupBy("work_id").agg(F.array_sort(F.collect_set(F.struct("topic"))).alias("t")).select("work_id", F.col("t.topic").alias("topics"))
    own = authorships.select("scholar_id", "work_id").distinct().hint("merge").join(works.select("work_id", "publication_year"), "work_id")
    return own.hint("merge").join(listed, "work_id", "left").select("scholar_id", "work_id", "publication_year", "topics")


def field_topics(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, k: int = 8) -> DataFrame:
    """Per scholar k topics: those of several years first, then by works; only sustained ones where there are any."""
    return field_topics_of(with_topics(works, authorships, work_topics), k)


def field_topics_of(own: DataFrame, k: int = 8) -> DataFrame:
    """``field_topics`` from the rows of ``with_topics``."""
    t = dealt(own).select("scholar_id", "publication_year", F.explode("topics").alias("topic"))
    # counted by year first, by hash: a set per topic would be sorted and spilled row by row
    t = t.groupBy("scholar_id", "topic", "publication_year").agg(F.count("*").alias("n"))
    t = t.groupBy("scholar_id", "topic").agg(F.sum("n").alias("works_count"), F.count("publication_year").cast("int").alias("active_years"))
    t = t.withColumn("sustained", (F.col("works_count") >= 2) | (F.col("active_years") >= 2))
    # the order puts sustained topics before all others, so it suffices to look for one among the first k
    t = top(t, ["scholar_id"], [F.desc((F.col("active_years") >= 2).cast("int")), F.desc("works_count"), F.col("topic")], k)
    t = t.withColumn("any_sustained", F.max("sustained").over(Window.partitionBy("scholar_id"))).filter("sustained or not any_sustained")
    return t.select("scholar_id", "rank", "topic", "works_count", "active_years")


def topic_lineup(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, k: int = 3, recent_years: int = 4) -> DataFrame:
    """The k long-term topics (2 works or years at least) and the k most frequent topics of the latest years, with flags."""
    counted = topic_years(works, authorships, work_topics)
    newest = counted.agg(F.max("year").alias("as_of"))
    t = counted.crossJoin(F.broadcast(newest)).groupBy("scholar_id", "topic").agg(  # one number
        F.sum("papers").alias("n"), F.count("*").alias("years"), F.sum(F.when(F.col("year") > F.col("as_of") - recent_years, F.col("papers")).otherwise(0)).alias("recent")
    )
    long = top(t.filter("n >= 2 or years >= 2"), ["scholar_id"], [F.desc("n"), F.desc("years"), F.col("topic")], k).select("scholar_id", "topic", F.lit(1).alias("long_term"), F.lit(0).alias("is_recent"))
    new = top(t.filter("recent > 0"), ["scholar_id"], [F.desc("recent"), F.desc("n"), F.col("topic")], k).select("scholar_id", "topic", F.lit(0).alias("long_term"), F.lit(1).alias("is_recent"))
    return long.unionByName(new).groupBy("scholar_id", "topic").agg(F.max("long_term").alias("long_term"), F.max("is_recent").alias("is_recent"))


def citation_lineage(works: DataFrame, authorships: DataFrame, citations: DataFrame, k: int = 100) -> DataFrame:
    """Per scholar the k newest citations of which both works are the scholar's own."""
    own = authorships.select("scholar_id", "work_id").distinct()
    citing = citations.join(own.select(F.col("scholar_id"), F.col("work_id").alias("citing_work_id")), "citing_work_id")
    both = citing.join(own.select("scholar_id", F.col("work_id").alias("cited_work_id")), ["scholar_id", "cited_work_id"], "left_semi")
    dated = both.join(works.select(F.col("work_id").alias("citing_work_id"), F.col("publication_year").alias("year")), "citing_work_id")
    return top(dated, ["scholar_id"], [F.desc_nulls_last("year"), F.col("citing_work_id"), F.col("cited_work_id")], k).select("scholar_id", "rank", "citing_work_id", "cited_work_id", "year")


def representative_by_topic(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, topics: DataFrame, k: int = 3) -> DataFrame:
    """The k most cited works of each of a scholar's topics (scholar_id, topic), some few a scholar."""
    wanted = topics.groupBy("scholar_id").agg(F.collect_set("topic").alias("wanted"))
    own = dealt_topics(works, authorships, work_topics, "cited_by_count").hint("merge").join(wanted, "scholar_id")
    own = own.select("scholar_id", F.explode(F.array_intersect("topics", "wanted")).alias("topic"), "work_id", "cited_by_count")
    return top(own, ["scholar_id", "topic"], [F.desc_nulls_last("cited_by_count"), F.col("work_id")], k)


def grouped_counts(works: DataFrame, work_topics: DataFrame, authorships: DataFrame, topics: DataFrame, since_year: int) -> DataFrame:
    """Works per scholar that carry one of the topics (topic): in all and since a year."""
    hit = work_topics.select("work_id", "topic").join(topics.select("topic").distinct(), "topic", "left_semi").select("work_id").distinct()
    own = authorships.select("scholar_id", "work_id").distinct().join(hit, "work_id", "left_semi").join(works.select("work_id", "publication_year"), "work_id")
    return own.groupBy("scholar_id").agg(F.count("*").alias("historical_works"), F.count_if(F.col("publication_year") >= since_year).alias("recent_works"))


def discover_institutions(counts: DataFrame, own: int | None = None, k: int = 60) -> DataFrame:
    """The k institutions (institution_id, historical_works, recent_works) with the greatest historical + 2 x recent works, and the focus's own one behind them."""
    scored = counts.withColumn("score", F.col("historical_works") + 2 * F.col("recent_works"))
    order = [F.desc("score"), F.col("institution_id")]
    best = scored.orderBy(*order).limit(k)  # k rows, so one task may number them
    forced = scored.filter(F.col("institution_id") == F.lit(own)).join(best.select("institution_id"), "institution_id", "left_anti")
    return best.unionByName(forced).withColumn("discovery_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def discover_candidates(counts: DataFrame, k: int = 60, most: int = 600, focus: int | None = None) -> DataFrame:
    """The k scholars with the greatest historical + 2 x recent works; the focus and those with more than ``most`` works are left out."""
    scored = counts.filter(F.col("historical_works") <= most).filter(~F.col("scholar_id").eqNullSafe(F.lit(focus))).withColumn("score", F.col("historical_works") + 2 * F.col("recent_works"))
    best = scored.orderBy(F.desc("score"), "scholar_id").limit(k)  # k rows, so one task may number them
    return best.withColumn("discovery_rank", F.row_number().over(Window.orderBy(F.desc("score"), "scholar_id")).cast("long"))
