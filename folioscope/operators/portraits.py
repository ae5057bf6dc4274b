"""Views of single scholars for all scholars at once: context of phases, networks, documents; institutions of a field; comparisons; candidates without an id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T

from .graph import components_of, kept
from .rollups import h_index, top, topic_years


def matrix_topics(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, k: int = 10) -> DataFrame:
    """The k topics with most dated works of each scholar, over all its phases."""
    n = topic_years(works, authorships, work_topics).groupBy("scholar_id", "topic").agg(F.sum("papers").alias("papers"))
    return top(n, ["scholar_id"], [F.desc("papers"), F.col("topic")], k)


def phase_context(phases: DataFrame, events: DataFrame, works: DataFrame, authorships: DataFrame, abstracts: DataFrame, k: int = 2) -> DataFrame:
    """Per phase (scholar_id, phase, start_year, end_year) its latest k institutions, its new collaborators, and its k most cited works with an abstract.

    events: (scholar_id, event_key, event_type, event_year). A scholar has few phases, so joins by scholar meet few rows.
    """
    spans = phases.select("scholar_id", "phase", "start_year", "end_year")
    # a year belongs to one phase; phases come from windows and years from sequence, so the joins are told
    years = spans.select("scholar_id", "phase", F.explode(F.sequence("start_year", "end_year")).alias("year")).hint("merge")
    placed = events.filter("event_type = 'collaboration_started' or event_type like 'institution%'").withColumnRenamed("event_year", "year").join(years, ["scholar_id", "year"])
    new = placed.groupBy("scholar_id", "phase").agg(F.count_if(F.col("event_type") == "collaboration_started").alias("new_collaborators"))
    place = placed.filter("event_type like 'institution%'").select("scholar_id", "phase", F.regexp_extract("event_key", ":(.*)$", 1).alias("institution"), F.struct("year", "event_key").alias("at"))
    latest = place.groupBy("scholar_id", "phase", "institution").agg(F.max("at").alias("at"))
    places = in_order(top(latest, ["scholar_id", "phase"], [F.desc("at")], k), ["scholar_id", "phase"], "institutions", "institution")
    told = works.select("work_id", F.col("publication_year").alias("year"), F.coalesce("cited_by_count", F.lit(0)).alias("c")).join(abstracts.filter("trim(abstract) <> ''").select("work_id"), "work_id", "left_semi")
    own = authorships.select("scholar_id", "work_id").distinct().join(told, "work_id").join(years, ["scholar_id", "year"])
    papers = in_order(top(own, ["scholar_id", "phase"], [F.desc("c"), F.col("work_id")], k), ["scholar_id", "phase"], "insight_papers", "work_id")
    x = spans
    for part in (places, new, papers):
        x = x.join(part.hint("merge"), ["scholar_id", "phase"], "left")
    return x.na.fill(0, ["new_collaborators"])


def in_order(ranked: DataFrame, keys: list[str], name: str, *fields: str) -> DataFrame:
    """One array a group of the rows' field (of structs where there are several), by rank."""
    value = F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)
    listed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", value.alias("value")))).alias("r"))
    return listed.select(*keys, F.transform("r", lambda x: x["value"]).alias(name))


def _numbered(df: DataFrame, order: list[Column], k: int | None = None) -> DataFrame:
    return top(df, ["scholar_id"], order, k if k is not None else 2**31 - 1)


def ranked_collaborations(edges: DataFrame, k: int | None) -> DataFrame:
    """edges: (scholar_id, other_id, last_year, works_count); the latest first, then those of most works."""
    return _numbered(edges, [F.desc_nulls_last("last_year"), F.desc("works_count"), F.col("other_id")], k)


def ranked_affiliations(affiliations: DataFrame, k: int | None) -> DataFrame:
    """affiliations: (scholar_id, institution_id, start_year, end_year, is_current); current ones first, then the latest."""
    return _numbered(affiliations, [F.desc("is_current"), F.desc_nulls_last("end_year"), F.desc_nulls_last("start_year"), F.col("institution_id")], k)


def ranked_papers(works: DataFrame, authorships: DataFrame, k: int | None) -> DataFrame:
    own = authorships.select("scholar_id", "work_id").distinct().join(works.select("work_id", "title", "publication_year", F.coalesce("cited_by_count", F.lit(0)).alias("c")), "work_id")
    return _numbered(own, [F.desc("c"), F.desc_nulls_last("publication_year"), F.col("work_id")], k)


def local_network(
    scholars: DataFrame, edges: DataFrame, works: DataFrame, authorships: DataFrame, work_topics: DataFrame, affiliations: DataFrame,
    collaborators: int = 10, papers: int = 8, topics: int = 2, institutions: int = 4, most_nodes: int = 30, most_edges: int = 60,
) -> tuple[DataFrame, DataFrame]:
    """Nodes (scholar_id, rank, node, kind) and edges (scholar_id, rank, source, target, type, label) of each scholar's surroundings.

    The author, then collaborators, papers each with its topics, and institutions; cut in that order, nodes and edges apart. scholars: (scholar_id).
    """
    node = lambda kind, c: F.concat_ws(":", F.lit(kind), F.col(c).cast("string"))
    self_node = node("author", "scholar_id")
    no = F.lit(0)

    def rows(df: DataFrame, kind: str, place: list[Column], target: Column, source: Column | None, link: str, label: Column) -> DataFrame:
        return df.select("scholar_id", F.struct(*[c.cast("int").alias(n) for c, n in zip(place, "abc", strict=True)]).alias("place"), F.lit(kind).alias("kind"), (self_node if source is None else source).alias("source"), target.alias("target"), F.lit(link).alias("type"), label.cast("string").alias("label"))

    best = ranked_papers(works, authorships, papers)
    order = [F.desc("is_primary"), F.desc_nulls_last("score"), F.col("topic")]
    on = top(best.select("scholar_id", "work_id", F.col("rank").alias("paper_rank")).hint("merge").join(work_topics, "work_id"), ["scholar_id", "work_id"], order, topics)
    linked = [
        rows(ranked_collaborations(edges, collaborators), "collaborator", [F.lit(1), F.col("rank"), no], node("author", "other_id"), None, "collaborates", F.col("works_count")),
        rows(best, "paper", [F.lit(2), F.col("rank"), no], node("paper", "work_id"), None, "authored", F.coalesce(F.col("publication_year").cast("string"), F.lit(""))),
        rows(on, "topic", [F.lit(2), F.col("paper_rank"), F.col("rank")], node("topic", "topic"), node("paper", "work_id"), "has_topic", F.lit("")),
        rows(ranked_affiliations(affiliations, institutions), "institution", [F.lit(3), F.col("rank"), no], node("institution", "institution_id"), None, "affiliated", F.lit("")),
    ]
    found = reduce(DataFrame.unionByName, linked)
    own = rows(scholars, "author", [no, no, no], self_node, None, "", F.lit(""))
    nodes = found.unionByName(own).groupBy("scholar_id", F.col("target").alias("node")).agg(F.min("place").alias("place"), F.min_by("kind", "place").alias("kind"))
    cut = lambda df, k: top(df, ["scholar_id"], [F.col("place")], k).drop("place")
    return cut(nodes, most_nodes), cut(found.drop("kind"), most_edges)


def graph_documents(
    scholars: DataFrame, events: DataFrame, topics: DataFrame, edges: DataFrame, affiliations: DataFrame, works: DataFrame, authorships: DataFrame, work_topics: DataFrame,
    most_collaborations: int = 50, most_papers: int = 1000,
) -> DataFrame:
    """One nested row a scholar: timeline, topic evolution, collaborations, affiliations, papers, nodes and edges, each in its order.

    topics: (scholar_id, topic, first_year, last_year, works_count). A document holds all events of one scholar, as its reader asks for.
    """
    nodes, links = local_network(scholars, edges, works, authorships, work_topics, affiliations)
    key = ["scholar_id"]
    parts = [
        in_order(_numbered(events, [F.desc_nulls_last("event_year"), F.desc("event_key")]), key, "timeline", "event_key", "event_type", "event_year"),
        in_order(_numbered(topics, [F.desc_nulls_last("last_year"), F.desc("works_count"), F.col("topic")]), key, "topic_evolution", "topic", "first_year", "last_year", "works_count"),
        in_order(ranked_collaborations(edges, most_collaborations), key, "collaborations", "other_id", "last_year", "works_count"),
        in_order(ranked_affiliations(affiliations, None), key, "affiliations", "institution_id", "start_year", "end_year", "is_current"),
        in_order(ranked_papers(works, authorships, most_papers), key, "papers", "work_id", "title", "publication_year", "c"),
        in_order(nodes, key, "nodes", "node", "kind"),
        in_order(links, key, "edges", "source", "target", "type", "label"),
    ]
    x = scholars.select("scholar_id")
    for part in parts:  # each is written, so that its shuffle files don't stay while the next one is made
        x = x.join(kept(part).hint("merge"), "scholar_id", "left")
    return x


def institution_counts(fields: DataFrame, work_topics: DataFrame, bylines: DataFrame, since_year: int) -> DataFrame:
    """(focus_id, institution_id, historical_works, recent_works): works on any of a focus's topics (focus_id, topic), by byline institution.

    A focus's works are counted, not made: of a work with m of its topics, m are counted by single topics, m (m - 1) / 2 by pairs, and (m - 1) (m - 2) / 2 are the
    triples that begin with its first, and m - m (m - 1) / 2 + (m - 1) (m - 2) / 2 = 1. Counts of topics and pairs don't grow with the works; only works with
    three topics of a focus or more meet it themselves.
    """
    recent = F.coalesce(F.max(F.col("year") >= since_year), F.lit(False))
    at = bylines.groupBy("work_id", "institution_id").agg(recent.alias("recent"))
    listed = work_topics.groupBy("work_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    rows = kept(at.hint("merge").join(listed, "work_id"))
    own = kept(fields.filter("topic is not null").groupBy("focus_id").agg(F.array_sort(F.collect_set("topic")).alias("topics")))
    names = ["institution_id", "recent"]

    def of(df: DataFrame, n: int, *columns: str) -> DataFrame:
        """A row for each n of the topics, t1 to tn in order."""
        for k in range(1, n + 1):
            df = df.select(*columns, *[f"t{i}" for i in range(1, k)], "topics", F.posexplode("topics").alias("i", f"t{k}"))
            df = df.withColumn("topics", F.slice("topics", F.col("i") + 2, F.size("topics"))).drop("i")
        return df.drop("topics")

    parts = []
    for n, sign in ((1, 1), (2, -1)):
        keys = [f"t{k}" for k in range(1, n + 1)]
        counts = kept(of(rows, n, *names).groupBy(*keys, "institution_id").agg(F.count("*").alias("h"), F.count_if("recent").alias("r")))
        met = of(own, n, "focus_id").hint("merge").join(counts, keys).groupBy("focus_id", "institution_id")
        parts.append(met.agg((sign * F.sum("h")).alias("h"), (sign * F.sum("r")).alias("r")))
    keys = ["t1", "t2", "t3"]
    wanted = of(own, 3, "focus_id")
    sent = of(rows.filter(F.size("topics") > 2), 3, "work_id", *names).hint("merge").join(wanted, keys)
    begun = sent.groupBy("focus_id", "work_id", *names, "t1").agg(F.count("*").alias("n")).groupBy("focus_id", "work_id", *names).agg(F.min_by("n", "t1").alias("n"))
    parts.append(begun.groupBy("focus_id", "institution_id").agg(F.sum("n").alias("h"), F.coalesce(F.sum(F.when(F.col("recent"), F.col("n"))), F.lit(0)).alias("r")))
    every = reduce(DataFrame.unionByName, [kept(p) for p in parts])
    return every.groupBy("focus_id", "institution_id").agg(F.sum("h").alias("historical_works"), F.sum("r").alias("recent_works"))


def institution_rows(counts: DataFrame, scholars: DataFrame, edges: DataFrame) -> DataFrame:
    """counts with joint works and analysed members (ready scholars there, the focus aside) and whether the focus is there.

    scholars: (scholar_id, institution_id, graph_ready); edges: (scholar_id, other_id, works_count), both directions.
    """
    ready = scholars.filter("graph_ready and institution_id is not null").select("scholar_id", "institution_id")
    members = ready.groupBy("institution_id").agg(F.count("*").alias("members"))
    joint = edges.withColumnRenamed("scholar_id", "focus_id").filter("focus_id <> other_id").hint("merge").join(ready.withColumnRenamed("scholar_id", "other_id"), "other_id").groupBy("focus_id", "institution_id").agg(F.sum("works_count").alias("joint_works"))
    home = scholars.select(F.col("scholar_id").alias("focus_id"), F.col("institution_id").alias("home"), F.col("graph_ready").alias("home_ready"))
    x = counts.join(home, "focus_id", "left").join(members, "institution_id", "left").join(joint, ["focus_id", "institution_id"], "left").na.fill(0, ["members", "joint_works"])
    here = F.coalesce(F.col("home") == F.col("institution_id"), F.lit(False))
    return x.withColumn("is_focus", here).withColumn("members", F.col("members") - F.when(here & F.col("home_ready"), 1).otherwise(0)).drop("home", "home_ready")


def field_institutions(rows: DataFrame, k: int = 8) -> DataFrame:
    """The k most active institutions of each focus, its own always among them, and its k opportunities (recent works, at most one joint work)."""
    w = Window.partitionBy("focus_id")
    placed = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("recent_works"), F.desc("historical_works"), "institution_id")))
    own = F.max(F.when(F.col("is_focus"), F.col("rank"))).over(w)
    first = placed.withColumn("own", own).filter((F.col("is_focus") & (F.col("rank") >= k)) | (F.col("rank") < k) | ((F.col("rank") == k) & (F.coalesce("own", F.lit(0)) <= k)))
    active = first.withColumn("rank", F.least("rank", F.lit(k))).drop("own").withColumn("list", F.lit("active"))
    open_ = rows.filter("not is_focus and recent_works > 0 and joint_works <= 1")
    chances = top(open_, ["focus_id"], [F.col("joint_works"), F.desc("recent_works"), F.desc("members"), F.col("institution_id")], k).withColumn("list", F.lit("opportunities"))
    return active.unionByName(chances)


def compare_institutions(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """pairs: (focus_id, institution_id) against the focus's own institution; both must be among the listed ones, else insufficient.

    Adds recent shares (1 at most), which side has more recent works and by what factor, and the difference of shares in points.
    """
    names = ["historical_works", "recent_works", "joint_works", "members"]
    # an institution may be in both lists
    rows = listed.select("focus_id", "institution_id", "is_focus", *names).distinct()
    left = rows.filter("is_focus").select("focus_id", *[F.col(c).alias(f"left_{c}") for c in names])
    right = rows.filter("not is_focus").select("focus_id", "institution_id", *[F.col(c).alias(f"right_{c}") for c in names])
    x = pairs.select("focus_id", "institution_id").join(left, "focus_id", "left").join(right, ["focus_id", "institution_id"], "left")
    both = F.col("left_recent_works").isNotNull() & F.col("right_recent_works").isNotNull()
    share = lambda s: F.when(F.col(f"{s}_historical_works") > 0, F.least(F.lit(1.0), F.col(f"{s}_recent_works") / F.col(f"{s}_historical_works")))
    a, b = F.col("left_recent_works"), F.col("right_recent_works")
    activity = F.when(~both, None).when(a == b, "equal").when(a == 0, "right_only").when(b == 0, "left_only").when(b > a, "right").otherwise("left")
    factor = F.when(both & (a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))
    return (
        x.withColumn("status", F.when(both, "available").otherwise("insufficient"))
        .withColumn("left_recent_share", share("left")).withColumn("right_recent_share", share("right"))
        .withColumn("activity", activity).withColumn("factor", F.round(factor, 1))
        .withColumn("share_points", F.floor((F.col("right_recent_share") - F.col("left_recent_share")) * 100 + 0.5).cast("int"))
    )


def team_topics(scholars: DataFrame, authorships: DataFrame, work_topics: DataFrame) -> DataFrame:
    """(institution_id, topic, n): works of an institution's scholars on each topic, a work counted once."""
    own = scholars.filter("institution_id is not null").select("scholar_id", "institution_id").join(authorships.select("scholar_id", "work_id"), "scholar_id").select("institution_id", "work_id").distinct()
    return own.join(work_topics.select("work_id", "topic").distinct(), "work_id").groupBy("institution_id", "topic").agg(F.count("*").alias("n"))


def team_profiles(teams: DataFrame, topics: DataFrame, scholars: DataFrame, field: DataFrame, k: int = 6) -> DataFrame:
    """teams with their k most frequent topics, the share of a field's topics (topic), the share of ready members, and confidence.

    topics: team_topics; scholars: (scholar_id, institution_id, graph_ready).
    """
    best = in_order(top(topics, ["institution_id"], [F.desc("n"), F.col("topic")], k), ["institution_id"], "topics", "topic", "n")
    totals = topics.groupBy("institution_id").agg(F.sum("n").alias("all"))
    met = topics.join(field.select("topic").distinct(), "topic", "left_semi").groupBy("institution_id").agg(F.sum("n").alias("met"))
    ready = scholars.groupBy("institution_id").agg((F.count_if("graph_ready") / F.count("*")).alias("ready_share"))
    x = teams
    for part in (best, totals, met, ready):
        x = x.join(part.hint("merge"), "institution_id", "left")
    least = lambda c, n: F.least(F.lit(1.0), F.col(c) / n)
    score = least("members", 4) * 0.35 + least("works", 20) * 0.35 + F.coalesce("ready_share", F.lit(0.0)) * 0.3
    level = F.when(score >= 0.78, "high").when(score >= 0.55, "medium").otherwise("low")
    share = F.when(F.col("all") > 0, F.coalesce("met", F.lit(0)) / F.col("all")).otherwise(0.0)
    return x.withColumn("field_overlap", F.round(share, 3)).withColumn("confidence", F.round(score, 3)).withColumn("level", level).drop("all", "met")


def compare_recent(pairs: DataFrame, trend: DataFrame, since_year: int) -> DataFrame:
    """(a, b) with both sides' papers, citations and active years since a year; trend: (scholar_id, year, papers, citations)."""
    sums = trend.filter(F.col("year") >= since_year).groupBy("scholar_id").agg(F.sum("papers").alias("papers"), F.sum("citations").alias("citations"), F.count_if(F.col("papers") > 0).alias("years"))
    x = pairs.select("a", "b")
    for s in ("a", "b"):
        x = x.join(sums.select(F.col("scholar_id").alias(s), *[F.col(c).alias(f"{s}_recent_{c}") for c in ("papers", "citations", "years")]), s, "left")
    return x.na.fill(0)


def compare_sets(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, kind) with the values that both, only a and only b have, in order; values: (scholar_id, kind, value), few a scholar, case aside."""
    folded = values.select("scholar_id", "kind", F.lower(F.trim("value")).alias("value"))
    held = folded.groupBy("scholar_id", "kind").agg(F.array_sort(F.collect_set("value")).alias("v"))
    kinds = values.select("kind").distinct()
    x = pairs.select("a", "b").crossJoin(F.broadcast(kinds))  # a handful of kinds
    for s in ("a", "b"):
        x = x.join(held.select(F.col("scholar_id").alias(s), "kind", F.col("v").alias(f"v{s}")).hint("merge"), [s, "kind"], "left")
    none = F.array().cast("array<string>")
    x = x.withColumns({c: F.coalesce(c, none) for c in ("va", "vb")})
    return x.select("a", "b", "kind", F.array_intersect("va", "vb").alias("shared"), F.array_except("va", "vb").alias("a_only"), F.array_except("vb", "va").alias("b_only"))


def compare_topics(pairs: DataFrame, profiles: DataFrame, best: DataFrame) -> DataFrame:
    """(a, b) with the weighted overlap of their topics and each side's representative works; profiles: (scholar_id, topic, n), best: (scholar_id, rank, work_id)."""
    p = profiles.select("scholar_id", "topic", "n")
    totals = p.groupBy("scholar_id").agg(F.sum("n").alias("all"))
    side = lambda df, s: df.select(F.col("scholar_id").alias(s), *[F.col(c).alias(f"{s}_{c}") if c != "topic" else F.col(c) for c in df.columns if c != "scholar_id"])
    met = pairs.select("a", "b").join(side(p, "a"), "a").join(side(p, "b"), ["b", "topic"]).groupBy("a", "b").agg(F.sum(F.least("a_n", "b_n")).alias("least"))
    x = pairs.select("a", "b").join(met, ["a", "b"], "left").join(side(totals, "a"), "a", "left").join(side(totals, "b"), "b", "left").na.fill(0)
    listed = in_order(best, ["scholar_id"], "works", "work_id")
    for s in ("a", "b"):
        x = x.join(side(listed, s).hint("merge"), s, "left")
    union = F.col("a_all") + F.col("b_all") - F.col("least")
    return x.select("a", "b", F.round(F.when(union > 0, F.col("least") / union).otherwise(0.0), 3).alias("topic_overlap"), "a_works", "b_works")


def compare_teams(pairs: DataFrame, scholars: DataFrame, teams: DataFrame, team_topics: DataFrame, scholar_topics: DataFrame) -> DataFrame:
    """pairs: (a, b) by the teams of their institutions: members, works, active years, and the share of the pair's topics among the team's.

    teams: (institution_id, members, works, active_years); scholar_topics: (scholar_id, topic). Insufficient where either has no team.
    """
    home = scholars.select("scholar_id", "institution_id")
    x = pairs.select("a", "b")
    for s in ("a", "b"):
        x = x.join(home.select(F.col("scholar_id").alias(s), F.col("institution_id").alias(f"{s}_institution")), s, "left")
    topics = scholar_topics.select("scholar_id", "topic").distinct()
    field = reduce(DataFrame.unionByName, [x.select("a", "b").join(topics.withColumnRenamed("scholar_id", s), s).select("a", "b", "topic") for s in ("a", "b")]).distinct()
    totals = team_topics.groupBy("institution_id").agg(F.sum("n").alias("all"))
    for s in ("a", "b"):
        of = x.select("a", "b", F.col(f"{s}_institution").alias("institution_id"))
        met = of.join(field, ["a", "b"]).join(team_topics, ["institution_id", "topic"]).groupBy("a", "b").agg(F.sum("n").alias("met"))
        share = of.join(totals, "institution_id").join(met, ["a", "b"], "left").select("a", "b", F.round(F.coalesce("met", F.lit(0)) / F.col("all"), 3).alias(f"{s}_field_overlap"))
        named = teams.select(F.col("institution_id").alias(f"{s}_institution"), *[F.col(c).alias(f"{s}_{c}") for c in ("members", "works", "active_years")])
        x = x.join(named, f"{s}_institution", "left").join(share, ["a", "b"], "left")
    both = F.col("a_members").isNotNull() & F.col("b_members").isNotNull()
    return x.na.fill(0.0, ["a_field_overlap", "b_field_overlap"]).withColumn("status", F.when(both, "available").otherwise("insufficient"))


#: Features that can be the angle of a reference, in order of priority.
ANGLES = ("topic_overlap", "recent_overlap", "downstream", "continuity", "impact")


def reference_angles(rows: DataFrame) -> DataFrame:
    """Adds the angle of each row: the feature that stands out most among the focus's candidates, then the greatest one, then by priority.

    rows: (focus_id, candidate_id) with ANGLES, continuity and impact from 0 to 100 or null.
    """
    scaled = {c: F.coalesce(F.col(c), F.lit(0.0)) / (100 if c in ("continuity", "impact") else 1) for c in ANGLES}
    x = rows.withColumns({f"v_{c}": v for c, v in scaled.items()})
    n = F.count("*").over(Window.partitionBy("focus_id"))
    options = []
    for i, c in enumerate(ANGLES):
        below = F.rank().over(Window.partitionBy("focus_id").orderBy(f"v_{c}")) - 1
        ties = F.count("*").over(Window.partitionBy("focus_id", f"v_{c}"))
        position = F.when(n <= 1, 0.5).otherwise((below + (ties - 1) / 2) / (n - 1))
        options.append(F.struct(position.alias("position"), F.col(f"v_{c}").alias("value"), F.lit(-i).alias("priority"), F.lit(c).alias("angle")))
    return x.withColumn("angle", F.array_max(F.array(*options))["angle"]).drop(*[f"v_{c}" for c in ANGLES])


def percent(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("int").cast("string")


def explain(rows: DataFrame) -> DataFrame:
    """Adds text_en and text_zh, one sentence by the row's own evidence. The wording is ours; numbers and cases are the inventory's.

    rows: (focus_id, candidate_id, category, topic_overlap, recent_overlap, temporal, direct_count, shared_collaborators, method_similarity,
    problem_similarity, and for references angle, downstream, recent_works). Categories without a rule get null.
    """
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    recent, temporal, topic, down = (percent(F.col(c)) for c in ("recent_overlap", "temporal", "topic_overlap", "downstream"))
    shared, fresh = F.col("shared_collaborators").cast("string"), F.col("recent_works").cast("string")
    peer, lead, rival, ref = (F.col("category") == c for c in ("peer", "potential_collaborator", "potential_competitor", "reference"))
    nearer = F.col("recent_overlap") >= F.col("temporal")
    alone = F.col("direct_count") == 0
    on = lambda a: ref & (F.col("angle") == a)
    english = (
        F.when(peer & nearer, say("Recent topics overlap by ", recent, "%, more than active years (", temporal, "%): follow the recent results."))
        .when(peer, say("Active years overlap by ", temporal, "%, recent topics by ", recent, "%: follow how the work of both develops."))
        .when(lead & alone, say("No joint paper yet; ", shared, " common collaborators could make contact."))
        .when(lead, say("One joint paper only; ", shared, " common collaborators."))
        .when(rival, say("Problems overlap by ", percent(F.col("problem_similarity")), "%, methods by ", percent(F.col("method_similarity")), "%, ", F.when(alone, "without a joint paper").otherwise("with few joint papers"), "; this shows related topics, not rivalry."))
        .when(on("topic_overlap"), say("Topics overlap by ", topic, "%: the nearest line of work."))
        .when(on("recent_overlap"), say("Recent topics overlap by ", recent, "%, with ", fresh, " works of the last years."))
        .when(on("downstream") | (on("impact") & (F.col("downstream") > 0)), say(down, "% of the works are cited within the corpus."))
        .when(on("impact"), say("Works rank high for their topic and year; no later use is seen in the corpus."))
        .when(on("continuity"), say("Topics are followed over many years."))
    )
    chinese = (
        F.when(peer & nearer, say("近期方向重合 ", recent, "%，高于活跃年份的 ", temporal, "%，可先看近期论文。"))
        .when(peer, say("活跃年份重合 ", temporal, "%，近期方向重合 ", recent, "%，可对照两人研究的变化。"))
        .when(lead & alone, say("还没有合著，有 ", shared, " 位共同合作者可以引荐。"))
        .when(lead, say("只有一篇合著，有 ", shared, " 位共同合作者。"))
        .when(rival, say("问题重合 ", percent(F.col("problem_similarity")), "%，方法重合 ", percent(F.col("method_similarity")), "%，", F.when(alone, "没有合著").otherwise("合著很少"), "；只说明选题接近。"))
        .when(on("topic_overlap"), say("方向重合 ", topic, "%，研究路线最近。"))
        .when(on("recent_overlap"), say("近期方向重合 ", recent, "%，近年论文 ", fresh, " 篇。"))
        .when(on("downstream") | (on("impact") & (F.col("downstream") > 0)), say("库内 ", down, "% 的论文被引用。"))
        .when(on("impact"), say("论文在同主题同年份中靠前，库内未见后续引用。"))
        .when(on("continuity"), say("多年持续同一方向。"))
    )
    return rows.withColumn("text_en", english).withColumn("text_zh", chinese)


def provisional_authors(works: DataFrame, authorships: DataFrame, k: int = 20) -> DataFrame:
    """Candidates of authorships without a scholar_id: (name_key, rank, candidate_id, name, works_count, cited_by_count, h_index, has_institution).

    authorships: (work_id, position_index, scholar_id, raw_name, institution_id). Names are equal whose words are, in any order. Two authorships of
    one name are one person if they are of one work (by doi, else by id) or share a co-author's id; an institution alone is not enough.
    The most cited work is the anchor. Per name k candidates: with an institution first, then by citations and works. Names without a word are left out.
    """
    words = F.filter(F.split(T.normalize_title(F.col("raw_name")), " "), lambda t: t != "")
    named = authorships.filter("scholar_id is null").withColumn("name_key", F.array_join(F.array_sort(words), " ")).filter("name_key <> ''")
    dated = works.select("work_id", F.coalesce("doi", F.col("work_id").cast("string")).alias("work_key"), F.coalesce("publication_year", F.lit(0)).alias("year"), F.greatest(F.lit(0), F.coalesce("cited_by_count", F.lit(0))).alias("c"))
    records = named.join(dated, "work_id").withColumn("id", F.concat_ws(":", "work_id", "position_index"))
    known = authorships.filter("scholar_id is not null").select("work_id", F.col("scholar_id").cast("string").alias("value")).distinct()
    key = lambda kind, c: F.concat_ws("\n", F.col("name_key"), F.lit(kind), F.col(c))
    keys = records.select("id", key("work", "work_key").alias("key")).unionByName(records.select("id", "work_id", "name_key").join(known, "work_id").select("id", key("coauthor", "value").alias("key"))).distinct()
    found = records.join(components_of(records.select("id").distinct(), keys).hint("merge"), "id")
    once = found.groupBy("name_key", "component", "work_key").agg(F.max("c").alias("c"))
    totals = once.groupBy("name_key", "component").agg(F.count("*").alias("works_count"), F.sum("c").alias("cited_by_count"))
    anchor = found.groupBy("name_key", "component").agg(F.max(F.struct("c", "year", "work_id", "position_index", "raw_name")).alias("a"), F.max_by(F.col("institution_id").isNotNull(), F.struct("year", "work_id", "position_index")).alias("has_institution"))
    h = h_index(once, "component", "c")
    x = totals.join(anchor, ["name_key", "component"]).join(h, "component")
    x = x.select("name_key", F.concat_ws(":", F.lit("provisional"), "a.work_id", "a.position_index").alias("candidate_id"), F.col("a.raw_name").alias("name"), "works_count", "cited_by_count", "h_index", "has_institution")
    return top(x, ["name_key"], [F.desc("has_institution"), F.desc("cited_by_count"), F.desc("works_count"), F.col("candidate_id")], k)
