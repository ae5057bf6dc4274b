"""What a profile claims and rests on: text profiles, style, numbered evidence and its review, byline statements, lookups, ranked recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T

from .rollups import dealt_coauthors, dealt_topics


def affiliation_statements(bylines: DataFrame) -> DataFrame:
    """(scholar_id, place, text, years): the distinct byline texts of each scholar, newest first, their years newest first. bylines: (scholar_id, seq, text, year)."""
    x = bylines.withColumn("text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))).filter("text <> ''")
    rows = x.groupBy("scholar_id", F.lower("text").alias("folded")).agg(F.min_by("text", "seq").alias("text"), T.clean_years(F.collect_set("year")).alias("years"))
    order = Window.partitionBy("scholar_id").orderBy(F.desc(F.coalesce(F.array_max("years"), F.lit(0))), F.desc("folded"))
    return rows.select("scholar_id", F.row_number().over(order).alias("place"), "text", "years")


def lookup_objects(requests: DataFrame, authors: DataFrame, papers: DataFrame, institutions: DataFrame, topics: DataFrame) -> DataFrame:
    """The public attributes of requested objects (object_type, object_id); unknown ids and types give no row.

    Every table has object_id and display_name and what else its type has; a paper's abstract_basis_label says whether it has an abstract.
    """
    papers = papers.withColumn("abstract_basis_label", F.when(F.coalesce("abstract", F.lit("")) != "", "基于摘要"))
    found = None
    for kind, table in (("author", authors), ("paper", papers), ("institution", institutions), ("topic", topics)):
        part = requests.filter(F.col("object_type") == kind).distinct().join(table, "object_id")
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def text_profiles(works: DataFrame, authorships: DataFrame, keywords: dict[str, list[str]], since: int | None = None) -> DataFrame:
    """(scholar_id, kind, value, n): the tokens of recent works' methods and problems (n is 1), and how many works fall into each category.

    works: (work_id, year, title, method, problem, work_type); ``since``: the first recent year, all works without one.
    """
    own = authorships.select("scholar_id", "work_id").distinct().join(works, "work_id")
    recent = own if since is None else own.filter(F.coalesce("year", F.lit(0)) >= since)
    words = lambda kind: recent.select("scholar_id", F.lit(kind).alias("kind"), F.explode(T.tokens(F.col(kind))).alias("value")).distinct().withColumn("n", F.lit(1).cast("long"))
    text = F.concat_ws(" ", "title", "problem", "method", "work_type")
    kinds = own.select("scholar_id", F.lit("category").alias("kind"), F.explode(T.categories(text, keywords)).alias("value")).groupBy("scholar_id", "kind", "value").agg(F.count("*").alias("n"))
    return words("method").unionByName(words("problem")).unionByName(kinds)


def style_profile(works: DataFrame, authorships: DataFrame, work_topics: DataFrame, categories: DataFrame, continuity: DataFrame) -> DataFrame:
    """Orientation, pacing, dominant category and collaboration pattern of each scholar with three titled works or more; null for others.

    categories: (scholar_id, value, n) of method, system, data, application; continuity: (scholar_id, continuity). The thresholds are fixed values.
    """
    own = authorships.select("scholar_id", "work_id").distinct().join(works.select("work_id", "title", "publication_year"), "work_id")
    team = authorships.groupBy("work_id").agg(F.count_distinct("scholar_id").alias("authors"))
    base = own.join(team, "work_id").groupBy("scholar_id").agg(F.count_if(F.coalesce("title", F.lit("")) != "").alias("evidence"), F.percentile("authors", F.lit(0.5)).alias("typical_team"))
    # topics and co-authors are sent as one row a work and scholar, and counted where they lie
    topics = dealt_topics(works, authorships, work_topics, "publication_year").select("scholar_id", "publication_year", F.explode("topics").alias("topic")).groupBy("scholar_id", "topic", "publication_year").agg(F.count("*").alias("n"))
    topics = topics.groupBy("scholar_id", "topic").agg(F.sum("n").alias("n"), F.count("publication_year").alias("years"))
    lasting = topics.groupBy("scholar_id").agg(F.count_if((F.col("n") >= 3) & (F.col("years") >= 3)).alias("sustained"))
    pairs = dealt_coauthors(authorships).groupBy("scholar_id", "other_id").agg(F.count("*").alias("n"))
    repeated = pairs.groupBy("scholar_id").agg(F.count_if(F.col("n") >= 2).alias("repeated"))
    # of equally frequent categories the first in this order dominates
    names = ["method", "system", "data", "application"]
    counts = categories.groupBy("scholar_id").agg(*[F.coalesce(F.sum(F.when(F.col("value") == v, F.col("n"))), F.lit(0)).alias(v) for v in names])
    x = base.join(lasting, "scholar_id", "left").join(repeated, "scholar_id", "left").join(counts.hint("merge"), "scholar_id", "left").join(continuity.select("scholar_id", "continuity"), "scholar_id", "left").na.fill(0, ["sustained", "repeated", *names])
    c = F.col
    applied, method = c("system") + c("application"), c("method") + c("data")
    orientation = F.when((applied >= method * 1.35) & (applied >= 2), "applied").when((method >= applied * 1.35) & (method >= 2), "method").otherwise("mixed")
    pacing = F.when((c("continuity") >= 68) & (c("sustained") > 0), "sustained").when(c("continuity") < 45, "changing").otherwise("coexisting")
    best = F.greatest(*names)
    dominant = F.when(best >= 2, F.coalesce(*[F.when(c(v) == best, v) for v in names])).otherwise("none")
    pattern = F.when(c("repeated") >= 3, "several_repeated").when(c("repeated") >= 1, "stable_core").otherwise("limited")
    enough = c("evidence") >= 3
    return x.select("scholar_id", "evidence", *[F.when(enough, v).alias(n) for n, v in (("orientation", orientation), ("pacing", pacing), ("work_type", dominant), ("collaboration", pattern), ("typical_team", F.round("typical_team", 1)))], "repeated")


def rank_recommendations(rows: DataFrame, allowed: DataFrame | None = None, k: int = 20) -> DataFrame:
    """(focus_id, category, rank, candidate_id, index): the k best of each focus and category, ties by candidate.

    allowed: (focus_id, candidate_id), the candidates discovered in a focus's field; a focus that has any is restricted to them.
    """
    if allowed is not None:
        pairs = allowed.select("focus_id", "candidate_id").distinct()
        bound = pairs.select("focus_id").distinct()
        rows = rows.join(bound, "focus_id", "left_anti").unionByName(rows.join(bound, "focus_id", "left_semi").join(pairs, ["focus_id", "candidate_id"], "left_semi").select(rows.columns))
    order = Window.partitionBy("focus_id", "category").orderBy(F.desc("index"), "candidate_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("focus_id", "category", "rank", "candidate_id", "index")


def build_evidence(summary: DataFrame, topics: DataFrame, institutions: DataFrame, papers: DataFrame, coauthors: DataFrame) -> DataFrame:
    """(scholar_id, evidence_id, type, text, url, value): numbered evidence of each profile.

    One row of figures, then five topics, six institutions, three papers (a row each), three co-authors, where there are any. summary: (scholar_id, papers, citations,
    h_index); topics, institutions: (scholar_id, rank, name); papers: (scholar_id, rank, title, year, citations, url); coauthors: (scholar_id, rank, name, papers).
    """
    def listed(df: DataFrame, kind: str, place: int, most: int, text) -> DataFrame:
        names = df.filter(F.col("rank") <= most).groupBy("scholar_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), ", ").alias("text"))
        return names.select("scholar_id", F.lit(place).alias("place"), F.lit(kind).alias("type"), "text", F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("value"))

    figures = summary.select("scholar_id", F.lit(0).alias("place"), F.lit("metric").alias("type"), F.format_string("%d papers, %d citations, h-index %d", F.col("papers").cast("long"), F.col("citations").cast("long"), F.col("h_index").cast("long")).alias("text"), F.lit(None).cast("string").alias("url"), F.col("papers").cast("long").alias("value"))
    works = papers.filter("rank <= 3").select("scholar_id", (F.lit(10) + F.col("rank")).cast("int").alias("place"), F.lit("paper").alias("type"), F.format_string("%s (%s), cited %d times", F.coalesce("title", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("year unknown")), F.col("citations").cast("long")).alias("text"), "url", F.lit(None).cast("long").alias("value"))
    every = figures.unionByName(listed(topics, "topic", 1, 5, F.col("name"))).unionByName(listed(institutions, "institution", 2, 6, F.col("name"))).unionByName(works).unionByName(listed(coauthors, "coauthor", 20, 3, F.format_string("%s (%d)", F.col("name"), F.col("papers").cast("long"))))
    # only profiles with figures have evidence
    every = every.join(summary.select("scholar_id"), "scholar_id", "left_semi")
    return every.withColumn("evidence_id", F.row_number().over(Window.partitionBy("scholar_id").orderBy("place"))).select("scholar_id", "evidence_id", "type", "text", "url", "value")


def review_evidence(evidence: DataFrame, works: DataFrame, audits: DataFrame) -> DataFrame:
    """Adds approved, confidence and flag: a paper's url or DOI must be among the scholar's works, a count of papers equal to theirs; other known types stand.

    works: (scholar_id, work_id, url, doi); audits: (scholar_id, status).
    """
    # a scholar's few evidence keys go to the rows of its works, of which only those named remain
    asked = evidence.groupBy("scholar_id").agg(F.collect_set(T.normalize_doi(F.col("url"))).alias("asked")).hint("shuffle_hash")
    keys = works.join(asked, "scholar_id").select("scholar_id", "asked", F.explode(F.array("url", T.normalize_doi(F.col("doi")))).alias("k")).filter("k <> ''")
    # a url that holds a DOI and the DOI itself are the same key
    keys = keys.select("scholar_id", "asked", T.normalize_doi(F.col("k")).alias("k")).filter(F.array_contains("asked", F.col("k"))).select("scholar_id", "k").distinct().withColumn("known", F.lit(True))
    recount = works.groupBy("scholar_id").agg(F.count_distinct("work_id").alias("papers"))
    x = evidence.withColumn("k", T.normalize_doi(F.col("url"))).join(keys.hint("merge"), ["scholar_id", "k"], "left").join(recount, "scholar_id", "left").join(audits, "scholar_id", "left")
    kind = F.col("type")
    valid = F.when(kind == "paper", F.coalesce("known", F.lit(False))).when(kind == "metric", F.coalesce("value", F.lit(0)) == F.coalesce("papers", F.lit(0))).otherwise(kind.isin("topic", "institution", "coauthor"))
    flag = F.when(valid, None).when(kind == "paper", "untraceable_paper_evidence").when(kind == "metric", "metric_recalculation_mismatch").otherwise("unsupported_evidence_type")
    confidence = F.when(valid, F.when((kind == "metric") & (F.col("status") == "sufficient"), "high").otherwise("medium"))
    return x.select(*evidence.columns, valid.alias("approved"), confidence.alias("confidence"), flag.alias("flag"))


def review_summary(reviewed: DataFrame, audits: DataFrame) -> DataFrame:
    """(scholar_id, approved, rejected, flags, publishable, confidence) of each profile's reviewed evidence."""
    ids = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("evidence_id"))))
    x = reviewed.groupBy("scholar_id").agg(ids(F.col("approved")).alias("approved"), ids(~F.col("approved")).alias("rejected"), F.array_sort(F.collect_set("flag")).alias("flags"), F.max(F.col("approved") & (F.col("type") == "metric")).alias("publishable"))
    sure = F.col("publishable") & (F.size("flags") == 0) & (F.col("status") == "sufficient")
    return x.join(audits, "scholar_id", "left").select("scholar_id", "approved", "rejected", "flags", "publishable", F.when(F.coalesce(sure, F.lit(False)), "high").when(F.col("publishable"), "medium").otherwise("low").alias("confidence"))
