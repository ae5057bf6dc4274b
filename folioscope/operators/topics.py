"""Research directions of a scholar from topics, keywords, concepts and titles: scored, selected, assigned to works, checked.

Weights, limits and the labels between broad and specific are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T

from .graph import kept
from .rollups import dealt

# Labels that are too coarse to stand alone but begin specific ones.
MID_LEVEL_LABELS = [
    "data mining", "information retrieval", "machine learning", "natural language processing",
    "world wide web", "database", "deep learning", "information system",
]


def is_specific(key: Column) -> Column:
    return (F.length(key) >= 3) & ~key.isin(T.BROAD_LABELS)


def _damped(key: Column) -> Column:
    begins = F.exists(F.array(*[F.lit(f"{x} ") for x in MID_LEVEL_LABELS]), lambda x: F.startswith(key, x))
    return F.when(key.isin(MID_LEVEL_LABELS), 0.28).when(begins, 0.55).otherwise(1.0)


def topic_candidates(works: DataFrame, authorships: DataFrame, labels: DataFrame) -> DataFrame:
    """(scholar_id, key, score, n_works, sources): every direction that some work of the scholar supports.

    labels: (work_id, name, kind, score, level), kind one of primary, topic, keyword, concept. A keyword counts if the title has it or two works do, a concept from level 2, a
    title phrase from three works; recent and cited works weigh more.

    What a work says of a key is told once per work, then sent as one row a work and scholar and counted by hash where the scholar's rows lie. A work is given once in works.
    """
    c = F.col
    # keys and phrases of a title are made once per work, not per author
    w = kept(works.select("work_id", T.topic_key(c("title")).alias("title_key"), T.title_phrases(c("title")).alias("phrases"), F.coalesce("publication_year", F.lit(0)).alias("year"), F.coalesce("cited_by_count", F.lit(0)).alias("citations")))
    named = labels.select("work_id", T.topic_key(c("name")).alias("key"), "kind", "score", F.coalesce("level", F.lit(0)).alias("level")).hint("merge").join(w.select("work_id", "title_key"), "work_id")
    keyed = named.select(
        "work_id", "key",
        F.when(c("kind") == "primary", 2.2 * F.coalesce("score", F.lit(1.0))).when(c("kind") == "topic", 1.2 * F.coalesce("score", F.lit(1.0))).alias("topic"),
        F.when(c("kind") == "keyword", 2.4 * F.coalesce("score", F.lit(0.7))).alias("keyword"),
        F.when((c("kind") == "concept") & (c("level") >= 2), 0.45 * F.coalesce("score", F.lit(0.5))).alias("concept"),
        F.contains("title_key", "key").alias("titled"), F.lit(False).alias("phrase"),
    )
    none = F.lit(None).cast("double")
    said = keyed.unionByName(w.select("work_id", F.explode("phrases").alias("key"), none.alias("topic"), none.alias("keyword"), none.alias("concept"), F.lit(False).alias("titled"), F.lit(True).alias("phrase")))
    per_work = said.repartition("work_id").groupBy("work_id", "key").agg(*[F.sum(x).alias(x) for x in ("topic", "keyword", "concept")], *[F.max(x).alias(x) for x in ("titled", "phrase")]).filter(is_specific(c("key")))
    listed = per_work.groupBy("work_id").agg(F.collect_list(F.struct("key", "topic", "keyword", "concept", "titled", "phrase")).alias("items"))
    own = kept(authorships.select("scholar_id", "work_id").distinct().hint("merge").join(w.select("work_id", "year", "citations"), "work_id"))
    newest = own.groupBy("scholar_id").agg(F.max("year").alias("newest"))
    recency = F.when((c("newest") > 0) & (c("year") > 0), 1 + 0.35 * F.greatest(F.lit(0), c("year") - c("newest") + 5) / 5).otherwise(1.0)
    weight = recency * (1 + F.least(F.log1p("citations") / 12, F.lit(0.45)))
    rows = dealt(own.hint("merge").join(listed, "work_id")).join(newest.hint("shuffle_hash"), "scholar_id")
    x = rows.select("scholar_id", "work_id", weight.alias("w"), F.explode("items").alias("i")).select("scholar_id", "work_id", "w", "i.*")
    asked = c("keyword").isNotNull()
    plain = c("topic").isNotNull() | c("concept").isNotNull() | (asked & c("titled"))  # counts whatever other works say
    per = x.groupBy("scholar_id", "key").agg(
        F.sum(F.coalesce(c("topic") * c("w"), F.lit(0.0)) + F.coalesce("concept", F.lit(0.0)) + F.when(asked & c("titled"), c("keyword") * c("w")).otherwise(0.0)).alias("points"),
        F.sum(F.when(asked & ~c("titled"), c("keyword") * c("w")).otherwise(0.0)).alias("spread_points"),
        F.count("topic").alias("n_topic"), F.count("concept").alias("n_concept"), F.count("keyword").alias("n_keyword"), F.count_if(asked & c("titled")).alias("n_titled"), F.count_if("phrase").alias("n_phrase"),
        F.count_if(plain).alias("n0"), F.count_if(plain | asked).alias("n1"), F.count_if(plain | c("phrase")).alias("n2"), F.count_if(plain | asked | c("phrase")).alias("n3"),
        F.collect_list(F.struct("work_id", plain.alias("plain"), asked.alias("keyword"), "phrase")).alias("listed"),  # made only where works are asked for
    )
    spread, known = c("n_keyword") >= 2, c("n_phrase") >= 3
    n_works = F.when(spread & known, c("n3")).when(spread, c("n1")).when(known, c("n2")).otherwise(c("n0"))
    score = c("points") + F.when(spread, c("spread_points")).otherwise(0.0) + F.when(known, c("n_phrase") * (2.4 + 0.5 * F.least(F.size(F.split("key", " ")), F.lit(4)))).otherwise(0.0)
    counted = F.filter("listed", lambda v: v["plain"] | (spread & v["keyword"]) | (known & v["phrase"]))
    sources = F.array_compact(F.array(F.when(c("n_concept") > 0, "concept"), F.when(spread | (c("n_titled") > 0), "keyword"), F.when(known, "title_phrase"), F.when(c("n_topic") > 0, "topic")))
    return per.filter(n_works > 0).select("scholar_id", "key", (score * _damped(c("key"))).alias("score"), F.array_sort(F.transform(counted, lambda v: v["work_id"])).alias("works"), sources.alias("sources"), n_works.cast("int").alias("n_works"))


def select_topics(candidates: DataFrame, k: int = 10, overlap: float = 0.7) -> DataFrame:
    """(scholar_id, rank, key, weight, works): by score, without those whose words include or are included in those of a chosen one with which they share most works.

    Choosing one by one needs all candidates of a scholar in order, so they meet in one row, of which the fold keeps k.
    """
    item = F.struct((-F.round("score", 9)).alias("minus"), (-F.col("n_works")).alias("fewer"), (-F.size(F.split("key", " "))).alias("shorter"), "key", "works", "score")
    rows = candidates.groupBy("scholar_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def redundant(chosen: Column, x: Column) -> Column:
        words = lambda v: F.array_distinct(F.split(v["key"], " "))
        inside = lambda a, b: F.size(F.array_except(words(a), words(b))) == 0
        shared = lambda e: F.size(F.array_intersect(x["works"], e["works"])) / F.greatest(F.lit(1), F.least(F.size(x["works"]), F.size(e["works"])))
        return F.exists(chosen, lambda e: (inside(x, e) | inside(e, x)) & (shared(e) >= overlap))

    kind = dict(rows.dtypes)["items"]
    chosen = F.aggregate("items", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) >= k) | redundant(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    total = F.aggregate("chosen", F.lit(0.0), lambda a, x: a + x["score"])
    out = rows.select("scholar_id", chosen.alias("chosen")).withColumn("total", F.when(total > 0, total).otherwise(1.0))
    return out.select("scholar_id", "total", F.posexplode("chosen").alias("pos", "t")).select("scholar_id", (F.col("pos") + 1).alias("rank"), "t.key", F.round(F.col("t.score") / F.col("total"), 3).alias("weight"), "t.works")


def work_topics_of(selected: DataFrame) -> DataFrame:
    """(scholar_id, work_id, topics): the selected topics of each work in their order, each once."""
    x = selected.select("scholar_id", "rank", F.trim("key").alias("key"), F.explode("works").alias("work_id")).filter("key <> ''")
    once = x.groupBy("scholar_id", "work_id", "key").agg(F.min("rank").alias("rank"))
    return once.groupBy("scholar_id", "work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda t: t["key"]).alias("topics"))


def validate_labels(labels: DataFrame, candidates: DataFrame, titles: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """(scholar_id, issues): what is wrong with the proposed directions of each scholar, each issue once.

    labels: (scholar_id, name, sources, description_zh, description_en); candidates: (scholar_id, topic), what sources may name; titles: (scholar_id, title).
    """
    named = labels.withColumn("key", T.topic_key(F.col("name")))
    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "")
    n_words = F.size(F.filter(F.split("key", " "), lambda w: w != ""))
    pool = candidates.groupBy("scholar_id").agg(F.collect_set("topic").alias("known"))
    # titles meet labels by a shared word; a label is a title if it shares three quarters of the shorter one's words
    t = titles.select("scholar_id", F.explode(F.array_distinct(F.transform(F.array(T.topic_key(F.col("title"))), words))).alias("title_words"))
    asked = named.select("scholar_id", "name", words(F.col("key")).alias("label_words")).distinct()
    met = asked.select("scholar_id", "name", "label_words", F.explode("label_words").alias("w")).hint("merge").join(t.select("scholar_id", "title_words", F.explode("title_words").alias("w")), ["scholar_id", "w"])
    shared = met.groupBy("scholar_id", "name", "label_words", "title_words").agg(F.count("*").alias("n"))
    alike = shared.filter(F.col("n") / F.least(F.size("label_words"), F.size("title_words")) >= 0.75).select("scholar_id", "name", F.lit(True).alias("titled")).distinct()
    x = named.hint("merge").join(pool, "scholar_id", "left").join(alike.hint("merge"), ["scholar_id", "name"], "left")
    sources, known = F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("known", F.array().cast("array<string>"))
    per_label = F.array_compact(
        F.array(
            F.when((n_words < 2) | (n_words > 8), "topic_name_word_count"), F.when(~is_specific(F.col("key")) | F.col("key").isin(MID_LEVEL_LABELS), "broad_topic_label"), F.when(F.col("titled"), "paper_title_as_topic"),
            F.when((F.size(sources) == 0) | (F.size(F.array_except(sources, known)) > 0), "untraceable_source_topic"),
            F.when((F.length(F.trim("description_zh")) < 8) | (F.length(F.trim("description_en")) < 12), "topic_description_too_short"),
        )
    )
    per = x.groupBy("scholar_id").agg(F.array_distinct(F.flatten(F.collect_list(per_label))).alias("found"), F.count("*").alias("n"), F.count_distinct("key").alias("keys"))
    counted = F.array_compact(F.array(F.when((F.col("n") < least) | (F.col("n") > most), "topic_count_out_of_range"), F.when(F.col("keys") < F.col("n"), "duplicate_topic_label")))
    return per.select("scholar_id", F.array_sort(F.concat("found", counted)).alias("issues"))


def validate_trends(reports: DataFrame, claims: DataFrame, topics: DataFrame | None, evidence: DataFrame) -> DataFrame:
    """(scholar_id, issues) of reports on trends.

    reports: (scholar_id, summary_zh, summary_en); claims: (scholar_id, topic, class, works, text_zh, text_en), class emerging, rising, steady, falling or insight;
    topics: (scholar_id, topic), those of the evidence where there is no such table; evidence: (scholar_id, topic, work_id).
    """
    none = F.array().cast("array<long>")
    # of topics and evidence only what is claimed is read: a scholar's few claimed topics and works go to the scholar's rows, which stay where they lie
    asked = claims.groupBy("scholar_id").agg(F.collect_set("topic").alias("asked"), F.flatten(F.collect_list(F.coalesce("works", none))).alias("named")).hint("shuffle_hash")
    if topics is not None:
        topics = topics.join(asked, "scholar_id").filter(F.array_contains("asked", F.col("topic"))).select("scholar_id", "topic")
    evidence = evidence.join(asked, "scholar_id").filter(F.array_contains("asked", F.col("topic")) | F.array_contains("named", F.col("work_id"))).select("scholar_id", "topic", "work_id")
    x = claims.join((evidence if topics is None else topics).select("scholar_id", "topic", F.lit(True).alias("known")).distinct().hint("merge"), ["scholar_id", "topic"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    listed = x.filter("class <> 'insight'")
    lists = listed.groupBy("scholar_id").agg((F.count("*") > F.count_distinct("topic")).alias("twice"), F.max(~F.col("known")).alias("unknown"))
    own = evidence.groupBy("scholar_id", "topic").agg(F.collect_set("work_id").alias("related"))
    whole = evidence.groupBy("scholar_id").agg(F.collect_set("work_id").alias("valid"))
    i = x.filter("class = 'insight'").join(own.hint("merge"), ["scholar_id", "topic"], "left").join(whole.hint("merge"), "scholar_id", "left")
    cited, valid, related = (F.coalesce(c, none) for c in ("works", "valid", "related"))
    short = lambda c, n: F.length(F.trim(F.coalesce(c, F.lit("")))) < n
    bare = lambda c: T.count_only_text(F.col(c))
    insights = i.groupBy("scholar_id").agg(
        F.count("*").alias("insights"), F.max(~F.col("known")).alias("stray"), F.max((F.size(cited) == 0) | (F.size(F.array_except(cited, valid)) > 0)).alias("no_evidence"), F.max(F.size(F.array_except(cited, related)) > 0).alias("unrelated"),
        F.max(short("text_zh", 12) | short("text_en", 20)).alias("short"), F.max(bare("text_zh") | bare("text_en")).alias("bare"),
    )
    r = reports.join(lists.hint("merge"), "scholar_id", "left").join(insights.hint("merge"), "scholar_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    issues = F.array(
        F.when(yes(F.col("unknown")) | yes(F.col("stray")), "unknown_trajectory_topic"), F.when(yes(F.col("twice")), "duplicate_trajectory_classification"), F.when(short("summary_zh", 20) | short("summary_en", 30), "trajectory_summary_too_short"),
        F.when(bare("summary_zh") | bare("summary_en") | yes(F.col("bare")), "count_only_trajectory"), F.when(F.coalesce("insights", F.lit(0)) > 4, "too_many_trajectory_insights"), F.when(yes(F.col("no_evidence")), "unknown_trajectory_evidence"),
        F.when(yes(F.col("unrelated")), "unrelated_trajectory_evidence"), F.when(yes(F.col("short")), "trajectory_insight_too_short"),
    )
    return r.select("scholar_id", F.array_sort(F.array_compact(issues)).alias("issues"))


def validate_markers(reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """(scholar_id, issues): the [n] in a report's texts must be declared, and what is declared must exist. reports: (scholar_id, summary_zh, summary_en, declared)."""
    known = evidence.groupBy("scholar_id").agg(F.collect_set(F.col("evidence_id").cast("string")).alias("valid"))
    x = reports.join(known.hint("merge"), "scholar_id", "left")
    none = F.array().cast("array<string>")
    cited = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "summary_zh", "summary_en"), F.lit(r"\[(\d+)\]"), 1))
    declared, valid = F.coalesce("declared", none), F.coalesce("valid", none)
    outside = lambda a, b: F.size(F.array_except(a, b)) > 0
    wrong = (F.size(cited) == 0) | outside(cited, valid) | outside(declared, valid) | outside(cited, declared)
    n_words = F.size(F.filter(F.split(F.coalesce("summary_en", F.lit("")), r"\s+"), lambda w: w != ""))
    short = (F.length(F.trim(F.coalesce("summary_zh", F.lit("")))) < 60) | (n_words < 45)
    return x.select("scholar_id", F.array_compact(F.array(F.when(wrong, "invalid_report_citations"), F.when(short, "report_too_short"))).alias("issues"))
