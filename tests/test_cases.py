"""Literal cases: ties, empty windows, folding rules and limits."""

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import resolve as E
from folioscope.operators import rollups as R
from folioscope.operators import scoring as S
from folioscope.operators import usage as U


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_midpoint_percentile_shares_ties(spark):
    # one year, so impacts rank like the citations 1, 2, 2, 4
    works = spark.createDataFrame([(k, 2000, c) for k, c in enumerate([1, 2, 2, 4])], "work_id long, publication_year int, cited_by_count int")
    topics = spark.createDataFrame([], "work_id long, topic string")
    assert [p for _, p in values(S.impact_percentile(works, topics))] == [0.125, 0.5, 0.5, 0.875]


def test_later_works_on_the_same_topic(spark):
    works = spark.createDataFrame([(k, 2000 + k, 0) for k in (1, 2, 3, 4)], "work_id long, publication_year int, cited_by_count int")
    authorships = spark.createDataFrame([(k, 7) for k in (1, 2, 3, 4)], "work_id long, scholar_id long")
    topics = spark.createDataFrame([(1, "graph"), (1, "retrieval"), (2, "graph"), (2, "retrieval"), (3, "retrieval"), (4, "vision")], "work_id long, topic string")
    assert [(w, n) for _, w, n in values(S.later_same_topic(works, authorships, topics))] == [(1, 2), (2, 1), (3, 0), (4, 0)]


def test_h_index(spark):
    rows = spark.createDataFrame([("a", c) for c in (9, 5, 4, 4, 1)] + [("b", 0)] + [("c", 1), ("c", None)], "k string, c int")
    assert values(R.h_index(rows, "k", "c")) == [("a", 4), ("b", 0), ("c", 1)]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.normalize_doi(F.lit(" https://DX.doi.org/10.1/A ")).alias("doi"),
        T.normalize_doi(F.lit(None)).alias("no_doi"),
        T.normalize_orcid(F.lit("https://orcid.org/0000-0001-2345-678x")).alias("orcid"),
        T.topic_key(F.lit("Ontologies and Classes, glass Boxes")).alias("key"),
        T.tokens(F.lit("Ab graph-net 知识图谱")).alias("tokens"),
        T.title_phrases(F.lit("A survey of deep graph networks")).alias("phrases"),
        T.abstract_from_inverted(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))).alias("abstract"),
        T.has_consecutive_years(T.clean_years(F.array(F.lit(2001), F.lit(1999), F.lit(2000), F.lit(9999)))).alias("consecutive"),
        T.institution_match_score(F.lit("University of Graz"), F.lit("Graz University")).alias("score"),
    ).first()
    assert row.doi == "10.1/a" and row.no_doi == "" and row.orcid == "0000-0001-2345-678X"
    assert row.key == "ontology and classe glass boxe"
    assert row.tokens == ["graph-net", "图谱", "知识", "识图"]
    assert row.phrases == ["deep graph", "deep graph network", "graph network"]
    assert row.abstract == "a b a" and row.consecutive and row.score == 1


def test_refused_events_do_not_count(spark):
    events = spark.createDataFrame([(k, 1, t) for k, t in enumerate((0, 10, 20, 70, 75))], "event_id long, user_id long, t int")
    events = events.withColumn("created_at", F.timestamp_seconds("t"))
    # limit 2 in 60 s: the third is refused, so by t = 70 only t = 10 and itself count
    assert values(U.quota_decisions(events, 2, 60).select("event_id", "allowed")) == [(0, True), (1, True), (2, False), (3, True), (4, True)]


def test_status_changes_drop_immediate_repeats_only(spark):
    rows = [(1, 2, "running", "a", 1), (1, 2, "running", "a", 2), (1, 2, "ready", "b", 3), (1, 2, "running", "a", 4), (1, 1, "running", "a", 5)]
    df = spark.createDataFrame(rows, "scholar_id long, version int, status string, updated_at string, seq int")
    assert [r[-1] for r in values(U.status_changes(df, 2))] == [1]
    assert [r.seq for r in U.status_changes(df, 1).orderBy("seq").collect()] == [1, 3, 4, 5]


def test_input_order_does_not_matter(spark):
    a = spark.createDataFrame([(w, s) for w in range(6) for s in range(w % 3 + 1)], "work_id long, scholar_id long")
    assert values(R.coauthor_pairs(a)) == values(R.coauthor_pairs(a.orderBy(F.rand(1))))


def test_quota_of_one_hot_user(spark):
    # a long run without a gap, a run behind a gap, equal times and a time that is missing
    times = [k * 7 % 900 for k in range(400)] + [5000, 5000, 5000, 5001, None]
    events = spark.createDataFrame([(k, 1, t) for k, t in enumerate(times)] + [(1000, 2, 5), (1001, None, 5)], "event_id long, user_id long, t long").select("event_id", "user_id", F.timestamp_seconds("t").alias("created_at"))
    kept, want = [], [(404, 1, True), (1000, 2, True)]
    for t, k in sorted((t, k) for k, t in enumerate(times) if t is not None):
        live = [x for x in kept if x >= t - 60]
        want.append((k, 1, len(live) < 3))
        kept = live + [t] * (len(live) < 3)
    found = U.quota_decisions(events, 3, 60)
    assert values(found) == sorted(want)
    assert "collect_list" not in found._jdf.queryExecution().toString()  # no user is one row


def test_one_title_in_two_years_is_two_works(spark):
    works = spark.createDataFrame([(1, None, "One", 2000), (2, None, "One", 2001), (3, None, "one", 2000), (4, None, "Two", 2000), (5, None, "Two", None), (6, None, "Two", 2001)], "work_id long, doi string, title string, publication_year int")
    authorships = spark.createDataFrame([(k, 7) for k in range(1, 7)], "work_id long, scholar_id long")
    assert [(w, c) for _, w, c in values(E.work_components(works, authorships))] == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4), (6, 4)]


def test_pairs_of_equal_names_are_counted_not_made(spark, tmp_path):
    """Of 100,000 scholars of one institution and two names, ten thousand million pairs."""
    from folioscope.plans import extra

    n = 100_000
    spark.range(n).selectExpr("case when id = 0 then 1 else id * 20 end as s_suppkey", "'x' as s_name", "1 as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {(r.form, r.match): r.n for r in extra.QUERIES["B17_person_name_match"](spark, str(tmp_path)).collect()}
    equal = (n - 1) ** 2 + 1
    want = {}
    for form, (*_, fits) in enumerate(extra.NAME_FORMS):
        want |= {(form, True): equal, (form, False): n * n - equal} if fits else {(form, False): n * n}
    assert got == want


def test_works_without_a_topic_name_share_none(spark):
    from folioscope.operators import scoring as S

    works = spark.createDataFrame([(w, 2000 + w) for w in range(1, 5)], "work_id long, publication_year int")
    authorships = spark.createDataFrame([(w, 1) for w in range(1, 5)], "work_id long, scholar_id long")
    topics = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (4, None)], "work_id long, topic string")
    rows = lambda enough: sorted(map(tuple, S.later_same_topic(works, authorships, topics, enough).collect()))
    assert rows(3) == rows(None) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 0)]


def test_match_containment_against_all_pairs(spark):
    from folioscope.functions import text as T
    from folioscope.operators import candidates as C

    a = "one two three four five six"
    works = [(1, a, 2000), (1, a + " seven", None), (1, "short title", 2001), (1, "Short  Title!", 2002), (1, "", 2000), (1, None, 2000), (2, a, 0), (None, a, 2000), (3, a, 2000), (3, a, 2001)]
    titles = [a, a.upper() + " seven", "zero " + a + " eight", "zero one two three four five sixth", a + " x" * 16, a + " x" * 17, "x " * 16 + a, "a short title", "short-title", "", None, "six " + a + " " + a]
    records = [(s, 100 * k + y % 100, t, yy) for k, t in enumerate(titles) for s in (1, 2, 3) for y, yy in ((0, 0), (1, None), (2, 2000), (3, 2001), (4, 2002))] + [(None, 1, a, 2000)]
    r = spark.createDataFrame(records, "scholar_id long, record_id long, title string, year int")
    w = spark.createDataFrame(works, "scholar_id long, known string, publication_year int")
    pairs = r.join(w, "scholar_id").filter(T.title_contains_match(F.col("known"), F.col("title"))).filter("coalesce(year, 0) = 0 or year = coalesce(publication_year, 0)")
    want = sorted(map(tuple, pairs.select("scholar_id", "record_id").distinct().collect()))
    found = C.match_containment(r, w.withColumnRenamed("known", "title"))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 40
    # no pair of titles is compared after the join, so heads that many titles share make no rows
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1 and "contains(" not in plan.lower()
