"""Literal cases of records, names and sentences; groups of works and authors against brute force."""

import itertools
import json
import random

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import candidates as C
from folioscope.operators import resolve as E
from folioscope.sources import external as X
from folioscope.sources import records as A


def raw(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "json string")


def test_topics_without_ids_stay_apart(spark):
    doc = {"id": "x/W1", "primary_topic": {"id": "x/T3", "display_name": "Gamma"}, "topics": [{"display_name": "Alpha"}, {"display_name": "Beta"}, {"display_name": "alpha "}, {"id": "x/T3", "display_name": "Gamma"}, {"id": "x/T4", "display_name": "Delta"}]}
    got = {(r.topic, r.is_primary, r.confidence) for r in A.explode_topics(raw(spark, doc)).collect()}
    assert got == {("Gamma", True, 0.9), ("Alpha", False, 0.7), ("Beta", False, 0.7), ("Delta", False, 0.9)}


def test_publisher_titles_are_decoded_before_tags_go(spark):
    row = A.crossref_records(raw(spark, {"DOI": "10.1/X", "title": ["&lt;i&gt;x&lt;/i&gt; caf&eacute;&nbsp;y"]}, {"DOI": "10.1/Y"})).orderBy("doi").collect()
    assert [r.title for r in row] == ["x café y", ""]


def test_names(spark):
    cases = [("Jo Smith", "Joanna Smith", False), ("John Smith", "John Q R Smith", False), ("Smith John", "J Smith", True), ("A B Smith", "Smith, A.", True), ("Smith", "Smith", True), ("Smith", "A Smith", False), (None, "x", False), ("", "", False), ("J S", "J S Smith", False)]
    got = spark.createDataFrame(cases, "a string, b string, want boolean").select("a", "b", "want", T.person_name_match(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b, r.got) for r in got] == [(r.a, r.b, r.want) for r in got]


def test_count_only_sentences(spark):
    cases = [("论文数量由3篇增长至8篇", True), ("占比从 3% 降至 8%", True), ("从3篇论文增加", True), ("papers rose from 3% to 8%", True), ("3 → 8", True), ("a method from 3 papers to 8", False), ("no digits from papers", False), (None, False)]
    got = spark.createDataFrame(cases, "t string, want boolean").select("t", "want", T.count_only_text(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_person_records(spark):
    xml = "<dblpperson><r><article key='a/1'><author>Ada B</author><title>On <sub>x</sub> y.</title><year>n/a</year><ee>https://x.org</ee><ee>https://doi.org/10.1/Z</ee></article></r><r/><r><book><title/></book></r></dblpperson>"
    got = [tuple(r) for r in X.person_records_xml(spark.createDataFrame([(xml,), (None,)], "xml string")).collect()]
    assert got == [("a/1", "10.1/z", "On x y.", None, "", ["Ada B"]), ("", "", "", None, "", [])]


def groups(items, linked):
    """item -> least item reachable."""
    least = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_work_components(spark):
    r = random.Random(3)
    works = [(10**13 + k, f"10.1/{r.randrange(25)}" if r.random() < 0.4 else None, f"title {r.randrange(30)}" if r.random() < 0.9 else None, r.choice([None, 2000, 2001])) for k in range(60)]
    own = sorted({(w[0], r.randrange(6)) for w in works for _ in range(2)})
    got = {(x.scholar_id, x.work_id): x.component for x in E.work_components(spark.createDataFrame(works, "work_id long, doi string, title string, publication_year int"), spark.createDataFrame(own, "work_id long, scholar_id long")).collect()}
    authors = {w[0]: {s for i, s in own if i == w[0]} for w in works}
    for s in range(6):
        mine = [w for w in works if s in authors[w[0]]]
        pairs = []
        for a, b in itertools.combinations(mine, 2):
            title = a[2] and a[2] == b[2] and (a[3] == b[3] or a[3] is None or b[3] is None or any(x[2] == a[2] and x[3] is None for x in mine))
            if (a[1] and a[1] == b[1]) or title or (authors[a[0]] & authors[b[0]]) - {s}:
                pairs.append((a[0], b[0]))
        assert {w: c for (i, w), c in got.items() if i == s} == groups([w[0] for w in mine], pairs)


def test_insufficient_evidence_keeps_all_works(spark):
    c = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 3, 3), (2, 4, 3), (2, 5, 3), (2, 6, 6)], "scholar_id long, work_id long, component long")
    e = c.select("scholar_id", "work_id", F.lit(None).cast("int").alias("year"), F.lit(0).alias("coauthors"), F.lit(False).alias("at_target"))
    none = c.filter("false").select("scholar_id", "work_id")
    got = {(r.work_id, r.kept, r.method) for r in C.primary_cluster(c, e, none).collect()}
    assert got == {(1, True, "insufficient_evidence"), (2, True, "insufficient_evidence"), *((k, k < 6, "institution_collaborator_cluster") for k in (3, 4, 5, 6))}
