"""Topics are dealt by scholar before they are exploded: rows as by plain counting, and no exchange of exploded rows."""

import re
from collections import Counter, defaultdict

import pytest

from folioscope.operators import rollups as R
from folioscope.operators import tracking as K


@pytest.fixture(scope="module")
def corpus(spark):
    works = [(w, None if w % 11 == 0 else 2000 + w * 7 % 9, None if w % 5 == 0 else w % 4) for w in range(60)]
    authorships = [(w, s) for w in range(60) for s in range(6) if (w * 3 + s) % 4 == 0 or s == 0 and w < 2] + [(4, 0), (4, 0)]  # work 4 is listed repeatedly
    topics = [(w, f"t{(w * k) % 7}") for w in range(60) if w % 6 for k in (1, 2, 3)]
    return works, authorships, topics, (
        spark.createDataFrame(works, "work_id long, publication_year int, cited_by_count int"),
        spark.createDataFrame(authorships, "work_id long, scholar_id long"),
        spark.createDataFrame(topics, "work_id long, topic string"),
    )


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scholar_topics(corpus):
    works, authorships, topics, tables = corpus
    year, of = {w: y for w, y, _ in works}, defaultdict(set)
    for w, t in topics:
        of[w].add(t)
    want = defaultdict(list)
    for w, s in set(authorships):
        for t in of[w]:
            want[s, t].append(year[w])
    found = R.scholar_topics(*tables)
    got = {(r.scholar_id, r.topic): (r.first_year, r.last_year, r.works_count, r.years) for r in found.collect()}
    real = lambda ys: sorted({y for y in ys if y is not None})
    assert got == {k: (min(real(v), default=None), max(real(v), default=None), len(v), real(v)) for k, v in want.items()}
    assert not re.search(r"Exchange hashpartitioning\(scholar_id#\d+L?, topic", plan(found))


def test_topic_years_and_phases_count_every_row_of_authorships(corpus):
    works, authorships, topics, tables = corpus
    year, of = {w: y for w, y, _ in works}, defaultdict(set)
    for w, t in topics:
        of[w].add(t)
    want = Counter((s, t, year[w]) for w, s in authorships for t in of[w] if year[w] is not None)
    found = R.topic_years(*tables)
    assert {(r.scholar_id, r.topic, r.year): r.papers for r in found.collect()} == want
    assert not re.search(r"Exchange hashpartitioning\(scholar_id#\d+L?, topic", plan(found))
    phases = R.research_phases(*tables)
    papers = Counter(s for w, s in authorships if year[w] is not None)
    assert Counter({r.scholar_id: r.n for r in phases.groupBy("scholar_id").agg({"papers": "sum"}).toDF("scholar_id", "n").collect()}) == papers
    assert not re.search(r"Exchange hashpartitioning\(scholar_id#\d+L?, phase#\d+L?, topic", plan(phases))
    last = {s: max(y for (a, _, y) in want if a == s) for (s, _, _) in want}
    for r in K.activity_matrix(*tables).collect():
        assert last[r.scholar_id] - 5 <= r.year <= last[r.scholar_id] and r.papers == want.get((r.scholar_id, r.topic, r.year), 0)


def test_field_topics(corpus):
    works, authorships, topics, tables = corpus
    year, of = {w: y for w, y, _ in works}, defaultdict(set)
    for w, t in topics:
        of[w].add(t)
    own = defaultdict(lambda: defaultdict(list))
    for w, s in set(authorships):
        for t in of[w]:
            own[s][t].append(year[w])
    for k in (2, 8):
        want = set()
        for s, by in own.items():
            rows = [(t, len(ys), len({y for y in ys if y is not None})) for t, ys in by.items()]
            lasting = [r for r in rows if r[1] >= 2 or r[2] >= 2]
            best = sorted(lasting or rows, key=lambda r: (-(r[2] >= 2), -r[1], r[0]))[:k]
            want |= {(s, i + 1, *r) for i, r in enumerate(best)}
        found = R.field_topics(*tables, k=k)
        assert set(map(tuple, found.collect())) == want
    assert "collect_set(publication_year" not in plan(found)


def test_audit_asks_for_as_many_profiles_as_it_reads(spark):
    from folioscope.plans.candidates import _requests

    asked = _requests(spark, "/root/testdata/sf0.1")[0].groupBy("scholar_id").count()
    assert asked.count() == 1000 and {r["count"] for r in asked.collect()} == {8}


def test_trends_know_the_topics_of_their_evidence(spark):
    from folioscope.operators.topics import validate_trends

    reports = spark.createDataFrame([(k, "x" * 20, "x" * 30) for k in (1, 2)], "scholar_id long, summary_zh string, summary_en string")
    claims = spark.createDataFrame([(1, "a", "insight", [5], "x" * 12, "x" * 20), (2, "b", "insight", [6], "x" * 12, "x" * 20)], "scholar_id long, topic string, class string, works array<long>, text_zh string, text_en string")
    evidence = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (2, "c", 7)], "scholar_id long, topic string, work_id long")
    expected = {1: [], 2: ["unknown_trajectory_topic", "unrelated_trajectory_evidence"]}
    for topics in (None, evidence.select("scholar_id", "topic")):
        assert {r.scholar_id: r.issues for r in validate_trends(reports, claims, topics, evidence).collect()} == expected


def test_continuity_sends_no_rows_by_topic(spark):
    from folioscope.operators.scoring import continuity_index

    w = spark.createDataFrame([(k, 2000 + k) for k in range(6)] + [(6, None)], "work_id long, publication_year int")
    a = spark.createDataFrame([(k, 1) for k in range(7)] + [(6, 2)], "work_id long, scholar_id long")
    t = spark.createDataFrame([(k, "a") for k in range(4)] + [(4, "b")], "work_id long, topic string")
    found = continuity_index(w, a, t)
    assert "hashpartitioning(scholar_id#" in plan(found) and ", topic#" not in "".join(x for x in plan(found).splitlines() if "hashpartitioning" in x)
    got = {r.scholar_id: (r.longest_span, r.topic_repeat, r.sustained_topics, r.sustained_share) for r in found.collect()}
    assert got == {1: (4, 0.8, 1, round(4 / 7, 6)), 2: (0, 0.0, 0, 0.0)}


def test_peer_page_keeps_one_row_more_than_a_page(spark):
    from folioscope.operators.lookups import peer_page

    rows = spark.createDataFrame([(f, c, c * 37 % 101, c % 2) for f, n in ((1, 10), (2, 11), (3, 5), (4, 6)) for c in range(n)], "focus_id long, candidate_id long, discovery_rank long, ready int")
    found = peer_page(rows, limit=5, offset=5)
    assert "WindowGroupLimit" in plan(found)
    assert sorted((r.focus_id, r.place, r.next_offset) for r in found.collect()) == [(1, p, None) for p in range(6, 11)] + [(2, p, 10) for p in range(6, 11)] + [(4, 6, None)]


def test_compared_sets_meet_as_one_row_a_scholar(spark):
    from folioscope.operators.lookups import set_compare

    v = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (1, None), (2, "y"), (2, None), (2, "z"), (3, "q")], "scholar_id long, value string")
    found = set_compare(spark.createDataFrame([(1, 2), (3, 4), (1, 2)], "a long, b long"), v)
    assert not [x for x in plan(found).splitlines() if re.search(r"hashpartitioning\(a#\w+, b#\w+, value#", x)]
    assert Counter(map(tuple, found.collect())) == Counter([(1, 2, "x", "left_only"), (1, 2, "y", "shared"), (1, 2, None, "shared"), (1, 2, "z", "right_only"), (3, 4, "q", "left_only")])


def test_style_sends_no_rows_by_topic_or_pair(corpus, spark):
    from folioscope.operators.evidence import style_profile

    works, authorships, topics, (w, a, t) = corpus
    none = spark.createDataFrame([], "scholar_id long, value string, n long")
    found = style_profile(w.selectExpr("*", "'x' as title"), a, t, none, spark.createDataFrame([(0, 80.0)], "scholar_id long, continuity double"))
    sent = "".join(x for x in plan(found).splitlines() if "hashpartitioning" in x)
    assert ", topic#" not in sent and ", other" not in sent
    own = {s: {x for x, y in authorships if y == s} for s in range(6)}
    assert {r.scholar_id: r.repeated for r in found.collect()} == {s: sum(len(own[s] & own[o]) >= 2 for o in own if o != s) for s in own}


def test_review_reads_only_the_keys_that_evidence_names(spark):
    from folioscope.operators.evidence import review_evidence

    evidence = spark.createDataFrame([(1, 1, "paper", "HTTPS://doi.org/10.1/A", None), (1, 2, "paper", "w:9", None), (2, 1, "paper", "w:3", None), (2, 2, "metric", None, 1), (3, 1, "metric", None, 1)], "scholar_id long, evidence_id int, type string, url string, value long")
    works = spark.createDataFrame([(1, 1, "w:1", "10.1/a"), (1, 2, "", None), (2, 3, "w:3", None), (4, 9, "w:9", None)], "scholar_id long, work_id long, url string, doi string")
    found = review_evidence(evidence, works, spark.createDataFrame([(2, "sufficient")], "scholar_id long, status string"))
    assert "array_contains(asked" in plan(found)
    assert sorted((r.scholar_id, r.evidence_id, r.approved, r.confidence) for r in found.collect()) == [(1, 1, True, "medium"), (1, 2, False, None), (2, 1, True, "medium"), (2, 2, True, "high"), (3, 1, False, None)]


def test_topic_candidates_are_told_once_per_work_and_counted_by_hash(spark):
    """Each rule for counting a keyword or phrase alone and together; no set of works is made and no exploded row is sent."""
    from folioscope.operators import topics as P

    works = [(w, "Fast Graph Search" if w < 3 else "Fast Graph Search Again" if w == 3 else None if w == 4 else "Other thing", 2000 + w, w * 10) for w in range(6)]
    authorships = [(w, s) for w in range(6) for s in range(3) if w != s] + [(3, 0)]
    labels = [(0, "graph search", "keyword", None, 2), (1, "Lonely Keyword", "keyword", 0.5, 2), (5, "lonely keywords", "keyword", 0.5, 2), (5, "odd one", "keyword", 1.0, 2), (2, "Fast graphs", "primary", 1.0, 2), (2, "fast graph", "topic", 1.0, 2),
              (4, "shallow", "concept", 1.0, 1), (4, "data mining", "concept", None, 2), (3, "fast graph", "concept", 1.0, 3)]
    found = P.topic_candidates(spark.createDataFrame(works, "work_id long, title string, publication_year int, cited_by_count int"), spark.createDataFrame(authorships, "work_id long, scholar_id long"),
                               spark.createDataFrame(labels, "work_id long, name string, kind string, score double, level int"))
    got = {(r.scholar_id, r.key): (r.works, r.sources, r.n_works) for r in found.collect()}
    own = {s: sorted({w for w, a in authorships if a == s}) for s in range(3)}
    for s in range(3):
        titled = [w for w in own[s] if w < 4]
        assert got[s, "fast graph"] == (titled, ["concept", "title_phrase", "topic"] if 2 in titled else ["concept", "title_phrase"], len(titled))
        assert got.get((s, "graph search")) == (titled, ["keyword", "title_phrase"] if 0 in titled else ["title_phrase"], len(titled))
        assert got.get((s, "lonely keyword")) == (None if s == 1 else ([1, 5], ["keyword"], 2))
        assert got[s, "data mining"] == ([4], ["concept"], 1)
        assert (s, "odd one") not in got and (s, "shallow") not in got and (s, "search again") not in got
    text = plan(found.select("scholar_id", "key", "score", "n_works", "sources"))
    assert "collect_set" not in text and not re.search(r"Exchange hashpartitioning\(scholar_id#\d+L?, key", text)


def test_components_within_scopes_are_told_where_they_lie(spark):
    """The least id reachable within each scope, as without scopes on marked ids, and no exchange by scope and id."""
    from folioscope.operators import graph as G

    links = [(s, (k * 7 + s) % 40, (k * 11 + 3) % 40) for s in range(3) for k in range(14 + s)] + [(9, 5, 5)]
    near = defaultdict(set)
    for s, a, b in links:
        near[s, a].add(b)
        near[s, b].add(a)
    want = {}
    for s, a in sorted(near):
        todo = [a]
        while todo:
            x = todo.pop()
            if (s, x) not in want:
                want[s, x] = a
                todo += near[s, x]
    found = G.components(spark.createDataFrame(links, "s long, a long, b long"), "s")
    assert {(r.s, r.id): r.component for r in found.collect()} == {k: v for k, v in want.items() if near[k] != {k[1]}}
    keys = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, 2, "x"), (2, 3, "y"), (1, 3, "y"), (1, 2, "y")], "s long, id long, key string")
    of = G.components_of(keys.select("s", "id").distinct(), keys, "s")
    assert sorted(map(tuple, of.collect())) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 2, 2), (2, 3, 3)]


def test_anchored_profiles_normalise_known_titles_once(spark):
    """The profile with most works of the scholar's own among those reached by an anchor; only the records' titles are left to normalise in the last job."""
    from folioscope.operators import candidates as C

    works = spark.createDataFrame([(1, "Top: title", 2000, 9), (1, "Second", 2001, 8), (1, "third", 2002, 1), (2, "Alone", 2000, None)], "scholar_id long, title string, publication_year int, cited_by_count int")
    hits = spark.createDataFrame([(1, "top TITLE", 11), (1, "second!", 12), (1, "third", 13), (2, "no", 21), (1, "Top title", 11)], "scholar_id long, title string, author_id long")
    articles = spark.createDataFrame([(1, 11, 1, "Top title", 2000), (1, 12, 2, "SECOND", 2001), (1, 12, 3, "Third", None), (1, 13, 4, "Top title", 2000), (1, 13, 5, "Second", 2001), (1, 13, 6, "third", 2002), (2, 21, 7, "Alone", 2000)], "scholar_id long, author_id long, record_id long, title string, year int")
    found = C.choose_anchored(works, hits, articles, spark.createDataFrame([(1, 11, 2)], "scholar_id long, author_id long, score int"))
    assert [tuple(r) for r in found.collect()] == [(1, 12, 2)]
    assert len(re.findall(r"Project \[.*regexp_replace", plan(found).split("Initial Plan")[0])) == 1
