"""Literal cases and a brute-force version of the operators in portraits."""

import json
import random
from collections import defaultdict

from folioscope.operators import lookups as L
from folioscope.operators import portraits as P


def values(df):
    return sorted(tuple(r) for r in df.collect())


def brute_provisional(works, rows):
    """{(name key, frozenset of record ids): (works, citations, h-index, anchor)} by comparing all pairs of one name."""
    by_id = {w: (doi or str(w), year or 0, max(0, c or 0)) for w, doi, year, c in works}
    coauthors = defaultdict(set)
    for w, _, s, _, _ in rows:
        if s is not None:
            coauthors[w].add(s)
    names = defaultdict(list)
    for r in rows:
        words = sorted((r[3] or "").lower().split())
        if r[2] is None and words:
            names[" ".join(words)].append(r)
    out = {}
    for name, records in names.items():
        left = set(range(len(records)))
        while left:
            group, front = set(), [left.pop()]
            while front:
                i = front.pop()
                group.add(i)
                near = {j for j in left if by_id[records[i][0]][0] == by_id[records[j][0]][0] or coauthors[records[i][0]] & coauthors[records[j][0]]}
                left -= near
                front += near
            own = [records[i] for i in group]
            cited = {}
            for r in own:
                key, _, c = by_id[r[0]]
                cited[key] = max(c, cited.get(key, 0))
            ordered = sorted(cited.values(), reverse=True)
            anchor = max(own, key=lambda r: (by_id[r[0]][2], by_id[r[0]][1], r[0], r[1]))
            out[name, f"provisional:{anchor[0]}:{anchor[1]}"] = (len(cited), sum(ordered), max([i for i, c in enumerate(ordered, 1) if c >= i], default=0))
    return out


def test_provisional_authors(spark):
    pick = random.Random(5)
    works = [(w, pick.choice([None, f"10.1/{w % 17}"]), pick.choice([None, 1999, 2004]), pick.choice([None, 0, 2, 7, w])) for w in range(60)]
    rows = []
    for w in range(60):
        for k in range(pick.randint(1, 3)):
            known = pick.random() < 0.4
            rows.append((w, k, pick.randint(1, 25) if known else None, pick.choice(["Ann Lee", "lee  ann", "Bo Wu", "", None, "Ann-Lee"]), pick.choice([None, 3])))
    w = spark.createDataFrame(works, "work_id long, doi string, publication_year int, cited_by_count int")
    a = spark.createDataFrame(rows, "work_id long, position_index int, scholar_id long, raw_name string, institution_id long")
    got = {(r["name_key"], r["candidate_id"]): (r["works_count"], r["cited_by_count"], r["h_index"]) for r in P.provisional_authors(w, a, k=1000).collect()}
    want = brute_provisional(works, [(*r[:3], (r[3] or "").replace("-", " "), r[4]) for r in rows])
    assert got == want and len(got) > 10
    first = P.provisional_authors(w, a, k=1).collect()
    assert len(first) == len({n for n, _ in want})
    assert P.provisional_authors(w.limit(0), a.limit(0)).count() == 0


def test_own_institution_is_always_listed(spark):
    rows = spark.createDataFrame(
        [(1, i, 10 * i, 20 - i, 0 if i % 2 else 2, 0, i == 12) for i in range(1, 13)] + [(2, 1, 5, 0, 0, 0, True), (2, 2, 5, 3, 1, 2, False)],
        "focus_id long, institution_id long, historical_works long, recent_works long, joint_works long, members long, is_focus boolean",
    )
    got = P.field_institutions(rows)
    assert [(i, r) for f, i, r in values(got.filter("list = 'active'").select("focus_id", "institution_id", "rank")) if f == 1] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (12, 8)]
    chances = values(got.filter("list = 'opportunities'").select("focus_id", "rank", "institution_id"))
    assert chances == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (1, 4, 7), (1, 5, 9), (1, 6, 11), (2, 1, 2)]
    pairs = spark.createDataFrame([(1, 2), (1, 9), (1, 10), (2, 2), (3, 1)], "focus_id long, institution_id long")
    compared = {(r["focus_id"], r["institution_id"]): r for r in P.compare_institutions(pairs, got).collect()}
    assert compared[1, 10]["status"] == "insufficient" and compared[3, 1]["status"] == "insufficient"
    assert (compared[1, 2]["activity"], compared[1, 2]["factor"], compared[1, 2]["share_points"]) == ("right", 2.3, 83)
    assert (compared[2, 2]["activity"], compared[2, 2]["factor"], compared[2, 2]["left_recent_share"]) == ("right_only", None, 0.0)


def test_angles_and_sentences(spark):
    rows = spark.createDataFrame(
        [(1, 10, 0.5, 0.2, 0.1, None, 30.0), (1, 11, 0.2, 0.9, 0.1, 80.0, 20.0), (1, 12, 0.2, 0.1, 0.1, 10.0, 90.0), (2, 10, 0.3, 0.3, 0.3, 30.0, 30.0)],
        "focus_id long, candidate_id long, topic_overlap double, recent_overlap double, downstream double, continuity double, impact double",
    )
    angles = P.reference_angles(rows)
    assert values(angles.select("focus_id", "candidate_id", "angle")) == [(1, 10, "topic_overlap"), (1, 11, "recent_overlap"), (1, 12, "impact"), (2, 10, "topic_overlap")]
    said = P.explain(angles.selectExpr("*", "'reference' as category", "0D as temporal", "0L as direct_count", "0L as shared_collaborators", "0D as method_similarity", "0D as problem_similarity", "4L as recent_works"))
    assert values(said.filter("focus_id = 1").select("text_en"))[2] == ("Topics overlap by 50%: the nearest line of work.",)
    assert said.filter("text_en is null or text_zh is null").count() == 0
    kinds = spark.createDataFrame(
        [("peer", 0.4, 0.2, 0, 0), ("peer", 0.1, 0.2, 0, 0), ("potential_collaborator", 0.0, 0.0, 0, 3), ("potential_collaborator", 0.0, 0.0, 1, 3), ("potential_competitor", 0.0, 0.0, 1, 0), ("other", 0.0, 0.0, 0, 0)],
        "category string, recent_overlap double, temporal double, direct_count long, shared_collaborators long",
    ).selectExpr("*", "0.5D as topic_overlap", "0.125D as method_similarity", "0.1D as problem_similarity", "cast(null as string) as angle", "cast(null as double) as downstream", "cast(null as long) as recent_works")
    texts = [t for (t,) in values(P.explain(kinds).filter("text_en is not null").select("text_en"))]
    assert len(set(texts)) == 5 and any("methods by 13%, with few joint papers" in t for t in texts)
    assert P.explain(kinds).filter("text_zh is null").count() == 1


def test_phase_context(spark):
    phases = spark.createDataFrame([(1, 0, 2000, 2002), (1, 1, 2003, 2004)], "scholar_id long, phase int, start_year int, end_year int")
    events = spark.createDataFrame(
        [(1, f"institution_{what}:{i}", f"institution_{what}", y) for what, i, y in (("started", 5, 2000), ("ended", 5, 2002), ("started", 6, 2001), ("started", 7, 2000), ("started", 8, None))]
        + [(1, "collaboration_started:9", "collaboration_started", 2003), (1, "paper_published:1", "paper_published", 2003)],
        "scholar_id long, event_key string, event_type string, event_year int",
    )
    works = spark.createDataFrame([(1, 2000, 4), (2, 2001, None), (3, 2002, 4), (4, 2003, 9)], "work_id long, publication_year int, cited_by_count int")
    authorships = spark.createDataFrame([(w, 1) for w in (1, 2, 3, 4)], "work_id long, scholar_id long")
    abstracts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, " ")], "work_id long, abstract string")
    got = {r["phase"]: r for r in P.phase_context(phases, events, works, authorships, abstracts).collect()}
    assert (got[0]["institutions"], got[0]["insight_papers"], got[0]["new_collaborators"]) == (["5", "6"], [1, 3], 0)
    assert (got[1]["institutions"], got[1]["insight_papers"], got[1]["new_collaborators"]) == (None, None, 1)


def test_profile_documents(spark):
    totals = spark.createDataFrame([(1, 2, 7, 1), (2, 0, 0, 0)], "scholar_id long, papers long, citations long, h_index int")
    trend = spark.createDataFrame([(1, 2001, 1, 5), (1, 2000, 1, 2)], "scholar_id long, year int, papers long, citations long")
    topics = spark.createDataFrame([(1, 2, "b", 1), (1, 1, "a", 2)], "scholar_id long, rank int, topic string, works_count long")
    coauthors = spark.createDataFrame([(1, 1, 2, "Bo", 1)], "scholar_id long, rank int, other_id long, name string, papers long")
    network = spark.createDataFrame([(1, "self", 1), (1, "coauthor", 2)], "scholar_id long, kind string, node_id long")
    got = {r["scholar_id"]: json.loads(r["document"]) for r in L.profile_documents(totals, trend, topics, coauthors, network=network).collect()}
    assert [t["year"] for t in got[1]["trend"]] == [2000, 2001] and [t["topic"] for t in got[1]["topics"]] == ["a", "b"]
    assert got[1]["network"] == [{"kind": "coauthor", "node_id": 2}, {"kind": "self", "node_id": 1}] and got[1]["coauthors"][0]["name"] == "Bo"
    assert got[2] == {"metrics": {"papers": 0, "citations": 0, "h_index": 0}}
