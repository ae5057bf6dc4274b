"""Works on any of a focus's topics by institution, counted from topics, pairs and triples: against the works themselves."""

import random

from folioscope.operators import portraits as P


def test_counts_of_works_with_many_topics(spark):
    r = random.Random(7)
    topics = {w: set(r.sample("abcdefghij", r.randint(0, 7))) for w in range(120)}
    fields = {f: set(r.sample("abcdefghij", r.randint(1, 8))) for f in range(6)} | {6: {"a"}, 7: {"z"}}
    places = sorted({(w, r.randint(1, 3), r.choice([1990, 1999, None])) for w in range(120) for _ in range(r.randint(0, 3))}, key=str)
    flat = lambda x: [(i, t) for i, own in x.items() for t in own]
    df = P.institution_counts(
        spark.createDataFrame(flat(fields), "focus_id long, topic string"), spark.createDataFrame(flat(topics) * 2, "work_id long, topic string"),
        spark.createDataFrame(places, "work_id long, institution_id int, year int"), 1996,
    )
    want = {}
    for f, own in fields.items():
        for i in (1, 2, 3):
            hit = {w for w, at, _ in places if at == i and topics[w] & own}
            if hit:
                want[f, i] = (len(hit), len({w for w, at, y in places if at == i and w in hit and y == 1999}))
    assert {(x.focus_id, x.institution_id): (x.historical_works, x.recent_works) for x in df.collect()} == want
    assert any(len(topics[w] & fields[f]) > 4 for w in topics for f in fields)


def test_works_of_a_focus_are_not_made(spark):
    """40 scholars of one frequent topic: 40 rows of counts, not a row a scholar and work."""
    fields = spark.createDataFrame([(f, "a") for f in range(40)], "focus_id long, topic string")
    topics = spark.createDataFrame([(w, t) for w in range(500) for t in "ab"], "work_id long, topic string")
    df = P.institution_counts(fields, topics, spark.createDataFrame([(w, 1, 2000) for w in range(500)], "work_id long, institution_id int, year int"), 1996)
    assert {(x.historical_works, x.recent_works) for x in df.collect()} == {(500, 500)} and df.count() == 40
    assert "work_id" not in df._jdf.queryExecution().optimizedPlan().toString()
