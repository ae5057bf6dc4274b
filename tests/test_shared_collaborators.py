"""Common collaborators: counted for every pair, with no row for each way over a third scholar."""

from collections import Counter

from folioscope.operators import scoring as S


def test_ways_over_a_hub_are_not_made(spark):
    """300 scholars who all wrote with two hubs: 90,000 ways, which no join of the plan makes."""
    edges = [(h, k) for h in (1000, 1001) for k in range(300)] + [(5, 6)]
    both = edges + [(b, a) for a, b in edges]
    found = S.shared_collaborators(spark.createDataFrame(both, "scholar_id long, other_id long"), spark.createDataFrame([(k,) for k in (3, 5, 1000)], "scholar_id long"))
    near = {}
    for a, b in both:
        near.setdefault(a, set()).add(b)
    want = Counter({(f, o): len(near[f] & near[o]) for f in (3, 5, 1000) for o in near if o != f and near[f] & near[o]})
    assert Counter({(r.focus_id, r.other_id): r.shared for r in found.collect()}) == want
    assert "middle" not in found._jdf.queryExecution().toString()
