"""Who is merged with whom: evidence against all pairs, groups against the walk in order of ids, chains and hubs of links."""

import random
from itertools import combinations

import pytest

from folioscope.operators import resolve as E
from folioscope.operators.graph import first_independent


def walk(n, edges):
    """In order of ids, who is linked to none before that is a member is one."""
    first = {}
    for i in range(n):
        first[i] = not any(first[a] for a, b in edges if b == i)
    return first


LINKS = {
    "none": (3, []),
    "chain": (90, [(k, k + 1) for k in range(89)]),
    "random": (60, sorted({tuple(sorted(random.Random(k).sample(range(60), 2))) for k in range(110)})),
    "hub": (40, [(0, k) for k in range(1, 40)] + [(5, 6), (7, 9)]),
    "triangles": (30, [e for k in range(0, 30, 3) for e in combinations(range(k, k + 3), 2)] + [(k, k + 3) for k in range(0, 27, 3)]),
    "backwards": (20, [(k, 19) for k in range(19)]),
}


@pytest.mark.parametrize("case", sorted(LINKS))
def test_first_independent_set(spark, case):
    n, edges = LINKS[case]
    found = first_independent(spark.createDataFrame(edges, "a long, b long"))
    want = walk(n, edges)
    linked = {i for e in edges for i in e}
    assert {r.id: r.first for r in found.collect()} == {i: want[i] for i in linked}


def test_groups_are_stars(spark):
    profiles = spark.createDataFrame([(k,) for k in range(1, 8)], "profile_id long")
    merges = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 5), (6, 7)]
    decisions = spark.createDataFrame([(*m, True) for m in merges] + [(1, 7, False)], "left_id long, right_id long, merge boolean")
    # 1 takes 2 and 5, 3 is free and takes 4, 6 takes 7
    assert {r.profile_id: r.group_id for r in E.author_groups(profiles, decisions).collect()} == {1: 1, 2: 1, 5: 1, 3: 3, 4: 3, 6: 6, 7: 6}
    assert {r.group_id for r in E.author_groups(profiles, decisions.limit(0)).collect()} == set(range(1, 8))


def test_evidence_of_all_pairs_with_a_decisive_fact(spark):
    r = random.Random(4)
    people = [(k, r.choice(["li wei", "li wei", "a b", None]), r.choice([None, None, "X1", "x1", "x2"]), r.randint(1, 9)) for k in range(40)]
    facts = sorted({(k, kind, f"{kind[0]}{r.randrange(6 if kind == 'institution' else 25)}") for k in range(40) for kind in E.KINDS for _ in range(r.randint(0, 4))})
    own = {k: {kind: {v for i, t, v in facts if i == k and t == kind} for kind in E.KINDS} for k in range(40)}
    want = {}
    for (i, name, orcid, n), (j, other, second, m) in combinations(people, 2):
        a, b = (orcid or "").lower(), (second or "").lower()
        shared = {kind: len(own[i][kind] & own[j][kind]) for kind in E.KINDS}
        if (a and a == b) or (name is not None and name == other and (shared["work"] or shared["coauthor"])):
            conflict = bool(a and b and a != b)
            contained = {kind: round(shared[kind] / max(1, min(len(own[i][kind]), len(own[j][kind]))), 6) for kind in E.KINDS}
            want[i, j] = (*shared.values(), *contained.values(), bool(a and a == b), conflict, min(n, m))
    p = spark.createDataFrame(people, "profile_id long, name_key string, orcid string, works_count long")
    f = spark.createDataFrame(facts, "profile_id long, kind string, value string")
    found = E.pair_evidence(p, f).collect()
    got = {(x.left_id, x.right_id): (*(x[f"shared_{k}"] for k in E.KINDS), *(round(x[f"{k}_containment"], 6) for k in E.KINDS), x.same_orcid, x.orcid_conflict, x.fewest_works) for x in found}
    assert len(found) == len(got) and got == want
    counts = {x.name_key: x for x in E.undecided_pairs(p, E.pair_evidence(p, f)).collect()}
    names = [name for _, name, _, _ in people]
    with_evidence = sum(names[i] == names[j] == "li wei" for i, j in want)
    k = names.count("li wei")
    assert (counts["li wei"].profiles, counts["li wei"].pairs, counts["li wei"].without) == (k, k * (k - 1) // 2, k * (k - 1) // 2 - with_evidence)


def test_no_join_on_the_name_alone(spark):
    p = spark.createDataFrame([(k, "li wei", None, 3) for k in range(300)], "profile_id long, name_key string, orcid string, works_count long")
    f = spark.createDataFrame([(k, "work", f"w{k // 2}") for k in range(300)] + [(k, "institution", "i") for k in range(300)], "profile_id long, kind string, value string")
    assert E.pair_evidence(p, f).count() == 150
