"""Pairs of profiles meet by name and fact, or by ORCID; the keys that blocks meet by are not sent with them."""

from folioscope.operators import overlaps as O
from folioscope.operators import resolve as E


def test_keys_to_meet_by_are_not_sent(spark, monkeypatch):
    sent = []
    tiles = O.in_tiles
    monkeypatch.setattr(O, "in_tiles", lambda blocks, *more, **named: sent.append(blocks.columns) or tiles(blocks, *more, **named))
    people = [(1, "li", None, 2), (2, "li", "X", 2), (3, "wu", "x", 2), (4, "li", "Y", 2), (5, None, None, 2), (6, None, None, 2), (7, "", "", 1), (8, "", "", 1)]
    facts = [(1, "work", "w"), (4, "work", "w"), (3, "work", "w"), (2, "coauthor", "c"), (4, "coauthor", "c"), (5, "work", "v"), (6, "work", "v"), (2, "topic", "t"), (1, "topic", "t")]
    found = E.pair_evidence(spark.createDataFrame(people, "profile_id long, name_key string, orcid string, works_count long"), spark.createDataFrame(facts, "profile_id long, kind string, value string"))
    got = {(r.left_id, r.right_id): (r.shared_work, r.shared_coauthor, r.same_orcid, r.orcid_conflict) for r in found.collect()}
    assert got == {(1, 4): (1, 0, False, False), (2, 4): (0, 1, False, True), (2, 3): (0, 0, True, False), (7, 8): (0, 0, True, False)}
    assert sent and not [c for c in sent[0] if c.startswith("meet")]
