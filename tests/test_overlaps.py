"""Pairs made tile by tile against all pairs, and the gates of the dimensions and recommendations by literal cases."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import overlaps as O
from folioscope.operators import scoring as S


def profiles(seed, groups, per_group, keys):
    """Weighted profiles of scholars in groups that hardly share keys; one key is everybody's."""
    r = random.Random(seed)
    rows = {}
    for g in range(groups):
        for k in range(per_group):
            own = {f"g{g}k{r.randrange(keys)}": r.randint(1, 9) for _ in range(r.randint(1, 6))}
            if r.random() < 0.8:
                own["common"] = r.randint(1, 4)
            if r.random() < 0.2:
                own[f"g{r.randrange(groups)}k{r.randrange(keys)}"] = r.randint(1, 9)
            rows[g * per_group + k] = own
    return rows


def blocks_of(spark, rows, block):
    flat = [(i, k, n) for i, own in rows.items() for k, n in own.items()]
    df = spark.createDataFrame(flat, "id long, key string, n long").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("x"))
    members = df.select("id", F.col("x.key").alias("keys"), F.col("x.n").alias("keys_n"))
    return O.blocked(members.withColumn("main", O.main_key(F.col("keys"), F.col("keys_n"))), {"keys": ["n"]}, [], block=block)


@pytest.mark.parametrize("block", [1, 3, 128])
@pytest.mark.parametrize("least", [0.15, 0.5])
def test_no_pair_that_reaches_the_bound_is_missed(spark, block, least):
    rows = profiles(1, 6, 8, 7)
    blocks = blocks_of(spark, rows, block)
    place = {i: b.block for b in blocks.select("block", "id").collect() for i in b.id}
    tiles = {(t.a, t.b) for t in O.bounded_tiles(blocks, {"keys": ["n"]}, "keys", {"n": least}).collect()}
    ids = sorted(rows)
    for x in ids:
        for y in ids:
            if x < y:
                m = sum(min(n, rows[y].get(k, 0)) for k, n in rows[x].items())
                if m and m >= least * (sum(rows[x].values()) + sum(rows[y].values()) - m):
                    assert tuple(sorted((place[x], place[y]))) in tiles
    n = len(set(place.values()))
    assert len(tiles) <= n * (n + 1) // 2 and (block > 1 or least < 0.5 or len(tiles) < n * (n + 1) // 4)  # and most others aren't made


def test_set_pairs(spark):
    rows = profiles(2, 5, 9, 6)
    want = set()
    for x in rows:
        for y in rows:
            common = len(rows[x].keys() & rows[y].keys())
            if x < y and common:
                want.add((x, y, common, len(rows[x]), len(rows[y])))
    sets = spark.createDataFrame([(i, k) for i, own in rows.items() for k in own], "id long, key string")
    got = [tuple(r) for r in O.set_pairs(sets).collect()]
    assert len(got) == len(want) and set(got) == want
    assert O.set_pairs(sets.limit(0)).count() == 0


def corpus(spark):
    """Scholar 1 asks; 2 and 3 have its topics, 3 is not ready; 4 has one topic of many; 5 shares nothing."""
    topics = {1: "ab", 2: "ab", 3: "ab", 4: "acdefghijk", 5: "z"}
    works, authorships, work_topics, n = [], [], [], 0
    for s, own in topics.items():
        for year in (2018, 2019, 2020, 2021):
            for t in own:
                n += 1
                works.append((n, year, 5))
                authorships.append((n, s, 1, "first", 0, True))
                work_topics.append((n, t))
    w = spark.createDataFrame(works, "work_id long, publication_year int, cited_by_count int")
    a = spark.createDataFrame(authorships, "work_id long, scholar_id long, author_count int, author_position string, position_index int, is_corresponding boolean")
    scholars = spark.createDataFrame([(s, 7, s != 3) for s in topics], "scholar_id long, institution_id int, graph_ready boolean")
    return w, a, spark.createDataFrame(work_topics, "work_id long, topic string"), scholars


def test_pair_features_and_gates(spark):
    w, a, t, scholars = corpus(spark)
    focus = spark.createDataFrame([(1,)], "scholar_id long")
    values = lambda v: spark.createDataFrame([(s, v) for s in (1, 2, 3)], "scholar_id long, value string")
    links = spark.createDataFrame([(1, 9, 1), (2, 9, 2), (1, 2, 1), (2, 1, 1)], "scholar_id long, other_id long, direct_count long")
    f = S.pair_features(w, a, t, scholars, focus, values("method"), values("m"), values("p"), links)
    got = {r.candidate_id: r for r in f.collect()}
    assert set(got) == {2, 3}  # 4 overlaps by 4 of 44, 5 not at all
    assert (got[2].topic_overlap, got[2].temporal, got[2].shared_topics, got[2].direct_count, got[2].shared_collaborators, got[2].complementarity) == (1.0, 1.0, ["a", "b"], 1, 1, 0.0)
    assert [r.candidate_id for r in S.recommend_peers(f).collect()] == [2]  # 3 is not ready
    assert [r.candidate_id for r in S.recommend_competitors(f).collect()] == [2]
    whole = S.pair_features(w, a, t, scholars, focus, values("method"), values("m"), values("p"), links, least_overlap=0.05)
    assert {r.candidate_id: round(r.topic_overlap, 3) for r in whole.collect()} == {2: 1.0, 3: 1.0, 4: 0.091}


def test_dimensions_are_null_without_enough_data(spark):
    w, a, t, scholars = corpus(spark)
    none = spark.createDataFrame([], "citing_work_id long, cited_work_id long")
    confidence = S.data_confidence(w, a, t, spark.createDataFrame([], "work_id long, abstract string"), scholars)
    d = {r.scholar_id: r for r in S.scholar_dimensions(confidence, S.quality_index(w, a, t, none), S.continuity_index(w, a, t), S.impact_index(w, a, t, none)).collect()}
    assert d[3].level == "insufficient" and (d[3].quality, d[3].continuity, d[3].impact, d[3].quality_band, d[3].evidence) == (None, None, None, None, [])
    assert d[2].quality is not None and {e.dimension for e in d[2].evidence} == {"quality", "continuity", "impact"}
    assert {e.code: e.value for e in d[2].evidence if e.dimension == "continuity"} == {"sustained_topics": 2.0, "longest_span": 4.0, "sustained_share": 1.0, "recent_stability": 0.0}
    per = defaultdict(list)
    for e in d[2].evidence:
        per[e.dimension].append(e.code)
    assert per["quality"] == ["representative_signal", "strong_contribution_share", "field_normalized_impact", "internal_diffusion"]


def test_a_block_is_sent_once_per_stripe_and_heavy_weights_count(spark):
    rows = profiles(3, 4, 10, 6)
    for k, i in enumerate(rows):
        rows[i]["common"] = 1 + 7 * k  # more distinct weights than are compared by levels
    parts = {"keys": ["n"]}
    blocks = blocks_of(spark, rows, 2)
    n = blocks.count()
    groups = spark.sparkContext.accumulator(0)

    def kernel(x, y, same):
        least = O.least_sums(x["keys"], y["keys"], ("n",))[0]
        i, j = np.nonzero(np.triu(np.ones_like(least), 1) if same else np.ones_like(least))
        return pd.DataFrame({"a": np.minimum(x["id"][i], y["id"][j]), "b": np.maximum(x["id"][i], y["id"][j]), "least": least[i, j]})

    def counting():
        groups.add(1)
        return lambda rows: rows

    tiles = O.bounded_tiles(blocks, parts, "keys", {"": 0.0})
    got = {(r.a, r.b): r.least for r in O.in_tiles(blocks, tiles, parts, kernel, "a long, b long, least long", counting).collect()}
    assert got == {(x, y): sum(min(v, rows[y].get(k, 0)) for k, v in rows[x].items()) for x in rows for y in rows if x < y}
    stripes = 3  # for four partitions
    assert n == 20 and groups.value <= stripes * (stripes + 1) // 2 < n * (n + 1) // 2


@pytest.mark.parametrize("name, recommend", [("peer", S.recommend_peers), ("potential_collaborator", S.recommend_collaborators), ("potential_competitor", S.recommend_competitors)])
def test_rows_for_a_list_give_the_same_list(name, recommend):
    """Of many tiles' rows with many ties: the first k by the index are among those that stay."""
    r = np.random.default_rng(5)
    best, every = S._Best((name,), 3, most=200), []
    for tile in range(12):
        n = 120
        coarse = lambda low=0: r.integers(low, 10, n) / 9  # noqa: E731, B023
        rows = pd.DataFrame({
            "focus_id": r.integers(0, 6, n), "candidate_id": 1000 * tile + np.arange(n), "topic_overlap": coarse(), "recent_overlap": coarse(), "temporal": coarse(), "direct_count": r.integers(0, 3, n), "shared_collaborators": r.integers(0, 4, n),
            "method_similarity": coarse(), "problem_similarity": coarse(), "complementarity": coarse(), "has_institution": r.random(n) < 0.5, "graph_ready": r.random(n) < 0.8, "points": np.nan,
        })
        every.append(rows)
        assert best(rows) is None
    stayed, whole = best(None), pd.concat(every, ignore_index=True)

    def first(rows):
        own = rows[S._eligible(rows, name)]
        index = np.floor(np.round(S._score(own, name), 9) * 10 + 0.5)
        ordered = own.assign(index=index).sort_values(["focus_id", "index", "candidate_id"], ascending=[True, False, True])
        return ordered.groupby("focus_id").head(3)[["focus_id", "candidate_id", "index"]].values.tolist()

    assert first(stayed) == first(whole) and len(stayed) < len(whole) / 10


def test_lists_from_the_rows_made_for_them(spark):
    w, a, t, scholars = corpus(spark)
    values = lambda v: spark.createDataFrame([(s, v) for s in (1, 2, 3)], "scholar_id long, value string")
    links = spark.createDataFrame([(1, 9, 1), (2, 9, 2), (1, 2, 1), (2, 1, 1)], "scholar_id long, other_id long, direct_count long")
    of = lambda **more: S.pair_features(w, a, t, scholars, scholars, values("method"), values("m"), values("p"), links, **more)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(S.recommend_peers(of(best=("peer",)))) == rows(S.recommend_peers(of())) != []
    points = spark.createDataFrame([(2, 0.5), (3, 0.5), (4, 0.5)], "scholar_id long, points double")
    assert {(r.focus_id, r.candidate_id) for r in of(best=("reference",), points=points).collect()} == {(1, 2), (3, 2)}
    everyone = {(r.focus_id, r.candidate_id) for r in of(least_overlap=0.0, least_recent=0.0).collect()}
    assert everyone == {(x, y) for x in (1, 2, 3, 4) for y in (1, 2, 3, 4) if x != y}  # who shares one topic of many, too; 5 shares none
