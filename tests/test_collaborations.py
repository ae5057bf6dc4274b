"""Lists that rest on collaborations count those of all works, however many authors a work has."""

import random
from collections import Counter
from pathlib import Path

import pytest

from folioscope import registry
from folioscope.plans.fixtures import view
from tests.oracle_check import TABLES, assert_same

SF = Path("/root/testdata/sf0.001")
#: Titles of different categories.
PARTS = [("ECONOMY", "old ring"), ("LARGE", "hot bolt"), ("PROMO", "red anvil"), ("STANDARD", "blue plate")]


@pytest.fixture(scope="module")
def works_of_three(spark, tmp_path_factory):
    """Works of three authors each, so that nobody wrote anything with one other alone."""
    r, at = random.Random(4), tmp_path_factory.mktemp("three")
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("supplier", "part", "orders", "lineitem")}
    make = lambda t, made: spark.createDataFrame([tuple(row.get(c) for c in rows[t].columns) for row in made], rows[t].schema)
    first = {t: df.first().asDict() for t, df in rows.items()}
    orders, lines = rows["orders"].limit(60).collect(), []
    for n, o in enumerate(orders):
        for k, (s, p) in enumerate(zip(r.sample(range(1, 31), 3), r.sample(range(4), 3))):
            lines.append(first["lineitem"] | {"l_orderkey": o.o_orderkey, "l_linenumber": k + 1, "l_suppkey": s, "l_partkey": p + 1})
    made = {
        "supplier": make("supplier", [first["supplier"] | {"s_suppkey": s, "s_nationkey": s % 5} for s in range(1, 31)]),
        "part": make("part", [first["part"] | {"p_partkey": k + 1, "p_type": kind, "p_name": name} for k, (kind, name) in enumerate(PARTS)]),
        "orders": make("orders", [o.asDict() for o in orders]), "lineitem": make("lineitem", lines),
    }
    for t in TABLES:
        (made[t] if t in made else spark.read.parquet(f"{SF}/{t}.parquet")).coalesce(1).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", ["H10_recommend_collaborators", "H11_recommend_competitors", "H13_merge_recommendations", "H14_explain_recommendations"])
def test_collaborations_of_all_works_count(spark, works_of_three, name):
    run = registry.queries()[name]
    a = view(spark, works_of_three, "authorships").select("work_id", "scholar_id")
    joint = Counter((x.focus_id, x.candidate_id) for x in a.withColumnRenamed("scholar_id", "focus_id").join(a.withColumnRenamed("scholar_id", "candidate_id"), "work_id").collect())
    assert max(n for (x, y), n in joint.items() if x != y) > 1
    found = [r for r in run(spark, works_of_three).collect() if "potential" in r.asDict().get("categories", r.asDict().get("category", name.replace("recommend", "potential")))]
    assert found and max(joint[r.focus_id, r.candidate_id] for r in found) == 1  # those with more are known to each other
    assert_same(spark, works_of_three, run, registry.oracle_sql()[name])
