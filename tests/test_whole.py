"""The registered queries take the whole tables; their gates are tried on a thin copy of the tables."""

from pathlib import Path

import pytest

from folioscope import registry
from folioscope.plans.fixtures import VIEWS, view
from tests.oracle_check import TABLES, assert_same

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_whole_tables(spark):
    run = lambda name: registry.queries()[name](spark, SF)
    assert run("A1_works_from_json").count() == view(spark, SF, "orders").count()
    assert run("A4_citation_edges").count() == view(spark, SF, "work_citations").distinct().count()
    assert run("E9_work_components").select("work_id").distinct().count() == view(spark, SF, "authorships").select("work_id").distinct().count()
    assert view(spark, SF, "focus").count() == view(spark, SF, "supplier").count()
    assert not [n for n, text in VIEWS.items() if n.startswith("sparse")]


@pytest.mark.skipif(not Path(LARGER).exists(), reason="needs the given tables")
def test_gates_on_a_thin_copy(spark, tmp_path):
    for t in TABLES:
        df = spark.read.parquet(f"{LARGER}/{t}.parquet")
        df = df.filter(f"{t[0]}_orderkey % 40 = 0") if t in ("orders", "lineitem") else df
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    name = "H10_recommend_collaborators"
    assert registry.queries()[name](spark, str(tmp_path)).count() > 0
    assert_same(spark, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.skipif(not Path(LARGER).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", ["H8_recommend_references", "H9_recommend_peers", "H10_recommend_collaborators", "H11_recommend_competitors", "H15_compare_scholars"])
def test_gated_lists_have_rows(spark, name):
    assert registry.queries()[name](spark, LARGER).count() > 0
