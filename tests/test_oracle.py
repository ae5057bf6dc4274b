"""Every registered bibliographic query against its oracle at the smallest scale."""

from pathlib import Path

import pytest

from folioscope import registry
from tests.oracle_check import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    assert_same(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
