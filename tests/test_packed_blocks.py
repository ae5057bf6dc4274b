"""What blocks hold of a member is sent in the least width that holds it, and comes back as it was."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import overlaps as O
from folioscope.operators.graph import kept


@pytest.mark.parametrize("most, width", [(255, 1), (256, 2), (65_536, 4), (1 << 33, 8)])
def test_widths(spark, most, width):
    rows = spark.createDataFrame([(1, ["a", "b"], [most, 1], "a"), (2, ["b"], [3], "b")], "id long, keys array<string>, keys_n array<long>, main string")
    blocks = O.blocked(rows.coalesce(1), {"keys": ["n"]}, [])
    found = {}
    for r in blocks.collect():
        assert len(r.keys_n) % width == 0 and len(r.keys_at) == len(r.keys_n) // (width if len(r.id) > 1 or 1 in r.id else 1)
        ends, at, weights = O._entries(r.asDict(), "keys", ["n"])
        for i, own, n in zip(r.id, np.split(at, ends[:-1]), np.split(weights["n"], ends[:-1])):
            found[i] = {r["keys"][k]: int(v) for k, v in zip(own, n)}
    assert found == {1: {"a": most, "b": 1}, 2: {"b": 3}}


def test_shuffle_files_of_a_finished_job_go(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    before = files()
    df = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert files() <= before and df.count() == 7
