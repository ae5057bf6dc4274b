"""Queries of many steps hold the shuffle files of one step at a time, not of all until their end."""

import threading
import time
from pathlib import Path

import pytest

from folioscope import registry

SF = "/root/testdata/sf0.01"


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_"))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", ["H4_quality_index", "H15_compare_topics", "E11_cluster_summary", "F27_scholar_graph_document", "F28_profile_document"])
def test_shuffle_files_at_once_are_a_part_of_all(spark, name):
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")  # as a new session has it; the query asks for more itself
    before, most, over = shuffled(spark), [0], threading.Event()

    def watch():
        while not over.is_set():
            most[0] = max(most[0], shuffled(spark) - before)
            time.sleep(0.1)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        over.set()
        watcher.join()
    assert 0 < most[0] < LEAST_BEFORE[name] * 0.9


#: Bytes of shuffle files that lay there at once when all steps were one job.
LEAST_BEFORE = {"H4_quality_index": 31_159_091, "H15_compare_topics": 26_385_677, "E11_cluster_summary": 5_947_695, "F27_scholar_graph_document": 9_071_622, "F28_profile_document": 14_152_154}
