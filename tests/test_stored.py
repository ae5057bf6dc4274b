"""Tables changed in place: what a change touches, what it leaves, and that it may be run again."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from folioscope.sources import stored


def files(path):
    """Every data file with the time of its last change, by folder."""
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(os.path.basename(folder), {})[n] = os.stat(f"{folder}/{n}").st_mtime_ns
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def table(spark, tmp_path):
    data = spark.createDataFrame([(k, f"t{k}", 0) for k in range(200)], "id long, title string, n int")
    return stored.Bucketed(spark, f"{tmp_path}/t", ["id"], 16).create(data)


def latest(current, batch):
    x = current.alias("c").join(batch.alias("b"), F.col("c.id") == F.col("b.id"), "full_outer")
    return x.select(F.coalesce("b.id", "c.id").alias("id"), F.coalesce("b.title", "c.title").alias("title"), F.greatest(F.coalesce("c.n", F.lit(0)), F.coalesce("b.n", F.lit(0))).alias("n"))


def test_upsert_touches_its_buckets_only_and_may_be_run_again(spark, table):
    batch = spark.createDataFrame([(3, "new", 5), (500, "added", 1)], "id long, title string, n int")
    before = files(table.path)
    touched = table.upsert(batch, latest)
    want = sorted([(k, "new" if k == 3 else f"t{k}", 5 if k == 3 else 0) for k in range(200)] + [(500, "added", 1)])
    assert rows(table.read()) == want and 1 <= len(touched) <= 2
    after = files(table.path)
    assert all(after[b] == before[b] for b in before if b not in {f"bucket={t}" for t in touched})
    assert table.upsert(batch, latest) == touched and rows(table.read()) == want
    assert table.upsert(batch.limit(0), latest) == [] and rows(table.read()) == want


def test_replace_removes_what_the_batch_lacks(spark, table):
    keys = spark.createDataFrame([(k,) for k in range(0, 40)], "id long")
    batch = spark.createDataFrame([(5, "x", 1), (900, "not asked for", 1)], "id long, title string, n int")
    table.replace(keys, batch)
    assert rows(table.read()) == [(5, "x", 1)] + [(k, f"t{k}", 0) for k in range(40, 200)]
    table.replace(spark.createDataFrame([(k,) for k in range(200)], "id long"), batch.limit(0))  # whole buckets become empty
    assert not files(table.path)


def test_refresh_computes_the_changed_only(spark, table):
    seen = []

    def compute(keys):
        seen.extend(r.id for r in keys.collect())
        return keys.select("id", F.lit("again").alias("title"), F.lit(7).alias("n"))

    before = files(table.path)
    touched = stored.refresh(table, spark.createDataFrame([(9,), (9,), (11,)], "id long"), compute)
    assert sorted(seen) == [9, 11]
    assert {r.id for r in table.read().filter("n = 7").collect()} == {9, 11} and table.read().count() == 200
    after = files(table.path)
    assert sum(after[b] != before[b] for b in before) == len(touched) <= 2


@pytest.fixture()
def dated(spark, tmp_path):
    data = spark.createDataFrame([(k % 3, k, date(2020, 1 + k % 12, 1 + k % 28)) for k in range(240)] + [(1, 999, None)], "scholar_id long, work_id long, day date")
    return stored.ByPeriod(spark, f"{tmp_path}/d", "day", "month").create(data)


def test_slices_read_the_periods_that_they_need(spark, dated):
    since = spark.createDataFrame([(0, date(2020, 11, 10)), (1, date(2020, 10, 5))], "scholar_id long, since date")
    sliced = dated.read_since(since, "scholar_id", F.lit("2020-12-31"))
    want = sorted((r.scholar_id, r.work_id) for r in dated.read().collect() if r.day and r.scholar_id in (0, 1) and r.day >= (date(2020, 11, 10), date(2020, 10, 5))[r.scholar_id])
    assert sorted((r.scholar_id, r.work_id) for r in sliced.collect()) == want and want
    assert "dynamicpruning" in sliced._jdf.queryExecution().optimizedPlan().toString().lower() or "dynamicpruning" in sliced._jdf.queryExecution().executedPlan().toString().lower()
    spark.sql("set spark.sql.adaptive.enabled=false")
    try:
        plain = dated.read_since(since, "scholar_id", F.lit("2020-12-31"))
        plain.collect()
        scan = []

        def walk(node):
            if "FileScan" in node.nodeName() or "Scan parquet" in node.nodeName():
                found = node.metrics().get("numPartitions")
                if found.isDefined():
                    scan.append(found.get().value())
            for k in range(node.children().size()):
                walk(node.children().apply(k))

        walk(plain._jdf.queryExecution().executedPlan())
        assert 3 in scan  # October to December, of twelve months and the rows without a date
    finally:
        spark.sql("set spark.sql.adaptive.enabled=true")


def test_old_periods_are_dropped_as_folders(spark, tmp_path):
    data = spark.createDataFrame([(k, datetime(2024, 1, 1 + k // 24, k % 24)) for k in range(240)], "id long, at timestamp")
    table = stored.ByPeriod(spark, f"{tmp_path}/e", "at").create(data)
    before = files(table.path)
    assert table.drop_before("2024-01-04 06:00:00") == ["2024-01-01", "2024-01-02", "2024-01-03"]
    after = files(table.path)
    assert sorted(after) == [f"period=2024-01-{d:02}" for d in range(4, 11)]
    assert all(after[p] == before[p] for p in after if p != "period=2024-01-04")
    assert sorted(r.id for r in table.read().collect()) == list(range(78, 240))
    assert table.drop_before("2024-01-04 06:00:00") == []
    assert table.read().count() == 162
