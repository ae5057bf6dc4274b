"""Tables that are kept between runs and changed in place: Parquet folders by hash bucket of a key, or by a period of time.

A change reads the touched buckets only, stages their new rows in the shared folder, and swaps them in by Spark's dynamic partition overwrite; all other
buckets keep their files. As new rows are made from the stored ones by a rule that gives the same for the same batch, a change that is run again, after a
failure too, leaves the table as it was. Periods are read by dynamic partition pruning and dropped as folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.graph import kept


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _write(rows: DataFrame, path: str, part: str) -> None:
    """One file a partition, or few; partitions that rows do not name stay."""
    rows.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


@dataclass
class Bucketed:
    """Rows by hash bucket of ``key`` in the column ``bucket``."""

    spark: SparkSession
    path: str
    key: list[str]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> Bucketed:
        _write(rows.withColumn("bucket", self._bucket()), self.path, "bucket")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def change(self, keys: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> list[int]:
        """The stored rows of all buckets in which a row of ``keys`` lies are replaced by what ``rule`` makes of them; these buckets' numbers."""
        touched = sorted(r.bucket for r in keys.select(self._bucket().alias("bucket")).distinct().collect())  # at most one row a bucket
        if not touched:
            return []
        stored = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).drop("bucket")
        new = kept(rule(stored).select(stored.columns).withColumn("bucket", self._bucket()))
        left = {r.bucket for r in new.select("bucket").distinct().collect()}
        _write(new, self.path, "bucket")
        for number in set(touched) - left:  # nothing is left of these
            files, where = _files(self.spark, f"{self.path}/bucket={number}")
            files.delete(where, True)
        return touched

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """merge(stored, batch) of the touched buckets."""
        batch = kept(batch)
        return self.change(batch, lambda stored: merge(stored, batch))

    def replace(self, keys: DataFrame, batch: DataFrame) -> list[int]:
        """The rows of these keys come from the batch only; others stay."""
        names = kept(keys.select(*self.key).distinct())
        own = batch.hint("merge").join(names, self.key, "left_semi")
        return self.change(names, lambda stored: stored.hint("merge").join(names, self.key, "left_anti").unionByName(own.select(stored.columns)))


@dataclass
class ByPeriod:
    """Rows by day or month of ``column`` in the column ``period`` (a date)."""

    spark: SparkSession
    path: str
    column: str
    unit: str = "day"

    def create(self, rows: DataFrame) -> ByPeriod:
        _write(rows.withColumn("period", F.date_trunc(self.unit, self.column).cast("date")), self.path, "period")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("period")

    def read_since(self, since: DataFrame, key: str, until: Column) -> DataFrame:
        """The rows of each key at or after its date; since: (<key>, since). Only periods that some key needs are read.

        ``until``: the last date of the table, or later. The periods (one row each) are broadcast.
        """
        first = since.agg(F.min("since").alias("since"))
        low = F.date_trunc(self.unit, "since").cast("date")
        periods = first.select(low.alias("low"), F.explode(F.sequence(low, until.cast("date"), F.expr(f"interval 1 {self.unit}"))).alias("period"))
        stored = self.spark.read.parquet(self.path)
        # Spark prunes partitions by a side that is filtered by a comparison
        rows = stored.join(F.broadcast(periods.filter("period >= low").select("period")), "period", "left_semi").drop("period")
        return rows.hint("merge").join(since, key).filter(F.col(self.column) >= F.col("since")).drop("since")

    def drop_before(self, cutoff: str) -> list[str]:
        """Drops what lies before the time ``cutoff``: whole periods as folders; of the period in which it lies the rest is written anew. The folders dropped."""
        spark = self.spark
        at = spark.range(1).select(F.lit(cutoff).cast("timestamp").alias("t")).select(F.date_trunc(self.unit, "t").cast("date").cast("string").alias("p")).first().p
        files, where = _files(spark, self.path)
        dropped = []
        for status in files.listStatus(where):
            name = status.getPath().getName()
            if name.startswith("period=") and name[7:] < at:
                files.delete(status.getPath(), True)
                dropped.append(name[7:])
        edge = spark.read.parquet(self.path).filter(F.col("period") == F.lit(at).cast("date"))
        left = kept(edge.filter(F.col(self.column) >= F.lit(cutoff).cast("timestamp")))
        if not left.isEmpty():
            _write(left, self.path, "period")
        elif not edge.isEmpty():
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/period={at}"), True)
        return sorted(dropped)


def refresh(stored: Bucketed, changed: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Results by focus: only the changed focus scholars (<key>) are computed anew and swapped in."""
    changed = kept(changed.select(*stored.key).distinct())
    return stored.replace(changed, compute(changed))
