"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows as Parquet in the shared folder and
hands the reread table to the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common, decontaminate, jaccard_join, packing, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold of their language."""
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), learned)
    return toxicity.score(docs, model).filter(~F.col("rejected")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more the one with the smallest doc_id; rows without a doc_id stay."""
    found = jaccard_join.similar_components(docs, width=5, percent=80)
    others = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("other")).distinct()
    return docs.hint("merge").join(others, docs["doc_id"] == others["other"], "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 or more words that a document of smaller doc_id has too."""
    return suffix_dedup.cut(docs, suffix_dedup.repeated_passages(docs, least=50))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window similar to a benchmark item; rows without a doc_id or with a repeated one are judged by their own text."""
    row = F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"))
    found = decontaminate.contaminated(docs.withColumn("doc_id", row), _table(spark, sf_dir, "benchmark"), width=5, percent=80)
    leaked = found.select(F.col("doc_id").alias("leaked")).distinct()
    return docs.hint("merge").join(leaked, row == leaked["leaked"], "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row per piece of a document."""
    return packing.pack(docs, end_id=2, capacity=4096)


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
