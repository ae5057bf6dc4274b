"""Approximate nearest neighbours by a block matrix join.

Vectors are dealt to blocks; every block of queries meets every block of vectors in one tile, a row of the join. A
tile multiplies int8-quantised rows. With q = a*Q + e and v = b*V + f, the true product differs from a*b*(Q.V) by at most
|e||v| + |a*Q||f|, so a pair whose upper bound stays below the k-th greatest lower bound of its tile, or the k-th score so far, can't be
among the k nearest and is left out; the survivors are recomputed in double precision from the original
vectors, and each query's best of all tasks are merged by a heap. Pairs whose norms are too large for a bound are all recomputed. Nothing is lost:
the result is exact. A product may overflow to an infinity, or be no number where infinities of both signs meet; scores are ordered as SQL orders doubles, no
number above all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

FOUND = "query_id long, rank int, vec_id long, score double"


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part, one per id: of repeated ids the least vector."""
    kind = vectors.schema[vector_col].dataType
    v = F.col(f"`{vector_col}`") if kind.simpleString() == "array<float>" else F.col(f"`{vector_col}`").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter(ok)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def _blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """(dim, <name>, ids, data): vectors of one length in n blocks."""
    return (
        rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
        .groupBy("dim", name)
        .agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("v")).alias("data"))
    )


#: So many products of numbers up to 127 add up exactly in float32.
EXACT = 1024
#: Pairs with a greater product of norms have no bound.
HUGE = 1e300
#: Found rows that one merging group holds, about.
MERGED_ROWS = 200_000


def _each(n: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows (as float32, in which their products are exact), scale, |scaled row|, |rest|, |row|; norms rounded up."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    near = np.rint(x / scale[:, None]).astype(np.int8)
    scaled = near * scale[:, None]
    return near.astype(np.float32), scale, _norm(scaled), _norm(x - scaled), _norm(x)


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, rounded up; rows are scaled, so that no square overflows or vanishes."""
    most = np.abs(x).max(axis=1)
    by = np.where(most > 0, most, 1.0)
    return np.linalg.norm(x / by[:, None], axis=1) * by * (1.0 + 1e-12)


def _exact_product(q8: np.ndarray, v8: np.ndarray) -> np.ndarray:
    """All inner products of int8 rows: float32 sums of up to EXACT products of two int8 are whole numbers below 2 ** 24; more are added in double."""
    out = np.zeros((len(q8), len(v8)))
    for d in range(0, q8.shape[1], EXACT):
        out += q8[:, d : d + EXACT] @ v8[:, d : d + EXACT].T
    return out


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    out = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(q.shape[1]):
            out += q[:, d] * v[:, d]
    return out


def _top(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: greatest score first, ties to the smaller id."""
    order = np.lexsort((ids, -np.where(np.isnan(scores), np.inf, scores), ~np.isnan(scores), query))
    query, ids, scores = query[order], ids[order], scores[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], scores[kept]


def _tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray, np.ndarray], strip: int = 256):
    """The k best (row of q, id, score) of this tile and of ``best``, those of the tiles before."""
    floor = np.full(len(q), -np.inf)
    if len(best[0]):
        rows, counts = np.unique(best[0], return_counts=True)
        least = np.minimum.reduceat(np.where(np.isnan(best[2]), np.inf, best[2]), np.searchsorted(best[0], rows))
        floor[rows[counts >= k]] = least[counts >= k]
    v8, b, v_scaled, v_rest, v_norm = _quantised(v)
    found = [best]
    for at in range(0, len(q), strip):
        own, x = query_ids[at : at + strip], q[at : at + strip]
        q8, a, q_scaled, q_rest, q_norm = _quantised(x)
        with np.errstate(over="ignore", invalid="ignore"):
            product = _exact_product(q8, v8) * a[:, None] * b[None, :]
            bound = q_rest[:, None] * v_norm[None, :] + q_scaled[:, None] * v_rest[None, :] + 1e-9 * (q_scaled[:, None] * v_norm[None, :])
            # no product or partial sum of such a pair is anywhere near an overflow
            bounded = (q_norm[:, None] * v_norm[None, :] < HUGE) & np.isfinite(product) & np.isfinite(bound)
            other = own[:, None] != ids[None, :]
            lower, least = np.where(bounded & other, product - bound, -np.inf), floor[at : at + strip]
        if lower.shape[1] > k:
            least = np.maximum(least, np.partition(lower, lower.shape[1] - k, axis=1)[:, -k])
        with np.errstate(over="ignore", invalid="ignore"):
            i, j = np.nonzero(other & (~bounded | (product + bound >= least[:, None])))
        found.append((at + i, ids[j], _product(x[i], v[j])))
    return _top(*(np.concatenate(c) for c in zip(*found)), k)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 1024) -> DataFrame:
    """The k rows of greatest inner product with each query row, nearest first, ties to the smaller id.

    queries: a condition on vec_id that states the query set. Null, zero and non-finite vectors and rows with a null id take no part; a repeated
    id counts once, with its least vector; vectors meet only those of their own length. With fewer than
    k candidates all are returned; a query without candidates gives no row. Other columns are ignored.
    """
    rows = _usable(vectors, id_col, vector_col)
    count = rows.agg(F.count("*"), F.count_if(queries)).first()
    blocks, query_blocks = (max(1, -(-n // block_rows)) for n in count)
    # a task runs through the blocks of one slice for one query block, and keeps the best of all of them only
    slices = min(blocks, max(1, -(-2 * shuffle_partitions(rows.sparkSession) // query_blocks)))
    every = _blocks(rows, blocks, "block").select("dim", (F.col("block") % slices).alias("slice"), _each(query_blocks, "query_block"), "ids", "data")
    asked = _blocks(rows.filter(queries), query_blocks, "query_block")
    asked = asked.select("dim", _each(slices, "slice"), "query_block", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    tiles = asked.hint("merge").join(every, ["dim", "slice", "query_block"])
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, query_ids = None, none, none[0]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                this = tuple(batch.column(c)[r].as_py() for c in ("dim", "slice", "query_block"))
                if this != key:
                    if key is not None:
                        yield out()
                    key, best, query_ids = this, none, get("query_ids")
                q, v = (get(c).astype(np.float64).reshape(-1, key[0]) for c in ("query_data", "data"))
                best = _tile(query_ids, q, get("ids"), v, k, best)
        if key is not None:
            yield out()

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query_id, g in group.groupby("query_id", sort=True):
            numbers = g["score"].notna()
            best = heapq.nsmallest(k, zip(numbers, -g["score"].where(numbers, 0.0), g["vec_id"]))
            out += [(query_id, n, vec_id, -less if number else math.nan) for n, (number, less, vec_id) in enumerate(best, 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    parts = max(1, -(-count[1] * min(slices * k, count[0]) // MERGED_ROWS))
    groups = found.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    merged = groups.groupBy("part").applyInPandas(merge, FOUND)
    return merged.withColumn("score", F.coalesce("score", F.lit(math.nan)))  # pandas hands "no number" on as null
