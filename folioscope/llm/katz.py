"""LM scoring: a Katz backoff bigram model with Good-Turing discounts, over all documents.

P(w|h) = d(c(h,w)) c(h,w) / c(h) for a seen pair, else alpha(h) P(w); P(w) = d(c(w)) c(w) / N for a known word, and what
the discounts leave goes to the one class of unknown words. alpha(h) is what the seen pairs of h leave, divided by exactly 1 - sum P(w) over them.

Counting and looking up are one exchange in blocks. A chunk (some million tokens of whole documents, written once as packed
numbers) sends every bucket its distinct words with their training counts and gets back each word's number and total count; then
the same with its distinct word pairs, of which the bucket that holds a history also returns how much that history leaves. So
every distinct word or pair is one entry per chunk, however frequent; pairs of a very frequent history are dealt to several buckets by their
second word, and the parts of such histories (a bounded number) are added up. Nothing but these and the counts of counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest, scratch
from .shingles import mix
from .wordhash import hashed_words

#: Counts up to this are discounted.
DISCOUNTED = 5
CHUNK_TOKENS = 1_000_000
BUCKET_KEYS = 1_500_000
#: Most histories that are dealt to several buckets.
MANY_HISTORIES = 50_000
END = np.uint64(0x9E3779B97F4A7C15)


def pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), 1) if len(a) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(a: np.ndarray) -> bytes:
    return pack(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


@dataclass
class Discounts:
    """d(r) for r = 0..DISCOUNTED; greater counts keep their full weight."""

    d: np.ndarray

    @staticmethod
    def good_turing(counts: list[int]) -> Discounts:
        """counts[r]: how many types have count r, r = 0..DISCOUNTED + 1."""
        for k in range(DISCOUNTED, 0, -1):
            n = np.array(counts[: k + 2], np.float64)
            if (n[1:] <= 0).any():
                continue
            beyond = (k + 1) * n[k + 1] / n[1]
            r = np.arange(1, k + 1)
            d = ((r + 1) * n[2:] / n[1:-1] / r - beyond) / (1 - beyond) if beyond < 1 else np.zeros(k)
            if ((d > 0) & (d <= 1)).all() and d.min() < 1:
                return Discounts(np.concatenate([[1.0], d, np.ones(DISCOUNTED - k)]))
        return Discounts(np.array([1.0, 0.5] + [1 - 0.5 / r for r in range(2, DISCOUNTED + 1)]))  # too few counts: half a count each

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > DISCOUNTED, 1.0, self.d[np.minimum(c, DISCOUNTED)])


@dataclass
class Unigrams:
    total: int
    types: int
    discounts: Discounts
    unknown: float  # probability of the class of unknown words

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts.of(c) * c / max(self.total, 1), self.unknown)


CHUNK = "chunk long, n_tokens long, n_words long, ids binary, missing binary, held binary, lengths binary, at binary, words binary, counts binary"


def _chunks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows of some million tokens: documents as indices into the chunk's distinct words (hashes, ascending), and these words' training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 24
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        tokens = 0

        def out() -> pa.RecordBatch:
            nonlocal serial, held, tokens
            ids, missing, is_held, lengths, words = (np.concatenate([h[k] for h in held]) for k in range(5))
            vocabulary, at = np.unique(words, return_inverse=True)
            counts = np.bincount(at, weights=np.repeat(~is_held, lengths), minlength=len(vocabulary)).astype(np.int64)
            row = [pack(ids), pack(missing), pack(is_held), pack(lengths), pack(at.astype(np.int32)), _steps(vocabulary), pack(counts.astype(np.int32))]
            numbers = [serial, len(words), len(vocabulary)]
            serial, held, tokens = serial + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in numbers] + [pa.array([c], pa.binary()) for c in row], names=names)

        names = [f.split()[0] for f in CHUNK.split(", ")]
        for batch in batches:
            values, offsets = hashed_words(batch.column(2))
            lengths = np.diff(offsets).astype(np.int64) + 1
            edges = np.concatenate([[0], np.cumsum(lengths)])
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            is_held = batch.column(1).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:  # as many documents as the chunk has room for, one at least
                stop = max(start + 1, int(np.searchsorted(edges, edges[start] + CHUNK_TOKENS - tokens, "right")) - 1)
                own = slice(start, stop)
                words = np.full(int(edges[stop] - edges[start]), END)
                inner = np.ones(len(words), bool)
                inner[edges[start + 1 : stop + 1] - edges[start] - 1] = False
                words[inner] = values[offsets[start] : offsets[stop]]
                held.append((ids[own], missing[own], is_held[own], lengths[own].astype(np.int32), words))
                tokens += len(words)
                start = stop
                if tokens >= CHUNK_TOKENS * 0.9:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNK)


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by bucket, and where each bucket's part starts."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


REPLY = "chunk long, bucket int, a binary, b binary, c binary, stats array<long>"


def _word_numbers(chunks: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket: the number and the training count of each of its words there; and the bucket's statistics (chunk -1)."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, words, counts in zip(frame["chunk"], frame["words"], frame["counts"]):
                words, counts = _from_steps(words), unpack(counts, np.int32)
                order, edges = _dealt((mix(words) % np.uint64(buckets)).astype(np.int32), buckets)
                rows = [(b, chunk, _steps(words[order[e:f]]), pack(counts[order[e:f]])) for b, (e, f) in enumerate(zip(edges[:-1], edges[1:])) if f > e]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "words", "counts"])

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        parts = [_from_steps(w) for w in asked["words"]]
        words, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpack(c, np.int32) for c in asked["counts"]]), minlength=len(words)).astype(np.int64)
        each = np.split(at, np.cumsum([len(p) for p in parts])[:-1])
        bucket = int(asked["bucket"].iloc[0])
        rows = [(c, bucket, _steps(i), pack(total[i]), None, None) for c, i in zip(asked["chunk"], each)]
        few = np.bincount(total[total <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
        rows.append((-1, bucket, None, None, None, [int(total.sum()), int((total > 0).sum()), *few.tolist()]))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "a", "b", "c", "stats"])

    asked = chunks.select("chunk", "words", "counts").mapInPandas(ask, "bucket int, chunk long, words binary, counts binary")
    return asked.groupBy("bucket").applyInPandas(answer, REPLY)


class _Chunk:
    """A chunk with the numbers and counts of its words, and its distinct pairs in the order in which they are dealt to buckets."""

    def __init__(self, row, replies: pd.DataFrame, word_buckets: int, pair_buckets: int, often: int):
        self.ids, self.missing = unpack(row["ids"], np.int64), unpack(row["missing"], bool)
        self.held, self.lengths = unpack(row["held"], bool), unpack(row["lengths"], np.int32)
        self.at = unpack(row["at"], np.int32)
        words = _from_steps(row["words"])
        order, _ = _dealt((mix(words) % np.uint64(word_buckets)).astype(np.int32), word_buckets)
        replies = replies.sort_values("bucket")
        self.number, self.count = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        self.number[order] = np.concatenate([_from_steps(a) * np.uint64(word_buckets) + np.uint64(b) for a, b in zip(replies["a"], replies["bucket"])])
        self.count[order] = np.concatenate([unpack(b, np.int64) for b in replies["b"]])
        end = int(np.searchsorted(words, END))
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        before = np.empty_like(self.at)
        before[1:] = self.at[:-1]
        before[starts] = end  # a document begins behind an end
        pairs, self.pair_at = np.unique(before.astype(np.int64) * len(words) + self.at, return_inverse=True)
        h, w = pairs // len(words), pairs % len(words)
        salts = 1 + self.count[h] // often
        bucket = mix(self.number[h] * np.uint64(1_000_003) + mix(self.number[w]) % salts.astype(np.uint64)) % np.uint64(pair_buckets)
        order = np.lexsort((self.number[w], self.number[h], bucket))
        self.h, self.w = h[order], w[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.edges = np.searchsorted(bucket[order], np.arange(pair_buckets + 1))

    def training_pairs(self) -> np.ndarray:
        learned = np.repeat(~self.held, self.lengths)
        return np.bincount(self.place[self.pair_at], weights=learned, minlength=len(self.h)).astype(np.int32)


def _pair_counts(chunks: DataFrame, numbers: DataFrame, unigrams: Unigrams, word_buckets: int, pair_buckets: int, often: int) -> DataFrame:
    """Per chunk and bucket: the count of each of its pairs there, and per history how many of its pairs have each small count and
    1 - the sum of P(w) over its pairs. Parts of frequent histories have chunk -2, statistics chunk -1."""

    def ask(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in frame.iterrows():
            c = _Chunk(row, replies, word_buckets, pair_buckets, often)
            counts = c.training_pairs()
            for b, (e, f) in enumerate(zip(c.edges[:-1], c.edges[1:])):
                if f > e:
                    h, w = c.h[e:f], c.w[e:f]
                    rows.append((b, row["chunk"], _steps(c.number[h]), pack(c.number[w].astype(np.uint64)), pack(c.count[w]), pack(counts[e:f]), pack(c.count[h] >= often)))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "h", "w", "of_w", "counts", "often"])

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        parts = [_from_steps(h) for h in asked["h"]]
        h = np.concatenate(parts)
        w = np.concatenate([unpack(x, np.uint64) for x in asked["w"]])
        if len(h) and max(h.max(), w.max()) < 1 << 32:
            order = np.argsort((h << np.uint64(32)) | w, kind="stable")
        else:
            order = np.lexsort((w, h))
        h, w = h[order], w[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        pair = np.cumsum(new) - 1
        at = np.empty(len(order), np.int64)
        at[order] = pair
        total = np.bincount(at, weights=np.concatenate([unpack(x, np.int32) for x in asked["counts"]])).astype(np.int64)
        of_w = np.concatenate([unpack(x, np.int64) for x in asked["of_w"]])[order][new]
        many = np.concatenate([unpack(x, bool) for x in asked["often"]])[order][new]
        h = h[new]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        history = np.cumsum(first) - 1
        n = int(history[-1]) + 1
        seen = total > 0
        left = 1.0 - np.bincount(history, weights=np.where(seen, unigrams.p(of_w), 0.0), minlength=n)
        small = np.stack([np.bincount(history[total == r], minlength=n) for r in range(1, DISCOUNTED + 1)], axis=1).astype(np.int32)
        bucket = int(asked["bucket"].iloc[0])
        rows = []
        for chunk, i in zip(asked["chunk"], np.split(at, np.cumsum([len(p) for p in parts])[:-1])):
            own = np.unique(history[i])  # ascending, as the chunk's own histories in this bucket are
            rows.append((chunk, bucket, pack(total[i].astype(np.int32)), pack(small[own]), pack(left[own]), None))
        hot = np.nonzero(many[first])[0]
        if len(hot):
            rows.append((-2, bucket, pack(h[first][hot]), pack(small[hot]), pack(left[hot]), None))
        few = np.bincount(total[total <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
        rows.append((-1, bucket, None, None, None, few.tolist()))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "a", "b", "c", "stats"])

    asked = chunks.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInPandas(ask, "bucket int, chunk long, h binary, w binary, of_w binary, counts binary, often binary")
    return asked.groupBy("bucket").applyInPandas(answer, REPLY)


def _small_rows(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4 * DISCOUNTED, -1).T).view(np.int32) if data else np.zeros((0, DISCOUNTED), np.int32)


def backoff(small: np.ndarray, left: np.ndarray, count: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """Per history its alpha and the number its pairs' counts are divided by.

    A history whose pairs leave nothing gets one more count, which is what it leaves.
    """
    r = np.arange(1, DISCOUNTED + 1)
    spared = small @ ((1 - discounts.d[1:]) * r)
    by = np.where(spared > 0, count, count + 1).astype(np.float64)
    spared = np.where(spared > 0, spared, 1.0)
    return np.where(count > 0, spared / np.maximum(by, 1) / np.maximum(left, 1e-12), 1.0), by


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, learned from those not held out.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased, and one end; a null or blank text is an end alone. Rows
    with a null doc_id are learned from and scored; repeated rows are documents of their own; an empty table gives no rows;
    other columns are ignored. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    modest(spark)
    path = scratch(spark, "chunks")
    _chunks(docs, held_out).write.parquet(path)
    chunks = spark.read.parquet(path)
    word_buckets, pair_buckets = (max(8, -(-(n or 0) // BUCKET_KEYS)) for n in chunks.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    number_path = scratch(spark, "numbers")
    _word_numbers(chunks, word_buckets).write.parquet(number_path)
    numbers = spark.read.parquet(number_path)
    stats = _sum_stats(numbers, DISCOUNTED + 4)
    total, types, counts = stats[0], stats[1], stats[2:]
    d1 = Discounts.good_turing(counts)
    known = sum((1 - d1.d[r]) * r * counts[r] for r in range(1, DISCOUNTED + 1))
    unigrams = Unigrams(total, types, d1, max(known, 0.5) / max(total, 1))
    often = max(1_000_000, -(-total // MANY_HISTORIES))
    pair_path = scratch(spark, "pairs")
    replies = numbers.filter("chunk >= 0")
    _pair_counts(chunks, replies, unigrams, word_buckets, pair_buckets, often).write.parquet(pair_path)
    pairs = spark.read.parquet(pair_path)
    d2 = Discounts.good_turing(_sum_stats(pairs, DISCOUNTED + 2))
    hot: dict[int, list] = {}
    for row in pairs.filter("chunk = -2").select("a", "b", "c").collect():  # at most MANY_HISTORIES histories and their parts
        for h, s, left in zip(unpack(row.a, np.uint64).tolist(), _small_rows(row.b), unpack(row.c, np.float64)):
            so_far = hot.setdefault(h, [np.zeros(DISCOUNTED, np.int64), 1.0])
            so_far[0], so_far[1] = so_far[0] + s, so_far[1] - (1.0 - left)

    def final(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in frame.iterrows():
            words, mine = answers[answers["kind"] == 1], answers[answers["kind"] == 2].sort_values("bucket")
            c = _Chunk(row, words, word_buckets, pair_buckets, often)
            pair_count = np.concatenate([unpack(a, np.int32) for a in mine["a"]]).astype(np.int64)
            # histories of each bucket in the order of their first pairs
            per_bucket = np.repeat(np.arange(pair_buckets), np.diff(c.edges))
            first = np.concatenate([[True], (c.h[1:] != c.h[:-1]) | (per_bucket[1:] != per_bucket[:-1])])
            small = np.concatenate([_small_rows(b) for b in mine["b"]]).astype(np.int64)
            left = np.concatenate([unpack(x, np.float64) for x in mine["c"]])
            heads = c.h[first]
            for k in np.nonzero(c.count[heads] >= often)[0]:
                small[k], left[k] = hot[int(c.number[heads[k]])]
            alpha, by = backoff(small, left, c.count[heads], d2)
            of = np.cumsum(first) - 1
            p = unigrams.p(c.count[c.w])
            seen = pair_count > 0
            p = np.where(seen, d2.of(pair_count) * pair_count / by[of], alpha[of] * p)
            logs = np.log10(p)[c.place[c.pair_at]]
            n = c.count[c.at]
            base = np.log10((n + 0.1) / (total + 0.1 * (types + 1)))
            starts = np.concatenate([[0], np.cumsum(c.lengths)[:-1]])
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(c.ids, "Int64"),
                        "held_out": c.held,
                        "n_tokens": c.lengths.astype(np.int64),
                        "n_known": np.add.reduceat((n > 0).astype(np.int64), starts),
                        "train_tokens": total,
                        "base_score": np.add.reduceat(base, starts),
                        "score": np.add.reduceat(logs, starts),
                    }
                )
            )
            out[-1].loc[c.missing, "doc_id"] = pd.NA
        return pd.concat(out)

    answers = replies.withColumn("kind", F.lit(1)).unionByName(pairs.filter("chunk >= 0").withColumn("kind", F.lit(2))).select("chunk", "bucket", "kind", "a", "b", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(final, schema)


def _sum_stats(table: DataFrame, n: int) -> list[int]:
    sums = table.filter("chunk = -1").agg(*[F.sum(F.col("stats")[k]) for k in range(n)]).first()
    return [int(x or 0) for x in sums]
