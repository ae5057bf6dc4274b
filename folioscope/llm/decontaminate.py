"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification.

Every window of a document that is as long as a benchmark item, and shares at least one shingle with an item of that length (a window
without one can't be similar to any), gets a 64-bit SimHash of its shingles. Fingerprints are cut into radius + 1 blocks: of two within the radius at
least one block is equal, so looking each block up finds all of them. Candidates within the radius are verified by the exact
weighted Jaccard similarity of the two multisets of shingles.

Items are a query set held against all documents: they are broadcast in slices of a bounded size, one pass
over the documents each, so a benchmark of any size works.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest
from .shingles import mix, rolling
from .wordhash import hashed_words

SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double"
#: Bytes of items in one broadcast slice (an index takes some 40 times as much).
SLICE_BYTES = 4_000_000
BITS = 64


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 numbers +1 or -1 per shingle."""
    bits = np.unpackbits(np.ascontiguousarray(mix(shingles + np.uint64(99))).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1)).view(np.uint64).ravel()


def simhash(shingles: np.ndarray) -> np.uint64:
    return _packed(_signs(shingles).sum(axis=0, keepdims=True))[0]


def simhash_windows(shingles: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of each run of ``size`` shingles."""
    sums = np.cumsum(np.concatenate([np.zeros((1, BITS), np.int32), _signs(shingles)]), axis=0, dtype=np.int32)
    return _packed(sums[size:] - sums[:-size])


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[k]) for k, n in a.items())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


class Index:
    """Benchmark items by length, their fingerprints by block."""

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int, percent: int, radius: int):
        self.width, self.percent, self.radius = width, percent, radius
        self.ids = [i for i, _ in items]
        sets = [rolling(w, width) for _, w in items]
        self.counts = [Counter(s.tolist()) for s in sets]
        self.known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:])]
        self.prints = np.array([simhash(s) for s in sets], np.uint64)
        sizes = np.array([len(s) for s in sets], np.int64)
        # the sizes of the items that have a shingle: a window can only be similar to an item with which it shares one
        self.sizes_of: dict[int, set[int]] = {}
        for s in sets:
            for k in s.tolist():
                self.sizes_of.setdefault(k, set()).add(len(s))
        # per size in shingles: its items, and per block the items in order of their block
        self.by_size = {}
        for size in np.unique(sizes).tolist():
            own = np.nonzero(sizes == size)[0]
            tables = []
            for shift, mask in self.blocks:
                block = (self.prints[own] >> shift) & mask
                order = np.argsort(block, kind="stable")
                tables.append((block[order], own[order]))
            self.by_size[size] = tables

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        maybe = np.nonzero(self.filter[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
        if not len(maybe) or not len(self.known):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == shingles[maybe]]

    def near(self, prints: np.ndarray, tables: list) -> list[tuple[int, int]]:
        """All pairs (window, item) within the radius."""
        found = set()
        for (shift, mask), (blocks, owners) in zip(self.blocks, tables):
            own = (prints >> shift) & mask
            low, high = np.searchsorted(blocks, own, "left"), np.searchsorted(blocks, own, "right")
            window = np.repeat(np.arange(len(prints)), high - low)
            place = np.arange(len(window)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            item = owners[place]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.update(zip(window[close].tolist(), item[close].tolist()))
        return sorted(found)

    def matches(self, shingles: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, start word, words, similarity): the best window for each similar item, the first of equals."""
        best: dict[int, tuple[float, int, int]] = {}
        n = len(shingles)
        hits_of: dict[int, list[int]] = {}
        for place, shingle in zip(hits.tolist(), shingles[hits].tolist()):
            for size in self.sizes_of[shingle]:
                hits_of.setdefault(size, []).append(place)
        for size, places in sorted(hits_of.items()):
            tables, hits, own = self.by_size[size], np.array(places), min(size, n)
            if 100 * own < self.percent * size:
                continue
            # windows that hold a hit, in runs that do not touch
            starts = np.zeros(n - own + 2, np.int32)
            np.add.at(starts, np.maximum(hits - own + 1, 0), 1)
            np.add.at(starts, np.minimum(hits, n - own) + 1, -1)
            windows = np.nonzero(np.cumsum(starts[:-1]) > 0)[0]
            for run in np.split(windows, np.nonzero(np.diff(windows) > 1)[0] + 1):
                if not len(run):
                    continue
                prints = simhash_windows(shingles[run[0] : run[-1] + own], own)
                for w, item in self.near(prints, tables):
                    start = int(run[0]) + w
                    similarity = weighted_jaccard(Counter(shingles[start : start + own].tolist()), self.counts[item])
                    if similarity * 100 >= self.percent - 1e-9 and (item not in best or (-similarity, start) < (-best[item][0], best[item][1])):
                        best[item] = (similarity, start, own + self.width - 1)
        return [(self.ids[i], start, words, s) for i, (s, start, words) in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, radius: int = 20) -> DataFrame:
    """One row per document and benchmark item with a similar window: the best one, where it starts, its words, their similarity.

    docs: (doc_id, text), items: (item_id, text); words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. A document shorter than an
    item is one window. Items of fewer than ``width`` words and null or empty texts match nothing; repeated rows give repeated
    results; an empty table gives none. Other columns are ignored.
    """
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // SLICE_BYTES))
    spark = docs.sparkSession
    modest(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(part: int) -> DataFrame:
        table = known.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == part).toArrow()
        values, offsets = hashed_words(table.column(1))
        pairs = [(i, values[a:b]) for i, a, b in zip(table.column(0).to_pylist(), offsets[:-1], offsets[1:]) if b - a >= width]
        shared = spark.sparkContext.broadcast(Index(pairs, width, percent, radius))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                values, offsets = hashed_words(batch.column(1))
                if batch.num_rows == 0:
                    continue
                every = rolling(values[offsets[0] : offsets[-1]], width)
                hits = index.hits(every) + offsets[0]
                out = []
                # a window of words across two texts is none of either
                rows_hit = np.searchsorted(offsets, hits, "right") - 1
                inside = hits + width <= offsets[rows_hit + 1]
                for i in np.unique(rows_hit[inside]).tolist():
                    own = hits[inside & (rows_hit == i)] - offsets[i]
                    shingles = every[offsets[i] - offsets[0] : offsets[i + 1] - width + 1 - offsets[0]]
                    doc_id = batch.column(0)[i].as_py()
                    out += [(doc_id, *m) for m in index.matches(shingles, own)]
                if out:
                    yield pa.RecordBatch.from_pydict(
                        dict(zip(["doc_id", "item_id", "start_word", "n_words", "similarity"], zip(*out))),
                        pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "start_word", "n_words")] + [("similarity", pa.float64())]),
                    )

        return rows.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, [one(k) for k in range(slices)])
