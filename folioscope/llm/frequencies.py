"""How many documents have each shingle of a document: asked and answered in blocks of packed keys.

A chunk row holds some million shingles of whole documents: the distinct shingles of the chunk once, ascending, and each document's places in them. It
asks every bucket (a range of the leading ``BITS`` of a shingle) about its own part and gets back one byte a shingle, so a hot shingle is
one entry per chunk. There are never more messages than distinct shingles of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import from_steps, pack, steps, unpack
from .shingles import mix, needed, rolling, shingle_set
from .wordhash import hashed_words

CHUNK_KEYS = 1_000_000
BUCKET_KEYS = 1_000_000
#: Frequencies are told by the leading bits of a shingle; two shingles that agree in them count as one, which never hides a frequent one.
BITS = 48

CHUNK = "chunk long, n_keys long, ids binary, n binary, k1 binary, k2 binary, at binary, keys binary, counts binary"


def shingles_of(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a batch of documents, repeats too, and how many each document has."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1)).astype(np.int64)
    starts = np.cumsum(counts) - counts
    at = np.repeat(offsets[:-1] - starts, counts) + np.arange(int(counts.sum()))
    rolled = rolling(values, width)
    keys = rolled[np.minimum(at, len(rolled) - 1)] if len(rolled) else np.zeros(len(at), np.uint64)
    for i in np.nonzero((lengths > 0) & (lengths < width))[0]:
        keys[starts[i]] = shingle_set(values[offsets[i] : offsets[i + 1]], width)[0]
    return keys, counts


def _sums(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums per owner (ascending) in unsigned arithmetic."""
    out = np.zeros(n, np.uint64)
    if len(x):
        first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
        out[owner[first]] = np.add.reduceat(x, first)
    return out


def names_of(s: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the shingle set of each owner."""
    sizes = np.bincount(owner, minlength=n).astype(np.uint64)
    return _sums(mix(s + np.uint64(1)), owner, n).view(np.int64), (_sums(mix(s ^ np.uint64(0x5555555555555555)), owner, n) + sizes).view(np.int64)


def chunks_of(docs: DataFrame, width: int) -> DataFrame:
    """Chunk rows of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 24
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def out() -> pa.RecordBatch:
            nonlocal serial, held, total
            ids, counts, keys = (np.concatenate([h[k] for h in held]) for k in range(3))
            full, place = np.unique(keys, return_inverse=True)
            code = np.unique(np.repeat(np.arange(len(ids)), counts) << 32 | place)
            owner, place = code >> 32, code & 0xFFFFFFFF
            n = np.bincount(owner, minlength=len(ids))
            k1, k2 = names_of(full[place], owner, len(ids))
            short = full >> np.uint64(64 - BITS)
            new = np.concatenate([[True], short[1:] != short[:-1]]) if len(short) else np.zeros(0, bool)
            at = (np.cumsum(new) - 1)[place]
            _, one = np.unique(np.stack([k1, k2]), axis=1, return_index=True)
            alone = np.zeros(len(ids), bool)
            alone[one] = True
            times = np.bincount(at[alone[owner]], minlength=int(new.sum()))
            row = [pack(ids), pack(n.astype(np.int32)), pack(k1), pack(k2), pack(at.astype(np.int32)), steps(short[new]), pack(times.astype(np.int32))]
            numbers = [serial, int(new.sum())]
            serial, held, total = serial + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in numbers] + [pa.array([c], pa.binary()) for c in row], names=[f.split()[0] for f in CHUNK.split(", ")])

        for batch in batches:
            values, offsets = hashed_words(batch.column(1))
            keys, counts = shingles_of(values, offsets, width)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), counts, keys))
            total += len(keys)
            if total >= CHUNK_KEYS:
                yield out()
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)


def members_of(chunks: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2): the size of each document's shingle set and 128 bits that name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = [unpack(row["ids"], np.int64), unpack(row["n"], np.int32), unpack(row["k1"], np.int64), unpack(row["k2"], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], names=["doc_id", "n", "k1", "k2"])

    return chunks.select("ids", "n", "k1", "k2").mapInArrow(run, "doc_id long, n int, k1 long, k2 long")


def code_of(times: np.ndarray) -> np.ndarray:
    """A frequency in a byte, in steps of a sixteenth of a power of two; 0: one document."""
    return np.minimum(np.round(16 * np.log2(np.maximum(times, 1))), 255).astype(np.uint8)


def _answers(chunks: DataFrame) -> DataFrame:
    total = chunks.agg(F.sum("n_keys")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_KEYS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = np.array([(b << BITS) // buckets for b in range(1, buckets)], np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                keys, times = from_steps(row["keys"]), unpack(row["counts"], np.int32)
                edges = [0, *np.searchsorted(keys, inner).tolist(), len(keys)]
                rows = [(b, row["chunk"], steps(keys[e:f]), pack(times[e:f])) for b, (e, f) in enumerate(zip(edges[:-1], edges[1:])) if f > e]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(["bucket", "chunk", "keys", "counts"], zip(*rows))), pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        parts = [from_steps(k) for k in asked["keys"]]
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        code = code_of(np.bincount(at, weights=np.concatenate([unpack(c, np.int32) for c in asked["counts"]])))
        each = np.split(code[at], np.cumsum([len(p) for p in parts])[:-1])
        return pd.DataFrame({"chunk": asked["chunk"], "bucket": asked["bucket"], "codes": [pack(c) for c in each]})

    asked = chunks.select("chunk", "keys", "counts").mapInArrow(ask, "bucket int, chunk long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInPandas(answer, "chunk long, bucket int, codes binary")


def shared_sets(chunks: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, codes): the documents of which at least as many shingles occur elsewhere as a similar set must share.

    ``codes`` are the frequencies (``code_of``) of the document's shingles in ascending order. What has fewer such shingles has no partner; equal sets in one
    chunk count once, so copies in several chunks may be among the rows.
    """

    def hit(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for row in rows.itertuples():
            if not len(replies):
                continue
            codes = np.concatenate([unpack(c, np.uint8) for c in replies.sort_values("bucket")["codes"]])
            n = unpack(row.n, np.int32).astype(np.int64)
            own = codes[unpack(row.at, np.int32)]
            ends = np.cumsum(n)
            known = np.concatenate([[0], np.cumsum(own > 0)])
            good = np.nonzero((n > 0) & (known[ends] - known[ends - n] >= needed(n, percent)))[0]
            if len(good):
                ids, k1, k2 = (unpack(x, np.int64) for x in (row.ids, row.k1, row.k2))
                out += [(ids[i], n[i], k1[i], k2[i], own[ends[i] - n[i] : ends[i]].tobytes()) for i in good]
        return pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2", "codes"])

    left = chunks.select("chunk", "ids", "n", "k1", "k2", "at").groupBy("chunk")
    return left.cogroup(_answers(chunks).groupBy("chunk")).applyInPandas(hit, "doc_id long, n int, k1 long, k2 long, codes binary")
