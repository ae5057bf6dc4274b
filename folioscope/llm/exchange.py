"""Which keys do others have too: asked and answered in blocks of packed keys.

A chunk is what one task read (its number is kept as a column of a written table); a bucket is a range of hashed keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack_sorted, unpack_sorted
from .shingles import mix

#: Keys that one bucket holds at most, about.
BUCKET_KEYS = 2_000_000


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (as unsigned) and offsets of a list<int64> column without nulls."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False) if len(column.values) else np.zeros(0, np.int64)
    return values.view(np.uint64), offsets


def lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def known_elsewhere(sets: DataFrame) -> DataFrame:
    """(doc_id, known): the rows of sets (chunk, doc_id, k1, s, least) with those of their keys s that other classes k1 have too.

    Rows with fewer than ``least`` such keys are left out; a class dealt to several chunks counts as several. Every chunk asks each bucket about its
    distinct keys once, however frequent they are, and gets those back that others have too; so a hot key is one entry per chunk.
    """
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_KEYS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            values, offsets = flat(batch.column(2))
            classes = np.repeat(batch.column(1).to_numpy(), np.diff(offsets))
            per_key = np.repeat(chunks, np.diff(offsets))
            own = values[offsets[0] : offsets[-1]]
            for c in np.unique(chunks):
                held.setdefault(int(c), []).append((own[per_key == c], classes[per_key == c]))
        for c, parts in held.items():
            keys, classes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.lexsort((classes, keys))
            keys, classes = keys[order], classes[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            other = np.concatenate([[False], (keys[1:] == keys[:-1]) & (classes[1:] != classes[:-1])]) if len(keys) else np.zeros(0, bool)
            shared = np.zeros(int(new.sum()), np.uint8)
            np.maximum.at(shared, np.cumsum(new)[other] - 1, 1)
            keys = keys[new]
            bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, shared = keys[order], shared[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, c, pack_sorted(keys[e:f]), shared[e:f].tobytes()) for b, (e, f) in enumerate(zip(edges[:-1], edges[1:])) if f > e]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(["bucket", "chunk", "keys", "shared"], zip(*rows))), pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("shared", pa.binary())]))

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(k) for k in asked["keys"]]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(at, minlength=len(keys))
        np.maximum.at(count, at, 2 * np.concatenate([np.frombuffer(s, np.uint8) for s in asked["shared"]]))
        edges = np.cumsum([len(p) for p in parts])[:-1]
        known = [p[count[a] > 1] for p, a in zip(parts, np.split(at, edges))]
        return pd.DataFrame({"chunk": asked["chunk"], "keys": [pack_sorted(k) for k in known]})

    def hit(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known = np.sort(np.concatenate([unpack_sorted(k) for k in answers["keys"]])) if len(answers) else np.zeros(0, np.uint64)
        if not len(known) or not len(docs):
            return pd.DataFrame({"doc_id": docs["doc_id"][:0], "known": pd.Series([], dtype=object)})
        found = []
        for s, least in zip(docs["s"], docs["least"]):
            s = np.asarray(s, np.int64).view(np.uint64)
            own = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
            found.append(np.unique(s[own].view(np.int64)) if own.sum() >= max(least, 1) else None)
        out = pd.DataFrame({"doc_id": docs["doc_id"], "known": found})
        return out[out["known"].notna()]

    asked = sets.select("chunk", "k1", "s").mapInArrow(ask, "bucket int, chunk int, keys binary, shared binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "chunk int, keys binary")
    return sets.select("chunk", "doc_id", "s", "least").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(hit, "doc_id long, known array<long>")


def _packed(ids: np.ndarray) -> bytes:
    """The least of some ids and, in four bytes each where they fit, how far the others lie above it."""
    least = int(ids.min())
    kind = np.uint32 if int(ids.max()) - least < 1 << 32 else np.int64
    return np.int64(least).tobytes() + (ids - least if kind is np.uint32 else ids).astype(kind).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if len(data) == 8 + 4 * n:
        return np.frombuffer(data, np.uint32, offset=8).astype(np.int64) + np.frombuffer(data, np.int64, 1)[0]
    return np.frombuffer(data, np.int64, offset=8)


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the least and the greatest id of each."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    new = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return keys[new], np.minimum.reduceat(ids, new), np.maximum.reduceat(ids, new)


def first_holders(sets: DataFrame) -> DataFrame:
    """(chunk, keys, first): for each chunk its keys that several doc_ids have, and the least doc_id of each; rows of sets: (chunk, doc_id, s).

    As in ``known_elsewhere`` a chunk asks about its distinct keys once, so a hot key is one entry per chunk. ``read_holders`` unpacks the rows.
    """
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_KEYS))
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("first", pa.binary()), ("several", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            values, offsets = flat(batch.column(2))
            ids = np.repeat(batch.column(1).to_numpy(), np.diff(offsets))
            per_key = np.repeat(chunks, np.diff(offsets))
            own = values[offsets[0] : offsets[-1]]
            for c in np.unique(per_key):
                held.setdefault(int(c), []).append((own[per_key == c], ids[per_key == c]))
        for c in list(held):
            parts = held.pop(c)
            keys, first, last = _least(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
            bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, first, several = keys[order], first[order], (first < last).astype(np.uint8)[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, c, pack_sorted(keys[e:f]), _packed(first[e:f]), several[e:f].tobytes()) for b, (e, f) in enumerate(zip(edges[:-1], edges[1:])) if f > e]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema)

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(k) for k in asked["keys"]]
        firsts = [_unpacked(f, len(p)) for f, p in zip(asked["first"], parts)]
        keys, first, last = _least(np.concatenate(parts), np.concatenate(firsts))
        out = []
        for chunk, own, several in zip(asked["chunk"], parts, asked["several"]):
            at = np.searchsorted(keys, own)
            shared = (first[at] < last[at]) | (np.frombuffer(several, np.uint8) > 0)
            if shared.any():
                out.append((chunk, pack_sorted(own[shared]), _packed(first[at[shared]])))
        return pd.DataFrame(out, columns=["chunk", "keys", "first"])

    asked = sets.select("chunk", "doc_id", "s").mapInArrow(ask, "bucket int, chunk int, keys binary, first binary, several binary")
    return asked.groupBy("bucket").applyInPandas(answer, "chunk int, keys binary, first binary")


def read_holders(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one chunk's rows of ``first_holders``, ascending, and the least doc_id of each."""
    parts = [unpack_sorted(k) for k in answers["keys"]]
    first = np.concatenate([_unpacked(f, len(p)) for f, p in zip(answers["first"], parts)])
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    return keys[order], first[order]
