"""Packing: documents cut and dealt to fixed-length sequences of about equal attention cost.

Each task packs the documents of its own partition in windows of a bounded number of tokens, so there is no shuffle and no
group grows with the data. A piece costs ``linear * n + quadratic * n * n``. A document longer than a sequence first
gives whole sequences; what is left of all documents is dealt in descending cost, each to the sequence with the lowest cost so far
that still has room for all of it. Only where no sequence has is a document cut to fill the emptiest, so each window leaves less than
one sequence of padding in all.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def deal(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document index, start, length, sequence, offset) of documents with these token counts."""
    pieces: list[tuple[int, int, int, int, int]] = []
    cost = lambda n: linear * n + quadratic * n * n
    sequence = 0
    for i in np.nonzero(lengths >= capacity)[0]:
        for start in range(0, int(lengths[i]) - capacity + 1, capacity):
            pieces.append((int(i), start, capacity, sequence, 0))
            sequence += 1
    rest = lengths % capacity
    bins = -(-int(rest.sum()) // capacity)
    # lengths fall, so a sequence without room for this document waits, by its room, until one that it has room for comes
    open_: list[tuple[float, int, int]] = [(0.0, sequence + k, capacity) for k in range(bins)]  # cost so far, sequence, room
    waiting: list[tuple[int, int, float]] = []
    for i in np.argsort(-rest, kind="stable"):
        left = int(rest[i])
        if not left:
            break
        start = int(lengths[i]) - left
        while left:
            while waiting and -waiting[0][0] >= left:
                room, k, spent = heapq.heappop(waiting)
                heapq.heappush(open_, (spent, k, -room))
            while open_ and open_[0][2] < left:
                spent, k, room = heapq.heappop(open_)
                heapq.heappush(waiting, (-room, k, spent))
            if open_:
                spent, k, room = heapq.heappop(open_)
            else:
                room, k, spent = heapq.heappop(waiting)
                room = -room
            n = min(left, room)
            pieces.append((int(i), start, n, k, capacity - room))
            start, left = start + n, left - n
            if room > n:
                heapq.heappush(open_, (spent + cost(n), k, room - n))
    return pieces


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, capacity: int = 4096, window_tokens: int = 8_000_000) -> DataFrame:
    """One row per piece of every document: where it lies in its document and in its sequence.

    A document's ids are those of its whole text (null or empty: none) and ``end_id``; every id lies in exactly one piece. Columns other
    than doc_id and text are ignored; rows with a null or repeated doc_id are documents of their own; an empty table gives no pieces.
    """
    path = tokenizer_path or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = encoder(path)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def window() -> pa.RecordBatch:
            nonlocal first, held, tokens
            lengths = np.array([len(x) // 4 for _, x in held], np.int64)
            pieces = deal(lengths, capacity)
            out = [
                [held[i][0] for i, *_ in pieces],
                [s for _, s, *_ in pieces],
                [n for _, _, n, *_ in pieces],
                [zlib.crc32(held[i][1][4 * s : 4 * (s + n)]) for i, s, n, *_ in pieces],
                [int(lengths[i]) for i, *_ in pieces],
                [first + k for *_, k, _ in pieces],
                [o for *_, o in pieces],
            ]
            first += 1 + max((k for *_, k, _ in pieces), default=-1)
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py()) + end
                held.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= window_tokens:
                    yield window()
        if held:
            yield window()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
