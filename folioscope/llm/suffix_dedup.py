"""Passages of at least ``least`` words that another document has too, from a sparse suffix array.

1. Winnowing: every window of ``least`` words names the lowest hash of its grams of ``gram`` words, and the leftmost place of it: the places at which
   suffixes are retained. They depend on the window's words alone.
2. Two filters that lose nothing keep the suffix array small: grams of one document only go, then windows (as hashes) of one document only. What they let
   through is known to recur, and which document has it first.
3. Suffixes: each maximal stretch of such windows with one retained place and one first document is one suffix with the words before it (no
   further than these windows reach). Equal ones of a task are one row with the least doc_id. They are dealt by gram and first document; windows that are equal
   agree in both, so a frequent gram is split, and a passage that very many documents have is one row a task.
4. Each bucket is sorted, and neighbours are compared: the common length to the right bounds the runs in which a passage can lie. For every width
   to the left, rows of a run that also agree in that many words before the suffix share a whole window; the least doc_id among them keeps it.
5. A document's windows that a smaller doc_id has are joined to the left and right into maximal passages. A marked passage thus always remains in a
   document of smaller doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, modest, scratch
from .exchange import first_holders, flat, known_elsewhere, lists, read_holders
from .shingles import mix, rolling
from .wordhash import hashed_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPANS = "array<struct<start int, end int, first long>>"
#: Suffixes of a bucket, about, and distinct ones that a task holds before it passes them on.
BUCKET_SUFFIXES, HELD = 20_000, 30_000


def retained(words: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``least`` words the lowest hash of its grams, and its leftmost place."""
    low, width, reach = rolling(words, gram), least - gram + 1, 1
    if len(low) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(len(low))
    while reach < width:
        step = min(reach, width - reach)
        further = low[step:] < low[:-step]
        low, place = np.where(further, low[step:], low[:-step]), np.where(further, place[step:], place[:-step])
        reach += step
    return low, place


def lowest_grams(words: np.ndarray, least: int, gram: int) -> np.ndarray:
    return retained(words, least, gram)[0]


def _row_id() -> Column:
    """Rows of one doc_id and one text are one document; a doc_id with several texts stands for several."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _kept(docs: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        for batch in batches:
            values, offsets = hashed_words(batch.column(1))
            keys = [np.unique(lowest_grams(values[a:b], least, gram)) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, chunk, np.int32)), batch.column(0), batch.column(0), lists(keys), pa.array(np.ones(batch.num_rows, np.int32))], names=["chunk", "doc_id", "k1", "s", "least"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, "chunk int, doc_id long, k1 long, s array<long>, least int")


def _windows(docs: DataFrame, known: DataFrame, least: int, gram: int) -> DataFrame:
    """(chunk, doc_id, rid, s, at): hashes and places of the windows whose lowest gram other documents have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        for batch in batches:
            values, offsets = hashed_words(batch.column("text"))
            asked, asked_at = flat(batch.column("known"))
            found, places = [], []
            for i in range(batch.num_rows):
                words = values[offsets[i] : offsets[i + 1]]
                at = np.nonzero(np.isin(lowest_grams(words, least, gram), asked[asked_at[i] : asked_at[i + 1]]))[0]
                found.append(rolling(words, least)[at])
                places.append(at.astype(np.int32))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32))
            at = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places) if places else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, chunk, np.int32)), batch.column("doc_id"), batch.column("rid"), lists(found), at], names=["chunk", "doc_id", "rid", "s", "at"])

    rows = docs.join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "rid", "text", "known")
    return rows.mapInArrow(run, "chunk int, doc_id long, rid long, s array<long>, at array<int>").filter("size(s) > 0")


def joined(at: np.ndarray, first: np.ndarray, least: int) -> list[dict]:
    """Overlapping and touching windows as spans; at: their places, ascending."""
    new = np.nonzero(np.concatenate([[True], np.diff(at) > least]))[0]
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return [{"start": int(a), "end": int(e) + least, "first": int(f)} for a, e, f in zip(at[new], at[last], np.minimum.reduceat(first, new))]


def _recurring(windows: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, rid, starts, counts, firsts): stretches of windows that several documents have, of one first document each."""

    def run(docs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(held):
            keys, first = read_holders(held)
            for doc_id, rid, s, at in zip(docs["doc_id"], docs["rid"], docs["s"], docs["at"]):
                s, at = np.asarray(s, np.int64).view(np.uint64), np.asarray(at, np.int64)
                place = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                own = keys[place] == s
                if own.any():
                    at, f = at[own], first[place[own]]
                    new = np.nonzero(np.concatenate([[True], (np.diff(at) != 1) | (f[1:] != f[:-1])]))[0]
                    out.append((doc_id, rid, at[new].astype(np.int32), np.diff(new, append=len(at)).astype(np.int32), f[new]))
        return pd.DataFrame(out, columns=["doc_id", "rid", "starts", "counts", "firsts"])

    found = windows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, "doc_id long, rid long, starts array<int>, counts array<int>, firsts array<long>")
    return found.groupBy("doc_id", "rid").agg(*[F.first(c).alias(c) for c in ("starts", "counts", "firsts")])  # repeated rows have equal ones


SUFFIXES = pa.schema(
    [("chunk", pa.int32()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    + [("route", pa.int64()), ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("words", pa.binary()), ("first", pa.int64())]
)
SUFFIXES_DDL = "chunk int, doc_id long, rid long, keys array<long>, starts array<int>, counts array<int>, route long, key long, low int, high int, words binary, first long"


def _suffixes(docs: DataFrame, recurring: DataFrame, least: int, gram: int) -> DataFrame:
    """Two kinds of rows: of documents (the keys of their suffixes, and which windows these stand for), and of a task's distinct suffixes: words from ``high`` before
    the retained place to ``least - low`` behind it, and the least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId(), {}

        def out(rows: dict[str, list], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in SUFFIXES], schema=SUFFIXES)

        def distinct() -> pa.RecordBatch:
            columns = list(zip(*((route, key, low, high, text, first) for key, (route, low, high, text, first) in held.items())))
            return out({"chunk": [chunk] * len(held)} | {c: list(v) for c, v in zip(("route", "key", "low", "high", "words", "first"), columns)}, len(held))

        for batch in batches:
            values, offsets = hashed_words(batch.column("text"))
            ids, rids, rows = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), {c: [] for c in ("chunk", "doc_id", "rid", "keys", "starts", "counts")}
            stretches = [[np.asarray(x.values, np.int64) for x in batch.column(c)] for c in ("starts", "counts", "firsts")]
            for i in range(batch.num_rows):
                words = values[offsets[i] : offsets[i + 1]]
                low, place = retained(words, least, gram)
                short = (words >> np.uint64(32)).astype(np.uint32)
                starts, counts, firsts = (s[i] for s in stretches)
                at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
                first = np.repeat(firsts, counts)
                new = np.nonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(place[at]) != 0) | (first[1:] != first[:-1])]))[0]
                last = np.append(new[1:], len(at)) - 1
                p = place[at[new]]
                routes = (mix(low[at[new]]) ^ mix(first[new].astype(np.int64).view(np.uint64))).view(np.int64)
                keys = []
                for a, b, q, route in zip(at[new].tolist(), at[last].tolist(), p.tolist(), routes.tolist()):
                    text = short[a : b + least].tobytes()
                    key = xxhash.xxh3_64_intdigest(text, q - a) - (1 << 63)
                    keys.append(key)
                    known = held.get(key)
                    if known is None or ids[i] < known[4]:
                        held[key] = (route, q - b, q - a, text, ids[i])
                for c, v in zip(rows, (chunk, ids[i], rids[i], keys, at[new].astype(np.int32), (at[last] - at[new] + 1).astype(np.int32))):
                    rows[c].append(v)
                if len(held) >= HELD:
                    yield distinct()
                    held.clear()
            yield out(rows, batch.num_rows)
        if held:
            yield distinct()

    rows = docs.join(recurring.hint("shuffle_hash"), ["doc_id", "rid"]).select("doc_id", "rid", "text", "starts", "counts", "firsts")
    return rows.mapInArrow(run, SUFFIXES_DDL)


def compared_neighbours(low: np.ndarray, high: np.ndarray, texts: list[bytes], first: np.ndarray, least: int, gram: int) -> np.ndarray:
    """For each suffix and width to the left the least doc_id of the suffixes that share the window of that width; sorts the suffixes and compares neighbours."""
    n, widths = len(low), least - gram + 1
    flat = np.frombuffer(b"".join(texts), np.uint32)
    begin = np.cumsum([len(t) // 4 for t in texts]) - [len(t) // 4 for t in texts]
    reach = least - low
    column = np.arange(least)
    right = np.full((n, least), 0xFFFFFFFF, np.uint32)
    inside = column[None, :] < reach[:, None]
    right[inside] = flat[((begin + high)[:, None] + column[None, :])[inside]]
    order = np.argsort(right.astype(">u4").view(f"S{4 * least}").ravel(), kind="stable")
    right, reach, low, high, begin = right[order], reach[order], low[order], high[order], begin[order]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), least)
    common = np.minimum(common, np.minimum(reach[1:], reach[:-1]))
    ids = first[order]
    before = np.zeros(n, np.uint64)
    found = np.repeat(ids[:, None], widths, axis=1)
    for width in range(widths):
        if width:  # one word further to the left
            further = np.nonzero(high >= width)[0]
            before[further] = mix(before[further] + flat[begin[further] + high[further] - width] + np.uint64(1))
        eligible = np.nonzero((low <= width) & (width <= high))[0]
        if len(eligible) < 2:
            continue
        run = np.concatenate([[0], np.cumsum(common < least - width)])[eligible]
        by = np.lexsort((before[eligible], run))
        run, left = run[by], before[eligible][by]
        new = np.nonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (left[1:] != left[:-1])]))[0]
        found[eligible[by], width] = np.repeat(np.minimum.reduceat(ids[eligible[by]], new), np.diff(new, append=len(by)))
    out = np.empty_like(found)
    out[order] = found
    return out


def _kept_by(suffixes: DataFrame, least: int, gram: int) -> DataFrame:
    """(chunk, key, names, codes): for each suffix of a task, by start of the window, which document keeps it: distinct doc_ids and their places."""
    rows = suffixes.filter("key is not null").select("route", "chunk", "key", "low", "high", "words", "first")
    buckets = max(8, -(-rows.count() // BUCKET_SUFFIXES))

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        low, high = bucket["low"].to_numpy(np.int64), bucket["high"].to_numpy(np.int64)
        found = compared_neighbours(low, high, [bytes(w) for w in bucket["words"]], bucket["first"].to_numpy(np.int64), least, gram)
        names, codes = [], []
        for row, a, b in zip(found, low, high):
            own, code = np.unique(row[a : b + 1][::-1], return_inverse=True)
            names.append(own.tobytes())
            codes.append(code.astype(np.uint8).tobytes())
        return pd.DataFrame({"chunk": bucket["chunk"], "key": bucket["key"], "names": names, "codes": codes})

    dealt = rows.withColumn("bucket", F.pmod("route", F.lit(buckets))).drop("route")
    return dealt.groupBy("bucket").applyInPandas(run, "chunk int, key long, names binary, codes binary")


def _marked(suffixes: DataFrame, keepers: DataFrame, least: int) -> DataFrame:
    def run(docs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        kept = {k: (n, c) for k, n, c in zip(held["key"], held["names"], held["codes"])}
        out: list[tuple] = []
        for doc_id, rid, keys, starts, counts in zip(*(docs[c] for c in ("doc_id", "rid", "keys", "starts", "counts"))):
            at, first = [], []
            for key, start, count in zip(keys, starts, counts):
                names, codes = kept[key]
                at.append(np.arange(start, start + count))
                first.append(np.frombuffer(bytes(names), np.int64)[np.frombuffer(bytes(codes), np.uint8)])
            at, first = np.concatenate(at), np.concatenate(first)
            own = first < doc_id
            if own.any():
                out.append((doc_id, rid, joined(at[own], first[own], least)))
        return pd.DataFrame(out, columns=["doc_id", "rid", "spans"])

    docs = suffixes.filter("key is null").select("chunk", "doc_id", "rid", "keys", "starts", "counts")
    found = docs.groupBy("chunk").cogroup(keepers.groupBy("chunk")).applyInPandas(run, f"doc_id long, rid long, spans {SPANS}")
    return found.groupBy("doc_id", "rid").agg(F.first("spans").alias("spans"))  # repeated rows have equal spans


def repeated_passages(docs: DataFrame, least: int = 50, gram: int = 8) -> DataFrame:
    """(doc_id, rid, spans): the word ranges of each document that a document of smaller doc_id has too, at least ``least`` words each.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Null and short texts have none, nor have rows with a null doc_id; repeats within
    one document or between texts of one doc_id are left alone; documents without any get no row. ``rid`` tells texts of one doc_id apart.
    """
    spark = docs.sparkSession
    modest(spark)

    def table(df: DataFrame, name: str, *done: str) -> tuple[DataFrame, str]:
        """The rows as a table in the shared folder; tables that nothing needs any more go."""
        path = scratch(spark, name)
        df.write.parquet(path)
        discard(spark, *done)
        return spark.read.schema(df.schema).parquet(path), path

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_id().alias("rid"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    grams, grams_at = table(_kept(docs, least, gram), "grams")
    known, known_at = table(known_elsewhere(grams), "known", grams_at)
    known = known.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))
    windows, windows_at = table(_windows(docs, known, least, gram), "windows", known_at)
    first, first_at = table(first_holders(windows.select("chunk", "doc_id", "s")), "first")
    recurring, recurring_at = table(_recurring(windows, first), "recurring", windows_at, first_at)
    suffixes, _ = table(_suffixes(docs, recurring, least, gram), "suffixes", recurring_at)
    keepers, _ = table(_kept_by(suffixes, least, gram), "keepers")
    return _marked(suffixes, keepers, least)


def cut(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents without the words of ``passages`` (doc_id, rid, spans); those of which no word is left go.

    Documents without passages stay exactly as they are, null and empty texts and rows without a doc_id too, and so do all columns but text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(1), []
            if batch.column(2).null_count < batch.num_rows:
                new = texts.to_pylist()
                for i, spans in enumerate(batch.column(2).to_pylist()):
                    if spans:
                        new[i] = without(new[i], [(s["start"], s["end"]) for s in spans])
                    keep.append(not spans or bool(WORD.search(new[i])))
                texts = pa.array(new, pa.string())
            part = pa.RecordBatch.from_arrays([batch.column(0), texts], names=["row", "text"])
            yield part.filter(pa.array(keep)) if keep and not all(keep) else part

    modest(docs.sparkSession, 250)
    found = passages.select(F.col("doc_id").alias("at_doc"), F.col("rid").alias("at_row"), "spans")
    # whole texts go to Python and back once, beside the other columns
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("own_doc"), _row_id().alias("own_row"))
    joined = rows.hint("merge").join(found, (F.col("own_doc") == F.col("at_doc")) & (F.col("own_row") == F.col("at_row")), "left")
    joined = joined.select("row", "text", "spans")
    left = joined.mapInArrow(run, joined.select("row", "text").schema)
    return left.select([F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these word ranges; the white space behind a removed word goes with it."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    at, parts = 0, []
    for first, end in spans:
        parts.append(text[at : starts[first]])
        at = starts[min(end, len(starts) - 1)]
    return "".join([*parts, text[at:]])
