"""Secrets in texts: three plain patterns, and what a primed zstandard compressor can't foresee in a sensitive context.

Added spans (kind ``novel``) are found by their marginal cost: a candidate is a run of key characters that begins shortly after a word like
``password`` or ``bearer``. Its surrounding text is compressed twice, with and without it, by a zstandard compressor that is primed with a dictionary of the corpus's
own identifiers (those that most documents have, counted over all documents). What costs nearly its own length again repeats neither the
surrounding code nor known identifiers, and is reported; names, paths and prose compress and are not.

Defined results: a null text is empty and has no spans; rows keep their number, order is not defined; repeated rows are found alike; an
empty table has no rows; other columns, whatever their names, are left alone. Whole texts are searched; no run is too long. Places are code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.rollups import top as first_of_each

from .common import modest

#: Fixed patterns, each with the least length of the given group; A-Z and a-z are alike in the first.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # maximal runs, so that the length may stand in the pattern
)
KINDS = [kind for kind, *_ in BASE] + ["novel"]

SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase|code)|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|credentials?|authorization|bearer|client[_-]?id|webhook|\bpwd\b", re.I | re.A
)
#: Lower-cased texts with none of these hold no match of the first pattern or of SENSITIVE: a search for plain strings is far cheaper.
MARKS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer", "client", "webhook")

#: A candidate, and how far from a sensitive word it may begin.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~!@#$%^&*.-]{12,}")
REACH = 48
AROUND = 256  #: characters of surrounding text on either side
LEVEL = 19
#: Runs of key characters; those of letters (and _ between them) are identifiers, so that parts of random strings, however often copied, are not.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
LONGEST_PART = 24
FLUSH = 200_000
SLICES = 8

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_DDL = "array<struct<kind: string, start: bigint, end: bigint>>"


def identifier_parts(text: str) -> set[str]:
    runs = {p for run in set(RUN.findall(text)) if run.replace("_", "").isalpha() for p in run.split("_")}
    return {p for p in runs if 4 <= len(p) <= LONGEST_PART}


def identifier_counts(docs: DataFrame) -> DataFrame:
    """(part, n): in how many documents each part of an identifier occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": list(held), "n": list(held.values())}, pa.schema([("part", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(identifier_parts(text))
                if len(held) > FLUSH:  # what has been counted so far goes on to the sum
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def identifiers(docs: DataFrame, most: int = 6000) -> bytes:
    """A dictionary of the ``most`` most frequent identifiers, the commonest last (near matches cost least); ties by name."""
    modest(docs.sparkSession)
    order = [F.desc("n"), F.col("part")]
    # the first of each slice of the names, then the first of all: the driver gets no more than SLICES times as many rows, whatever the number of tasks
    sliced = identifier_counts(docs).withColumn("slice", F.pmod(F.xxhash64("part"), F.lit(SLICES)))
    top = first_of_each(sliced, ["slice"], order, most).drop("rank", "slice").orderBy(*order).limit(most).collect()
    return " ".join(r.part for r in reversed(top)).encode()


class Novelty:
    """Marginal compressed bytes of a string within its surroundings."""

    def __init__(self, dictionary: bytes):
        primed = None
        if len(dictionary) >= 8:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def marginal(self, text: str, start: int, end: int) -> int:
        own = text[start:end]
        # other copies of the string nearby would make it look familiar
        before, after = (x.replace(own, "") for x in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
        return self.size(before + own + after) - self.size(before + after)


def base_spans(text: str, marked: bool = True) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the plain patterns: leftmost matches that don't overlap, without those that are too short."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and not marked:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    return found


def novel_spans(text: str, novelty: Novelty, known: list[tuple[int, int, int]], percent: int) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context, clear of known spans, of which compression leaves ``percent`` or more."""
    found, done = [], 0
    for m in SENSITIVE.finditer(text):
        if m.end() + REACH <= done:
            continue
        for c in CANDIDATE.finditer(text, max(m.end(), done)):
            if c.start() > m.end() + REACH:
                break
            start, end = c.span()
            done = end
            while end > start and text[end - 1] in ".-!":
                end -= 1
            if end - start < 12 or any(s < end and start < e for s, _, e in known):
                continue
            if 100 * novelty.marginal(text, start, end) >= percent * (end - start):
                found.append((start, len(BASE), end))
    return found


def spans(text: str | None, novelty: Novelty, percent: int) -> list[tuple[int, int, int]]:
    if not text:
        return []
    low = text.lower()
    marked = any(m in low for m in MARKS)
    base = base_spans(text, marked)
    return sorted(base + novel_spans(text, novelty, base, percent)) if marked else sorted(base)


def find_secrets(docs: DataFrame, percent: int = 85, dictionary_words: int = 6000) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): the spans of every text by start, then kind in the order assign, access, hex, novel."""
    dictionary = identifiers(docs, dictionary_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t, novelty, percent)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"doc_id long, spans {SPANS_DDL}")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
