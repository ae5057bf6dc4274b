"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of two hashed embeddings, of the whole word and of its first letters (so that unseen compounds of
a known stem are covered). Filters of several widths slide over the words, the greatest response of each over the whole text is
kept, and a logistic layer scores these. Training (Adam, balanced classes) reads every labelled row: a start in one task, then rounds in
which each task learns from its rows and the changes are averaged. The model has a fixed size and is broadcast. Scoring is a map over all
rows: the products of embeddings and filters are tabulated, so a convolution is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_columns, modest, scratch

WORDS, STEMS, STEM_LETTERS = 1 << 15, 1 << 13, 4
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 8
GAP = max(WIDTHS) - 1
OWN = ("score", "threshold", "rejected")
BINS = 4096


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case, as array<struct<w int, s int>> of bucket numbers; 0 is no word."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    bucket = lambda c, n: (F.pmod(F.xxhash64(c), F.lit(n - 1)) + 1).cast("int")
    return F.transform(found, lambda w: F.struct(bucket(w, WORDS).alias("w"), bucket(F.substring(w, 1, STEM_LETTERS), STEMS).alias("s")))


@dataclass
class Model:
    word: np.ndarray
    stem: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)

    def params(self) -> list[np.ndarray]:
        return [self.word, self.stem, *self.filters, *self.shift, self.out, np.full(1, self.bias, np.float32)]

    def tabulate(self) -> Model:
        self.tables = [[(self.word @ f[j], self.stem @ f[j]) for j in range(len(f))] for f in self.filters]
        return self

    def pooled(self, w: np.ndarray, s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greatest response of each filter per text; w and s hold GAP zeros behind each text."""
        real = np.zeros(len(w), bool)
        np.add.at(flags := np.zeros(len(w) + 1, np.int32), starts, 1)
        np.add.at(flags, ends, -1)
        real = np.cumsum(flags[:-1]) > 0
        result = np.zeros((len(starts), FILTERS * len(WIDTHS)), np.float32)
        for k, width in enumerate(WIDTHS):
            n = len(w) - width + 1
            response = np.broadcast_to(self.shift[k], (n, FILTERS)).copy()
            for j in range(width):
                a, b = self.tables[k][j]
                response += a[w[j : j + n]]
                response += b[s[j : j + n]]
            response[~real[:n]] = 0
            full = ends > starts
            if full.any():
                # the rows between two texts are 0, as is a response below 0
                result[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(response, starts[full], axis=0), 0)
        return result

    def scores(self, w: np.ndarray, s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        z = self.pooled(w, s, starts, ends) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _padded(w: np.ndarray, s: np.ndarray, lengths: np.ndarray):
    """The flat bucket numbers with GAP zeros behind each text, and where each text starts and ends."""
    starts = np.concatenate([[0], np.cumsum(lengths + GAP)])[:-1].astype(np.int64)
    to = np.arange(len(w)) + np.repeat(np.arange(len(lengths)) * GAP, lengths)
    total = int((lengths + GAP).sum()) + GAP
    pw, ps = np.zeros(total, np.int32), np.zeros(total, np.int32)
    pw[to], ps[to] = w, s
    return pw, ps, starts, starts + lengths


class Learner:
    """A copy of a model that learns from batches of texts; rows of the tables in ``frozen`` stay zero."""

    def __init__(self, model: Model, frozen: list[np.ndarray], share: float, rate: float):
        self.params = [p.copy() for p in model.params()]
        self.frozen, self.rate, self.count = frozen, rate, 0
        self.weights = np.array([0.5 / (1 - share), 0.5 / share])
        self.m1, self.m2 = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.used = [np.zeros(len(p), np.int64) for p in self.params[:2]]

    def epoch(self, w: np.ndarray, s: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rng: np.random.Generator, damp: float = 1.0) -> None:
        edges = np.concatenate([[0], np.cumsum(lengths)])
        order = rng.permutation(len(lengths))
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            of = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in rows])
            self.step(*_padded(w[of], s[of], lengths[rows]), labels[rows], damp)

    def step(self, w: np.ndarray, s: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, damp: float) -> None:
        n, full = len(WIDTHS), np.flatnonzero(ends > starts)
        word, stem, filters, shift, out, bias = *self.params[:2], self.params[2 : 2 + n], self.params[2 + n : 2 + 2 * n], *self.params[-2:]
        e = word[w] + stem[s]
        pooled, best = np.zeros((len(labels), FILTERS * n), np.float32), np.zeros((len(labels), FILTERS * n), np.int64)
        if len(full):
            doc = np.repeat(full, (ends - starts)[full])
            real = np.arange(len(doc)) + np.repeat(starts[full] - np.concatenate([[0], np.cumsum((ends - starts)[full])[:-1]]), (ends - starts)[full])
            heads = np.concatenate([[0], np.cumsum((ends - starts)[full])[:-1]])
            for k, width in enumerate(WIDTHS):
                r = shift[k] + sum(e[real + j] @ filters[k][j] for j in range(width))
                top = np.zeros((len(labels), FILTERS), np.float32)
                top[full] = np.maximum.reduceat(r, heads, axis=0)
                hit, f = np.nonzero(r == top[doc])
                best[doc[hit[::-1]], k * FILTERS + f[::-1]] = real[hit[::-1]]  # the first of equals is written last
                pooled[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ out + bias, -30, 30)))
        d = ((p - labels) * self.weights[labels] / len(labels)).astype(np.float32)
        grads = [None, None, *[np.zeros_like(p) for p in self.params[2:-2]], d @ pooled, d.sum(keepdims=True)]
        g = d[:, None] * out * (pooled > 0)
        touched: tuple[list, list] = ([], [])
        backs = []
        for k, width in enumerate(WIDTHS):
            gk, at = g[:, k * FILTERS : (k + 1) * FILTERS], best[:, k * FILTERS : (k + 1) * FILTERS]
            grads[2 + n + k] = gk.sum(axis=0)
            live = np.nonzero(gk)
            for j in range(width):
                grads[2 + k][j] = np.einsum("bf,bfd->df", gk, e[at + j])
                place = at[live] + j
                touched[0].append(w[place])
                touched[1].append(s[place])
                backs.append(gk[live][:, None] * filters[k][j].T[live[1]])
        back = np.concatenate(backs)
        self.count += 1
        lr = self.rate * np.sqrt(1 - 0.999**self.count) / (1 - 0.9**self.count) * damp
        for k, p in enumerate(self.params):
            if k < 2:
                rows, inverse = np.unique(np.concatenate(touched[k]), return_inverse=True)
                grad = np.zeros((len(rows), DIM), np.float32)
                np.add.at(grad, inverse, back)
                free = ~self.frozen[k][rows]
                rows, grad = rows[free], grad[free]
                self.used[k][rows] += 1
            else:
                rows, grad = slice(None), grads[k] + 1e-4 * p
            self.m1[k][rows] = 0.9 * self.m1[k][rows] + 0.1 * grad
            self.m2[k][rows] = 0.999 * self.m2[k][rows] + 0.001 * grad * grad
            p[rows] -= lr * self.m1[k][rows] / (np.sqrt(self.m2[k][rows]) + 1e-6)


def _flat(t: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of words and stems, and numbers of words, of an array of packed texts."""
    x = np.asarray(t.flatten().to_numpy(zero_copy_only=False), np.int32)
    return x // STEMS, x % STEMS, np.diff(t.offsets.to_numpy()).astype(np.int64)


def _begun(met: np.ndarray, n_rows: int, seed: int, least_docs: int = 3) -> tuple[Model, list[np.ndarray]]:
    """A model with small random numbers, and which buckets are frozen: those met in fewer than least_docs texts keep a zero vector."""
    rng = np.random.default_rng(seed)
    word, stem = (rng.normal(0, 0.1, (n, DIM)).astype(np.float32) for n in (WORDS, STEMS))
    for table, seen in ((word, met[:WORDS]), (stem, met[WORDS:])):
        table[seen < min(least_docs, max(1, n_rows // 50))] = 0
        table[0] = 0
    frozen = [~table.any(axis=1) for table in (word, stem)]
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    return Model(word, stem, filters, shift, out, -1.0).tabulate(), frozen


def _learned(rows: DataFrame, model: Model, frozen: list[np.ndarray], share: float, rate: float, epochs: int, words: int = 2_000_000) -> Model:
    """The model after each task has gone over its rows, in parts of ``words`` words or one text, each ``epochs`` times.

    The tasks' changes are averaged by their steps, those of a word or stem over the tasks that met it. They are summed by Spark in pieces,
    so that a task or the driver holds one model, however many tasks there are.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((model, frozen))
    pieces = 16

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, still = shared.value
        learner, rng, held, size = Learner(start, still, share, rate), np.random.default_rng(7), [], 0

        def spend() -> None:
            t = pa.concat_arrays([b.column(1) for b in held])
            labels = np.concatenate([b.column(0).to_numpy() for b in held]).astype(np.int64)
            for epoch in range(epochs):
                learner.epoch(*_flat(t), labels, rng, 1 - epoch / (2 * epochs))

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                held.append(batch.slice(at, 100))
                size += len(held[-1].column(1).flatten())
                if size > words:
                    spend()
                    held, size = [], 0
        if held:
            spend()
        if learner.count:
            change = [(a - b) * (u[:, None] if u is not None else learner.count) for a, b, u in zip(learner.params, start.params(), [*learner.used, *[None] * (len(learner.params) - 2)], strict=True)]
            flat = np.concatenate([*[c.ravel() for c in change], *learner.used, [learner.count]]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.tobytes() for x in np.array_split(flat, pieces)], pa.binary())], names=["piece", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), np.float64)
                sums[piece] = sums[piece] + x if piece in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "x"])

    parts = rows.select("toxic", "t").mapInArrow(learn, "piece int, x binary").repartition(pieces, "piece").mapInArrow(add, "piece int, x binary")
    found = sorted(parts.toArrow().to_pylist(), key=lambda r: r["piece"])
    if not found:
        return model
    flat = np.concatenate([np.frombuffer(r["x"], np.float64) for r in found])
    old, used, steps, at, new = model.params(), np.maximum(flat[-1 - WORDS - STEMS : -1], 1), flat[-1], 0, []
    for k, p in enumerate(old):
        by = (used[:WORDS], used[WORDS:])[k][:, None] if k < 2 else steps
        new.append((p + flat[at : at + p.size].reshape(p.shape) / by).astype(np.float32))
        at += p.size
    n = len(WIDTHS)
    return Model(new[0], new[1], new[2 : 2 + n], new[2 + n : 2 + 2 * n], new[-2], float(new[-1][0])).tabulate()


def _calibrated(counts: dict[str, np.ndarray], prior: float = 20.0) -> dict[str, float]:
    """Per language the threshold of least weighted error, drawn towards the middle of all where a language has few rows.

    counts: by language the numbers of rows of label 0 and 1 (2, BINS) by score.
    """
    cuts = np.arange(BINS) / BINS

    def best(n: np.ndarray) -> float:
        if not n[0].sum() or not n[1].sum():
            return 0.5
        below = np.concatenate([[[0], [0]], np.cumsum(n, axis=1)[:, :-1]], axis=1)
        error = (1 - below[0] / n[0].sum()) * 2 + below[1] / n[1].sum()
        inside = (cuts > 0.05) & (cuts < 0.95)
        good = cuts[inside & (error <= error[inside].min() + 1e-12)]
        return float(good[np.abs(good - 0.5).argmin()])

    every = best(sum(counts.values()))
    out = {"": every}
    for name, n in sorted(counts.items()):
        out[name] = float((n.sum() * best(n) + prior * every) / (n.sum() + prior))
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, start_rows: int = 5000, rounds: int = 2, seed: int = 7) -> Model:
    """Learns from every labelled document whose doc_id fulfils ``learn``: counts, shares, weights and thresholds come from all of them.

    labels: (doc_id, toxic); rows without a label or text, or whose label is neither 0 nor 1, are left out. Without any
    labelled row every text scores by the bias alone. Some start_rows documents, by a hash of their doc_id, give the model from which
    the rounds over all rows start; where these are all, nothing is left to go over.
    """
    spark = docs.sparkSession
    modest(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    known = known.filter(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    packed = F.transform(tokens(F.col("text").cast("string")), lambda x: x["w"] * STEMS + x["s"])
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(lang, F.lit("")).alias("lang"), F.col("text")).filter("text is not null").filter(learn)
    path = scratch(spark, "labelled")
    told.select("doc_id", "lang", packed.alias("t")).hint("merge").join(known.hint("merge"), "doc_id").select("doc_id", "lang", "toxic", "t").write.parquet(path)
    rows = spark.read.schema("doc_id long, lang string, toxic int, t array<int>").parquet(path)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(WORDS + STEMS, np.int64)
        for batch in batches:
            w, s, lengths = _flat(batch.column(0))
            doc = np.repeat(np.arange(len(lengths)), lengths)
            for ids, first, size in ((w, 0, WORDS), (s, WORDS, STEMS)):
                met += np.bincount(np.unique(doc * size + ids) % size + first, minlength=len(met))
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met[at])], names=["bucket", "n"])

    met = np.zeros(WORDS + STEMS, np.int64)
    found = rows.select("t").mapInArrow(seen, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket at most
    met[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    model, frozen = _begun(met, n, seed)
    share = float(np.clip(toxic / n if n else 0.5, 0.02, 0.98))
    if n:
        chosen = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // start_rows))) == 0
        first = rows.filter(chosen).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "t")  # some start_rows rows, whatever n
        model = _learned(first, model, frozen, share, rate=0.02, epochs=8)
        for k in range(rounds if n > start_rows else 0):
            model = _learned(rows, model, frozen, share, rate=0.005 / (k + 1), epochs=1)
    shared = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scored(shared.value, *_flat(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.minimum(scores * BINS, BINS - 1).astype(np.int32))], names=["lang", "toxic", "bin"])

    counts: dict[str, np.ndarray] = {}
    for r in rows.select("lang", "toxic", "t").mapInArrow(binned, "lang string, toxic int, bin int").groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n")).toArrow().to_pylist():
        counts.setdefault(r["lang"], np.zeros((2, BINS), np.int64))[r["toxic"], r["bin"]] = r["n"]
    model.thresholds = _calibrated(counts) if counts else {"": 0.5}
    discard(spark, path)
    return model


def _scored(model: Model, w: np.ndarray, s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores of flat texts, in parts of a bounded number of words, or one text."""
    out = np.zeros(len(lengths))
    edges = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + 200_000, "right")) - 1)
        part = slice(edges[at], edges[to])
        out[at:to] = model.scores(*_padded(w[part], s[part], lengths[at:to]))
        at = to
    return out


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds score, threshold (of the row's lang) and rejected (score >= threshold) to every row, empty and null texts too.

    Columns of docs with these names are replaced; ``keep`` names the columns to carry along (all). The score reads the whole
    text and nothing else.
    """
    kept = drop_columns(docs if keep is None else docs.select(*keep, "text", *[c for c in docs.columns if c == "lang" and c not in keep]), OWN)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: two hash tables and the filters
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    levels = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair])
    threshold = F.coalesce(F.try_element_at(levels, lang), F.lit(model.thresholds[""]))
    modest(docs.sparkSession)
    carried = [c for c in kept.columns if keep is None or c in keep]
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), threshold.alias("threshold"), tokens(F.col("text").cast("string")).alias("t"))
    rows = rows.select("row", "threshold", F.col("t.w").alias("w"), F.col("t.s").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            w, s = (batch.column(k) for k in (2, 3))
            lengths = np.diff(w.offsets.to_numpy()).astype(np.int64)
            flat = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.int32) for c in (w, s)]
            out = _scored(m, *flat, lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["row", "threshold", "score"])

    schema = rows.select("row", "threshold").withColumn("score", F.lit(0.0)).schema
    scored = rows.mapInArrow(run, schema)
    return scored.select("row.*", "score", "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))
