"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent (ties by value). Two sets of sizes n and m with similarity t share at least a = ceil(t (n + m) / (1 + t))
shingles, hence at least l of the first n - a + l of the one and the first m - a + l of the other, for any l. Steps:

1. documents with one shingle set form a class, its least doc_id stands for it;
2. all documents' shingles are counted in buckets (``frequencies``): a document of which fewer shingles occur elsewhere than a partner must share has no
   partner, and only the others' sets are kept, with the frequencies that order them;
3. each set lengthens its prefix by l - 1 shingles, l by the estimated cost of its candidates. Leaving out the l - 1 most frequent of a prefix
   leaves the rarest n - a + 1, in one of which a pair must meet; of the pairs that meet, those that share fewer than l of the long prefixes
   go; the others are verified on the full sets;
4. first each set is so compared with the pivots of some of its long posting lists only, so that a large group of near copies joins up through
   few comparisons; then with all of the other components' sets that it meets. No link between different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, modest, scratch, written
from .exchange import lists
from .frequencies import chunks_of, members_of, names_of, shared_sets, shingles_of
from .shingles import needed
from .wordhash import hashed_words

#: A posting list of more sets is first joined up by pivots.
LONG_LIST = 32


def most_matches(n: int) -> int:
    """The longest prefix that is considered asks for so many shared shingles."""
    return 1 + n // 10


def matches(n: int, times: np.ndarray, percent: int) -> int:
    """The cheapest l of a set of n shingles: times, how many sets have each, ascending.

    Reading the long prefix's lists costs one for each entry; a list entry is a candidate at most once in l, and a candidate costs a look at n shingles (in blocks).
    """
    base = n - needed(n, percent)
    reach = np.concatenate([[0], np.cumsum(times - 1.0)])
    best, l = None, 1
    while l <= most_matches(n):
        entries = reach[min(base + l, n)]
        cost = entries + entries / l * (1 + n / 16)
        if best is None or cost < best[0]:
            best = (cost, l)
        l *= 2
    return best[1]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, k1, k2, s): the shingle sets, ascending, and their names; without words: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = shingles_of(*hashed_words(batch.column(1)), width)
            ends = np.cumsum(counts)
            rows = [np.unique(keys[e - c : e]) for e, c in zip(ends, counts)]
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            k1, k2 = names_of(np.concatenate(rows) if rows else np.zeros(0, np.uint64), owner, len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int32()), pa.array(k1), pa.array(k2), lists(rows)], names=["doc_id", "n", "k1", "k2", "s"])

    return docs.mapInArrow(run, "doc_id long, n int, k1 long, k2 long, s array<long>").filter("n > 0")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(x, n, l, shared, s): s from rare to frequent, its first place of a shingle that others have, and the set's l."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(2).offsets.to_numpy()
            values = batch.column(2).values.to_numpy(zero_copy_only=False).view(np.uint64) if len(batch.column(2).values) else np.zeros(0, np.uint64)
            found, ls, shared = [], [], []
            for i, codes in enumerate(batch.column(3)):
                s, code = values[offsets[i] : offsets[i + 1]], np.frombuffer(codes.as_py(), np.uint8)
                order = np.argsort(code, kind="stable")
                found.append(s[order])
                ls.append(matches(len(s), 2.0 ** (code[order] / 16), percent))
                shared.append(int((code == 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(ls, pa.int32()), pa.array(shared, pa.int32()), lists(found)], names=["x", "n", "l", "shared", "s"])

    return sets.select("doc_id", "n", "s", "codes").mapInArrow(run, "x long, n long, l int, shared int, s array<long>")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The least number of shingles that sets of these sizes share if they are similar."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent))


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share enough of their long prefixes and whose full sets reach the similarity."""
    sides = [full.select(F.col("x").alias(c), F.col("n").alias(f"n_{c}"), F.col("l").alias(f"l_{c}"), F.col("s").alias(f"s_{c}")) for c in "ab"]
    both = pairs.distinct().hint("merge").join(sides[0], "a").hint("merge").join(sides[1], "b")
    least = _overlap(F.col("n_a"), F.col("n_b"), percent)
    l = F.least(F.greatest("l_a", "l_b"), least)
    prefix = lambda c: F.slice(f"s_{c}", F.lit(1), (F.col(f"n_{c}") - least + l).cast("int"))
    enough = both.filter(F.size(F.array_intersect(prefix("a"), prefix("b"))) >= l)
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return enough.filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def _links(full: DataFrame, percent: int, pivots: int) -> DataFrame:
    """Verified links (a, b) between the classes of ``full`` that connect all that belongs together."""
    longest = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    entries = full.select("x", "n", F.posexplode(F.slice("s", F.col("shared") + 1, F.greatest(longest - F.col("shared"), F.lit(0)).cast("int"))).alias("at", "k"), "shared")
    # slack: how many shingles there are from this one on; a pair can meet here only if both have as many as they must share
    known = (F.col("n") - F.col("shared")).alias("known")
    postings = written(entries.select("x", "n", "k", (known - F.col("at")).alias("slack"), known), "postings")
    # the member of which the least part is its own lies nearest to what its list's near copies come from
    member = F.min_by(F.struct("x", "n", "known"), F.struct(-F.col("known") / F.col("n"), "x")).alias("p")
    long = postings.groupBy("k").agg(F.count("*").alias("df"), member).filter(F.col("df") > LONG_LIST).select("k", F.col("p.x").alias("y"), F.col("p.n").alias("n_y"), F.col("p.known").alias("known_y"))
    fits = (F.col("n") * percent <= F.col("n_y") * 100) & (F.col("n_y") * percent <= F.col("n") * 100)
    least = _overlap(F.col("n"), F.col("n_y"), percent)
    meets = fits & (F.col("slack") >= least) & (F.col("slack_y") >= least)
    # in a long list every set meets the list's own pivot; a few such meetings join up a group of near copies
    alike = fits & (F.col("known") >= least) & (F.col("known_y") >= least)
    met = postings.hint("merge").join(long, "k").filter((F.col("x") != F.col("y")) & alike).groupBy("x", "y").agg(F.min(F.xxhash64("k")).alias("h"))
    few = met.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy("h"))).filter(F.col("place") <= pivots)
    links = written(_verified(few.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), full, percent), "links")
    labels = written(components(links), "labels").withColumnsRenamed({"id": "x"})
    labelled = written(postings.hint("merge").join(labels, "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component"), "labelled")
    mixed = labelled.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("k")
    index = written(labelled.hint("merge").join(mixed, "k", "left_semi"), "index")
    # per list: which other components there are and what their members could share at most, then their members, so that a large component never meets itself
    groups = index.groupBy("k", F.col("c").alias("c_y")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("slack").alias("most"))
    could = _overlap(F.col("n"), F.col("lo"), percent)
    possible = (F.col("lo") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("hi") * 100) & (F.col("slack") >= could) & (F.col("most") >= could)
    asking = index.hint("merge").join(groups, "k").filter((F.col("c") < F.col("c_y")) & possible).select("k", "x", "n", "slack", "c_y")
    asked = index.select("k", F.col("c").alias("c_y"), F.col("x").alias("y"), F.col("n").alias("n_y"), F.col("slack").alias("slack_y"))
    rest = asking.hint("merge").join(asked, ["k", "c_y"]).filter(meets).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return links.unionByName(written(_verified(rest, full, percent), "links"))


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80, pivots: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id): which documents are connected by links of a Jaccard similarity of percent / 100 or more.

    A null, empty or blank text has no shingles and is its own component; a repeated doc_id gives one row each time and joins
    the classes of all its texts; rows with a null doc_id are left out; other columns are ignored.
    """
    spark = docs.sparkSession
    modest(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    chunks = written(chunks_of(docs, width), "chunks")
    members = written(members_of(chunks), "members")
    classes = members.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first")).checkpoint()
    hits = written(shared_sets(chunks, percent).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("codes").alias("codes")), "hits")
    chosen = docs.join(hits.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    # a repeated doc_id may stand for several texts; the class's own set is the one kept
    full = _sets(chosen, width).hint("merge").join(hits, ["doc_id", "k1", "k2"]).dropDuplicates(["k1", "k2"])
    links = _links(written(_ordered(full, percent), "full"), percent, pivots)
    if members.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        links = links.unionByName(members.hint("merge").join(classes, ["k1", "k2"]).filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    labels = components(links)
    member = members.hint("merge").join(classes, ["k1", "k2"], "left")
    named = member.hint("merge").join(labels.withColumnRenamed("id", "first"), "first", "left")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "first", "doc_id").alias("component_id"))
