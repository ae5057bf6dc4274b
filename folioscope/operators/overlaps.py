"""Pairs of members with overlapping sets or weighted profiles, made tile by tile.

Members are put in order of their main key, so that alike ones are neighbours, and cut into blocks of bounded size. Two blocks meet only if some pair of
their members could reach the least overlap: every block knows the greatest weight of each key and the least total of its members, keys are ordered
from rare to frequent, and a block offers the shortest prefix of its keys beyond which the rest can't reach the overlap (the first key that two
blocks have in common lies in both prefixes). Blocks that share an offered key make one tile, in which all pairs are computed at once from dense
rows, and those below the overlap are left out. So a heavy key makes pairs of blocks, not of members, and a pair is made once, however
many keys it shares.

Neighbouring blocks are gathered in stripes of bounded bytes, and one task's group makes all tiles of two stripes: a block is sent once per
stripe that it meets, not once per tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType
from pyspark.sql.window import Window

from .graph import kept

#: Members and entries (member, key) of a block at most.
BLOCK, ENTRIES = 128, 400_000
#: Keys that are dense at a time.
DENSE = 1 << 15
#: Bytes of a stripe's blocks, of which a group holds two.
STRIPE = 48 << 20
#: Distinct weights that are compared by products of matrices; what exceeds the last of them is compared one by one.
LEVELS = 16
#: Bytes of a number to its kind.
WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


class Part:
    """The entries of one kind in a block: the distinct keys in order, as places in the ordered ``names``, and per member which of them it has, with weights."""

    def __init__(self, words: np.ndarray, names: pa.Array, ends: np.ndarray, at: np.ndarray, weights: dict[str, np.ndarray]):
        self.words, self.names, self.ends, self.at, self.weights = words, names, ends, at, weights
        self.known: dict[str, np.ndarray] = {}
        self.sizes = np.diff(ends, prepend=0)
        self.rows = np.repeat(np.arange(len(ends)), self.sizes)

    def dense(self, place: np.ndarray, columns: int, weight: str | None = None) -> np.ndarray:
        """A row per member; key k goes to column place[k], unless that is negative."""
        small = weight is not None and self.levels(weight)[-1:].max(initial=0) < 1 << 15
        out = np.zeros((len(self.ends), columns), np.float32 if weight is None else np.int16 if small else np.int64)
        to = place[self.at]
        inside = to >= 0
        out[self.rows[inside], to[inside]] = 1 if weight is None else self.weights[weight][inside]
        return out

    def totals(self, weight: str) -> np.ndarray:
        return np.bincount(self.rows, weights=self.weights[weight], minlength=len(self.ends)).astype(np.int64)

    def levels(self, weight: str) -> np.ndarray:
        """The distinct weights, ascending."""
        if weight not in self.known:
            self.known[weight] = np.unique(self.weights[weight])
        return self.known[weight]

    def places(self, names: list[str]) -> np.ndarray:
        """Where these keys are among the part's own; -1 for others."""
        code = pc.fill_null(pc.index_in(pa.array(names, pa.string()), self.names), -1).to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.words, code)
        met = (at < len(self.words)) & (code >= 0)
        met[met] = self.words[at[met]] == code[met]
        return np.where(met, at, -1)


def _common(a: Part, b: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that both parts have, in order, and their columns by a's and by b's keys."""
    words, of_a, of_b = np.intersect1d(a.words, b.words, assume_unique=True, return_indices=True)
    columns = []
    for part, mine in ((a, of_a), (b, of_b)):
        columns.append(np.full(len(part.words), -1))
        columns[-1][mine] = np.arange(len(words))
    return words, *columns


def _windows(n: int, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first in range(0, n, DENSE):
        width = min(DENSE, n - first)
        yield width, *(np.where((of >= first) & (of < first + width), of - first, -1) for of in (of_a, of_b))


def shared_counts(a: Part, b: Part) -> np.ndarray:
    """How many keys each member of a has in common with each of b."""
    words, of_a, of_b = _common(a, b)
    out = np.zeros((len(a.ends), len(b.ends)), np.int64)
    for width, to_a, to_b in _windows(len(words), of_a, of_b):
        out += (a.dense(to_a, width) @ b.dense(to_b, width).T).astype(np.int64)  # whole numbers up to DENSE, exact as they are
    return out


def _least_sum(x: np.ndarray, y: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The sum of the lesser entries of each row of x and each of y, none of them negative; levels: the values that occur, ascending.

    min(p, q) is the sum, over the ordered values v that occur, of each one's step above the one before, where p and q both reach v.
    """
    out, below = np.zeros((len(x), len(y)), np.int64), 0
    for value in levels[: LEVELS + 1].tolist():
        if value > 0:
            p, q = x >= value, y >= value
            both = p.any(axis=0) & q.any(axis=0)
            if not both.any():
                return out
            out += (value - below) * (p[:, both].astype(np.float32) @ q[:, both].astype(np.float32).T).astype(np.int64)
            below = value
    x, y = np.maximum(x - below, 0), np.maximum(y - below, 0)
    both = x.any(axis=0) & y.any(axis=0)
    if both.any():
        x, y = x[:, both], y[:, both]
        for i in np.nonzero(x.any(axis=1))[0]:
            out[i] += np.minimum(x[i], y).sum(axis=1, dtype=np.int64)
    return out


def least_sums(a: Part, b: Part, weights: tuple[str, ...]) -> list[np.ndarray]:
    """For each weight the sum, over common keys, of the lesser weight, of every pair."""
    words, of_a, of_b = _common(a, b)
    out = [np.zeros((len(a.ends), len(b.ends)), np.int64) for _ in weights]
    for width, to_a, to_b in _windows(len(words), of_a, of_b):
        for total, weight in zip(out, weights):
            total += _least_sum(a.dense(to_a, width, weight), b.dense(to_b, width, weight), np.union1d(a.levels(weight), b.levels(weight)))
    return out


def greatest_common(a: Part, b: Part, weight: str, pairs: tuple[np.ndarray, np.ndarray], k: int) -> list[list[str]]:
    """The k common keys of the greatest lesser weight of each given pair, ties by key."""
    words, of_a, of_b = _common(a, b)
    if not len(words):
        return [[] for _ in pairs[0]]
    names = a.names.take(pa.array(words)).to_pylist()
    x, y = a.dense(of_a, len(words), weight), b.dense(of_b, len(words), weight)
    found = []
    for i in np.unique(pairs[0]):
        lesser = np.minimum(x[i], y[pairs[1][pairs[0] == i]])
        best_of: list[list[str]] = [[] for _ in lesser]
        for _ in range(k):
            best = lesser.argmax(axis=1)
            value = lesser[np.arange(len(lesser)), best]
            for own, at, v in zip(best_of, best, value):
                if v > 0:
                    own.append(names[at])
            lesser[np.arange(len(lesser)), best] = 0
        found += best_of
    return found


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.shape(a), np.float64), where=b > 0)


def blocked(members: DataFrame, parts: dict[str, list[str]], scalars: list[str], block: int = BLOCK, entries: int = ENTRIES) -> DataFrame:
    """Blocks of members (id, main, <scalars>, per part its keys and weights as arrays <part>, <part>_<weight>), in order of main and id."""
    columns = [c for name, weights in parts.items() for c in (name, *(f"{name}_{w}" for w in weights))]
    fields = [("block", "long", pa.int64()), ("id", "array<long>", pa.list_(pa.int64()))] + [(s, "array<string>", pa.list_(pa.string())) for s in scalars]
    for name, weights in parts.items():
        fields += [(name, "array<string>", pa.list_(pa.string()))] + [(f"{name}_{x}", "binary", pa.binary()) for x in ("ends", "at", *weights)]
    schema = pa.schema([(n, t) for n, _, t in fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            row = {"block": number, "id": [m["id"] for m in held]} | {s: [m[s] for m in held] for s in scalars}
            for name, weights in parts.items():
                words = sorted({w for m in held for w in m[name] or ()})
                place = {w: k for k, w in enumerate(words)}
                row |= {name: words, f"{name}_ends": np.cumsum([len(m[name] or ()) for m in held], dtype=np.int64).tobytes(), f"{name}_at": _packed([place[w] for m in held for w in m[name] or ()])}
                row |= {f"{name}_{x}": _packed([v for m in held for v in m[f"{name}_{x}"] or ()]) for x in weights}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for m in batch.to_pylist():
                n = sum(len(m[name] or ()) for name in parts)
                if held and (len(held) >= block or size + n > entries):
                    yield packed()
                    number, held, size = number + 1, [], 0
                held.append(m)
                size += n
        if held:
            yield packed()

    # written before: finding the ranges reads the rows once more
    ordered = kept(members.select("id", "main", *[F.col(s).cast("string").alias(s) for s in scalars], *columns)).repartitionByRange("main", "id").sortWithinPartitions("main", "id")
    return kept(ordered.drop("main").mapInArrow(cut, ", ".join(f"{n} {t}" for n, t, _ in fields)))


def _packed(numbers: list[int]) -> bytes:
    """Numbers, none of them negative, in the least width that holds all of them; blocks are sent many times."""
    whole = np.array(numbers, np.int64)
    return whole.astype(next(t for t in WIDTHS.values() if whole.max(initial=0) <= np.iinfo(t).max)).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, WIDTHS[len(data) // n if n else 8])


def _entries(row, name: str, weights: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Where each member's entries end, the entries' places among the block's keys, and their weights."""
    ends = np.frombuffer(row[f"{name}_ends"], np.int64)
    n = int(ends[-1]) if len(ends) else 0
    return ends, _unpacked(row[f"{name}_at"], n), {w: _unpacked(row[f"{name}_{w}"], n) for w in weights}


def bounded_tiles(blocks: DataFrame, parts: dict[str, list[str]], name: str, bounds: dict[str, float]) -> DataFrame:
    """(a, b), a <= b: blocks of which some pair of members could reach one of the least weighted Jaccard similarities of a part.

    bounds: weight to least similarity; without a weight ("") any common key is enough. Of a pair that reaches t the lesser weights sum to at least
    t times either total, so to t times the least total of each block, and no block has more of a key than its greatest weight.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, at, weights = _entries(row, name, parts[name])
                rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                for weight in bounds:
                    w = weights[weight] if weight else np.ones(len(at), np.int64)
                    most = np.zeros(len(row[name]), np.int64)
                    np.maximum.at(most, at, w)
                    totals = np.bincount(rows, weights=w, minlength=len(ends))
                    has = np.nonzero(most)[0]
                    if len(has):
                        yield pa.RecordBatch.from_pydict({
                            "weight": [weight] * len(has), "block": np.full(len(has), row["block"]), "key": pa.array(row[name], pa.string()).take(pa.array(has)), "most": most[has],
                            "needed": np.full(len(has), bounds[weight] * totals[totals > 0].min()),
                        })

    columns = ["block", name, f"{name}_ends", f"{name}_at", *(f"{name}_{w}" for w in parts[name])]
    keys = kept(blocks.select(columns).mapInArrow(summary, "weight string, block long, key string, most long, needed double"))
    met = keys.groupBy("weight", "key").agg(F.count("*").alias("blocks")).filter("blocks > 1")  # a key of one block makes no tile
    order = Window.partitionBy("weight", "block").orderBy(F.desc("blocks"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = keys.join(met.hint("merge"), ["weight", "key"]).withColumn("rest", F.sum("most").over(order))  # what this key and the more frequent ones can add
    offered = kept(ranked.filter("rest >= needed").select("weight", "key", "block"))
    shared = offered.groupBy("weight", "key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if 2 * shared > blocks.count():  # one key alone makes an eighth of all pairs or more, so all of them are offered
        a, b = (blocks.select(F.col("block").alias(c)) for c in "ab")
        pairs = a.crossJoin(F.broadcast(b)).filter("a < b")  # one number per block
    else:
        a, b = (offered.select("weight", "key", F.col("block").alias(c)) for c in "ab")
        pairs = a.hint("merge").join(b, ["weight", "key"]).filter("a < b").select("a", "b").distinct()
    return pairs.unionByName(blocks.select(F.col("block").alias("a"), F.col("block").alias("b")))


def _sides(table: pa.Table, parts: dict[str, list[str]]) -> dict[int, dict]:
    """The blocks of a group by number: ids, scalars as arrays, and parts whose keys are places in one order for all of the group."""
    sides = {b: {"block": b} for b in table.column("block").to_pylist()}
    other = {"sa", "sb", "a", "b", "block"} | {c for name, weights in parts.items() for c in (name, f"{name}_ends", f"{name}_at", *(f"{name}_{w}" for w in weights))}
    for c in table.column_names:
        if c not in other:
            for side, v in zip(sides.values(), table.column(c)):
                side[c] = np.array(v.as_py(), np.int64 if c == "id" else object)
    for name, weights in parts.items():
        columns = [table.column(c).to_pylist() for c in (f"{name}_ends", f"{name}_at", *(f"{name}_{w}" for w in weights))]
        keys = table.column(name).combine_chunks()
        keys = keys if isinstance(keys, pa.ListArray) else pa.concat_arrays(keys.chunks)
        flat = keys.flatten()
        met = pc.unique(flat)
        names = met.take(pc.sort_indices(met))
        codes = np.split(pc.index_in(flat, names).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pc.list_value_length(keys).to_numpy(zero_copy_only=False))[:-1])
        for side, words, *values in zip(sides.values(), codes, *columns):
            ends, at, own = _entries(dict(zip((f"{name}_ends", f"{name}_at", *(f"{name}_{w}" for w in weights)), values)), name, weights)
            side[name] = Part(words, names, ends, at, own)
    return sides


def in_tiles(
    blocks: DataFrame, tiles: DataFrame, parts: dict[str, list[str]], kernel: Callable[[dict, dict, bool], pd.DataFrame], schema: str,
    prune: Callable[[], Callable[[pd.DataFrame | None], pd.DataFrame | None]] | None = None, stripe: int = STRIPE,
) -> DataFrame:
    """The rows that ``kernel`` makes of each tile; it gets both blocks (scalars as arrays, parts as Part), and whether they are the same.

    ``prune`` makes, for each group of tiles, a function that takes each tile's rows in turn, then None, and gives back those to put out; without it all are.
    """
    fields = pa.schema([(f.name, _arrow(f.dataType)) for f in StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        sides = _sides(table.filter(pc.is_valid(table.column("block"))), parts)
        wanted = table.filter(pc.is_valid(table.column("a"))).select(["a", "b"]).to_pylist()
        del table
        pruned = prune() if prune else lambda rows: rows
        for t in [*wanted, None]:
            rows = pruned(t if t is None else kernel(sides[t["a"]], sides[t["b"]], t["a"] == t["b"]))
            if rows is not None and len(rows):
                yield from pa.Table.from_pandas(rows, fields, preserve_index=False).to_batches(max_chunksize=10_000)

    # few bytes make many pairs, so there are groups for all partitions, and more where stripes would be too large
    parts_ = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = [c for name, weights in parts.items() for c in (f"{name}_ends", f"{name}_at", *(f"{name}_{w}" for w in weights))]
    size = sum((F.length(c) for c in large), F.lit(0)) + sum((F.size(name) * 32 for name in parts), F.lit(0))
    n, total = blocks.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    stripes = max(1, min(n, max(math.ceil(total / stripe), math.ceil(math.sqrt(2 * parts_)))))
    # blocks in order of their numbers: those of the partitions before (one row a partition), and the place within
    counts = blocks.groupBy(F.shiftright("block", 32).alias("p")).agg(F.count("*").alias("n"))
    before = counts.select("p", (F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    numbered = blocks.select("block", F.shiftright("block", 32).alias("p")).hint("merge").join(before, "p")
    place = kept(numbered.select("block", F.floor((F.col("before") + F.col("block").bitwiseAND((1 << 32) - 1)) * stripes / max(n, 1)).cast("int").alias("s")))
    of = lambda side: place.select(F.col("block").alias(side), F.col("s").alias(f"s{side}"))
    wanted = kept(tiles.select("a", "b").hint("merge").join(of("a"), "a").hint("merge").join(of("b"), "b"))
    needed = wanted.select("sa", "sb", F.explode(F.array("a", "b")).alias("block")).distinct()
    sent = needed.hint("merge").join(blocks, "block")
    rows = sent.unionByName(wanted, allowMissingColumns=True).repartition(parts_, "sa", "sb")
    return rows.groupBy("sa", "sb").applyInArrow(run, schema)


def _arrow(kind: DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[kind.simpleString()]


def main_key(keys: Column, weights: Column) -> Column:
    """The key of the greatest weight, the first of equal ones."""
    return F.element_at(keys, F.array_position(weights, F.array_max(weights)).cast("int"))


def set_pairs(sets: DataFrame) -> DataFrame:
    """(a, b, common, n_a, n_b), a < b: pairs that share a key; sets: distinct (id, key)."""
    parts = {"keys": []}
    members = sets.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys")).withColumn("main", F.element_at("keys", 1))
    blocks = blocked(members, parts, [])
    tiles = bounded_tiles(blocks, parts, "keys", {"": 0.0})

    def kernel(x: dict, y: dict, same: bool) -> pd.DataFrame:
        common = shared_counts(x["keys"], y["keys"])
        ids, others = x["id"], y["id"]
        i, j = np.nonzero(common * np.triu(np.ones_like(common), 1) if same else common)
        turned = ids[i] > others[j]
        rows = {"a": (ids[i], others[j]), "b": (others[j], ids[i]), "n_a": (x["keys"].sizes[i], y["keys"].sizes[j]), "n_b": (y["keys"].sizes[j], x["keys"].sizes[i])}
        return pd.DataFrame({k: np.where(turned, v[1], v[0]) for k, v in rows.items()} | {"common": common[i, j]})

    return in_tiles(blocks, tiles, parts, kernel, "a long, b long, n_a long, n_b long, common long").select("a", "b", "common", "n_a", "n_b")
