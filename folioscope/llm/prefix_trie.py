"""The trie of conversation prefixes, from sorted conversations and range minima of their common lengths.

Conversations are sequences of turn digests. Sorted, the members of every prefix are neighbours, so a node of the trie is an interval of rows.
The sorted table is cut into blocks of bounded size. In a block the common length of each pair of neighbours goes into a sparse table; each pair
stands for the prefix that its two rows share, and finds how far that prefix reaches by two binary searches over range minima, one to the left and one
to the right, independently of all other prefixes. Ids of members come from a second sparse table, sums over subtrees from running sums in preorder.
No stack is kept. Nodes that lie on the first or last row of a block may go on in its neighbours: they are summed by key over all blocks.

Defined results: rows without a conv_id take no part; a null role or text is empty; turns that are equal (null ones too, which come first) follow in
order of the digest of role and text; repeated rows are turns of their own; a conversation that is left without turns is a member of the root alone; an
empty table has no nodes. Other columns, whatever their names, are left alone. A conversation is one row (20 bytes a turn) in the sort.
Turns are told apart by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WIDTH = 16  #: bytes of a turn's digest
NO_IDS = hashlib.sha256(b"").hexdigest()

BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.binary())), ("points", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64()))])
NODES = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("chain", pa.int64()), ("parent_chain", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("points", pa.int64()), ("block", pa.int64()), ("end_ids", pa.binary())]
)
SQL_TYPES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.binary()): "array<binary>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in schema)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, digest, points>>): every conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turn = F.struct("turn", digest.alias("digest"), F.char_length(text).alias("points"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt_with_shared_heads(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns come from the conversation at the start of the group of ids, h = crc32(conv_id) % heads."""
    own = written(turn_sequences(conversations), "turns")
    base = F.col("conv_id") - F.col("conv_id") % group
    lent = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("lender"), F.slice("turns", 1, heads).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.slice(F.coalesce(F.col("head"), F.slice("turns", 1, 0)), F.lit(1), h)
    return own.withColumn("lender", base).join(lent.hint("merge"), "lender", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _blocks(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """The rows in order of their keys, then ids, as one row a block; blocks are numbered in that order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, keys, points, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in points])
            flat = np.concatenate(points).astype(np.int32) if len(points) else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, ids, keys, flat, ends), BLOCK)], schema=BLOCK)

        for batch in batches:
            for i, key, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if ids and (len(ids) >= block_rows or held + len(key) > block_bytes):
                    yield block()
                    number, ids, keys, points, held = number + 1, [], [], [], 0
                ids.append(i)
                keys.append(key)
                points.append(p)
                held += len(key)
        if ids:
            yield block()

    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key")
    packed = written(rows.select("conv_id", key, F.transform("turns", lambda t: t["points"]).alias("points")), "sequences")
    ordered = packed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return written(ordered.mapInArrow(cut, _ddl(BLOCK)), "blocks")


class RangeMinimum:
    """A sparse table: minima of all stretches whose lengths are powers of two; two of them cover any range."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value at places first..last, both included."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.nonzero(level == k)[0]
            row = self.levels[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - 2**k + 1])
        return out


def _right_extent(common: RangeMinimum, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place p >= at so that all values at at..p are depth or more (value[at] is)."""
    low, high = at.copy(), np.full(len(at), len(common.levels[0]) - 1)
    while (open_ := np.nonzero(low < high)[0]).size:
        middle = (low[open_] + high[open_] + 1) // 2
        far = common.least(at[open_], middle) >= depth[open_]
        low[open_] = np.where(far, middle, low[open_])
        high[open_] = np.where(far, high[open_], middle - 1)
    return low


def _left_extent(common: RangeMinimum, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    low, high = np.zeros(len(at), np.int64), at.copy()
    while (open_ := np.nonzero(low < high)[0]).size:
        middle = (low[open_] + high[open_]) // 2
        far = common.least(middle, at[open_]) >= depth[open_]
        high[open_] = np.where(far, middle, high[open_])
        low[open_] = np.where(far, low[open_], middle + 1)
    return high


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count in turn."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _common_lengths(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many turns each row shares with the row before it; the first row none."""
    shortest = np.minimum(lengths[1:], lengths[:-1])
    place = _within(shortest)
    pair = np.repeat(np.arange(len(shortest)), shortest)
    a, b = begins[pair] + place, begins[pair + 1] + place
    differ = (flat[a] != flat[b]).any(axis=1)
    out = shortest.copy()
    np.minimum.at(out, pair[differ], place[differ])
    return np.concatenate([[0], out])


def block_nodes(ids: np.ndarray, keys: list[bytes], points: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of one block in preorder: first and last row, depth, parent's place, members, least id, children, leaves and sum below, ends."""
    n = len(ids)
    lengths = np.array([len(k) // WIDTH for k in keys], np.int64)
    begins = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, WIDTH // 8)
    common = _common_lengths(flat, begins, lengths)
    after = np.append(common[1:], 0)

    # prefixes that two or more rows share: pair p (rows p - 1 and p) stands for its common length
    pairs = np.nonzero(common > 0)[0]
    depth = common[pairs]
    table = RangeMinimum(common)
    left = _left_extent(table, pairs, depth) - 1 if len(pairs) else pairs
    right = _right_extent(table, pairs, depth) if len(pairs) else pairs
    shared = np.unique(np.stack([left, right, depth]), axis=1) if len(pairs) else np.zeros((3, 0), np.int64)
    left_of = np.zeros(n, np.int64)
    left_of[pairs] = left
    outer = np.maximum(common[shared[0]], after[shared[1]])
    spans = shared[2] - outer
    # prefixes of one row only need no search
    alone = lengths - np.maximum(common, after)
    rows = np.repeat(np.arange(n), alone)
    first = np.concatenate([[0], np.repeat(shared[0], spans), rows])
    last = np.concatenate([[n - 1], np.repeat(shared[1], spans), rows])
    depth = np.concatenate([[0], np.repeat(outer, spans) + _within(spans) + 1, np.repeat(lengths - alone, alone) + _within(alone) + 1])
    order = np.lexsort((depth, first))
    first, last, depth = first[order], last[order], depth[order]

    count = len(first)
    members = last - first + 1
    least = RangeMinimum(ids).least(first, last)
    begin_depth = np.where(depth > 0, depth - 1, 0)
    own_points = np.where(depth > 0, points[np.minimum(begins[first] + begin_depth, max(len(points) - 1, 0))] if len(points) else 0, 0)
    # the parent is the node before, in the same first row, or the prefix that this row shares with the row before
    parent_first = np.where((depth == 1) | (depth - 1 > common[first]), np.where(depth == 1, 0, first), left_of[first])
    step = int(depth.max()) + 1 if count else 1
    parent = np.searchsorted(first * step + depth, parent_first * step + begin_depth)
    parent[depth == 0] = -1
    below = np.searchsorted(first, last, "right")  # subtree: its own place up to this one
    children = np.bincount(parent[1:], minlength=count) if count > 1 else np.zeros(count, np.int64)
    # members that end here come first in the node: a run of equal rows
    same = np.concatenate([[False], (common[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])])
    run_end = np.append(np.nonzero(~same)[0][1:], n)
    ends = np.where(lengths[first] == depth, run_end[np.cumsum(~same)[first] - 1] - first, 0)
    return dict(first=first, last=last, depth=depth, parent=parent, members=members, least=least, points=own_points, below=below, children=children, ends=ends)


def _ids_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _prefix_keys(key: bytes) -> list[bytes]:
    """A key for each prefix of a row, the empty one included."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for k in range(0, len(key), WIDTH):
        h.update(key[k : k + WIDTH])
        out.append(h.copy().digest())
    return out


def _node_rows(block: int, ids: np.ndarray, keys: list[bytes], points: np.ndarray) -> pa.RecordBatch:
    """Closed nodes of a block whole (chain null), and the block's part of the nodes on its first (chain 2 x block) and last row (the one after)."""
    t = block_nodes(ids, keys, points)
    count, n = len(t["first"]), len(ids)
    head, tail = t["first"] == 0, t["last"] == n - 1
    edge = head | tail
    saved = np.where(edge, 0, (t["members"] - 1) * t["points"])
    leaf = np.where(edge, 0, t["children"] == 0).astype(np.int64)

    def total(x: np.ndarray) -> np.ndarray:
        """The sum over each node's subtree, which is a stretch of the preorder."""
        run = np.concatenate([[0], np.cumsum(x)])
        return run[t["below"]] - run[:-1]

    leaves_below, saved_below = total(leaf), total(saved)
    closed_children = np.bincount(t["parent"][~edge], minlength=count) if (~edge).any() else np.zeros(count, np.int64)
    digests = np.full(count, NO_IDS, object)
    for k in np.nonzero((t["ends"] > 0) & ~edge)[0]:
        digests[k] = _ids_digest(ids[t["first"][k] : t["first"][k] + t["ends"][k]])
    chain_of = np.where(head, 2 * block, 2 * block + 1)
    none = np.zeros(0, bool)

    closed = np.nonzero(~edge)[0]
    parent = t["parent"][closed]
    outside = edge[parent] if len(closed) else none
    rows = {
        "conv_id": t["least"][closed],
        "depth": t["depth"][closed],
        "parent_conv_id": pa.array(t["least"][parent], mask=outside),
        "n_convs": t["members"][closed],
        "n_children": t["children"][closed],
        "n_leaves": leaves_below[closed],
        "saved_tokens": saved_below[closed],
        "ends_sha256": pa.array(digests[closed].tolist(), pa.string()),
        "parent_chain": pa.array(chain_of[parent], mask=~outside),
    }
    whole = pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows and not isinstance(rows[f.name], pa.Array) else rows.get(f.name, pa.nulls(len(closed), f.type)) for f in NODES], schema=NODES)

    parts = []
    for side, mine, row in ((0, head, 0), (1, tail, n - 1)):
        names = _prefix_keys(keys[row])
        for k in np.nonzero(mine)[0]:
            d, first = int(t["depth"][k]), int(t["first"][k])
            counted = side == 0 or not head[k]  # a node on both rows is counted on the first one
            part = dict(depth=d, chain=2 * block + side, key=names[d], parent_key=names[d - 1] if d else None, points=int(t["points"][k]), block=block, n_convs=0, n_children=0, n_leaves=0, saved_tokens=0)
            if counted:
                part |= dict(conv_id=int(t["least"][k]), n_convs=int(t["members"][k]), n_children=int(closed_children[k]), n_leaves=int(leaves_below[k]), saved_tokens=int(saved_below[k]))
                if t["ends"][k]:
                    part["end_ids"] = ids[first : first + int(t["ends"][k])].tobytes()
            parts.append(part)
    return pa.Table.from_batches([whole, pa.RecordBatch.from_pylist(parts, NODES)]).combine_chunks().to_batches()[0]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            block, ids, keys, points = (batch.column(c)[k] for c in range(4))
            yield _node_rows(block.as_py(), ids.values.to_numpy(), keys.as_py(), points.values.to_numpy().astype(np.int64))


def _ends(parts: DataFrame) -> DataFrame:
    """(key, ends_sha256): one pass over ids in order of blocks; a digest is a sequence by nature, but never held whole."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for frame in frames:
            done = []
            for k, data in zip(frame["key"], frame["end_ids"]):
                k = bytes(k)
                text = ",".join(map(str, np.frombuffer(bytes(data), np.int64).tolist())).encode()
                if k != key:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(text)
                else:
                    h.update(b"," + text)
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends_sha256"])

    ends = parts.filter("end_ids is not null").select("key", "block", "end_ids")
    return ends.repartition("key").sortWithinPartitions("key", "block").mapInPandas(digest, "key binary, ends_sha256 string")


def prefix_nodes(sequences: DataFrame, block_rows: int = 20_000, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, turns), the empty one included: see the module's docstring."""
    blocks = _blocks(sequences, block_rows, block_bytes)
    found = written(blocks.mapInArrow(_nodes, _ddl(NODES)), "nodes")
    closed, parts = found.filter("chain is null"), found.filter("chain is not null")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    edges = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.max("points").alias("points"), F.min("chain").alias("owner"), *sums)
    edges = written(edges, "edges")
    grown = edges.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("edge_children"))
    edges = edges.join(grown.hint("merge"), "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("edge_children", F.lit(0)))
    edges = written(edges.drop("edge_children"), "edges")

    # each edge node is counted on one chain; a node's sum is that of all chains through it, from its depth downwards
    own = edges.select("key", F.col("conv_id").alias("edge_conv_id"), "owner", ((F.col("n_convs") - 1) * F.col("points")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    chains = parts.select("chain", "depth", "key").join(own.hint("merge"), "key")
    mine = lambda c: F.when(F.col("owner") == F.col("chain"), F.col(c)).otherwise(0)
    down = Window.partitionBy("chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    chains = written(chains.select("chain", "depth", "key", "edge_conv_id", F.sum(mine("saved")).over(down).alias("saved"), F.sum(mine("leaf")).over(down).alias("leaf")), "chains")
    below = chains.groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    parents = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    edge_rows = (
        edges.join(below.hint("merge"), "key")
        .join(_ends(parts).hint("merge"), "key", "left")
        .join(parents.hint("merge"), "parent_key", "left")
        .withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("saved"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_IDS))})
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tops = chains.select(F.col("chain").alias("parent_chain"), (F.col("depth") + 1).alias("depth"), "edge_conv_id")
    hanging = closed.filter("parent_chain is not null").join(tops.hint("merge"), ["parent_chain", "depth"]).withColumn("parent_conv_id", F.col("edge_conv_id"))
    return closed.filter("parent_chain is null").select(columns).unionByName(hanging.select(columns)).unionByName(edge_rows.select(columns))
