"""Token-id files: ids of whole texts, coded by an adaptive context-mixing range coder.

File format (little-endian). A file is a Parquet table of segments (shard, segment, n_tokens, payload); Spark writes it, so a lost
executor's part is written anew. A payload is

    magic "TID2", u32 documents, u64 tokens of the shard before this segment, u32 blocks,
    u8 id bits, 3 zero bytes, per document: i64 doc_id, u8 1 if it is null, u32 tokens; per block: u32 tokens, u32 crc32 of its ids as u32, u32 bytes;
    u32 bytes of the order-0 shares (u32 each, deflated), these; then the blocks' bytes, and a u32 crc32 of all before.

Every block is coded on its own from a fresh model. The model predicts the next id by what last followed the two ids before it (order 2)
or the one before it (order 1), whichever has been right more often; how far both have been right is mixed, in the logistic domain with weights
learned on the way, into the probability that the prediction holds. An id that is not the predicted one is coded, in the same step of the
coder, by its share of the segment's ids (order 0), which stands before the blocks. All arithmetic is on integers.
Many blocks are coded side by side, as rows of numpy arrays.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch
from .tokens import default_path, encoder

BLOCK, SEGMENT, LANES = 1024, 1 << 20, 4096
ONE, TWO, DEPTH = 8, 9, 18  # bits of the tables' sizes, and of an order-0 share
SEGMENTS = "shard int, segment int, n_tokens long, payload binary"


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """squash: (x + 2048) -> 12-bit probability of x / 256; stretch: its inverse."""
    x = np.arange(-2048, 2048)
    squash = np.clip(np.rint(4096 / (1 + np.exp(-x / 256.0))), 1, 4095).astype(np.int32)
    p = np.arange(4096)
    stretch = np.clip(np.rint(256 * np.log((p + 0.5) / (4095.5 - p))), -2047, 2047).astype(np.int32)
    return squash, stretch


SQUASH, STRETCH = _logistic()
#: By trust, and 8 more where the prediction held: the trust that follows, less the trust itself where the id stays known (above 1).
TRUST = np.array([(min(k + 1, 7) if held else k >> 1) - (k if k > 1 else 0) for held in (0, 1) for k in range(8)], np.int32)


class _Coder:
    """Range coder with a 62-bit interval and digits of 32 bits per lane; encodes where data is None, else decodes.

    The interval is at least 2 to the power 30 wide, so that a decision of 12 bits and a share of 18 need one new digit at most. A carry stays in
    the digit before it until all is written.
    """

    def __init__(self, lanes: int, room: int, data: list[bytes] | None):
        self.range = np.full(lanes, (1 << 62) - 1, np.int64)
        self.low = np.zeros(lanes, np.int64)  # when decoding, how far the code lies above it
        self.at = np.zeros(lanes, np.int64)
        self.decoding = data is not None
        if data is None:
            self.digits = np.zeros((lanes, room), np.int64)
        else:
            given = np.zeros((lanes, max(map(len, data), default=0) // 4 + 4), np.int64)
            for i, d in enumerate(data):
                given[i, : len(d) // 4] = np.frombuffer(d, ">u4")
            # the interval ends two bits before the second digit does
            self.digits = ((given[:, :-1] & 3) << 30) | (given[:, 1:] >> 2)
            self.low += (given[:, 0] << 30) | (given[:, 1] >> 2)
            self.at += 1

    def narrow(self, low: np.ndarray, wide: np.ndarray) -> None:
        """Sets the first lanes' intervals, widened by a digit where they are short."""
        n, short = len(low), np.flatnonzero(wide < 1 << 30)
        at, moved = self.at[short], low[short]
        if self.decoding:
            low[short] = (moved << 32) | self.digits[short, at]
        else:
            self.digits[short, at] = moved >> 30
            low[short] = (moved & 0x3FFFFFFF) << 32
        self.at[short] = at + 1
        wide[short] <<= 32
        self.low[:n], self.range[:n] = low, wide

    def finished(self) -> list[bytes]:
        """One digit more lies within the interval; zeros are read behind."""
        lanes = np.arange(len(self.low))
        self.digits[lanes, self.at] = (self.low + 0x3FFFFFFF) >> 30
        digits = self.digits[:, : int(self.at.max(initial=0)) + 1]
        while (carry := digits >> 32).any():
            digits &= 0xFFFFFFFF
            digits[:, :-1] += carry[:, 1:]
        plain = digits.astype(">u4")
        return [plain[i, : self.at[i] + 1].tobytes() for i in lanes]


class Shares:
    """Order-0 shares of several segments, of 2 to the power DEPTH each; even ones without counts."""

    def __init__(self, counts: list[np.ndarray] | None, bits: int, decoding: bool):
        if bits > DEPTH:
            raise ValueError(f"ids of more than {DEPTH} bits")
        even = np.full(1 << bits, 1 << (DEPTH - bits), np.int64)
        count = np.stack(counts if counts is not None else [even]).astype(np.int64)
        start = np.cumsum(count, axis=1) - count
        self.places = (start << 24) | count
        if decoding:
            self.ids = np.zeros((len(count), 1 << DEPTH), np.uint16 if bits <= 16 else np.uint32)
            for row, c in zip(self.ids, count):
                row[: c.sum()] = np.repeat(np.arange(len(c)), c)


def shares_of(ids: np.ndarray, bits: int) -> np.ndarray:
    """Each id's share of 2 to the power DEPTH by its count, at least 1 if it occurs; what is left over goes to the most frequent one."""
    n = np.bincount(ids, minlength=1 << bits)
    c = np.where(n > 0, np.maximum(1, n * ((1 << DEPTH) - np.count_nonzero(n)) // max(1, len(ids))), 0)
    if len(ids):
        c[int(n.argmax())] += (1 << DEPTH) - int(c.sum())
    return c.astype(np.uint32)


class _Model:
    """Prediction and probability of every lane, all from a fresh start; all but the order-0 shares learn on the way."""

    def __init__(self, lanes: int, bits: int, coder: _Coder, shares: Shares, own: np.ndarray):
        self.coder, self.shares, self.own = coder, shares, own
        self.table, self.slots = own << bits, own << DEPTH
        # id and trust (3 bits) of what last followed one id, then two ids
        self.known = np.zeros(lanes * ((1 << ONE) + (1 << TWO)), np.int32)
        self.place = np.stack([np.arange(lanes) << ONE, (lanes << ONE) + (np.arange(lanes) << TWO)])
        # per context (of order 1, of order 2) and lane 32 probabilities of 16 bits
        self.right = np.full(2 * lanes * 32, 1 << 15, np.int32)
        self.context = np.arange(2 * lanes).reshape(2, lanes) * 32
        self.weight = np.full((2, lanes), 33000, np.int32)
        self.before = [np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)]

    def step(self, n: int, ids: np.ndarray | None) -> np.ndarray:
        """Codes the next id of the first n lanes: whether it is the predicted one, and else which, in one step of the coder."""
        coder, known = self.coder, self.known
        one = self.before[0][:n] * np.uint32(0x9E3779B1)
        two = (one ^ (self.before[1][:n] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        at = self.place[:, :n].copy()
        at[0] += one >> np.uint32(32 - ONE)
        at[1] += two >> np.uint32(32 - TWO)
        entry = known.take(at)
        ids_before, trust = entry >> 3, entry & 7
        same = ids_before[0] == ids_before[1]
        # order 2 predicts where it has been right or order 1 has not
        by_two = trust[1] >= trust[0]
        predicted = np.where(by_two, ids_before[1], ids_before[0])
        places = self.context[:, :n] + ((trust << 2) + (same * 2 + by_two))
        p, w = self.right.take(places), self.weight[:, :n]
        s = STRETCH.take(p >> 4)
        voted = s * w
        mixed = SQUASH.take(((voted[0] + voted[1]) >> 16) + 2048, mode="clip")
        low, wide = coder.low[:n], coder.range[:n]
        edge = (wide >> 12) * mixed
        unit = (wide - edge) >> DEPTH
        if ids is None:
            hit = low < edge
            out = np.where(hit, predicted, self.shares.ids.take(self.slots[:n] + (low - edge) // unit, mode="clip")).astype(np.int32, copy=False)
        else:
            out = ids[:n]
            hit = predicted == out
        share = self.shares.places.take(self.table[:n] + out)
        lower = np.where(hit, 0, edge + unit * (share >> 24))
        coder.narrow(low - lower if ids is None else low + lower, np.where(hit, edge, unit * (share & 0xFFFFFF)))
        held = hit.astype(np.int32)
        w += (s * ((held << 12) - mixed)) >> 10
        self.right[places] = p + ((held * 65535 - p) >> 5)
        known[at] = np.where(trust > 1, entry, out << 3) + TRUST.take(trust | ((ids_before == out) << 3))
        self.before.reverse()
        self.before[0][:n] = out
        return out


def encode_blocks(blocks: list[np.ndarray], bits: int, counts: list[np.ndarray] | None = None, owner: list[int] | None = None) -> list[bytes]:
    """Codes every block of ids (uint32, below 2 to the power bits); block i by the order-0 shares counts[owner[i]], by even ones where there are none."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    shares = Shares(counts, bits, False)
    for at in range(0, len(order), LANES):
        own = order[at : at + LANES]
        lengths = np.array([len(blocks[i]) for i in own])
        ids = np.zeros((int(lengths.max()), len(own)), np.int32)
        for k, i in enumerate(own):
            ids[: lengths[k], k] = blocks[i]
        coder = _Coder(len(own), int(lengths.max()) + 4, None)
        model = _Model(len(own), bits, coder, shares, np.array([owner[i] if owner else 0 for i in own]))
        for t in range(len(ids)):
            model.step(int(np.searchsorted(-lengths, -t)), ids[t])
        for i, data in zip(own, coder.finished()):
            out[i] = data
    return out


def decode_blocks(data: list[bytes], lengths: list[int], bits: int, counts: list[np.ndarray] | None = None, owner: list[int] | None = None) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(data)
    order = sorted(range(len(data)), key=lambda i: -lengths[i])
    shares = Shares(counts, bits, True)
    for at in range(0, len(order), LANES):
        own = order[at : at + LANES]
        n = np.array([lengths[i] for i in own])
        ids = np.zeros((int(n.max()), len(own)), np.uint32)
        model = _Model(len(own), bits, _Coder(len(own), 0, [data[i] for i in own]), shares, np.array([owner[i] if owner else 0 for i in own]))
        for t in range(len(ids)):
            k = int(np.searchsorted(-n, -t))
            ids[t, :k] = model.step(k, None)
        for k, i in enumerate(own):
            out[i] = np.ascontiguousarray(ids[: n[k], k])
    return out


def _segment(docs: list[tuple[int | None, bytes]], before: int, coded: list[bytes], blocks: list[np.ndarray], bits: int, counts: np.ndarray | None = None) -> bytes:
    head = [b"TID2", struct.pack("<IQIBxxx", len(docs), before, len(blocks), bits)]
    head += [struct.pack("<qBI", d or 0, d is None, len(ids) // 4) for d, ids in docs]
    head += [struct.pack("<III", len(b), zlib.crc32(b.astype("<u4").tobytes()), len(c)) for b, c in zip(blocks, coded)]
    table = b"" if counts is None else zlib.compress(counts.astype("<u4").tobytes(), 1)
    head += [struct.pack("<I", len(table)), table]
    payload = b"".join(head + coded)
    return payload + struct.pack("<I", zlib.crc32(payload))


class _Read:
    """A payload's documents and blocks."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"TID2" or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("damaged segment")
        n, self.before, blocks, self.bits = struct.unpack_from("<IQIBxxx", payload, 4)
        at = 4 + struct.calcsize("<IQIBxxx")
        self.docs = [struct.unpack_from("<qBI", payload, at + 13 * k) for k in range(n)]
        at += 13 * n
        self.blocks = [struct.unpack_from("<III", payload, at + 12 * k) for k in range(blocks)]
        at += 12 * blocks
        (size,) = struct.unpack_from("<I", payload, at)
        at += 4 + size
        self.counts = np.frombuffer(zlib.decompress(payload[at - size : at]), "<u4") if size else None
        self.coded = []
        for _, _, size in self.blocks:
            self.coded.append(payload[at : at + size])
            at += size

    def joined(self, blocks: list[np.ndarray]) -> bytes:
        parts = [ids.astype("<u4").tobytes() for ids in blocks]
        for (n, crc, _), part in zip(self.blocks, parts):
            if len(part) != 4 * n or zlib.crc32(part) != crc:
                raise ValueError("damaged block")
        return b"".join(parts)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1, bits: int = 16) -> None:
    """Writes the ids of all documents, and end_id after each, in ascending doc_id order (null first, ties by text)."""
    tokenizer = tokenizer_path or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, shard = encoder(tokenizer), TaskContext.get().partitionId()
        segments: list[list[tuple[int | None, bytes]]] = [[]]
        held, own, written, serial = 0, 0, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal segments, held, own, written, serial
            parts = []
            for docs_ in segments:
                ids = np.frombuffer(b"".join(x for _, x in docs_), "<u4")
                if len(ids) and int(ids.max()) >> bits:
                    raise ValueError(f"an id needs more than {bits} bits")
                parts.append([ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK)])
            counts = [shares_of(np.concatenate(p), bits) for p in parts]
            coded = iter(encode_blocks([b for p in parts for b in p], bits, counts, [k for k, p in enumerate(parts) for _ in p]))
            rows = []
            for docs_, blocks, c in zip(segments, parts, counts):
                n = sum(map(len, blocks))
                rows.append((shard, serial, n, _segment(docs_, written, [next(coded) for _ in blocks], blocks, bits, c)))
                serial, written = serial + 1, written + n
            segments, held, own = [[]], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["shard", "segment", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py()) + end
                if own >= SEGMENT:
                    if held >= LANES * BLOCK:
                        yield out()
                    else:
                        segments.append([])
                        own = 0
                segments[-1].append((doc_id, ids))
                own, held = own + len(ids) // 4, held + len(ids) // 4
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text").mapInArrow(run, SEGMENTS).write.parquet(path)


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; checksums are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple[int, _Read]]) -> pa.RecordBatch:
            bits = held[0][1].bits
            owner = [k for k, (_, r) in enumerate(held) for _ in r.blocks]
            blocks = iter(decode_blocks([c for _, r in held for c in r.coded], [n for _, r in held for n, _, _ in r.blocks], bits, [r.counts for _, r in held], owner))
            rows = []
            for shard, r in held:
                data, at = r.joined([next(blocks) for _ in r.blocks]), 0
                for doc_id, missing, n in r.docs:
                    rows.append((shard, None if missing else doc_id, r.before + at, n, zlib.crc32(data[4 * at : 4 * (at + n)])))
                    at += n
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 4))], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

        held: list[tuple[int, _Read]] = []
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((shard, _Read(payload.as_py())))
                if sum(len(r.blocks) for _, r in held) >= LANES:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    decoded = files.select("shard", "payload").mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row per shard, of which there are as many as the writing job had tasks
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    return decoded.join(F.broadcast(shards.select("shard", "first")), "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the files to the shared folder and describes every document as read back from them.

    A null or empty text is end_id alone; repeated doc_ids are documents of their own; an empty table gives no rows; other
    columns are ignored.
    """
    path = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_path, end_id)
    return read_ids(docs.sparkSession.read.schema(SEGMENTS).parquet(path))
