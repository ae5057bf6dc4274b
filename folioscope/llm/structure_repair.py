"""Repair of conversations whose turns should read (system)? (user assistant)+, by Wagner-Fischer alignment with the texts of that grammar.

Faulty rows are found first: blank ones, repeats of an earlier row, texts cut off before their last stop. Then the rows are aligned with the target
string of every feasible length (none; ua, uaua, ..; sua, suaua, ..). Every target is one alignment table, filled from the end within Ukkonen's band:
the diagonals that can still lie on a path as cheap as the incumbent, which is the cheapest repair found so far; lengths that can't be that cheap
are left out. The table is walked from the start by the least letter that stays on a cheapest path, which gives the least audit of
that length; audits of lengths of equal cost are compared. Rows that must go are taken out before and put back as early as
possible: deleting them commutes with everything else, and D is the least letter.

Defined results: a null in any column reads as one space in the text, the role and the key that the damage is drawn by; turns that are equal (null ones
too, which come first) follow in order of role, then text; a null conv_id is a conversation of its own; repeated rows are rows like others (the
later one is a duplicate); a role that is neither system, user nor assistant counts by its first letter; an empty table has no rows; other columns,
whatever their names, are left alone. Rows of one conversation are sorted on disk and read one after another; a task keeps the texts of the conversation
that it is reading.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: Costs of the edits, of keeping a cut-off row, and neighbours that are in order.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
IN_ORDER = ("su", "ua", "au")
WHITE = " \t\n\v\f\r"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
FAR = 1 << 40


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after the damage that crc32(conv_id:turn) % 20 deals out; a dropped row stays with no copies, so that
    its conversation is not forgotten."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    drawn = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))) % 20
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), drawn.alias("drawn")).select(
        "conv_id",
        "turn",
        F.when(F.col("drawn") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("drawn") == 0, 0).when(F.col("drawn") == 3, 2).otherwise(1).alias("copies"),
    )


def _targets(most: int) -> list[str]:
    """The texts of the grammar up to a length, shortest first."""
    found = [""] + [head + "ua" * k for k in range(1, most // 2 + 1) for head in ("", "s")]
    return [t for t in found if len(t) <= most]


class _Rows:
    """What an alignment needs of the rows that need not go: initials, and costs beyond those that no repair avoids (3 for each cut-off row)."""

    def __init__(self, initials: str, cut_off: tuple[bool, ...]):
        self.initials, self.cut_off = initials, cut_off
        self.delete = [DELETE - CUT_OFF * c for c in cut_off]
        self.cheapest = np.concatenate([[0], np.cumsum(sorted(self.delete))])
        #: the cost of a row in the place of each of s, u, a: kept, given another role, or impossible
        self.place = np.array([[0 if r == t else (FAR if t == "s" else REROLE) for t in "sua"] for r in initials], np.int64).reshape(-1, 3)

    def at_least(self, surplus: int) -> int:
        """The least cost of a path that inserts (surplus > 0) or deletes so many more than the other."""
        return INSERT * surplus if surplus >= 0 else int(self.cheapest[min(-surplus, len(self.initials))])


def align(rows: _Rows, target: str, limit: int) -> tuple[int, str] | None:
    """(cost, least audit) of turning the rows into the target, or None beyond the limit. Cell (i, j): rows from i on against the target from j on."""
    n, m = len(rows.initials), len(target)
    inside = [k for k in range(-n, m + 1) if rows.at_least(k) + rows.at_least(m - n - k) <= limit]  # the band: diagonals k = j - i
    if not inside:
        return None
    low, width = inside[0], inside[-1] - inside[0] + 1
    diagonals = np.arange(low, low + width)
    letters = np.array(["sua".index(t) for t in target] + [0], np.int64)
    cells = np.full((n + 1, width), FAR, np.int64)
    for i in range(n, -1, -1):
        j = diagonals + i
        valid = (j >= 0) & (j <= m)
        if i == n:
            best = np.where(j == m, 0, FAR)
        else:
            after = cells[i + 1]
            through = np.where(valid & (j < m), after + rows.place[i][letters[np.clip(j, 0, m)]], FAR)
            without = np.concatenate([[FAR], after[:-1]]) + rows.delete[i]
            best = np.minimum(through, without)
        best = np.where(valid, best, FAR)
        # insertions run along the row: a running minimum from the right
        filled = np.minimum.accumulate((best + INSERT * diagonals)[::-1])[::-1] - INSERT * diagonals
        if target[:1] == "s":
            filled = np.where(j == 0, best, filled)  # a system turn is never inserted
        cells[i] = np.where(valid, np.minimum(filled, FAR), FAR)
    cost = int(cells[0, -low]) if low <= 0 < low + width else FAR
    if cost > limit:
        return None
    i, k, audit = 0, -low, []
    while i < n or k + low + i < m:
        j, now = k + low + i, cells[i, k]
        if i < n and k > 0 and cells[i + 1, k - 1] + rows.delete[i] == now:
            audit.append("D")
            i, k = i + 1, k - 1
        elif j < m and k + 1 < width and target[j] != "s" and cells[i, k + 1] + INSERT == now:
            audit.append("I")
            k += 1
        else:
            audit.append("K" if rows.initials[i] == target[j] else "R")
            i += 1
    return cost, "".join(audit)


@lru_cache(maxsize=50_000)
def repair(initials: str, faults: str) -> tuple[int, str, str]:
    """(cost, audit, target) of the cheapest repair. faults: a letter a row, D where it must go, T where it is cut off, else a space."""
    left = [k for k, f in enumerate(faults) if f != "D"]
    rows = _Rows("".join(initials[k] for k in left), tuple(faults[k] == "T" for k in left))
    n = len(left)
    limit = int(rows.cheapest[-1])  # the first incumbent: nothing stays
    targets = [t for t in _targets(n + limit // INSERT + 2) if rows.at_least(len(t) - n) <= limit]
    best: list[tuple[int, str, str]] = []
    for target in sorted(targets, key=lambda t: (rows.at_least(len(t) - n), len(t))):
        if rows.at_least(len(target) - n) > limit:
            break
        found = align(rows, target, limit)
        if found is not None:
            limit = found[0]
            best.append((*found, target))
    cost, audit, target = min(best, key=lambda b: b[:2])
    whole, place = [], 0  # rows that must go are deleted as soon as the rows before them are done
    for letter in [*audit, ""]:
        while place < len(faults) and faults[place] == "D":
            whole.append("D")
            place += 1
        whole.append(letter)
        place += letter in "DKR" and letter != ""
    cost += CUT_OFF * sum(rows.cut_off) + DELETE * (len(faults) - n)
    return cost, "".join(whole), target


class _Conversation:
    """The rows of one conversation in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.seen, self.turns = conv_id, set(), set()
        self.least = self.most = None
        self.lines, self.initials, self.faults = [], [], []

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns.add(turn)
        body = text.rstrip(WHITE)
        fault = "B" if not body else "D" if (role, text) in self.seen else " " if body[-1] in ".!?" else "T"
        self.seen.add((role, text))
        self.lines.append((role, text))
        self.initials.append(role[:1])
        self.faults.append(fault)

    def result(self) -> tuple:
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        illegal = sum(a + b not in IN_ORDER for a, b in zip(self.initials, self.initials[1:]))
        counts = [self.faults.count(f) for f in "BDT"]
        cost, audit, target = repair("".join(i or " " for i in self.initials), "".join("D" if f in "BD" else f for f in self.faults))
        digest, row, place = hashlib.sha256(), 0, 0
        for letter in audit:
            if letter != "D":
                role, text = self.lines[row] if letter in "KR" else ("", "")
                role = role if letter == "K" else ROLES[target[place]]
                digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
                place += 1
            row += letter != "I"
        return (self.conv_id, gaps, *counts, illegal, cost, audit, digest.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(RESULT)], schema=RESULT)

    for batch in batches:
        for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv_id)
            for _ in range(copies):
                now.add(turn, role, text)
        if done:
            yield out()
            done = []
    if now is not None:
        done = [now.result()]
        yield out()


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, perhaps copies): its faults, its cheapest repair, and the digest of what it repairs to."""
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    space = F.lit(" ")
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), copies.alias("copies")
    )
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_repaired, RESULT_DDL)
