"""The conversation operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

from folioscope.llm import prefix_trie, structure_repair

SCHEMA = "conv_id long, turn long, role string, text string, depth string, block int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def talks():
    r = random.Random(11)
    rows = []
    for c in [*range(0, 60), *range(100, 160), -3, -120, 305, 1001]:
        for t in range(r.choice([1, 2, 3, 4, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "a", "b", "", "à\U0001f600", None])))
    rows += [(7, None, None, "null turn"), (7, None, "user", None), (8, 1, "user", "a"), (8, 1, "user", "a"), (None, 0, "user", "no id"), (None, None, None, None)]
    rows += [(900 + k, t, "user", "deep") for k in range(5) for t in range(40 + k)]
    rows += [(700, 0, "user", "same"), *((k, 0, "user", "same") for k in range(710, 790))]
    r.shuffle(rows)
    return rows


def crc(text):
    return zlib.crc32(text.encode())


def trie_by_hand(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    for c, v in own.items():
        h = crc(str(c)) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full = own.get(base, [])[:h] + v[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append((c, len(full) == d))
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += children[p] == 0
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    digest = {p: hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in m if e)).encode()).hexdigest() for p, m in members.items()}
    return sorted((least[p], len(p), least[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], digest[p]) for p, m in members.items())


def key(row):
    return tuple((x is not None, x) for x in row)


def test_prefix_trie(spark):
    rows = talks()
    want = sorted(trie_by_hand(rows), key=key)
    sequences = prefix_trie.rebuilt_with_shared_heads(table(spark, rows).repartition(3))
    for block_rows in (1, 2, 7, 20_000):
        got = sorted((tuple(r) for r in prefix_trie.prefix_nodes(sequences, block_rows=block_rows).collect()), key=key)
        assert got == want, block_rows


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_nodes(prefix_trie.rebuilt_with_shared_heads(none)).count() == 0
    turnless = table(spark, [(101, 0, "user", "a")])  # h = 5, its only turn is replaced by turns of a conversation that is absent
    assert crc("101") % 6 > 0
    assert [tuple(r)[:7] for r in prefix_trie.prefix_nodes(prefix_trie.rebuilt_with_shared_heads(turnless)).collect()] == [(101, 0, None, 1, 0, 1, 0)]


def repaired_by_hand(rows):
    """The cheapest edits by trying all of them, place by place, as (cost, audit, lines)."""
    n = len(rows)
    grown = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserts(state):
        yield 0, "", [], state
        for _ in range(2):
            (state,) = [t for t in grown[state] if t != "s"]
            made.append(f"{structure_repair.ROLES[state]}:")
            yield 3 * len(made), "I" * len(made), list(made), state

    best = {(n, s): None for s in "0sua"}
    for i in range(n, -1, -1):
        for state in "0sua":
            found = []
            made = []
            for cost, audit, lines, now in inserts(state):
                if i == n:
                    if now in "0a":
                        found.append((cost, audit, lines))
                    continue
                role, text, fault = rows[i]
                moves = [(4, "D", [], now)]
                if fault not in "BD":
                    extra = 3 * (fault == "T")
                    for t in grown[now]:
                        if role[:1] == t:
                            moves.append((extra, "K", [f"{role}:{text}"], t))
                        if t != "s":
                            moves.append((3 + extra, "R", [f"{structure_repair.ROLES[t]}:{text}"], t))
                for c, letter, line, after in moves:
                    if (rest := best[i + 1, after]) is not None:
                        found.append((cost + c + rest[0], audit + letter + rest[1], lines + line + rest[2]))
            best[i, state] = min(found, key=lambda f: f[:2]) if found else None
    return best[0, "0"]


def audits_by_hand(rows):
    talks = defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        drawn = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        role = "user" if drawn == 4 else role
        text = "" if drawn == 1 else text.translate({ord(x): None for x in ".!?"}) if drawn == 2 else text
        talks[c] += [(t is not None, t or 0, role, text)] * {0: 0, 3: 2}.get(drawn, 1)
    for c, v in talks.items():
        faults, seen = [], set()
        for known, t, role, text in sorted(v):
            body = text.strip(" \t\n\v\f\r")
            faults.append((role, text, "B" if not body else "D" if (role, text) in seen else "T" if body[-1] not in ".!?" else " "))
            seen.add((role, text))
        turns = [t for known, t, *_ in v if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [f[0][:1] for f in faults]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = repaired_by_hand(faults)
        yield (c, gaps, *([f[2] for f in faults].count(x) for x in "BDT"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_structure_repair(spark):
    r = random.Random(13)
    texts = ["Yes.", "No!", "cut", "", " \n", "Why? ", "ok.\t", None, "caf\u00e9"]
    rows = [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts)) for c in range(160) for t in range(r.randint(1, 9))]
    for c in range(160, 200):  # longer ones in order, with a few faults
        rows += [(c, t if t < 5 else t + 2, ("system", "user", "assistant")[0 if t == 0 else 2 - t % 2], f"text {t}." if r.random() < 0.8 else "cut") for t in range(30)]
    rows += [(None, 0, "user", "x."), (None, None, None, None), (900, None, "user", "a."), (900, None, "assistant", "b"), (901, 1, "user", "a."), (901, 1, "user", "a."), (901, 1, "assistant", "a.")]
    r.shuffle(rows)
    df = table(spark, rows)
    got = sorted((tuple(x) for x in structure_repair.audits(structure_repair.damaged(df)).collect()), key=key)
    assert got == sorted(audits_by_hand(rows), key=key)
    assert structure_repair.audits(structure_repair.damaged(df.limit(0))).count() == 0


def test_structure_repair_of_rows_as_they_are(spark):
    df = table(spark, [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (2, 0, "user", "a."), (2, 1, "user", "b.")])
    got = {x.conv_id: (x.cost, x.audit) for x in structure_repair.audits(df).collect()}
    assert got == {1: (6, "IKKI"), 2: (3, "KR")}


def test_alignment_bands_lose_nothing():
    r = random.Random(7)
    for _ in range(400):
        n = r.randint(0, 12)
        initials = "".join(r.choice("suauax ") for _ in range(n))
        faults = "".join(r.choice("  TD") for _ in range(n))
        cost, audit, _ = structure_repair.repair(initials, faults)
        want = repaired_by_hand([({"s": "s", "u": "u", "a": "a"}.get(i, i), "", f) for i, f in zip(initials, faults)])
        assert (cost, audit) == want[:2], (initials, faults)
