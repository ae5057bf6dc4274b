"""Secret scans against a plain search character by character, and planted strings that compression does or doesn't foresee."""

import hashlib
import random
import re

import pytest

from folioscope.llm import registered, secrets

SCHEMA = "doc_id long, text string, kind string, spans int"
WORDS = "configuration value request response session handler account number customer invoice total return import module context parser".split()


def matches(pattern, text, group, least, fold):
    """Leftmost matches that don't overlap, tried at every place."""
    at, out = 0, []
    while at < len(text):
        m = re.compile(pattern, re.A | (re.I if fold else 0)).match(text, at)
        if m is None:
            at += 1
            continue
        if len(m.group(group)) >= least:
            out.append(m.span())
        at = m.end()
    return out


def by_hand(text):
    text = text or ""
    found = [(s, 0, e) for s, e in matches(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, 1, 12, True)]
    found += [(s, 1, e) for s, e in matches(r"AKIA[A-Z0-9]+", text, 0, 18, False)]
    found += [(s, 2, e) for s, e in matches(r"[0-9a-f]+", text, 0, 16, False)]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


def texts():
    r = random.Random(12)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows = [prose(r, 60) for _ in range(30)]
    rows += [f"{prose(r, 5)} token = \"{hexes(40)}\" {prose(r, 5)}", f"API_KEY:{hexes(12)}", f"apikey='{hexes(11)}'", f"é\U0001f600 PassWord=  {hexes(20)} {hexes(15)} {hexes(16)}"]
    rows += ["token: secret: abcdefghijklmnop", "token:password=abcdefghijkl", "token:tokentoken: abcdefghijklmnop", "secret=abcdefghijk", "ſecret=abcdefghijklmno toKen=abcdefghijklmno toKen=abcdefghijklmno"]
    rows += ["AKIA" + "Q" * 14, "AKIA" + "Q" * 13, "xAKIAAKIA" + "Z9" * 9, "AKIA" + "Q" * 30 + "a"]
    rows += [None, "", " ", "a" * 400_000, f"{prose(r, 40_000)} token={hexes(32)}", *["password=samesamesame1"] * 3]
    pieces = ["token", "=", ":", " ", '"', "'", "secret", "ab12cd34ef56", "AKIA", "QQQQQQQQ", "API_KEY", ".", "apikey", "0123456789abcdef", "ß"]
    rows += ["".join(r.choices(pieces, k=14)) for _ in range(400)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts())] + [(None, "token=abcdefghijklmnop", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_base_spans(docs):
    want = sorted((r.doc_id is not None, r.doc_id or 0, by_hand(r.text)) for r in docs.collect())
    base = registered.F.filter("spans", lambda s: s["kind"] != "novel")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.b) for r in secrets.find_secrets(docs).select("doc_id", secrets.joined(base).alias("b")).collect())
    assert got == want


def test_novel_spans_beside_the_base_ones(spark):
    r = random.Random(3)
    odd = "".join(r.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789+/", k=40))
    rows = [prose(r, 80) for _ in range(60)]
    planted = {
        100: (f"{prose(r, 9)}\nAuthorization: Bearer {odd} {prose(r, 9)}", True),
        101: (f"the password is {odd}, do not share. {odd} again", True),
        102: (f"{prose(r, 9)} {odd} {prose(r, 9)}", False),  # no sensitive context
        103: ("bearer configurationvaluerequest " + prose(r, 9), False),  # known identifiers
        104: ("credentials aaaaaaaaaaaaaaaaaaaaaaaaaa", False),
        105: (f"secret: {odd.replace('+', 'x').replace('/', 'y')}", False),  # a base span already
    }
    df = spark.createDataFrame([*enumerate(rows), *((k, t) for k, (t, _) in planted.items())], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secrets.find_secrets(df).collect()}
    for k, (text, novel) in planted.items():
        found = [text[s.start : s.end] for s in got[k] if s.kind == "novel"]
        assert (odd in found) == novel and len(found) <= 1, (k, found)
    assert [s.kind for s in got[105]] == ["assign"]
    assert not any(got[k] for k in range(60))


def test_digest_columns(spark, tmp_path):
    rows = [(1, 'x token = "abcdefghijkl" 0123456789abcdef'), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = registered.op12_secret_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (a.n_assign, a.n_access, a.n_hex, a.spans) == (1, 0, 1, "assign:2:23,hex:25:41")
    assert a.base_sha256 == hashlib.sha256(b"assign:2:23,hex:25:41").hexdigest()
    assert (b.n_assign, b.n_access, b.n_hex, b.spans, b.base_sha256) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_documents(spark):
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
