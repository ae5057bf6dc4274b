"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small tables with the awkward cases:
nulls in any column, empty and very long texts, ties, repeated rows, empty tables, columns named like the results."""

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, html_text, jaccard_join, katz, neighbours, packing, suffix_dedup, token_files, tokens, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, verdict string, spans int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def corpus():
    """Invented documents: copies, near copies, shared passages, blank, short and long ones."""
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage = text(60)
    near = text(120).split()
    rows = [text(r.randint(1, 150)) for _ in range(40)]
    rows += [rows[3], rows[3], rows[3].upper() + "\n"]
    for k in range(12):  # near copies: a few words changed
        w = list(near)
        for _ in range(k // 2):
            w[r.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    rows += [f"{text(30)} {passage} {text(20)}" for _ in range(9)]
    rows += [None, "", " \t\n", "one", "two words", "two words", text(30_000), "a " * 500]
    return rows


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(k, t, "en" if k % 3 else None, "s", None if t is None else len(t), "x", "y", 1) for k, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(None, "no id here", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)], DOCS)
    return table(spark, corpus()).unionByName(odd).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_token_files_round_trip(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    encode = tokens.encoder(tokens.default_path())
    want = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(encode(r.text) + b"\x01\0\0\0"), len(encode(r.text)) // 4 + 1) for r in rows)
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and got[0].doc_id is None
    assert token_files.round_trip(empty).count() == 0


def test_range_coder_blocks():
    r = np.random.default_rng(3)
    blocks = [np.zeros(0, np.uint32), np.array([65535], np.uint32), np.full(900, 7, np.uint32), r.integers(0, 50_000, 700).astype(np.uint32), np.tile(np.arange(40, dtype=np.uint32), 30)]
    coded = token_files.encode_blocks(blocks, 16)
    for a, b in zip(blocks, token_files.decode_blocks(coded, [len(b) for b in blocks], 16)):
        assert (a == b).all() and len(a) == len(b)
    assert len(coded[2]) < 60 and len(coded[4]) < 700  # what repeats costs little


def test_coder_takes_a_step_a_token(monkeypatch):
    """An id costs one step of the range coder, whatever its bits, and shares of the segment shorten the blocks."""
    r = np.random.default_rng(4)
    ids = np.minimum(r.geometric(0.01, 3000), 49_000).astype(np.uint32) * 41 % 49_157
    blocks, calls = [ids[:1500], ids[1500:]], []
    narrow = token_files._Coder.narrow
    monkeypatch.setattr(token_files._Coder, "narrow", lambda *a: (calls.append(1), narrow(*a))[1])
    shares = [token_files.shares_of(ids, 16)]
    coded = token_files.encode_blocks(blocks, 16, shares, [0, 0])
    assert len(calls) == 1500
    assert all((a == b).all() for a, b in zip(blocks, token_files.decode_blocks(coded, [1500, 1500], 16, shares, [0, 0])))
    assert sum(map(len, coded)) < 0.7 * sum(map(len, token_files.encode_blocks(blocks, 16)))


def test_coder_passes_carries_on():
    """Long runs of either decision drive low up to the edge of a digit, so that carries run over several digits."""
    r = np.random.default_rng(6)
    blocks = [(r.integers(0, 2, 2000) * 65535).astype(np.uint32) if k % 2 else r.integers(65_000, 65_536, 2000).astype(np.uint32) for k in range(300)]
    shares, owner = [token_files.shares_of(np.concatenate(blocks[k::3]), 16) for k in range(3)], [k % 3 for k in range(300)]
    coded = token_files.encode_blocks(blocks, 16, shares, owner)
    assert all((a == b).all() for a, b in zip(blocks, token_files.decode_blocks(coded, [2000] * 300, 16, shares, owner)))


def test_token_file_damage_is_found():
    ids = np.arange(50, dtype=np.uint32)
    payload = token_files._segment([(1, ids.tobytes())], 0, token_files.encode_blocks([ids], 16), [ids], 16)
    assert token_files._Read(payload).docs == [(1, 0, 50)]
    with pytest.raises(ValueError):
        token_files._Read(payload[:-9] + bytes([payload[-9] ^ 1]) + payload[-8:])


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path())
    encode = tokens.encoder(tokens.default_path())
    assert set(".,&$#%*") <= set(tokens._known[tokens.default_path()].tail)
    for text in ["wh,&&& atndti$$$ été### Ça%%%. a!? b.,. &&& ***x x***y 日本&&", "", "It's <|endoftext|> e.g., ÀÉ. ß", "日本 語\n\tab\u0301c\u2003x\x1cy", *[t for t in corpus() if t]]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block_rows", [2, 1024])
def test_nearest_neighbours_with_products_beyond_doubles(spark, block_rows):
    big = [[1e200, 0.0], [1e200, 1.0], [1.0, 1.0], [-1e200, 1e200], [1e200, 1e200], [1e308, 1e308], [-1e308, 1e308], [1e-200, 1e-200], [1e-308, 0.0], [3.0, -2.0], [0.0, 1e-160], [5e-324, 1.0]]
    vectors = [(k, v) for k, v in enumerate(big * 2)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in neighbours.nearest(df, F.col("vec_id") >= 0, k=6, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, str(x.score)))
    for q, v in vectors:
        every = [(0.0 + v[0] * w[0] + v[1] * w[1], i) for i, w in vectors if i != q]
        every.sort(key=lambda e: (not math.isnan(e[0]), 0.0 if math.isnan(e[0]) else -e[0], e[1]))
        assert got[q] == [(i, str(s)) for s, i in every[:6]], q


def test_nearest_neighbours(spark):
    r = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in r.normal(size=6)]) for k in range(120)]
    vectors[40] = (40, list(vectors[20][1]))  # a tie
    vectors += [(None, [1.0] * 6), (200, None), (220, [0.0] * 6), (240, [1.0, None] + [0.0] * 4), (260, [float("nan")] * 6), (20, vectors[20][1]), (280, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for x in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, block_rows=16).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    usable = {i: v for i, v in vectors[:120] if any(v)}
    for q in (i for i in usable if i % 20 == 0):
        every = sorted(((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q))[:5]
        assert [(k, i) for k, (_, i) in enumerate(every, 1)] == [(k, i) for k, i, _ in got[q]]
        assert np.allclose([-s for s, _ in every], [s for *_, s in got[q]])
    assert set(got) == {i for i in usable if i % 20 == 0}
    assert neighbours.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_url_filters(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), (None, "/", "block"), ("org", None, "block")]
    urls = ["http://example.com/en/x", "http://WWW.example.com/en/x?q#f", "http://a.www.example.com/en/", "http://notexample.com/en/", "https://x.net/es/1", "http://net/fr/", "http://example.com", "http://example.com?/en/", "nothing", "", None, "x://com./", "http://a.org#x", "http://example.com/en/x"]
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    rule_table = spark.createDataFrame(rules, "host string, path string, verdict string")
    valid = [(h, p or "", v) for h, p, v in rules if h and (h, p, v) != ("net", "/es/", "allow")]
    for row in url_filters.judge_urls(df, rule_table, salts=3).collect():
        m = re.match(r"^.*?://([^/?#]*)([^?#]*)", row.url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), h + p, v) for h, p, v in valid if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, None, "allow")
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, want[1], want[2]), row
    assert url_filters.judge_urls(df, rule_table, salts=3).count() == len(urls)
    assert url_filters.judge_urls(df.filter("false"), rule_table).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(df, rule_table.filter("false"), salts=2).collect()} == {"allow"}


def test_quantised_products_of_long_vectors_are_exact():
    r = np.random.default_rng(4)
    q, v = (r.integers(100, 128, (3, 5000)).astype(np.float32) for _ in range(2))
    assert (neighbours._exact_product(q, v) == q.astype(np.int64) @ v.astype(np.int64).T).all()


def test_html_extraction(spark):
    body = "The quick fox of the wood and the owl were in the tree for a day. " * 3
    page = (
        f"<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Home</a></ul></nav>"
        f"<div class='cookie-notice'>{body}</div><article><header><h1>A &amp; B&nbsp;title</h1></header><p>{body}<br>And   <b>bo</b>ld\n end.<p>Short.<aside>{body}</aside></article>"
        f"<section id=comments><article class=comment><p>{body}</p></article></section><form><p>{body}</p></form><footer>{body}</footer>"
    )
    text = " ".join(body.split())
    assert html_text.main_text(page) == f"A & B title {text} And bold end. Short."
    plain = f"<div><p>{body}</p><p>tiny</p><p>{body}</p></div><ul class=menu><li><a>one</a></li></ul><p>tail"
    assert html_text.main_text(plain) == f"{text} tiny {text}"
    pages = spark.createDataFrame([(1, "u", None, 3), (None, None, "", 3), (2, "u", page, 3), (2, "u", page, 3), (3, None, "<p>" * 20_000, 3)], "page_id long, url string, html string, n_chars int")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 5 and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text != "" for r in rows) == 2 and html_text.extract(pages.filter("false")).count() == 0


PROSE = "The quick fox of the wood and the owl were in the tree for a day and it was good. " * 2


@pytest.mark.parametrize(
    "inner",
    [
        "<p title='it's'>{0}</p><p>{0}</p><p>It's {0}</p>",
        "<p>{0}</p><button>{1}<p>{0}</p><p>{0}</p>",
        "<p>{0}</p><svg><p>{0}</p><select><option><p>{0}</p>",
        "<p>{0}</p><p><a href='/x'>{0}</a></p><p>{0}</p>",
        "<div class='notice-body'><p>{0}</p></div><div class='shareable tagsoup'><p>{0}</p></div><p>{0}</p>",
        "<p>{0}</p><p>so <math><mi>x</mi></math> it is</p><p>{0}</p>",
    ],
)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div>{}</div></main>"])
def test_html_keeps_the_whole_article(inner, around):
    page = "<html><body><nav><a href=/>Home</a></nav>" + around.format(inner.format(PROSE, "")) + "<footer>The end of the site and the rest.</footer></body></html>"
    want = " ".join(re.sub("<[^>]*>", " ", inner.format(PROSE, "").replace("='it's'", "")).split())
    assert " ".join(html_text.main_text(page).split()) == want


@pytest.mark.parametrize("name", ["search-methods", "copyright-law", "social-history", "related-work", "cookie_recipes", "informed-consent", "menu-planning"])
def test_html_names_that_only_may_mark_boilerplate(name):
    inside = f"<article><h1>Title</h1><p>{PROSE}</p><div class='{name}'><h2>Part</h2><p>{PROSE}</p></div></article>"
    assert html_text.main_text(inside) == " ".join(["Title", PROSE.strip(), "Part", PROSE.strip()])
    for marked in ("search-box", "social share-buttons", "cookie-notice", "related-posts", "comments-area", "sponsored"):
        assert html_text.main_text(inside.replace(name, marked)) == f"Title {PROSE}".strip()


def test_html_text_beside_a_teaser():
    page = f"<article><p>{PROSE}</p></article><div><p>{PROSE} one</p><p>{PROSE} two</p></div><footer>{PROSE}</footer>"
    assert html_text.main_text(page) == " ".join(f"{PROSE} {PROSE} one {PROSE} two".split())


@pytest.mark.parametrize("piece", ["<div></p></section>", "<button>", "<div></span></ul>", "<svg><div>", "<select></article>", "<div><section></main>"])
def test_html_of_broken_pages_takes_time_in_proportion(piece):
    import time

    page = f"<p>{PROSE}</p>" + piece * (2_000_000 // len(piece))
    began = time.process_time()
    text = html_text.main_text(page)
    assert time.process_time() - began < 12 and text.startswith(PROSE.strip())
    closed = page + "</button></svg></select>"
    began = time.process_time()
    html_text.main_text(closed)
    assert time.process_time() - began < 12


def test_html_neighbours_decide_on_short_blocks():
    long, low = " ".join(PROSE.split()), "zq vx " * 30
    page = f"<div><h2>Title</h2><p>{long}</p><p>short</p><p>{long}</p></div><div><p>{low}</p><p>alone</p><p>{low}</p></div>"
    assert html_text.main_text(page) == f"Title {long} short {long}"
    inside = f"<article><h1>Title</h1><p>{low}</p><p>{long}</p><ul class=share><li>x</ul><p>short</p></article><div><p>{long}</p></div>"
    assert html_text.main_text(inside) == f"Title {low.strip()} {long} short"
    nothing = "<article><p>a</p><p>b</p></article>"
    assert html_text.main_text(nothing) == "a b"


def test_decontamination(spark, docs, empty):
    r = random.Random(2)
    items = [" ".join(r.choices([f"v{k}" for k in range(200)], k=n)) for n in (12, 20, 20, 33)] + [items_text for items_text in ("too short", None, "")]
    edited = items[3].split()
    edited[0] = edited[-1] = "edge"
    leaks = [f"pre {items[0].upper()} post", items[1], "x " + " ".join(edited), "y " + " ".join(items[2].split()[:10]), f"{items[1]} {items[2]}"]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(leaks)], "doc_id long, text string"))
    item_table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(every, item_table).collect()}
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    want = {}
    for row in every.collect():
        w = words(row.text)
        if len(w) > 1000:
            continue
        for i, item in enumerate(items):
            own = shingles(words(item))
            n = min(len(words(item)), len(w))
            best = 0
            for k in range(len(w) - n + 1):
                x = shingles(w[k : k + n])
                if own and x:
                    best = max(best, sum((x & own).values()) / sum((x | own).values()))
            if best >= 0.8:
                want[row.doc_id, i] = best
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) == 5
    assert decontaminate.contaminated(empty, item_table).count() == 0
    assert decontaminate.contaminated(docs, item_table.filter("false")).count() == 0


def test_simhash_lookup_finds_all_within_the_radius():
    r = np.random.default_rng(4)
    items = [(k, r.integers(1, 1 << 60, 20).astype(np.uint64)) for k in range(60)]
    index = decontaminate.Index(items, 5, 80, 20)
    prints = np.concatenate([index.prints ^ np.uint64(0b1011 << k) for k in range(3)] + [r.integers(0, 1 << 63, 40).astype(np.uint64)])
    want = sorted((a, b) for a in range(len(prints)) for b in range(len(items)) if int(prints[a] ^ index.prints[b]).bit_count() <= 20)
    assert index.near(prints, index.by_size[16]) == want


def test_packing(docs, empty):
    rows = packing.pack(docs, capacity=64, window_tokens=3000).collect()
    encode = tokens.encoder(tokens.default_path())
    want = Counter(zlib.crc32(encode(r.text) + b"\x02\0\0\0") for r in docs.collect())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
    texts = {r.doc_id: r.text for r in docs.filter("doc_id is not null").collect()}
    for doc_id, pieces in by_doc.items():
        if doc_id is None:
            continue
        ids, at = encode(texts[doc_id]) + b"\x02\0\0\0", 0
        for x in sorted(pieces, key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids) // 4 and x.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + x.length)])
            at += x.length
        assert at == len(ids) // 4
    for pieces in by_sequence.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 64
    assert sum(want.values()) == docs.count() and packing.pack(empty).count() == 0


def test_packing_balances_cost_and_pads_little():
    lengths = np.array([5000, 4096, 1, *random.Random(1).choices(range(1, 3000), k=400)])
    pieces = packing.deal(lengths, 4096)
    used = Counter()
    for _, _, n, sequence, _ in pieces:
        used[sequence] += n
    assert sum(used.values()) == lengths.sum() and 4096 * len(used) - lengths.sum() < 4096


@pytest.mark.parametrize("seed", range(4))
def test_packing_takes_the_cheapest_sequence_with_room(seed):
    """The dealing by heaps against a search of all sequences for each document."""
    r = random.Random(seed)
    lengths = np.array(r.choices([*range(1, 900), 1000, 1000, 2500, 4095], k=300))
    left = sorted(((-int(n), i) for i, n in enumerate(lengths)))
    bins = [[0.0, k, 4096] for k in range(-(-int(lengths.sum()) // 4096))]
    want = []
    for n, i in left:
        n, start = -n, 0
        while n:
            fits = [b for b in bins if b[2] >= n]
            b = min(fits) if fits else min(bins, key=lambda b: (-b[2], b[1]))
            m = min(n, b[2])
            want.append((i, start, m, b[1], 4096 - b[2]))
            b[0], b[2] = b[0] + m + m * m / 1024, b[2] - m
            start, n = start + m, n - m
    assert packing.deal(lengths, 4096) == want


def test_suffix_dedup(docs, empty):
    found = suffix_dedup.repeated_passages(docs).collect()
    texts = {r.doc_id: words(r.text) for r in docs.filter("doc_id is not null").collect()}
    want, seen = defaultdict(set), {}
    for i in sorted(texts):
        own = {}
        for k in range(len(texts[i]) - 49):
            h = tuple(texts[i][k : k + 50])
            if h in seen:
                want[i].update(range(k, k + 50))
            own.setdefault(h, i)
        seen.update({h: i for h in own if h not in seen})
    got = {x.doc_id: {k for s in x.spans for k in range(s.start, s.end)} for x in found}
    assert got == {i: w for i, w in want.items() if w}
    left = suffix_dedup.cut(docs, suffix_dedup.repeated_passages(docs))
    assert left.columns == docs.columns
    kept = {r.doc_id: r.text for r in left.collect() if r.doc_id is not None}
    before = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert all(kept[i] == before[i] for i in before if i not in got)
    assert all(i not in kept or words(kept[i]) == [w for k, w in enumerate(texts[i]) if k not in got[i]] for i in got)
    assert suffix_dedup.repeated_passages(empty).count() == 0


def marked_words(rows, least=50):
    """{doc_id: places} of the words in windows that a smaller doc_id has too, by brute force; rows: (doc_id, words)."""
    want, seen = defaultdict(set), {}
    for i, text in sorted(rows):
        windows = [tuple(text[k : k + least]) for k in range(len(text) - least + 1)]
        for k, w in enumerate(windows):
            if seen.get(w, i) < i:
                want[i].update(range(k, k + least))
        for w in windows:
            seen.setdefault(w, i)
    return dict(want)


def found_words(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return {x.doc_id: {k for s in x.spans for k in range(s.start, s.end)} for x in suffix_dedup.repeated_passages(df).collect()}


def test_suffix_dedup_hot_ending(spark):
    """Pairs of documents share a passage that ends in a line which all documents have."""
    r = random.Random(11)
    text = lambda n: " ".join(f"v{r.randrange(100_000)}" for _ in range(n))
    line, texts = text(8), []
    for _ in range(150):
        shared = f"{text(42)} {line}"
        texts += [f"{text(5)} {shared} {text(40)}" for _ in range(2)]
    r.shuffle(texts)
    assert found_words(spark, texts) == marked_words([(i, t.split()) for i, t in enumerate(texts)])


def test_suffix_dedup_exact_width(spark):
    """Passages of exactly 50 words, whose lowest gram lies at every offset."""
    from folioscope.llm.shingles import rolling
    from folioscope.llm.wordhash import hashed_words

    r = random.Random(12)
    text = lambda n: [f"v{r.randrange(100_000)}" for _ in range(n)]
    passages = {}
    while len(passages) < 43:
        words = text(50)
        low = int(rolling(hashed_words(pa.array([" ".join(words)]))[0], 8).argmin())
        passages.setdefault(low, words)
    rows = [text(5) + words + text(5) for words in passages.values() for _ in range(2)]
    assert found_words(spark, map(" ".join, rows)) == marked_words(enumerate(rows)) == {2 * k + 1: set(range(5, 55)) for k in range(43)}


def test_suffix_dedup_of_nested_and_periodic_passages(spark):
    """Passages of one source cut at all lengths, periodic texts, and words that recur within a window."""
    r = random.Random(14)
    source = [f"s{r.randrange(40)}" for _ in range(160)]
    filler = lambda n: [f"f{r.randrange(10**6)}" for _ in range(n)]
    rows = [filler(3) + source[a : a + n] + filler(4) for a, n in ((r.randrange(60), r.randint(45, 100)) for _ in range(40))]
    rows += [source, ["x", "y"] * 40, ["y", "x"] * 33 + filler(5), ["x"] * 120, filler(2) + ["x"] * 51, ["x", "y", "z"] * 30]
    r.shuffle(rows)
    assert found_words(spark, map(" ".join, rows)) == marked_words(enumerate(rows))


def test_neighbours_of_suffixes_at_every_width():
    """Least doc_ids by suffix order against a comparison of all pairs."""
    r = random.Random(15)
    least, gram = 12, 3
    text = [r.randrange(3) for _ in range(300)]
    low, high, texts, first = [], [], [], []
    for k in range(120):
        at, a, b = r.randrange(20, 270), r.randint(0, 9), r.randint(0, 9)
        a, b = min(a, b), max(a, b)
        low.append(a)
        high.append(b)
        texts.append(np.array(text[at - b : at - a + least], np.uint32).tobytes())
        first.append(r.randrange(50))
    got = suffix_dedup.compared_neighbours(np.array(low), np.array(high), texts, np.array(first), least, gram)
    window = lambda i, width: texts[i][4 * (high[i] - width) : 4 * (high[i] - width + least)]
    for i in range(120):
        for width in range(low[i], high[i] + 1):
            assert got[i, width] == min(first[j] for j in range(120) if low[j] <= width <= high[j] and window(j, width) == window(i, width))


def test_suffix_dedup_has_no_single_task(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(60))) for k in range(3)], "doc_id long, text string")
    assert "Coalesce 1" not in suffix_dedup.repeated_passages(df)._jdf.queryExecution().toString()


def linked(rows):
    """doc_id -> (size of its shingle set, least doc_id reachable), by brute force."""
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def joined(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df, **more).collect()}


def test_jaccard_join(docs, empty):
    more = docs.unionByName(docs.filter("doc_id in (3, 45)"))  # repeated rows
    assert joined(more) == linked(docs.filter("doc_id is not null").collect())
    assert jaccard_join.similar_components(empty).count() == 0


#: Tables in which nothing, or nothing but copies, repeats.
PLAIN = {
    "one": ["a b c d e f g h"],
    "two unrelated": ["a b c d e f g h", "i j k l m n o p"],
    "blank, short and long": [None, " ", "one", " ".join(f"x{k}" for k in range(5000))],
    "two equal": ["a b c d e f g h", "A b c  d e f g h"],
    "two equal and one": ["a b c d e f g h", "a b c d e f g h", " ".join(f"y{k}" for k in range(200))],
    "long equal": [" ".join(f"z{k}" for k in range(120))] * 3,
}


@pytest.mark.parametrize("case", sorted(PLAIN))
def test_tables_without_repeats(spark, case):
    df = table(spark, PLAIN[case])
    assert joined(df) == linked(df.collect())
    texts = [words(t) for t in PLAIN[case]]
    repeats = {k for k, w in enumerate(texts) if len(w) >= 50 and w in texts[:k]}
    assert {r.doc_id for r in suffix_dedup.repeated_passages(df).collect()} == repeats


def test_jaccard_join_of_groups_near_the_threshold(spark):
    """Groups of near copies larger than a long posting list, some pairs of which are similar and some just not."""
    r = random.Random(11)
    texts = []
    for _ in range(3):
        base = [f"b{r.randrange(10**6)}" for _ in range(r.choice([40, 90, 140]))]
        for k in range(60):
            w = list(base[: len(base) - k % 7])
            for _ in range(k % 6):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w))
    df = table(spark, texts).repartition(7)
    want = linked(df.collect())
    assert len({c for _, c in want.values()}) > 5
    assert joined(df) == joined(df, pivots=1) == want


def test_longer_prefixes_where_candidates_are_many():
    assert jaccard_join.matches(200, np.ones(200), 80) == 1
    assert jaccard_join.matches(200, np.full(200, 50.0), 80) > 1


def test_components(spark):
    from folioscope.llm.common import components

    links = [(k, k + 1) for k in range(30)] + [(100, 50), (50, 75), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 75: 50, 100: 50}


def test_katz_backoff(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    rows = katz.score(docs, held).collect()
    texts = [(r.doc_id, words(r.text) + ["</s>"]) for r in docs.collect()]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c1, c2 = Counter(), Counter()
    for i, w in texts:
        if not is_held(i):
            c1.update(w)
            c2.update(zip(["</s>", *w], w))
    total = sum(c1.values())
    kinds = lambda c: [0] + [sum(v == r for v in c.values()) for r in range(1, 7)]
    d1, d2 = (katz.Discounts.good_turing(kinds(c)) for c in (c1, c2))
    weight = lambda d, n: float(d.of(np.array([n]))[0])
    left = max(sum((1 - d1.d[r]) * r * kinds(c1)[r] for r in range(1, 6)), 0.5) / total
    p1 = lambda w: weight(d1, c1[w]) * c1[w] / total if c1[w] else left
    after = defaultdict(list)
    for (h, w), n in c2.items():
        after[h].append((w, n))

    def p(h, w):
        if not c1[h]:
            return p1(w)
        spared = sum((1 - weight(d2, n)) * n for _, n in after[h])
        by, spared = (c1[h], spared) if spared > 1e-12 else (c1[h] + 1, 1.0)
        return weight(d2, c2[h, w]) * c2[h, w] / by if c2[h, w] else spared / by / (1 - sum(p1(x) for x, _ in after[h])) * p1(w)

    for h in ["</s>", "w1", *list(after)[:3]]:  # exactly normalised
        assert abs(sum(p(h, w) for w in c1) + p(h, "never met") - 1) < 1e-9 or not c1[h]
    cached, seen = {}, functools.lru_cache(None)(p)
    for i, w in texts:
        base = sum(math.log10((c1[x] + 0.1) / (total + 0.1 * (len(c1) + 1))) for x in w)
        cached[i, len(w)] = sum(math.log10(seen(h, x)) for h, x in zip(["</s>", *w], w)), base, sum(c1[x] > 0 for x in w)
    checked = 0
    for r in rows:
        assert r.train_tokens == total and r.held_out == is_held(r.doc_id)
        if (r.doc_id, r.n_tokens) in cached and r.doc_id is not None:
            score, base, known = cached[r.doc_id, r.n_tokens]
            assert math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_known == known
            checked += 1
    assert len(rows) == len(texts) and checked > 60 and katz.score(empty, held).count() == 0


def test_toxicity(spark, empty):
    r = random.Random(8)
    vocabulary = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(500):
        w = r.choices(vocabulary, k=r.randint(5, 80))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["nasty", "vile", "zzap" + r.choice("abcdefgh")])
        rows.append((k, " ".join(w), "en"))
        labels.append((k, int(toxic)))
    rows += [(None, None, None), (900, "", "xx"), (901, "vile " * 20_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    scored = toxicity.score(docs, toxicity.fit(docs, known, fold != 0)).collect()
    assert len(scored) == len(rows) and all(0 <= x.score <= 1 for x in scored)
    truth = dict(labels)
    held = [x for x in scored if x.doc_id in truth and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert sum((x.score >= 0.5) == bool(truth[x.doc_id]) for x in held) / len(held) > 0.95
    assert toxicity.score(empty, toxicity.fit(empty, known.filter("false"), fold != 0)).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    from folioscope.llm.toxicity import BINS, _calibrated

    r = random.Random(9)
    vocabulary = [f"word{k}" for k in range(200)]
    keys = spark.range(1200).select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").collect()
    rows, labels = [], []
    for key in keys:  # no document of the start has the word that the others' toxic ones have
        w = r.choices(vocabulary, k=20)
        if key.id % 4 == 0:
            w[r.randrange(20)] = "nasty" if key.h % 6 == 0 else "late"
        rows.append((key.id, " ".join(w), "en"))
        labels.append((key.id, int(key.id % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), start_rows=200, rounds=6)
    scored = toxicity.score(docs, model).collect()
    late = [x.score for x in scored if " late " in f" {x.text} "]
    assert len(late) > 200 and sum(s >= 0.5 for s in late) / len(late) > 0.9
    counts = np.zeros((2, BINS), np.int64)
    counts[0, :1000], counts[1, 1000:] = 1, 1
    assert _calibrated({"en": counts}) == {"": 1000 / BINS, "en": 1000 / BINS}


def test_decontamination_without_doc_ids(spark, tmp_path):
    from corpus_pipeline import without_benchmark

    r = random.Random(13)
    text = lambda n: " ".join(f"v{r.randrange(10_000)}" for _ in range(n))
    item, clean = text(40), [text(80) for _ in range(3)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{text(20)} {item} {text(20)}"
    rows = [(None, leak), (None, clean[0]), (7, leak), (7, clean[1]), (8, clean[2]), (None, None)]
    left = without_benchmark(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert Counter((x.doc_id, x.text) for x in left) == Counter([(None, clean[0]), (7, clean[1]), (8, clean[2]), (None, None)])
