"""The stages of the corpus pipeline on one small corpus with awkward rows, each against brute force on its own input."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from folioscope.llm import tokens, toxicity

from .test_operators import linked, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    item, passage, near = text(40), text(70), text(200).split()
    texts = [text(r.randint(1, 200)) for _ in range(60)]
    texts += [texts[3], texts[3].upper()] + [" ".join(near[:k] + ["changed"] + near[k + 1 :]) for k in (0, 9, 90)]
    texts += [f"{text(30)} {passage} {text(k)}" for k in (5, 50, 90)] + [passage]
    texts += [f"{text(40)} {item} {text(40)}", item] + [f"{text(20)} nasty vile {text(5)}" for _ in range(25)]
    texts += [None, "", " \n", "one", text(20_000)]
    rows = [(k, t, "en" if k % 3 else None, "s", None) for k, t in enumerate(texts)]
    rows += [(None, text(30), None, None, None), (None, None, None, None, None), (7, text(90), "en", "s", 1), rows[8], (None, f"{text(9)} {item} {text(9)}", "en", "s", 1)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(k, 1, int("nasty" in (t or ""))) for k, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxicity_drops_exactly_what_the_model_rejects(spark, folder, docs):
    from pyspark.sql import functions as F

    left = corpus_pipeline.without_toxic(spark, docs, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False)))
    assert left.columns == docs.columns and rows(left) == rows(toxicity.score(docs, model).filter("not rejected").select(docs.columns))
    assert sum(n for r, n in (rows(docs) - rows(left)).items() if "nasty" in (r[1] or "")) >= 20
    assert sum(n for r, n in (rows(docs) - rows(left)).items() if "nasty" not in (r[1] or "")) <= 2


def test_join_keeps_one_of_each_group(spark, folder, docs):
    # a repeated doc_id joins the groups of all its texts: give the second text of 7 to brute force as a link
    left = corpus_pipeline.one_of_each_group(spark, docs, folder)
    plain = [r for r in docs.collect() if r.doc_id is not None]
    first = {c for _, c in linked([r for r in plain if r.doc_id != 7]).values()}
    assert left.columns == docs.columns
    assert rows(left) == Counter({r: n for r, n in rows(docs).items() if r[0] is None or r[0] in first or r[0] == 7})


def test_repeats_are_cut_from_later_documents(spark, folder, docs):
    left = corpus_pipeline.without_repeats(spark, docs, folder)
    texts = [(r.doc_id, words(r.text)) for r in docs.collect()]
    holders = defaultdict(set)
    for i, w in texts:
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    want = Counter()
    for i, w in texts:
        marked = set()
        for k in range(len(w) - 49):
            if i is not None and any(x is not None and x < i for x in holders[tuple(w[k : k + 50])]):
                marked.update(range(k, k + 50))
        if not marked or len(marked) < len(w):
            want[i, " ".join(x for k, x in enumerate(w) if k not in marked)] += 1
    assert left.columns == docs.columns
    assert Counter((r.doc_id, " ".join(words(r.text))) for r in left.collect()) == want


def test_benchmark_passages_go(spark, folder, docs):
    item = next(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text)
    left = corpus_pipeline.without_benchmark(spark, docs, folder)
    assert left.columns == docs.columns
    assert rows(left) == Counter({r: n for r, n in rows(docs).items() if item not in (r[1] or "")})


def test_packing_covers_all_ids(spark, folder, docs):
    encode = tokens.encoder(tokens.default_path())
    want = sum(len(encode(r.text)) // 4 + 1 for r in docs.collect())
    got = corpus_pipeline.packed(spark, docs, folder).collect()
    assert sum(r.length for r in got) == want
    ends = defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    for pieces in ends.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_applies_the_stages_in_order(spark, folder, docs):
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder)
        path = f"{folder}/{name}"
        step.write.parquet(path)
        step = spark.read.parquet(path)
    ran = corpus_pipeline.run(spark, folder)
    assert sum(r.length for r in ran.collect()) == sum(r.length for r in corpus_pipeline.packed(spark, step, folder).collect())
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, folder).count() == 0
