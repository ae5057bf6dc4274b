"""Words that recur within a window, in mirrored and other orders with equal sums of places, are told apart."""

import itertools
import random

import numpy as np
import pyarrow as pa

from folioscope.llm import decontaminate, jaccard_join, suffix_dedup
from folioscope.llm.shingles import rolling
from folioscope.llm.wordhash import hashed_words


def hashes(text):
    return hashed_words(pa.array([text]))[0]


def test_all_orders_of_few_words_have_numbers_of_their_own():
    for width in (2, 3, 4, 5, 6):
        orders = [" ".join(o) for o in itertools.product("abc", repeat=width)]
        assert len({int(rolling(hashes(o), width)[0]) for o in orders}) == len(orders)
    r = random.Random(1)  # wider than any table of multipliers: words that change places far apart
    for width in (50, 64, 65, 130, 200):
        text = [r.choice("ab") for _ in range(width)]
        seen = {tuple(text)}
        for i, j in itertools.combinations(range(0, width, 3), 2):
            other = list(text)
            other[i], other[j] = other[j], other[i]
            seen.add(tuple(other))
        assert len({int(rolling(hashes(" ".join(o)), width)[0]) for o in seen}) == len(seen)
    assert len(np.unique(rolling(hashes("x y " * 500), 64))) == 2


def components(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df).collect()}


def test_jaccard_join_of_mirrored_words(spark):
    texts = ["no yes yes no", "yes no no yes", "a b b a c", "b a a b c", "x y y x " * 5, "a b b a c"]
    got = components(spark, texts)
    assert [got[k][1] for k in range(6)] == [0, 1, 2, 3, 4, 2]
    assert got[4][0] == 4


def test_suffix_dedup_of_mirrored_middle(spark):
    filler = [f"f{k}" for k in range(46)]
    texts = [" ".join(filler[:23] + middle.split() + filler[23:]) for middle in ("x y y x", "y x x y")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert suffix_dedup.repeated_passages(df).count() == 0


def test_decontamination_of_mirrored_words(spark):
    docs = spark.createDataFrame([(0, "a b b a c"), (1, "b a a b c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "b a a b c")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {1}
