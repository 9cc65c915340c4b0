"""Counts over n-grams taken from the texts equal those over a table of n-grams, and no such table is made."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.operators import text as T
from quarryline.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "a b c d", "a b c d e", "A b, b b; b B a", "x" * 300 + " b c d e f", "12 a1b2c3d4e5", "üİa K b cé d e f", "\n a-a a a a a a ", "e d c b a e d c b a f"]


def table(spark):
    rng = random.Random(3)
    texts = TEXTS + [rng.choice(["", " ", "."]).join([rng.choice("abcdefghij") + rng.choice(["", "x", "y"]) for _ in range(rng.randint(0, 40))]) for _ in range(60)]
    texts += [" ".join(rng.choice("pqrstuvw") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("n", [2, 5])
def test_counts_equal_those_of_ngrams(spark, n):
    df = table(spark)
    grams = T.ngrams(df, "text", n).cache()
    pairs = T.word_pairs(grams).cache()
    assert sorted(T.text_word_count(df, "text", n).collect()) == sorted(T.ngram_word_count(grams).collect())
    assert sorted(T.text_neighbor_counts(df, "text", n).collect()) == sorted(T.neighbor_counts(pairs).collect())
    few = spark.createDataFrame([("a",), ("b",), ("pp",), ("q",), ("f",), ("none",)], "word string")
    inside = sorted(pairs.where(F.col("w1").isin("a", "b", "pp", "q", "f") & F.col("w2").isin("a", "b", "pp", "q", "f")).collect())
    assert inside and sorted(T.text_pairs(df, "text", few, n).collect()) == inside


def test_nothing_counts_as_nothing(spark):
    df = table(spark).where("doc_id < 3")
    assert T.text_word_count(df, "text").count() == T.text_neighbor_counts(df, "text").count() == 0


def test_small_chunks_give_the_same_words_and_pairs(monkeypatch):
    texts = pa.array([x.lower() for x in TEXTS if x is not None] * 20)
    batches = lambda: [pa.RecordBatch.from_arrays([texts.slice(k, 7)], ["text"]) for k in range(0, len(texts), 7)]

    def met():
        found = [{(w[int(x)].as_py(), w[int(y)].as_py()) for x, y in zip(a, b)} for w, a, b in T._met_pairs(batches(), 5)]
        return set().union(*found), len(found)

    words = lambda: [(d[int(c)].as_py(), int(p), int(s)) for d, code, _, place, size in T._cut_words(batches(), 5) for c, p, s in zip(code, place, size)]
    whole, cut = met(), words()
    monkeypatch.setattr(T, "CHUNK_BYTES", 3)
    monkeypatch.setattr(T, "KEPT_PAIRS", 5)
    small = met()
    assert small[0] == whole[0] and small[1] > whole[1] == 1 and words() == cut
    assert all(a < b for a, b in whole[0])


def test_cells_beyond_what_is_kept(spark, monkeypatch):
    df = table(spark)
    whole = sorted(T.text_neighbor_counts(df, "text").collect())
    monkeypatch.setattr(T, "KEPT_PAIRS", 3)
    monkeypatch.setattr(T, "GRID", 1)
    assert sorted(T.text_neighbor_counts(df, "text").collect()) == whole


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["t4_neighbor_counts", "t5_ranking_overlap", "t7_stripes", "t8_similarity", "t8_similarity_extremes", "t11_term_cosine"])
def test_no_table_of_ngrams(spark, name, monkeypatch):
    def none(*_):
        raise AssertionError("n-grams made")

    monkeypatch.setattr(T, "ngrams", none)
    assert CATALOG[name][0](spark, SF).columns


def test_distinct():
    x = np.array([3, 1, 3, 2, 1])
    assert T._distinct(x.copy()).tolist() == [1, 2, 3] and T._distinct(x[:0]).tolist() == []
