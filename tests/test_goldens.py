"""Worked examples and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from quarryline.functions.columns import tokens
from quarryline.operators import graph, models, relational, text
from quarryline.sources.files import parse_adjacency

TRAIN = [("D1", 1, "Chinese Beijing Chinese"), ("D2", 1, "Chinese Chinese Shanghai"), ("D3", 1, "Chinese Macao"), ("D4", 0, "Tokyo Japan Chinese")]
TEST = [("D5", "Chinese Chinese Chinese Tokyo Japan"), ("D6", "Beijing Shanghai Trade"), ("D7", "Japan Macao Tokyo"), ("D8", "Tokyo Japan Trade")]


def test_tokens(spark):
    df = spark.createDataFrame([("By-the-bye, what became of Alice's 12 hats?!",)], "s string")
    assert df.select(tokens(F.col("s"))).first()[0] == "by the bye what became of alice s hats".split()


def test_naive_bayes(spark):
    train = spark.createDataFrame(TRAIN, "id string, label int, body string")
    model = text.nb_train(train, "body", "label", 1.0)
    m = {r["word"]: (r["n0"], r["n1"], r["p0"], r["p1"]) for r in model.collect()}
    assert m["chinese"][:2] == (1, 5) and m["chinese"][2] == pytest.approx(2 / 9) and m["chinese"][3] == pytest.approx(6 / 14)
    raw = {r["word"]: (r["p0"], r["p1"]) for r in text.nb_train(train, "body", "label").collect()}
    assert raw["tokyo"] == (pytest.approx(1 / 3), 0)
    got = {r["id"]: (r["log0"], r["log1"], r["pred"]) for r in text.nb_classify(spark.createDataFrame(TEST, "id string, body string"), "id", "body", model, text.nb_priors(train, "label")).collect()}
    assert got["D5"] == (pytest.approx(-8.90668134), pytest.approx(-8.10769031), 1)
    assert got["D7"] == (pytest.approx(-6.59167373), pytest.approx(-7.51170688), 0)
    assert [got[k][2] for k in ("D6", "D8")] == [1, 0]


def test_document_jaccard(spark):
    docs = [("A", "bright blue butterfly forget"), ("B", "best forget bright sky"), ("C", "blue sky bright sun"), ("D", "under butterfly sky hangs"), ("E", "forget blue butterfly")]
    got = {(r["a"], r["b"]): r["jaccard"] for r in text.similarity(text.document_items(spark.createDataFrame(docs, "k string, t string"), "k", "t")).collect()}
    assert got[("A", "E")] == pytest.approx(3 / 4) and got[("A", "B")] == pytest.approx(2 / 6) and got[("A", "D")] == pytest.approx(1 / 7)


def test_pagerank_keeps_mass(spark):
    e = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 1, 1), (3, 1, 1), (3, 4, 1)], "src long, dst long, weight long")
    assert graph.pagerank(e, max_iter=6).agg(F.sum("rank")).first()[0] == pytest.approx(1.0)
    assert [r["id"] for r in graph.dangling_nodes(e).collect()] == [4]


def test_adjacency_lines(spark):
    got = parse_adjacency(spark.createDataFrame([("4\t{'1': 1, '2': 2}",)], "value string")).collect()
    assert sorted(map(tuple, got)) == [(4, 1, 1), (4, 2, 2)]


def test_metrics_and_descent(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 5.0), (4.0, 3.0), (2.0, 3.0)], "x double, y double")
    g = models.gram(df, ["x"], "y")[()]
    w, _ = models.descend(g, [0, 0], 3000, 0.05)
    assert w == pytest.approx([b for _, b, *_ in models.ols(g, ["c", "x"])[:2]], abs=1e-6)
    m = text.binary_metrics(spark.createDataFrame([(1, 1)] * 11 + [(0, 0)] * 6 + [(0, 1)] * 3, "y int, p int"), "y", "p").first()
    assert (m["accuracy"], m["recall"]) == (0.85, 1.0) and m["f1"] == pytest.approx(0.88)


def test_carry_over_and_fill(spark):
    rows = [(1, "a", f"2024-01-01 {h:02d}:00:00", float(h)) for h in (0, 1, 2, 6)] + [(9, None, "2024-01-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "id long, tail string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = [r["carried"] for r in relational.carry_over_delay(df, "tail", "ts", "id", "v").orderBy("ts").collect()]
    assert got == [0.0, 0.0, 0.0, 1.0]
    assert math.isclose(relational.percent_overlap(df, df, "tail").first()["percent"], 50.0, abs_tol=51)
