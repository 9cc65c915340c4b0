"""Similarity where one feature stands in most items, PageRank with hubs and small blocks, and steps over all blocks."""

import itertools
import math
import random

import numpy as np
import pytest

from quarryline.operators import graph, models, text


@pytest.mark.parametrize("paired", [1_000, 7])
def test_similarity_of_a_frequent_feature(spark, monkeypatch, paired):
    monkeypatch.setattr(text, "PAIRED", paired)
    rng = random.Random(4)
    sets = {}
    for k in range(60):
        sets[f"i{k:02}"] = {f"f{rng.randrange(9)}" for _ in range(3)} | ({"all"} if k % 3 else set())
    items = spark.createDataFrame([(i, f) for i, own in sets.items() for f in own], "item string, feature string").repartition(5)
    got = {(r["a"], r["b"]): (r["common"], r["cosine"], r["overlap"]) for r in text.similarity(items).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        c = len(sets[a] & sets[b])
        if c:
            want[(a, b)] = (c, round(c / math.sqrt(len(sets[a]) * len(sets[b])), 9), round(c / min(len(sets[a]), len(sets[b])), 9))
    assert got == want
    ends = text.similarity_extremes(items, 4).collect()
    ordered = sorted(want, key=lambda p: (-want[p][1], p))
    assert [(r["a"], r["b"]) for r in sorted(ends, key=lambda r: r["rn"]) if r["side"] == "top"] == ordered[:4]
    ordered = sorted(want, key=lambda p: (want[p][1], p))
    assert [(r["a"], r["b"]) for r in sorted(ends, key=lambda r: r["rn"]) if r["side"] == "bottom"] == ordered[:4]


@pytest.mark.parametrize("nodes, edges", [(50_000, 500_000), (13, 40)])
def test_pagerank_with_hubs(spark, monkeypatch, nodes, edges):
    monkeypatch.setattr(graph, "NODES", nodes)
    monkeypatch.setattr(graph, "EDGES", edges)
    rng = random.Random(6)
    n = 80
    links = {(0, k): 1 for k in range(1, n)} | {(k, 1): 2 for k in range(2, 60)} | {(rng.randrange(60), rng.randrange(n)): rng.randrange(1, 4) for _ in range(150)}
    df = spark.createDataFrame([(a * 10, b * 10, w) for (a, b), w in links.items()], "src long, dst long, weight long").repartition(4)
    p = np.zeros((n, n))
    for (a, b), w in links.items():
        p[a, b] = w
    out = p.sum(1)
    p[out > 0] /= out[out > 0, None]
    mass, plain, leak = np.full(n, 1 / n), np.ones(n), np.full(n, 1 / n)
    log = []
    for _ in range(4):
        missing = mass[out == 0].sum()
        mass, plain, leak = 0.15 / n + 0.85 * (missing / n + mass @ p), 0.15 + 0.85 * (plain @ p), leak @ p
        log.append((missing, mass.sum()))
    own: list = []
    for df_, want in ((graph.pagerank(df, max_iter=4, log=own), mass), (graph.pagerank(df, max_iter=4, mode="unnormalized"), plain), (graph.power_iteration(df, 4), leak)):
        got = {r["id"] // 10: r["rank"] for r in df_.collect()}
        assert [got[k] for k in range(n)] == pytest.approx(want.tolist(), abs=1e-13)
    assert [x[1:] for x in own] == [pytest.approx(x, abs=1e-12) for x in log]


def test_an_iteration_moves_ranks_alone(spark):
    df = spark.createDataFrame([(k, (k * 7) % 30, 1) for k in range(30)], "src long, dst long, weight long")
    g = graph.PackedGraph(df)
    plan = g.gather(g.start(1.0))._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        assert "Exchange hashpartitioning(dst" not in line and "Exchange hashpartitioning(src" not in line and "Exchange hashpartitioning(id" not in line


@pytest.mark.parametrize("n", [None, 3, 10, 37])
def test_sgd_over_all_blocks(spark, n):
    data = [(i, float(i % 11), float(3 - (i % 11) + (i % 4))) for i in range(200)]
    cut = models.blocks(spark.createDataFrame(data, "id long, x double, y double").repartition(6), ["id"], 20)
    w = np.zeros(2)
    for step in range(10 if n is None else n):
        own = data[step % 10 * 20 : step % 10 * 20 + 20]
        a, y = np.array([[1, r[1]] for r in own]), np.array([r[2] for r in own])
        w = w - 0.01 * 2 * a.T @ (a @ w - y) / len(own)
    assert models.sgd(cut, ["x"], "y", "block", n, 0.01) == pytest.approx(w)
