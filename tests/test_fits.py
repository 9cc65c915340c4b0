"""Grouped models, penalised grids, one-hot components, neighbours and sketches against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import fits, models, segments
from quarryline.operators import series as Y


def plain_glm(x, y, w, family):
    a = np.column_stack([np.ones(len(y)), x])
    mu = y + 0.1 if family == "poisson" else (w * y + 0.5) / (w + 1)
    b = None
    for _ in range(50):
        eta = (np.log(mu) if family == "poisson" else np.log(mu / (1 - mu))) if b is None else a @ b
        mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
        v = mu if family == "poisson" else mu * (1 - mu)
        h = a.T * (w * v)
        b = np.linalg.solve(h @ a, h @ (eta + (y - mu) / v))
    return b, np.sqrt(np.diag(np.linalg.inv(h @ a)))


@pytest.mark.parametrize("family", ["poisson", "binomial"])
@pytest.mark.parametrize("broadcast", [100_000, 1])
def test_groups_fit_at_once(spark, monkeypatch, family, broadcast):
    """One group holds most rows; a null group is a group; rows with nulls are left out."""
    monkeypatch.setattr(segments, "BROADCAST_ROWS", broadcast)
    rng, data = np.random.default_rng(7), []
    for g, n in (("hot", 900), ("b", 60), (None, 80)):
        for _ in range(n):
            x = rng.normal(size=2)
            eta = 0.4 + 0.5 * x[0] - 0.3 * x[1] * (2 if g == "b" else 1)
            w = float(rng.integers(1, 9))
            y = float(rng.poisson(np.exp(eta))) if family == "poisson" else rng.binomial(int(w), 1 / (1 + np.exp(-eta))) / w
            data.append((g, float(x[0]), float(x[1]), y, w))
    df = spark.createDataFrame([*data, ("b", None, 1.0, 0.5, 1.0), ("c", 1.0, 1.0, None, 1.0)], "g string, x1 double, x2 double, y double, w double").repartition(5)
    got = {(r["g"], r["term"]): r for r in fits.fit_glm(df, "y", ["x1", "x2"], family, ["g"], "w").collect()}
    assert {k[0] for k in got} == {"hot", "b", None} and len(got) == 12
    for g in ("hot", "b", None):
        own = np.array([r[1:] for r in data if r[0] == g])
        b, se = plain_glm(own[:, :2], own[:, 2], own[:, 3], family)
        assert [got[g, t]["estimate"] for t in ("intercept", "x1", "x2")] == pytest.approx(b.tolist(), rel=1e-8)
        assert [got[g, t]["se"] for t in ("intercept", "x1", "x2")] == pytest.approx(se.tolist(), rel=1e-5)
        assert got[g, "deviance"]["estimate"] > 0 and got[g, "deviance"]["se"] is None


def test_fit_without_groups_or_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(float(v), float(rng.random() < 1 / (1 + np.exp(-v)))) for v in x], "x double, y double")
    mine = fits.fit_glm(df, "y", ["x"], "binomial").collect()
    ml = {t: (b, se) for t, b, se in models.glm(df, "y", ["x"], "binomial")}
    for r in mine:
        assert r["estimate"] == pytest.approx(ml[r["term"]][0], rel=1e-6)
    assert fits.fit_glm(df.where("x > 99"), "y", ["x"], "binomial").count() == 0
    twin = fits.fit_glm(df.withColumn("z", F.col("x")), "y", ["x", "z"], "binomial").collect()
    b = {r["term"]: r["estimate"] for r in twin}
    assert b["x"] == pytest.approx(b["z"]) and b["x"] + b["z"] == pytest.approx(ml["x"][0], rel=1e-5)


def test_elastic_net_equals_a_fit_on_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3)) * [1, 3, 0.2] + [5, -2, 0]
    y = x @ [2.0, -0.5, 0.0] + 7 + rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, y double, fold int")
    g = models.gram(df, ["a", "b", "c"], "y")[()]
    rows = models.feature.VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    for reg, mix in ((0.1, 1.0), (0.5, 0.5), (2.0, 0.0), (100.0, 1.0)):
        # Spark divides the squared part of its penalty by the label's deviation
        own = reg * mix + float(y.std()) * reg * (1 - mix)
        m = models.regression.LinearRegression(labelCol="y", standardization=False, regParam=own, elasticNetParam=reg * mix / own, tol=1e-12, maxIter=1000).fit(rows)
        assert fits.elastic_net(g, reg, mix) == pytest.approx(np.r_[m.intercept, m.coefficients.toArray()], abs=1e-5)
    for fold, reg, mix, mse, r2 in fits.grid_by_fold(df, ["a", "b", "c"], "y", "fold", [0.1, 1.0], [0.0, 1.0]):
        held = np.arange(400) % 3 == fold
        w = fits.elastic_net(models.gram(df.where(F.col("fold") != fold), ["a", "b", "c"], "y")[()], reg, mix)
        e = y[held] - (w[0] + x[held] @ w[1:])
        assert (mse, r2) == pytest.approx(((e**2).mean(), 1 - (e**2).mean() / y[held].var()))


def test_one_hot_components(spark):
    rng = np.random.default_rng(10)
    data = [(str(rng.integers(0, 4)), int(rng.integers(0, 3)) if i % 9 else None) for i in range(500)]
    df = spark.createDataFrame(data, "a string, b int")
    hot = np.array([[*[r[0] == str(k) for k in range(4)], *[r[1] == k for k in range(3)]] for r in data], float)
    values = np.clip(np.linalg.eigvalsh(np.cov(hot.T))[::-1], 0, None)
    got = fits.one_hot_variance(df, ["a", "b"])
    assert [k for k, _ in got] == list(range(1, 8))
    assert [v for _, v in got] == pytest.approx((np.cumsum(values) / values.sum()).tolist())
    assert fits.one_hot_variance(df.where("a = 'none'"), ["a", "b"]) == []


@pytest.mark.parametrize("block, strip", [(4_000, 50_000), (3, 7), (1, 40)])
def test_neighbours_by_grid(spark, block, strip):
    """Copies tie: the smaller key goes first, whatever the blocks; rows without a vector are left out."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 4)).round(3)
    data = [(i, base[i % 12 if i % 3 else 0].tolist(), i % 5 if i % 7 else None) for i in range(90)] + [(90, None, 1), (100, None, 1)]
    df = spark.createDataFrame(data, "id long, v array<double>, y int").repartition(4)
    got = {(r["q"], r["k"]): r["pred"] for r in fits.knn_regress(df.where("id % 20 != 0"), df.where("id % 20 = 0"), "id", "v", "y", [1, 4], block, strip).collect()}
    train = [r for r in data if r[0] % 20 and r[1]]
    asked = [r for r in data if r[0] % 20 == 0 and r[1]]
    assert len(got) == 2 * len(asked)
    for q, v, _ in asked:
        near = sorted(train, key=lambda r: (round(abs(sum((a - b) ** 2 for a, b in zip(v, r[1]))), 9), r[0]))
        for k in (1, 4):
            ys = [r[2] for r in near[:k] if r[2] is not None]
            assert got[q, k] == (pytest.approx(sum(ys) / len(ys)) if ys else None)
    assert fits.knn_regress(df.where("id < 0"), df.where("id % 20 = 0"), "id", "v", "y", [1]).count() == 0


def test_sketches_merge(spark):
    df = spark.range(200_000).select((F.col("id") % 8).alias("part"), (F.col("id") % 50_000).alias("v"))
    df = df.unionByName(spark.createDataFrame([(0, None)], "part long, v long"))
    sketches = fits.distinct_sketch(df, ["part"], "v")
    assert sketches.count() == 8
    assert abs(fits.merged_distinct(sketches).first()["approx"] - 50_000) < 0.05 * 50_000
    parts = {r["part"]: r["approx"] for r in fits.merged_distinct(sketches, ["part"]).collect()}
    assert all(abs(v - 50_000 / 8) < 0.06 * 50_000 / 8 for v in parts.values())


def test_residuals_of_a_trend(spark):
    rng = np.random.default_rng(12)
    data = [(k, t, t % 3 + 1, float(np.exp(1 + t / 50 + (t % 3) / 10 + rng.normal() / 9))) for k in "ab" for t in range(1, 31)]
    df = spark.createDataFrame(data, "key string, t int, s int, value double").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")))
    got = {(r["key"], r["t"]): r["value"] for r in Y.trend_residuals(df, 2, F.col("s"), 3, log=True).collect()}
    for k in "ab":
        own = [r for r in data if r[0] == k]
        a = np.array([[1, r[1] / 100, (r[1] / 100) ** 2, r[2] == 2, r[2] == 3] for r in own], float)
        y = np.log([r[3] for r in own])
        e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        assert [got[k, r[1]] for r in own] == pytest.approx(e.tolist(), abs=1e-8)
