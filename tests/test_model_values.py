"""Regressions, blocks, trends and intervals against numpy on the same rows."""

import math
import os

import numpy as np
import pytest

from quarryline.operators import models
from quarryline.operators import series as Y
from quarryline.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_tail_probabilities():
    assert models.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert models.chi2_upper(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert models.chi2_upper(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)
    assert models.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-7)
    assert models.t_two_sided(-12.706204736432095, 1) == pytest.approx(0.05, abs=1e-7)


def test_pooled_ols(spark):
    x = np.array([[0.0], [1], [2], [3], [5], [9]])
    y = np.array([1.0, 2, 2, 5, 4, 11])
    df = spark.createDataFrame([(float(a[0]), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = models.ols(models.gram(df, ["x"], "y")[()], ["intercept", "x"])
    beta, rss, *_ = np.linalg.lstsq(np.column_stack([np.ones(6), x]), y, rcond=None)
    assert [r[1] for r in got[:2]] == pytest.approx(beta.tolist())
    se = math.sqrt(rss[0] / 4 / ((x - x.mean()) ** 2).sum())
    assert got[1][2:4] == pytest.approx((se, beta[1] / se)) and 0 < got[1][4] < 0.01


def test_sgd_takes_consecutive_blocks(spark):
    data = [(i, float(i % 7), float(3 + 2 * (i % 7) + (i % 3))) for i in range(1, 96)]
    df = spark.createDataFrame(data, "id long, x double, y double").repartition(5)
    cut = models.blocks(df, ["id"], 10)
    assert {(r["id"], r["block"]) for r in cut.collect()} == {(i, (i - 1) // 10) for i, _, _ in data}
    w = np.zeros(2)
    for step in range(25):
        part = [r for r in data if (r[0] - 1) // 10 == step % 10]
        a, y = np.array([[1, r[1]] for r in part]), np.array([r[2] for r in part])
        w = w - 0.01 * 2 * a.T @ (a @ w - y) / len(part)
    assert models.sgd(cut, ["x"], "y", "block", 25, 0.01) == pytest.approx(w)


def test_trend_season_fit(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t, t % 4 + 1, float(5 + t / 10 + (t % 4) * (2 if k == "a" else -1) + (t in (7, 8)) * 3 + rng.normal())) for k in "ab" for t in range(1, 41)]
    df = spark.createDataFrame(rows, "key string, t int, s int, value double")
    fits = {r["key"]: r for r in Y.trend_season_fit(df, 2, models.F.col("s"), 4, models.F.col("t").isin(7, 8)).collect()}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        a = np.array([[1, r[1] / 100, (r[1] / 100) ** 2, *[r[2] == q for q in (2, 3, 4)], r[1] in (7, 8)] for r in mine], float)
        y = np.array([r[3] for r in mine])
        beta, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
        fit = 40 * (math.log(2 * math.pi * rss[0] / 40) + 1)
        assert fits[k]["coefs"] == pytest.approx(beta.tolist(), rel=1e-5)
        assert (fits[k]["rmse"], fits[k]["aic"], fits[k]["bic"]) == pytest.approx((math.sqrt(rss[0] / 40), fit + 16, fit + 8 * math.log(40)))


def test_logit_interval(spark):
    """The covariance from Spark's sums gives the standard errors of the fit itself."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(float(v), float(rng.random() < 1 / (1 + math.exp(-0.3 - v)))) for v in x], "x double, y double")
    fit = models.glm(df, "y", ["x"], "binomial")
    beta = [fit[1][1], fit[0][1]]
    cov = models.logit_covariance(df, ["x"], beta)
    assert np.sqrt(np.diag(cov)) == pytest.approx([fit[1][2], fit[0][2]], rel=1e-3)
    r = models.predict_ci(df.limit(1), ["x"], beta, cov).first()
    v = np.array([1.0, r["x"]])
    half = 1.959963984540054 * math.sqrt(v @ cov @ v)
    assert math.log(r["hi"] / (1 - r["hi"])) - math.log(r["prob"] / (1 - r["prob"])) == pytest.approx(half)


@pytest.mark.parametrize("name", ["e2_pooled_ols", "e6_likelihood_ratio", "e7_predict_ci", "e9_grid_probabilities", "e10_poisson_by_group", "r9_sgd_blocks", "y2_trend_season", "y2_trend_log", "m2_tree_features", "m4_importance", "m12_cross_validated", "m14_knn_scores"])
def test_values_are_sound(spark, name):
    got = CATALOG[name][0](spark, SF).collect()
    assert got
    for r in map(lambda r: r.asDict(), got):
        if name == "e7_predict_ci":
            assert 0 <= r["lo"] <= r["prob"] <= r["hi"] <= 1
        if name == "e9_grid_probabilities":
            assert r["p0"] + r["p1"] + r["p2"] == pytest.approx(1)
    if name == "m4_importance":
        assert sum(r["importance"] for r in got) == pytest.approx(1)
    if name == "e6_likelihood_ratio":
        assert got[0]["lr"] >= 0 and 0 <= got[0]["p"] <= 1


@pytest.mark.parametrize("name, reg", [("r5_descent_plain", None), ("r7_descent_ridge", "ridge"), ("r7_descent_lasso", "lasso")])
def test_descent_on_rows(spark, name, reg):
    """The losses of 50 steps from sums of products equal those of steps over the rows themselves."""
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax", "l_extendedprice").toPandas().to_numpy(float)
    z = (li - li.mean(0)) / li.std(0)
    a, y, w = np.column_stack([np.ones(len(z)), z[:, :3]]), z[:, 3], np.zeros(4)
    want = []
    for _ in range(50):
        extra = 0.2 * w if reg == "ridge" else 0.1 * np.sign(w) if reg == "lasso" else np.zeros(4)
        w = w - 0.1 * (2 * a.T @ (a @ w - y) / len(y) + np.r_[0, extra[1:]])
        want.append(float(((a @ w - y) ** 2).mean()))
    got = sorted(CATALOG[name][0](spark, SF).collect())
    assert [r["step"] for r in got] == list(range(50))
    assert [r["train"] for r in got] == pytest.approx(want, rel=1e-6)


def test_pagerank_keeps_its_mass(spark):
    """g11: at every step, rank that dangling nodes hold and all rank, which stays 1."""
    got = CATALOG["g11_mass_log"][0](spark, SF).collect()
    assert [r["iteration"] for r in got] == list(range(len(got))) or [r["iteration"] for r in got] == list(range(1, len(got) + 1))
    assert len(got) == 3 and all(r["total"] == pytest.approx(1) and 0 <= r["missing"] < 1 for r in got)
