"""Trees fitted on weighted cells of equal rows: the same boosted trees, the same kind of forest, every row counted."""

import numpy as np
from pyspark.ml import classification
from pyspark.sql import functions as F

from quarryline.operators import models
from quarryline.operators import text as T

NUM, CAT = ["a", "b"], ["c"]


def table(spark, rows=3_000):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 6, rows), rng.integers(0, 9, rows), rng.integers(0, 3, rows)
    y = (rng.random(rows) < 0.1 + 0.2 * ((a > 2) ^ (b > 4)) * (c + 2)).astype(float)
    whole = spark.createDataFrame([(float(p), float(q), str(r), float(v)) for p, q, r, v in zip(a, b, c, y)], "a double, b double, c string, label double")
    return whole.withColumn("k", F.monotonically_increasing_id() % 4)


def counts(df, n=None):
    return tuple(T.binary_metrics(df, "label", "prediction", n).first())


def test_boosted_equals_rows(spark, monkeypatch):
    monkeypatch.setitem(models.CLASSIFIERS, "boosted", lambda y: classification.GBTClassifier(labelCol=y, maxDepth=3, maxIter=3, maxBins=300, seed=1))
    df = table(spark)
    train, test, prepare = df.where("k > 0"), df.where("k = 0"), models.tree_pipeline(NUM, CAT)
    rows = counts(models.train_and_score(train, test, "label", "boosted", prepare))
    cells = models.score_cells(train, test, "label", "boosted", prepare)
    assert cells.count() <= 6 * 9 * 3 * 2 < test.count() == cells.agg(F.sum("n")).first()[0]
    assert counts(cells, "n") == rows and rows[0] > 0 and rows[1] > 0


def test_forest_is_near_that_of_rows(spark, monkeypatch):
    monkeypatch.setitem(models.CLASSIFIERS, "forest_deep", lambda y: classification.RandomForestClassifier(labelCol=y, numTrees=7, maxDepth=6, maxBins=300, seed=1))
    df = table(spark)
    train, test, prepare = df.where("k > 0"), df.where("k = 0"), models.tree_pipeline(NUM, CAT)
    rows = counts(models.train_and_score(train, test, "label", "forest_deep", prepare))
    mine = counts(models.score_cells(train, test, "label", "forest_deep", prepare), "n")
    assert sum(mine[:4]) == sum(rows[:4]) and abs(mine[4] - rows[4]) < 0.04


def test_cells_hold_every_row_and_draws_are_poisson(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 2).cast("string").alias("c"), (F.col("id") % 3 == 0).cast("double").alias("label"))
    cells = models.binned_cells(models.tree_pipeline(NUM, CAT).fit(df), [df], "label", 20)[0].cache()
    sizes = cells.groupBy(F.col("bins")[0]).agg(F.sum("n").alias("n")).collect()
    assert cells.agg(F.sum("n")).first()[0] == 20_000 and len(sizes) == 20 and all(abs(r["n"] - 1_000) < 20 for r in sizes)
    assert cells.select(F.col("bins")[1]).distinct().count() == 5
    drawn = sorted((tuple(r["bins"]), r["label"], r["n"], tuple(r["times"])) for r in models.bootstrapped(cells, 50, 1).collect())
    again = sorted((tuple(r["bins"]), r["label"], r["n"], tuple(r["times"])) for r in models.bootstrapped(cells.repartition(7), 50, 1).collect())
    z = np.array([(np.array(t) - n) / np.sqrt(n) for _, _, n, t in drawn])
    assert drawn == again and abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05
