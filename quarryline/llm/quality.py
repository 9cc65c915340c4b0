"""Quality classifier: regularised quadratic discriminant over document statistics (operator 7).

Class means and covariances come from sums over all labelled training rows, taken on the
executors. Each covariance is shrunk to the pooled one and to a multiple of the identity; scores
are differences of Gaussian log densities, by Mahalanobis distances through Cholesky factors that
every task keeps. Only the text is an input of a score.

Defined results: a null text is empty; a null doc_id is not held out and has no label; where one
class has no training row, every score is the share of label 1 (0.5 without labels). The fit takes
at most ``FIT_ROWS`` labelled rows, in order of a hash of doc_id: a documented bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import append_columns, materialise, read, temporary
from quarryline.llm.textstats import FEATURES, with_stats

#: Shrinkage to the pooled covariance and to the identity; threshold of a prediction.
TO_POOLED, TO_IDENTITY, THRESHOLD = 0.1, 0.05, 0.3
FOLDS, HELD_OUT = 5, 0
#: Most labelled rows of the fit, in order of a hash of doc_id: they are joined by broadcast.
FIT_ROWS = 200_000


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def class_sums(rows: DataFrame, label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label 0 and 1: rows, sums and cross products of ``st_features``, summed inside Spark."""
    d = len(FEATURES)

    def run(frames):
        total = {}
        for df in frames:
            for y, part in df.groupby("y"):
                x = np.stack(part["st_features"].to_numpy())
                n, s, q = total.get(y, (0, 0, 0))
                total[y] = (n + len(x), s + x.sum(0), q + x.T @ x)
        yield pd.DataFrame([(int(y), k, float(v)) for y, (n, s, q) in total.items() for k, v in enumerate([n, *s, *q.ravel()])], columns=["y", "k", "v"]).astype({"y": "int32", "k": "int32", "v": "float64"})

    sums = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), "st_features").mapInPandas(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v"))
    out = {}
    for r in sums.collect():  # 2 x (1 + d + d x d) numbers
        out.setdefault(r["y"], np.zeros(1 + d + d * d))[r["k"]] = r["v"]
    return {y: (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for y, v in out.items()}


class Discriminant:
    """Means, Cholesky factors and log determinants of both classes."""

    def __init__(self, sums: dict):
        n = {y: sums[y][0] if y in sums else 0 for y in (0, 1)}
        self.prior = (n[1] / (n[0] + n[1])) if n[0] + n[1] else 0.5
        self.parts = None
        if not n[0] or not n[1]:
            return
        mean = {y: sums[y][1] / n[y] for y in n}
        cov = {y: sums[y][2] / n[y] - np.outer(mean[y], mean[y]) for y in n}
        pooled = sum(n[y] * cov[y] for y in n) / (n[0] + n[1])
        d = len(pooled)
        self.parts = []
        for y in (0, 1):
            s = (1 - TO_POOLED) * cov[y] + TO_POOLED * pooled
            s = (1 - TO_IDENTITY) * s + TO_IDENTITY * (np.trace(pooled) / d + 1e-3) * np.eye(d)
            low = np.linalg.cholesky(s)
            self.parts.append((mean[y], np.linalg.inv(low), 2 * np.log(np.diag(low)).sum(), np.log(n[y] / (n[0] + n[1]))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        logs = [-0.5 * (((x - m) @ inverse.T) ** 2).sum(1) - 0.5 * det + prior for m, inverse, det, prior in self.parts]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40)))


def training_rows(labels: DataFrame, label: str = "quality", held_out: int = HELD_OUT, folds: int = FOLDS, most: int = FIT_ROWS) -> DataFrame:
    """doc_id and label ``_y`` of labelled rows outside the held-out fold, FIT_ROWS at most."""
    known = labels.where((fold(folds) != held_out) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("_y"))
    return known.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id", "_y").limit(most)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = HELD_OUT, folds: int = FOLDS) -> Discriminant:
    """The discriminant from the labelled rows of stats (doc_id, st_features) outside the held-out fold, FIT_ROWS at most."""
    known = training_rows(labels, label, held_out, folds).withColumnRenamed("doc_id", "_id")
    train = stats.select("doc_id", "st_features").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    return Discriminant(class_sums(train, "_y"))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """stats with ``q_score``, the probability of label 1."""

    @F.pandas_udf("double")
    def probability(features: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(features.to_numpy())) if len(features) else np.zeros(0))

    return stats.withColumn("q_score", probability("st_features"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``q_score`` and ``q_predicted`` (replaced where docs has them); the statistics are taken once for the fit and once for the scores."""
    whole = docs.drop("q_predicted")
    known = training_rows(labels).select(F.col("doc_id").alias("_id")).distinct()
    train = with_stats(whole.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left_semi")).select("doc_id", "st_features")
    with temporary(docs.sparkSession):
        model = fit(materialise(train, "quality-train"), labels)

    def make(chunk):
        from quarryline.llm.textstats import count_texts, transform

        return [pa.array(model.score(transform(count_texts(chunk.column("text")))))]

    return append_columns(whole, make, "q_score double").withColumn("q_predicted", (F.col("q_score") >= threshold).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score and predicted quality."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stats = materialise(with_stats(docs).select("doc_id", "st_features"), "quality-stats")
    scored = score(stats, fit(stats, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("q_score").alias("score"), (F.col("q_score") >= THRESHOLD).cast("int").alias("predicted"))
