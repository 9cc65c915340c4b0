"""Regression from Gram matrices, panel and categorical statistics, MLlib pipelines (R, E, M, X4)."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, classification, feature, regression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators import segments
from quarryline.sources.files import saved


# ---- Gram matrices: rows are reduced to d x d by Spark, algebra on that is done on the driver
def gram_sums(df: DataFrame, x: list[str], y: str, by: list[str] = ()) -> DataFrame:
    """Per key, the sums of products of (1, x..., y): the lower triangle of the matrix as columns s<i>_<j>."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i + 1)]
    return df.dropna(subset=[*x, y]).groupBy(*by).agg(*sums)


def gram(df: DataFrame, x: list[str], y: str, by: list[str] = ()) -> dict[tuple, np.ndarray]:
    """Per key, the matrix of sums of products of (1, x..., y)."""
    d, out = len(x) + 2, {}
    for r in gram_sums(df, x, y, by).collect():
        g = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                g[i, j] = g[j, i] = r[f"s{i}_{j}"] or 0.0
        out[tuple(r[k] for k in by)] = g
    return out


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"]) for c in cols}


def apply_scaler(df: DataFrame, stats: dict) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(m), F.lit(s)) for c, (m, s) in stats.items()})


def predict(x: list[str], w):
    return sum((F.col(c) * float(v) for c, v in zip(x, w[1:])), F.lit(float(w[0])))


def ols_loss(df: DataFrame, x: list[str], y: str, w) -> DataFrame:
    return df.agg(F.avg(F.pow(predict(x, w) - F.col(y), 2)).alias("loss"))


def _loss(g: np.ndarray, w: np.ndarray) -> float:
    v = np.r_[w, -1.0]
    return float(v @ g @ v / g[0, 0])


def gradient(g: np.ndarray, w: np.ndarray, reg: str | None = None, lam: float = 0.0) -> np.ndarray:
    out = 2 * (g[:-1, :-1] @ w - g[:-1, -1]) / g[0, 0]
    extra = 2 * lam * w if reg == "ridge" else lam * np.sign(w) if reg == "lasso" else np.zeros_like(w)
    extra[0] = 0
    return out + extra


def descend(g: np.ndarray, w0, n: int, lr: float, reg: str | None = None, lam: float = 0.0, test: np.ndarray | None = None):
    """Weights and (step, train loss, test loss) of n steps; one pass over the rows made ``g``."""
    w, history = np.array(w0, float), []
    for i in range(n):
        w = w - lr * gradient(g, w, reg, lam)
        history.append((i, _loss(g, w), _loss(test, w) if test is not None else None))
    return w, history


def cv_descent(df: DataFrame, x: list[str], y: str, fold: str, n: int, lr: float) -> list[tuple[int, float, float]]:
    """(fold, train loss, test loss) of the model of the other folds."""
    grams = {k[0]: g for k, g in gram(df, x, y, [fold]).items()}
    whole = sum(grams.values())
    out = []
    for k in sorted(grams):
        w, _ = descend(whole - grams[k], np.zeros(len(x) + 1), n, lr)
        out.append((int(k), _loss(whole - grams[k], w), _loss(grams[k], w)))
    return out


def sgd(df: DataFrame, x: list[str], y: str, batch: str, n: int | None, lr: float) -> np.ndarray:
    """Weights after steps over the blocks of a batch column, in turn: ``n`` of them, or one over each block.

    A step is an affine map of the weights, which a block's sums give. The maps of consecutive blocks are multiplied where
    the sums are; the driver multiplies one product for each range of blocks.
    """
    d = len(x) + 1
    sums = gram_sums(df, x, y, [batch]).where("s0_0 > 0")
    numbered = saved(segments.number_rows(sums, [], [batch], "_i"), "block-sums")
    count = numbered.count()
    if not count:
        return np.zeros(d)
    rest = 0 if n is None else n % count

    def multiply(frames):
        start, whole, part = None, np.eye(d + 1), np.eye(d + 1)
        for frame in frames:
            for row in frame.to_dict("records"):
                start = row["_i"] if start is None else start
                g = np.zeros((d + 1, d + 1))
                for i in range(d + 1):
                    for j in range(i + 1):
                        g[i, j] = g[j, i] = row[f"s{i}_{j}"] or 0.0
                step = np.eye(d + 1)
                step[:d] -= 2 * lr / g[0, 0] * np.column_stack([g[:d, :d], -g[:d, d]])
                whole = step @ whole
                part = step @ part if row["_i"] < rest else part
        if start is not None:
            yield pd.DataFrame({"start": [start], "whole": [whole.ravel().tolist()], "part": [part.ravel().tolist()]})

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = numbered.repartitionByRange(ranges, "_i").sortWithinPartitions("_i").mapInPandas(multiply, "start long, whole array<double>, part array<double>").collect()  # a row for each range
    whole = part = np.eye(d + 1)
    for r in sorted(made, key=lambda r: r["start"]):
        whole, part = np.array(r["whole"]).reshape(d + 1, d + 1) @ whole, np.array(r["part"]).reshape(d + 1, d + 1) @ part
    turns = 1 if n is None else n // count
    return (part @ np.linalg.matrix_power(whole, turns))[:d, d]


def blocks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``block``: the consecutive run of ``size`` rows, in the given order, that a row stands in."""
    return segments.number_rows(df, [], order, "_place").withColumn("block", F.floor(F.col("_place") / size)).drop("_place")


def compare_models(df: DataFrame, x: list[str], y: str, weights: dict[str, list[float]]) -> DataFrame:
    """(model, mse, mae) of named weight vectors on the same rows, in one pass."""
    scored = df.select(F.col(y).alias("_y"), F.explode(F.create_map(*[v for k, w in weights.items() for v in (F.lit(k), predict(x, w))])).alias("model", "_p"))
    e = F.col("_y") - F.col("_p")
    return scored.groupBy("model").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def t_two_sided(t: float, df: float, points: int = 20_001) -> float:
    """Chance of a larger |t|: with t = sqrt(df) tan(a) the density is a power of cos(a)."""
    a = np.arctan(abs(t) / np.sqrt(df))
    area = lambda lo: float(np.trapezoid(np.cos(np.linspace(lo, np.pi / 2, points)) ** (df - 1), dx=(np.pi / 2 - lo) / (points - 1)))
    return area(a) / area(0.0)


def chi2_upper(x: float, df: int) -> float:
    """Chance of a larger chi-squared value, by the recurrence of the incomplete gamma function in df / 2."""
    half = x / 2
    out, a = (math.erfc(math.sqrt(half)), 0.5) if df % 2 else (math.exp(-half), 1.0)
    while a < df / 2 - 1e-9:
        out, a = out + half**a * math.exp(-half) / math.gamma(a + 1), a + 1
    return out


def ols(g: np.ndarray, names: list[str], lost: int = 0) -> list[tuple]:
    """(term, coefficient, std error, t, p) and, last, the adjusted R2, from a Gram matrix."""
    n, xx, xy = g[0, 0], g[:-1, :-1], g[:-1, -1]
    beta = np.linalg.solve(xx, xy)
    rss, tss = float(g[-1, -1] - beta @ xy), float(g[-1, -1] - g[0, -1] ** 2 / n)
    df = n - len(beta) - lost
    se = np.sqrt(np.diag(np.linalg.inv(xx)) * rss / df)
    rows = [(t, float(b), float(s), float(b / s), t_two_sided(b / s, df)) for t, b, s in zip(names, beta, se)]
    return [*rows, ("adjusted_r2", float(1 - (rss / df) / (tss / (n - 1))), None, None, None)]


def demean(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    w = Window.partitionBy(entity)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in cols})


def fixed_effects(df: DataFrame, entity: str, y: str, x: list[str]) -> list[tuple]:
    g = next(iter(gram(demean(df, entity, [*x, y]), x, y).values()))
    inner, n_entities = g[1:, 1:], df.select(entity).distinct().count()
    beta = np.linalg.solve(inner[:-1, :-1], inner[:-1, -1])
    rss = inner[-1, -1] - beta @ inner[:-1, -1]
    cov = np.linalg.inv(inner[:-1, :-1]) * rss / (g[0, 0] - n_entities - len(x))
    return [(c, float(b), float(s)) for c, b, s in zip(x, beta, np.sqrt(np.diag(cov)))]


def random_effects(df: DataFrame, entity: str, y: str, x: list[str]) -> tuple[list[tuple], float]:
    """Quasi-demeaned coefficients (term, estimate, std error) and the Hausman statistic against the within model."""
    fe = fixed_effects(df, entity, y, x)
    k, n, groups = len(x), df.count(), df.select(entity).distinct().count()
    within = next(iter(gram(demean(df, entity, [*x, y]), x, y).values()))[1:, 1:]
    b = np.array([r[1] for r in fe])
    s_e = float(within[-1, -1] - b @ within[:-1, -1]) / (n - groups - k)
    means = df.groupBy(entity).agg(*[F.avg(c).alias(c) for c in [*x, y]], F.count("*").alias("t"))
    gb = next(iter(gram(means, x, y).values()))
    beta = np.linalg.lstsq(gb[:-1, :-1], gb[:-1, -1], rcond=None)[0]
    s_b = float(gb[-1, -1] - beta @ gb[:-1, -1]) / max(groups - k - 1, 1)
    per = n / groups
    s_u = max(0.0, s_b - s_e / per)
    theta = 1 - F.sqrt(F.lit(s_e) / (F.lit(s_e) + F.count("*").over(Window.partitionBy(entity)) * s_u))
    w = Window.partitionBy(entity)
    quasi = df.withColumn("_one", 1 - theta).withColumns({c: F.col(c) - theta * F.avg(c).over(w) for c in [*x, y]})
    g = next(iter(gram(quasi, ["_one", *x], y).values()))[1:, 1:]
    re = np.linalg.solve(g[:-1, :-1], g[:-1, -1])
    s2 = float(g[-1, -1] - re @ g[:-1, -1]) / (n - k - 1)
    cov = np.linalg.inv(g[:-1, :-1]) * s2
    diff = b - re[1:]
    spread = np.linalg.inv(within[:-1, :-1]) * s_e - cov[1:, 1:]
    return [(t, float(v), float(s)) for t, v, s in zip(["intercept", *x], re, np.sqrt(np.diag(cov)))], float(diff @ np.linalg.pinv(spread) @ diff)


def proportion_ci(df: DataFrame, keys: list[str], flag: str, z: float = 1.959963984540054) -> DataFrame:
    p = df.groupBy(*keys).agg(F.sum(flag).alias("w"), F.count(flag).alias("n"))
    r = F.col("w") / F.col("n")
    half = z * F.sqrt(r * (1 - r) / F.col("n"))
    mid = (F.col("w") + z * z / 2) / (F.col("n") + z * z)
    wide = z * F.sqrt(F.col("n")) / (F.col("n") + z * z) * F.sqrt(r * (1 - r) + z * z / (4 * F.col("n")))
    return p.select(*keys, "n", *[F.round(c, 9).alias(name) for c, name in ((r, "rate"), (r - half, "wald_lo"), (r + half, "wald_hi"), (mid - wide, "wilson_lo"), (mid + wide, "wilson_hi"))])


def poisson_fit_check(df: DataFrame, col: str) -> DataFrame:
    """Observed share of each count with the Poisson probability at the mean."""
    total = df.agg(F.avg(col).alias("m"), F.count(col).alias("total"))
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("x")).agg(F.count("*").alias("n"))
    log_factorial = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest("x", F.lit(1).cast("long"))), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))
    # x * ln(m) is 0 at x = 0, also for a mean of 0
    power = F.when(F.col("x") == 0, F.lit(0.0)).otherwise(F.col("x") * F.log("m"))
    return counts.crossJoin(F.broadcast(total)).select("x", "n", F.round(F.col("n") / F.col("total"), 9).alias("observed"), F.round(F.exp(power - F.col("m") - log_factorial), 9).alias("expected"))


def poisson_moments(df: DataFrame, col: str, z: float = 1.959963984540054) -> DataFrame:
    """Mean, variance and the Wald interval of a Poisson mean."""
    m, half = F.avg(col), z * F.sqrt(F.avg(col) / F.count(col))
    return df.agg(*[F.round(c, 9).alias(name) for c, name in ((m, "mean_n"), (F.var_samp(col), "var_n"), (m - half, "lo"), (m + half, "hi"))])


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    e = F.col(y) - F.col(pred)
    return df.agg(F.round(F.avg(e * e), 6).alias("mse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(1 - F.sum(e * e) / (F.var_pop(y) * F.count(y)), 9).alias("r2"))


def mape(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.abs(F.try_divide(F.col(y) - F.col(pred), F.col(y)))) * 100, 6).alias("mape"))


# ---- generalised linear models and the bootstrap
def glm(df: DataFrame, y: str, x: list[str], family: str, weight: str | None = None) -> list[tuple]:
    """(term, coefficient, std error) and the deviance."""
    rows = feature.VectorAssembler(inputCols=x, outputCol="features", handleInvalid="skip").transform(df)
    g = regression.GeneralizedLinearRegression(family=family, labelCol=y, featuresCol="features", maxIter=25, tol=1e-12)
    m = (g.setWeightCol(weight) if weight else g).fit(rows)
    se = m.summary.coefficientStandardErrors
    terms = [*zip(x, m.coefficients.toArray().tolist(), se), ("intercept", m.intercept, se[-1])]
    return [*[(t, float(b), float(s)) for t, b, s in terms], ("deviance", float(m.summary.deviance), None)]


def likelihood_ratio(small: list[tuple], large: list[tuple]) -> tuple[float, float, float, int, float]:
    """(deviance of the small model, of the large one, their difference, its degrees of freedom, p) of nested fits by ``glm``."""
    a, b = small[-1][1], large[-1][1]
    return a, b, a - b, len(large) - len(small), chi2_upper(max(a - b, 0.0), len(large) - len(small))


def logit_covariance(df: DataFrame, x: list[str], beta: list[float]) -> np.ndarray:
    """Covariance of a logistic fit's coefficients (intercept first): the inverse of the weighted Gram matrix."""
    p = 1 / (1 + F.exp(-predict(x, beta)))
    root = df.dropna(subset=x).withColumn("_w", F.sqrt(p * (1 - p)))
    scaled = root.select(F.col("_w").alias("_one"), *[(F.col(c) * F.col("_w")).alias(c) for c in x])
    return np.linalg.inv(gram(scaled, ["_one", *x], "_one")[()][1:-1, 1:-1])


def predict_ci(df: DataFrame, x: list[str], beta: list[float], cov: np.ndarray, z: float = 1.959963984540054) -> DataFrame:
    """df with prob, lo and hi: a normal interval of the link, transformed back."""
    link, v = predict(x, beta), [F.lit(1.0), *map(F.col, x)]
    d = len(v)
    var = sum((v[i] * v[j] * float(cov[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    back = lambda c: 1 / (1 + F.exp(-c))
    return df.withColumns({"prob": back(link), "lo": back(link - z * se), "hi": back(link + z * se)})


def multinomial_probabilities(x: list[str], coefs: list[list[float]]) -> list[Column]:
    """A probability of each class; coefficients of a class are (intercept, x...)."""
    eta = [predict(x, w) for w in coefs]
    top = F.greatest(*eta)
    total = sum((F.exp(e - top) for e in eta[1:]), F.exp(eta[0] - top))
    return [F.exp(e - top) / total for e in eta]


def multinomial_loglik(df: DataFrame, x: list[str], label: str, coefs: list[list[float]]) -> DataFrame:
    eta = [predict(x, w) for w in coefs]
    top = F.greatest(*eta)
    total = top + F.log(sum((F.exp(e - top) for e in eta[1:]), F.exp(eta[0] - top)))
    own = F.element_at(F.array(*eta), F.col(label).cast("int") + 1)
    return df.dropna(subset=[*x, label]).agg(F.sum(own - total).alias("loglik"))


def odds_ratios(terms: list[tuple], c: float = 1.0, z: float = 1.959963984540054) -> list[tuple]:
    return [(t, *(float(np.exp(c * (b + k * z * s))) for k in (0, -1, 1))) for t, b, s in terms if s is not None]


def irls(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 25) -> np.ndarray:
    """Binomial logit fit of successes y out of n."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        b = b + np.linalg.solve((x * w[:, None]).T @ x + 1e-9 * np.eye(len(b)), x.T @ (y - n * p))
    return b


def parametric_bootstrap(spark: SparkSession, x: list[float], n: list[float], beta: list[float], replicates: int, at: list[float]) -> DataFrame:
    """Mean and 5 % to 95 % interval of the refitted probability at each point of ``at``, over replicates of a small table."""
    points, trials, fitted = np.array(x), np.array(n), np.array(beta)

    def one(rep: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(rep["rep"].iloc[0]))
        k = rng.integers(0, len(points), len(points))
        design = np.column_stack([np.ones(len(points)), points[k]])
        y = rng.binomial(trials[k].astype(int), 1 / (1 + np.exp(-design @ fitted)))
        b = irls(design, y, trials[k])
        return pd.DataFrame({"at": at, "p": [float(1 / (1 + np.exp(-(b[0] + b[1] * v)))) for v in at]})

    reps = spark.range(replicates).withColumnRenamed("id", "rep").groupBy("rep").applyInPandas(one, "at double, p double")
    return reps.groupBy("at").agg(F.avg("p").alias("mean_p"), F.percentile("p", 0.05).alias("lo"), F.percentile("p", 0.95).alias("hi"))


# ---- MLlib
def class_weights(df: DataFrame, label: str) -> DataFrame:
    ratio = df.agg((1 - F.avg(label)).alias("_r"))
    return df.crossJoin(F.broadcast(ratio)).withColumn("class_weight", F.when(F.col(label) == 1, F.col("_r")).otherwise(1 - F.col("_r"))).drop("_r")


def feature_pipeline(num: list[str], cat: list[str], pca: int = 3) -> Pipeline:
    """Indexed and one-hot categories, the first sliced and all reduced by PCA, with the numeric columns."""
    index = [feature.StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="skip", stringOrderType="frequencyDesc") for c in cat]
    hot = feature.OneHotEncoder(inputCols=[f"{c}_ix" for c in cat], outputCols=[f"{c}_hot" for c in cat], dropLast=False)
    joined = feature.VectorAssembler(inputCols=[f"{c}_hot" for c in cat], outputCol="cat_all")
    reduced = feature.PCA(k=pca, inputCol="cat_all", outputCol="cat_pca")
    first = feature.VectorSlicer(inputCol="cat_all", outputCol="cat_first", indices=[0])
    numeric = feature.VectorAssembler(inputCols=num, outputCol="num_all", handleInvalid="skip")
    return Pipeline(stages=[*index, hot, joined, reduced, first, numeric, feature.VectorAssembler(inputCols=["num_all", "cat_pca", "cat_first"], outputCol="features")])


def tree_pipeline(num: list[str], cat: list[str]) -> Pipeline:
    index = [feature.StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="skip") for c in cat]
    joined = feature.VectorAssembler(inputCols=[*num, *[f"{c}_ix" for c in cat]], outputCol="raw", handleInvalid="skip")
    return Pipeline(stages=[*index, joined, feature.StandardScaler(inputCol="raw", outputCol="features")])


def house_features(df: DataFrame, num: list[str], logged: str, cat: list[str]) -> DataFrame:
    """df with ``features``: standardised numbers, a logarithm, one-hot categories in alphabetic order."""
    df = df.withColumn("_log", F.when(F.col(logged) > 0, F.log(logged)))
    index = [feature.StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="skip", stringOrderType="alphabetAsc") for c in cat]
    hot = feature.OneHotEncoder(inputCols=[f"{c}_ix" for c in cat], outputCols=[f"{c}_hot" for c in cat], dropLast=False)
    raw = feature.VectorAssembler(inputCols=num, outputCol="num_raw", handleInvalid="skip")
    scaled = feature.StandardScaler(inputCol="num_raw", outputCol="num_scaled", withMean=True, withStd=True)
    joined = feature.VectorAssembler(inputCols=["num_scaled", "_log", *[f"{c}_hot" for c in cat]], outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[*index, hot, raw, scaled, joined]).fit(df).transform(df).drop("_log", "num_raw", "num_scaled", *[f"{c}_{k}" for c in cat for k in ("ix", "hot")])


CLASSIFIERS = {
    "forest": lambda y: classification.RandomForestClassifier(labelCol=y, numTrees=10, maxDepth=10, maxBins=300, seed=1),
    "forest_deep": lambda y: classification.RandomForestClassifier(labelCol=y, numTrees=20, maxDepth=15, maxBins=300, seed=1),
    "logistic": lambda y: classification.LogisticRegression(labelCol=y, maxIter=20),
    "tree": lambda y: classification.DecisionTreeClassifier(labelCol=y, impurity="gini", maxDepth=10, maxBins=300),
    "boosted": lambda y: classification.GBTClassifier(labelCol=y, maxDepth=10, maxIter=10, maxBins=300, seed=1),
}


def train_and_score(train: DataFrame, test: DataFrame, label: str, kind: str, prepare: Pipeline) -> DataFrame:
    """test with ``prediction``; indexers and scalers are fitted on train alone."""
    fitted = prepare.fit(train)
    return CLASSIFIERS[kind](label).fit(fitted.transform(train)).transform(fitted.transform(test))


def binned_cells(fitted, parts: list[DataFrame], label: str, bins: int = 300) -> list[DataFrame]:
    """Of each part, the different rows of binned features with their number: (bins, label, n), bins an array.

    A tree asks of a row only in which bin each feature is, so rows of equal bins and label are one row with a weight. A
    feature of at most ``bins`` values in the first part has a bin for each, another is cut at its quantiles there (all
    rows are counted; a cut is within a ten-thousandth of the rows of its place).
    """
    row = fitted.transform(parts[0]).select("features").first()
    names = [f"x{k}" for k in range(len(row["features"]))]
    values = lambda df: fitted.transform(df).select(F.col(label).cast("double").alias("label"), vector_to_array("features").alias("_f")).select("label", *[F.col("_f")[k].alias(c) for k, c in enumerate(names)])
    first = values(parts[0])
    found = first.agg(*[F.percentile_approx(c, [k / bins for k in range(1, bins)], 10_000).alias(c) for c in names], *[F.approx_count_distinct(c, 0.01).alias(f"n_{c}") for c in names]).first()
    short = [c for c in names if found[f"n_{c}"] <= 1.2 * bins]
    sets = first.agg(*[F.collect_set(c).alias(c) for c in short]).first().asDict() if short else {}
    splits = []
    for c in names:
        few = sets.get(c, [])
        inner = sorted(few)[1:] if 0 < len(few) <= bins else sorted(set(found[c]))
        splits.append([-math.inf, *(inner or [0.0]), math.inf])
    coded = [f"b{k}" for k in range(len(names))]
    bucket = feature.Bucketizer(inputCols=names, outputCols=coded, splitsArray=splits)
    cells = [bucket.transform(values(part)).groupBy("label", *coded).agg(F.count("*").cast("double").alias("n")) for part in parts]
    return [saved(c.select(F.array(*coded).alias("bins"), "label", "n"), "cells") for c in cells]


def bootstrapped(cells: DataFrame, trees: int, seed: int) -> DataFrame:
    """cells with ``times``: how often each tree draws their rows with replacement.

    MLlib draws each row a Poisson number of times, of mean 1; for n rows these add up to a Poisson number of mean n. The
    random numbers follow from the cell alone.
    """

    def draw(h: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.Generator(np.random.Philox(key=[x % (1 << 64), seed])).poisson(m, trees).astype(float).tolist() for x, m in zip(h.tolist(), n)])

    times = F.pandas_udf(draw, "array<double>")
    return cells.withColumn("times", times(F.xxhash64("bins", "label"), "n"))


def score_cells(train: DataFrame, test: DataFrame, label: str, kind: str, prepare: Pipeline) -> DataFrame:
    """(label, prediction, n) of test: ``train_and_score`` of boosted trees or a forest, from weighted cells of equal rows.

    A forest's trees are fitted one by one on what each has drawn, and vote with their leaves' shares as MLlib's do.
    """
    model = CLASSIFIERS[kind]("label")
    learnt, judged = binned_cells(prepare.fit(train), [train, test], label, model.getMaxBins())
    learnt = learnt.repartition(2 * train.sparkSession.sparkContext.defaultParallelism)  # their files are few and small
    tests = judged.select(array_to_vector("bins").alias("features"), "label", "n")
    if isinstance(model, classification.GBTClassifier):
        rows = learnt.select(array_to_vector("bins").alias("features"), "label", "n")
        return model.setWeightCol("n").fit(rows).transform(tests).select("label", "prediction", "n")
    trees, seed = model.getNumTrees(), model.getSeed()
    drawn = saved(bootstrapped(learnt, trees, seed), "drawn-cells").select(array_to_vector("bins").alias("features"), "label", "times")
    one = model.copy().setNumTrees(1).setBootstrap(False).setSubsamplingRate(1.0).setFeatureSubsetStrategy("sqrt").setWeightCol("w")
    # A small fit is mostly waiting between its jobs: a few run side by side.
    with ThreadPoolExecutor(4) as pool:
        fits = list(pool.map(lambda k: one.copy({one.seed: seed + k}).fit(drawn.select("features", "label", F.col("times")[k].alias("w")).where("w > 0")), range(trees)))
    votes = F.lit(0.0)
    for k, fitted in enumerate(fits):
        tests = fitted.setRawPredictionCol("").setPredictionCol("").setProbabilityCol(f"_p{k}").transform(tests)
        votes = votes + vector_to_array(f"_p{k}")[1]
    return tests.select("label", F.when(votes > trees / 2, 1.0).otherwise(0.0).alias("prediction"), "n")


def feature_importance(train: DataFrame, label: str, num: list[str], cat: list[str], kind: str = "forest") -> list[tuple[str, float]]:
    """(feature, importance) by name, the largest first."""
    rows = tree_pipeline(num, cat).fit(train).transform(train)
    found = CLASSIFIERS[kind](label).fit(rows).featureImportances.toArray()
    return sorted(zip([*num, *cat], map(float, found)), key=lambda r: (-r[1], r[0]))


def roc_auc(df: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label).evaluate(df)
