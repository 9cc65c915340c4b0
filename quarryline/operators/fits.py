"""Generalised linear models of many groups at once, penalised grids and one-hot components from sums of products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import segments
from quarryline.operators.models import gram
from quarryline.sources.files import saved

#: categories over all columns of a one-hot PCA: their matrix of counts is decomposed on the driver
MOST_CATEGORIES = 4_000


def _response(family: str, y: Column, w: Column, eta: Column | None) -> tuple[Column, Column, Column, Column]:
    """(link, mean, variance, deviance) of a row; without a link the usual starting mean."""
    if family == "poisson":
        mu = y + 0.1 if eta is None else F.exp(eta)
        return (F.log(mu) if eta is None else eta), mu, mu, 2 * w * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - y + mu)
    if family != "binomial":
        raise ValueError(f"no family {family}")
    mu = (w * y + 0.5) / (w + 1) if eta is None else 1 / (1 + F.exp(-eta))
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    return (F.log(mu / (1 - mu)) if eta is None else eta), mu, mu * (1 - mu), 2 * w * (part(y, mu) + part(1 - y, 1 - mu))


def fit_glm(df: DataFrame, y: str, x: list[str], family: str, by: Sequence[str] = (), weight: str | None = None, steps: int = 25, tol: float = 1e-10) -> DataFrame:
    """(by..., term, estimate, se) of a fit in each group, and a row ``deviance``; all groups step together.

    Iteratively reweighted least squares: a step is one aggregate of weighted products over all rows, each group's small
    system is solved where its sums are, and the steps end when no group's deviance moves by more than ``tol`` of itself
    (or after ``steps``). Rows with a null in y, x or the weight are left out; a null group is a group. Where a group's
    columns depend on each other its coefficients are those of least norm. An empty table gives no rows.
    """
    keys, d = list(by) or ["_all"], len(x) + 1
    df = df if by else df.withColumn("_all", F.lit(0))
    own = {"_y": F.col(y), "_w": F.col(weight) if weight else F.lit(1.0), **{f"_x{i}": F.col(c) for i, c in enumerate(x)}}
    rows = saved(df.select(*keys, *[c.cast("double").alias(n) for n, c in own.items()]).dropna(subset=list(own)), "glm-rows")
    v = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(d - 1)]]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "_b array<double>", "_se array<double>", "_dev double"])

    def solve(frames):
        for part in frames:
            b, se = [], []
            for values in part[[f"a{i}_{j}" for i in range(d) for j in range(i + 1)] + [f"c{i}" for i in range(d)]].to_numpy(float):
                a = np.zeros((d, d))
                a[np.tril_indices(d)] = values[:-d]
                a = a + np.tril(a, -1).T
                inverse = np.linalg.pinv(a, rcond=1e-14, hermitian=True)
                b.append((inverse @ values[-d:]).tolist())
                se.append(np.sqrt(np.clip(np.diag(inverse), 0, None)).tolist())
            yield part[keys].assign(_b=b, _se=se, _dev=part["_dev"])

    fitted = None
    for step in range(steps):
        at = rows if fitted is None else segments.join_side(rows, fitted.select(*keys, "_b"), keys)
        eta = None if fitted is None else F.greatest(F.lit(-500.0), F.least(F.lit(500.0), sum((c * F.col("_b")[i] for i, c in enumerate(v)), F.lit(0.0))))
        link, mu, var, dev = _response(family, F.col("_y"), F.col("_w"), eta)
        var = F.greatest(var, F.lit(1e-12))
        at = at.withColumns({"_h": F.col("_w") * var, "_z": link + (F.col("_y") - mu) / var, "_d": dev})
        sums = [F.sum(F.col("_h") * v[i] * v[j]).alias(f"a{i}_{j}") for i in range(d) for j in range(i + 1)]
        sums += [F.sum(F.col("_h") * v[i] * F.col("_z")).alias(f"c{i}") for i in range(d)]
        now = saved(at.groupBy(*keys).agg(*sums, F.sum("_d").alias("_dev")).mapInPandas(solve, schema), f"glm-step-{step}")
        if fitted is not None:
            old = fitted.select(*keys, F.col("_dev").alias("_old"))
            moved = segments.join_side(now.select(*keys, "_dev"), old, keys).where(F.abs(F.col("_dev") - F.col("_old")) > tol * (F.abs("_dev") + 0.1))
            if moved.isEmpty():
                fitted = now
                break
        fitted = now
    names = F.array(*[F.lit(c) for c in ["intercept", *x, "deviance"]])
    values = F.arrays_zip(names.alias("term"), F.concat("_b", F.array("_dev")).alias("estimate"), F.concat("_se", F.array(F.lit(None).cast("double"))).alias("se"))
    return fitted.select(*by, F.inline(values).alias("term", "estimate", "se"))


def _centred(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(means of x, covariance of x, covariance of x with y, mean of y) from a matrix of sums."""
    n, m = g[0, 0], g[0, 1:] / g[0, 0]
    c = g[1:, 1:] / n - np.outer(m, m)
    return m[:-1], c[:-1, :-1], c[:-1, -1], m[-1]


def elastic_net(g: np.ndarray, reg: float, mix: float, steps: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Weights (intercept first) that minimise half the mean squared error + reg * (mix * |w| + (1 - mix) / 2 * |w|^2).

    Coordinate descent on the covariances of a matrix of sums; with mix 0 the closed form of ridge. A penalty of alpha on the
    sum of squared errors is reg = alpha / n. (MLlib divides the squared part by the label's deviation.)
    """
    m, c, xy, my = _centred(g)
    if mix == 0:
        w = np.linalg.lstsq(c + reg * np.eye(len(c)), xy, rcond=None)[0]
        return np.r_[my - m @ w, w]
    w = np.zeros(len(c))
    for _ in range(steps):
        old = w.copy()
        for j in range(len(w)):
            size = c[j, j] + reg * (1 - mix)
            pull = xy[j] - c[j] @ w + c[j, j] * w[j]
            w[j] = np.sign(pull) * max(abs(pull) - reg * mix, 0.0) / size if size > 0 else 0.0
        if np.abs(w - old).max(initial=0) <= tol * max(1.0, np.abs(w).max(initial=0)):
            break
    return np.r_[my - m @ w, w]


def held_out(g: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(mean squared error, R2) of weights on the rows that a matrix of sums holds."""
    v = np.r_[w, -1.0]
    rss = float(v @ g @ v)
    return rss / float(g[0, 0]), 1 - rss / float(g[-1, -1] - g[0, -1] ** 2 / g[0, 0])


def grid_by_fold(df: DataFrame, x: list[str], y: str, fold: str, regs: list[float], mixes: list[float]) -> list[tuple[int, float, float, float, float]]:
    """(fold, reg, mix, mse, r2) on each fold of the fit to the others, for the whole grid, in one pass over the rows.

    A fold's sums of products are all that any point of the grid needs: the sums of the other folds are the total less its own.
    """
    grams = {k[0]: g for k, g in gram(df, x, y, [fold]).items()}
    total = sum(grams.values())
    return [(int(k), reg, mix, *held_out(grams[k], elastic_net(total - grams[k], reg, mix))) for k in sorted(grams) for reg in regs for mix in mixes]


def one_hot_counts(df: DataFrame, cat: list[str]) -> DataFrame:
    """(a_column, a, b_column, b, n): rows with category a in one column and b in the same or a later one.

    These are the products that one-hot vectors would sum to, without the vectors; a null is in no category.
    """
    own = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cat)]
    pairs = F.explode(F.array(*[F.struct(own[i].alias("a"), own[j].alias("b")) for i in range(len(cat)) for j in range(i, len(cat))]))
    found = df.select(pairs.alias("p")).where("p.a.v IS NOT NULL AND p.b.v IS NOT NULL")
    return found.groupBy(F.col("p.a.c").alias("a_column"), F.col("p.a.v").alias("a"), F.col("p.b.c").alias("b_column"), F.col("p.b.v").alias("b")).agg(F.count("*").alias("n"))


def one_hot_variance(df: DataFrame, cat: list[str]) -> list[tuple[int, float]]:
    """(k, share of the variance of one-hot categories that their first k principal components explain), for every k."""
    counts = saved(one_hot_counts(df, cat), "one-hot")
    own = {c: i for i, c in enumerate(cat)}
    names = counts.where("a_column = b_column AND a = b").select("a_column", "a").limit(MOST_CATEGORIES + 1).collect()
    if len(names) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    if not names:
        return []
    at = {k: i for i, k in enumerate(sorted(((r["a_column"], r["a"]) for r in names), key=lambda k: (own[k[0]], k[1])))}
    n, products = df.count(), np.zeros((len(at), len(at)))
    for r in counts.collect():  # the square of MOST_CATEGORIES at most
        i, j = at[r["a_column"], r["a"]], at[r["b_column"], r["b"]]
        products[i, j] = products[j, i] = r["n"]
    m = np.diag(products) / n
    values = np.clip(np.linalg.eigvalsh(products / n - np.outer(m, m))[::-1], 0, None)
    share = np.cumsum(values) / values.sum() if values.sum() > 0 else np.ones(len(values))
    return [(k + 1, float(s)) for k, s in enumerate(share)]


def knn_regress(train: DataFrame, query: DataFrame, key: str, vector: str, y: str, ks: list[int], block: int = 4_000, strip: int = 50_000) -> DataFrame:
    """(q, k, pred): per query row and k, the mean y of its k nearest train rows; equal distances by the smaller key.

    A grid join: query rows in blocks, train rows in strips, a group of a block and a strip in a task, so neither side is
    ever whole in one place. A group keeps its best for each query row, and the strips' bests are merged by rank. Rows
    without a vector are left out; repeated rows count each; a null y has no part in a mean.
    """
    most = max(ks)
    asked = saved(segments.number_rows(query.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v")), [], ["q"], "_i"), "knn-query")
    known = saved(segments.number_rows(train.where(F.col(vector).isNotNull()).select(F.col(key).alias("t"), F.col(vector).cast("array<double>").alias("v"), F.col(y).cast("double").alias("y")), [], ["t"], "_i"), "knn-train")
    n_blocks, n_strips = -(-max(asked.count(), 1) // block), -(-max(known.count(), 1) // strip)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_r", F.floor(F.col("_i") / block).cast("int")).withColumn("_c", spread(n_strips))
    right = known.withColumn("_c", F.floor(F.col("_i") / strip).cast("int")).withColumn("_r", spread(n_blocks))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_i": [], "q": [], "t": [], "d": [], "y": []})
        m, best = np.stack(a["v"].to_numpy()).astype(float), None
        b = b.sort_values("t", kind="stable")
        for i in range(0, len(b), 1_000):
            part = b.iloc[i : i + 1_000]
            w = np.stack(part["v"].to_numpy()).astype(float)
            d = np.abs(((m**2).sum(1)[:, None] - 2 * m @ w.T + (w**2).sum(1)[None, :]).round(9))
            keep = min(most, d.shape[1])
            place = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            edge = np.take_along_axis(d, place, 1).max(1)
            tied = np.flatnonzero((d <= edge[:, None]).sum(1) > keep)
            place[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :keep]  # train rows stand by key
            new = [np.take_along_axis(d, place, 1), part["t"].to_numpy()[place], part["y"].to_numpy()[place]]
            if best is not None:
                new = [np.concatenate(pair, axis=1) for pair in zip(best, new)]
            order = np.lexsort((new[1], new[0]), axis=1)[:, :most]
            best = [np.take_along_axis(c, order, 1) for c in new]
        times = best[0].shape[1]
        return pd.DataFrame({"_i": np.repeat(a["_i"].to_numpy(), times), "q": np.repeat(a["q"].to_numpy(), times), "t": best[1].ravel(), "d": best[0].ravel(), "y": best[2].ravel()})

    found = left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInPandas(nearest, "_i long, q long, t long, d double, y double")
    order = F.struct(F.col("d"), F.col("t"), F.col("y"))
    ranked = found.groupBy("_i", "q").agg(F.slice(F.sort_array(F.collect_list(order)), 1, most).alias("best"))  # most for each strip
    means = [F.struct(F.lit(k).alias("k"), F.slice("best", 1, k).alias("near")) for k in ks]
    each = ranked.select("_i", "q", F.explode(F.array(*means)).alias("m")).select("_i", "q", "m.k", F.filter(F.transform("m.near", lambda s: s["y"]), lambda v: v.isNotNull()).alias("_y"))
    return each.select("q", "k", F.try_divide(F.aggregate("_y", F.lit(0.0), lambda acc, v: acc + v), F.size("_y")).alias("pred"))


def distinct_sketch(df: DataFrame, by: list[str], col: str, lg_k: int = 12) -> DataFrame:
    """(by..., sketch): a mergeable sketch of a column's different values per group, of at most about 2^lg_k bytes; nulls are not values."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(col, F.lit(lg_k)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., approx): different values over the union of sketches; the standard error is about 1.04 / sqrt(2^lg_k)."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx"))
