"""Time series per key (Y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import segments
from quarryline.operators.models import gram_sums
from quarryline.sources.files import saved


def hourly(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, t, value): means per hour, t numbered from 1 within the key."""
    means = df.groupBy(key, F.date_trunc("day", ts).cast("date").alias("day")).agg(F.avg(value).alias("value"))
    return means.select(F.col(key).alias("key"), "day", "value", F.row_number().over(Window.partitionBy(key).orderBy("day")).alias("t"))


def filter_index(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    return df.where((F.col(ts) >= F.lit(start).cast("date")) & (F.col(ts) < F.lit(end).cast("date")))


def trend_fit(series: DataFrame) -> DataFrame:
    """Linear trend per key, with residual RMSE."""
    fits = series.groupBy("key").agg(F.regr_slope("value", "t").alias("b"), F.regr_intercept("value", "t").alias("a"), F.count("*").alias("n"))
    r = series.join(fits, "key").withColumn("e", F.col("value") - F.col("a") - F.col("b") * F.col("t"))
    return r.groupBy("key").agg(F.round(F.first("b"), 6).alias("slope"), F.round(F.first("a"), 6).alias("intercept"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"))


def _trend_columns(degree: int, season: Column | None, seasons: int, event: Column | None, log: bool) -> tuple[dict[str, Column], Column]:
    x = {f"_p{k}": F.pow(F.col("t") / 100.0, k) for k in range(1, degree + 1)}
    if season is not None:
        x |= {f"_s{k}": (season == k).cast("double") for k in range(2, seasons + 1)}
    if event is not None:
        x["_e"] = event.cast("double")
    y = F.when(F.col("value") > 0, F.log("value")) if log else F.col("value").cast("double")
    return x, y


def trend_season_fit(series: DataFrame, degree: int = 1, season: Column | None = None, seasons: int = 0, event: Column | None = None, log: bool = False) -> DataFrame:
    """Per key, least squares on powers of t / 100, dummies of seasons 2 to ``seasons`` and an event flag.

    Returns (key, coefs, n, rmse, aic, bic), intercept first. Spark sums each key's products; the small systems
    are solved where the sums are. A season that a key lacks gets the least-norm coefficient, 0.
    """
    x, y = _trend_columns(degree, season, seasons, event, log)
    sums, d = gram_sums(series.select("key", y.alias("_y"), *[c.alias(k) for k, c in x.items()]), list(x), "_y", ["key"]), len(x) + 2

    def solve(frames):
        for df in frames:
            out = []
            for row in df.itertuples(index=False):
                g = np.zeros((d, d))
                g[np.tril_indices(d)] = row[1:]
                g = g + np.tril(g, -1).T
                beta, _, rank, _ = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)
                n, rss = g[0, 0], max(float(g[-1, -1] - 2 * beta @ g[:-1, -1] + beta @ g[:-1, :-1] @ beta), 1e-300)
                fit = n * (np.log(2 * np.pi * rss / n) + 1)
                out.append((row[0], beta.tolist(), int(n), float(np.sqrt(rss / n)), fit + 2 * (rank + 1), fit + np.log(n) * (rank + 1)))
            yield pd.DataFrame(out, columns=["key", "coefs", "n", "rmse", "aic", "bic"])

    return sums.mapInPandas(solve, "key string, coefs array<double>, n long, rmse double, aic double, bic double")


def trend_residuals(series: DataFrame, degree: int = 1, season: Column | None = None, seasons: int = 0, event: Column | None = None, log: bool = False) -> DataFrame:
    """(key, day, t, value) with value the residual of ``trend_season_fit``: a series for ``acf`` and ``ljung_box``.

    A value that has no logarithm has no residual. There is one fit for each key, so the fits are the small side of the join.
    """
    x, y = _trend_columns(degree, season, seasons, event, log)
    fits = saved(trend_season_fit(series, degree, season, seasons, event, log).select("key", "coefs"), "trend-fits")
    fitted = sum((F.col("coefs")[i] * c for i, c in enumerate([F.lit(1.0), *x.values()])), F.lit(0.0))
    return segments.join_side(series, fits, ["key"]).select("key", "day", "t", (y - fitted).alias("value"))


def ccf(series: DataFrame, a: str, b: str, lags: int) -> DataFrame:
    """(lag, r): correlation of a's value ``lag`` days after b's, over the days that both have; biased as in ``acf``."""
    side = lambda k, name: series.where(F.col("key") == k).select("day", F.col("value").alias(name))
    both = side(a, "x").join(side(b, "y"), "day")
    m = both.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.count("*") * F.stddev_pop("x") * F.stddev_pop("y")).alias("c"))
    z = both.crossJoin(F.broadcast(m)).select("day", "c", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    later = z.select("y", "c", F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), F.col("day").alias("_d")).withColumn("day", F.date_add("_d", F.col("lag")))
    return later.join(z.select("day", "x"), "day").groupBy("lag").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.first("c")).alias("r"))


def acf(series: DataFrame, lags: int) -> DataFrame:
    """Biased autocorrelations: sums at lag L over the sum of squares, both about the mean of all."""
    w = Window.partitionBy("key")
    y = series.withColumn("z", F.col("value") - F.avg("value").over(w))
    o = w.orderBy("t")
    parts = [F.sum(F.col("z") * F.col(f"z{k}")).alias(f"c{k}") for k in range(1, lags + 1)]
    wide = y.withColumns({f"z{k}": F.lag("z", k).over(o) for k in range(1, lags + 1)}).groupBy("key").agg(F.sum(F.col("z") * F.col("z")).alias("c0"), F.count("*").alias("n"), *parts)
    return wide.select("key", "n", F.posexplode(F.array(*[F.round(F.try_divide(F.col(f"c{k}"), F.col("c0")), 6) for k in range(1, lags + 1)])).alias("lag", "r")).withColumn("lag", F.col("lag") + 1)


def ljung_box(series: DataFrame, lags: int) -> DataFrame:
    a = acf(series, lags)
    return a.groupBy("key").agg(F.round(F.first("n") * (F.first("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag"))), 4).alias("q"))


def baseline_forecast(series: DataFrame, h: int) -> DataFrame:
    """Mean, naive and drift forecasts of the next h periods."""
    e = series.groupBy("key").agg(F.avg("value").alias("m"), F.max_by("value", "t").alias("last"), F.min_by("value", "t").alias("first"), F.count("*").alias("n"))
    e = e.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    drift = F.col("last") + F.col("step") * F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.col("n") - 1), F.lit(0.0))
    return e.select("key", "step", F.round("m", 6).alias("mean_fc"), F.round("last", 6).alias("naive_fc"), F.round(drift, 6).alias("drift_fc"))


def forecast_cv(series: DataFrame, init: int = 3, h: int = 8) -> DataFrame:
    """RMSE by horizon and method over all origins from ``init`` on, by windows alone."""
    o = Window.partitionBy("key").orderBy("t")
    s = series.withColumns({"m": F.avg("value").over(o.rowsBetween(Window.unboundedPreceding, 0)), "first": F.first("value").over(o.rowsBetween(Window.unboundedPreceding, 0))})
    s = s.withColumns({f"y{k}": F.lead("value", k).over(o) for k in range(1, h + 1)}).where(F.col("t") >= init)
    s = s.select("t", "value", "m", "first", F.posexplode(F.array(*[f"y{k}" for k in range(1, h + 1)])).alias("k", "y")).where("y is not null").withColumn("step", F.col("k") + 1)
    drift = F.col("value") + F.col("step") * (F.col("value") - F.col("first")) / (F.col("t") - 1)
    rmse = lambda p: F.round(F.sqrt(F.avg(F.pow(F.col("y") - p, 2))), 6)
    return s.groupBy("step").agg(rmse(F.col("m")).alias("mean_rmse"), rmse(F.col("value")).alias("naive_rmse"), rmse(drift).alias("drift_rmse"))


def forecast_accuracy(df: DataFrame, y: str, pred: str, by: list[str]) -> DataFrame:
    e = F.col(y) - F.col(pred)
    r = lambda c: F.round(c, 6)
    return df.groupBy(*by).agg(r(F.avg(e)).alias("me"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(F.avg(F.abs(e))).alias("mae"), r(100 * F.avg(F.try_divide(e, F.col(y)))).alias("mpe"), r(100 * F.avg(F.abs(F.try_divide(e, F.col(y))))).alias("mape"))


def split_tail(series: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("t")))
    return series.withColumn("held_out", rank <= n)


def to_long(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.unpivot(key, cols, "name", "value")


def to_wide(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    return df.groupBy(key).pivot("name", names).agg(F.first("value"))
