"""Cleaning, joins, aggregates, windows, top-k, set operations and samples (P, J, A, W, O, U, X)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.columns import hash_bucket
from quarryline.operators import segments
from quarryline.sources.files import saved

#: Most rows of a lookup side that is broadcast.
BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, side: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a side that is broadcast where it has at most BROADCAST_ROWS rows, else shuffled."""
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if small else side, on, how)


def add_station(df: DataFrame, stations: DataFrame, keys: dict[str, str], side: str) -> DataFrame:
    """Inner join on several keys ({column of df: column of stations}); the station's other columns get ``side`` as prefix."""
    renamed = stations.select([F.col(c).alias(f"{side}_{c}") for c in stations.columns])
    on = [df[mine] == renamed[f"{side}_{theirs}"] for mine, theirs in keys.items()]
    return lookup(df, renamed, on).drop(*[f"{side}_{theirs}" for theirs in keys.values()])


# ---- cleaning
def binarize(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    return df.withColumns({f"{c}_flag": F.when(F.col(c) > t, 1).otherwise(0) for c, t in thresholds.items()})


def case_category(df: DataFrame, name: str, rules: list[tuple[Column, object]], default) -> DataFrame:
    first, *rest = rules
    return df.withColumn(name, reduce(lambda c, r: c.when(r[0], r[1]), rest, F.when(first[0], first[1])).otherwise(default))


def null_sentinels(df: DataFrame, codes: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != code, F.col(c)) for c, code in codes.items()})


def null_counts(df: DataFrame, top: int = 20) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], counts.columns, "column", "nulls").orderBy(F.desc("nulls"), "column").limit(top)


def drop_sparse_columns(df: DataFrame, most: int = 10) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if row[c] <= most])


def impute(df: DataFrame, mean_cols: list[str], mode_cols: list[str]) -> DataFrame:
    """Means and most frequent values (the smallest of ties) take the place of nulls."""
    fills = df.agg(*[F.avg(c).alias(c) for c in mean_cols], *[F.mode(c, True).alias(c) for c in mode_cols]).first().asDict()
    return df.withColumns({c: F.coalesce(c, F.lit(fills[c])) for c in [*mean_cols, *mode_cols]})


def dedupe(df: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_k", rank).where("_k = 1").drop("_k")


def feature_columns(df: DataFrame, exclude: list[str] = ()) -> tuple[list[str], list[str]]:
    text = [c for c, t in df.dtypes if t == "string" and c not in exclude]
    return text, [c for c, t in df.dtypes if t in ("int", "double", "bigint") and c not in exclude]


def incomplete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols or df.columns]))


def rescale01(df: DataFrame, cols: list[str]) -> DataFrame:
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(row[f"lo_{c}"]), F.lit(row[f"hi_{c}"]) - F.lit(row[f"lo_{c}"])) for c in cols})


def stray_header_rows(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_if(F.col(col) == col).alias("stray_rows"))


# ---- joins and aggregates
def attach_group_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with the size of their group; rows with a null key are dropped."""
    return segments.attach_counts(df.dropna(subset=keys), keys, name)


def inbound_count(df: DataFrame, origin: str, dest: str, keys: list[str], name: str) -> DataFrame:
    """Rows leaving a place with the number of rows arriving there under the same keys; none without arrivals."""
    arrivals = df.groupBy(F.col(dest).alias(origin), *keys).agg(F.count("*").alias(name))
    return df.join(arrivals, [origin, *keys])


def join_hourly(events: DataFrame, obs: DataFrame, keys: list[str], ts: str, suffix: str) -> DataFrame:
    """Events with the observation of their key's hour (obs: keys, hour, measures)."""
    own = obs.select(*keys, F.col("hour").alias("_hour"), *[F.col(c).alias(f"{c}{suffix}") for c in obs.columns if c not in [*keys, "hour"]])
    return events.withColumn("_hour", F.date_trunc("hour", ts)).join(own, [*keys, "_hour"]).drop("_hour")


def collapse_hourly_max(df: DataFrame, keys: list[str], ts: str, cols: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(*[F.max(c).alias(c) for c in cols])


def top_with_names(ranks: DataFrame, names: DataFrame, key: str, score: str, k: int) -> DataFrame:
    top = ranks.orderBy(F.desc(score), key).limit(k)
    return top.join(names, key)


def delay_summary(df: DataFrame, delay: str, limit: float = 15) -> DataFrame:
    return df.agg(F.count_if(F.col(delay) <= limit).alias("on_time"), F.count_if(F.col(delay) > limit).alias("delayed"), F.round(F.avg(delay), 6).alias("mean_delay"), F.max(delay).alias("longest"))


def rate_by(df: DataFrame, key: str, label: str, min_rows: int = 0, top: int | None = None) -> DataFrame:
    out = df.groupBy(key).agg(F.round(F.avg(label), 9).alias("rate"), F.count("*").alias("n")).where(F.col("n") > min_rows)
    return out.orderBy(F.desc("rate"), key).limit(top) if top else out


def prop_table(df: DataFrame, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


def resample_mean(df: DataFrame, ts: str, value: str, period: str = "month", null_policy: str = "ignore") -> DataFrame:
    mean = F.avg(value) if null_policy == "ignore" else F.when(F.count(value) == F.count("*"), F.avg(value))
    return df.groupBy(F.date_trunc(period, ts).cast("date").alias("period")).agg(F.round(mean, 6).alias("mean_value"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row for each column; quartiles by distributed selection, exact."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean_value"), F.round(F.stddev_samp(c), 6).alias("sd"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")) for c in cols]
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "_value")
    out = _with_quartiles(df.agg(F.array(*stats).alias("s")).select(F.inline("s")), long, ["column"], "_value")
    return out.select("column", "n", "mean_value", "sd", "lo", "q1", "median", "q3", "hi")


def _with_quartiles(rows: DataFrame, data: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows (one for each key) with q1, median and q3 of the key's values."""
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    long = segments.exact_quantiles(data, value, list(names.values()), by)
    wide = long.groupBy(*by).agg(*[F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 6).alias(n) for n, q in names.items()])
    return segments.join_side(rows, saved(wide, "quartiles"), by, "left")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_if(F.col(label) == 1).alias("positives"), F.round(100 * F.avg(label), 6).alias("percent_positive"), F.round(1 - F.avg(label), 9).alias("balancing_ratio"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")) for a in cols for b in cols]
    return df.agg(F.array(*pairs).alias("s")).select(F.inline("s"))


def select_by_correlation(df: DataFrame, target: str, cols: list[str], lo: float = 0.5, hi: float = 1.0) -> DataFrame:
    m = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.corr(c, target), 6).alias("r")) for c in cols]).alias("s")).select(F.inline("s"))
    return m.where((F.abs("r") > lo) & (F.abs("r") < hi)).orderBy(F.desc(F.abs("r")), "feature")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    row = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    if row["lo"] is None:
        return df.limit(0).select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"))
    width = (row["hi"] - row["lo"]) / bins or 1.0
    b = F.least(F.floor((F.col(col) - row["lo"]) / width), F.lit(bins - 1)).cast("long")
    return df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Least, quartiles (exact, by distributed selection) and largest value of each key."""
    ends = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return _with_quartiles(ends, df, [key], value).select(key, "lo", "q1", "median", "q3", "hi")


# ---- windows
def carry_over_delay(df: DataFrame, key: str, ts: str, tie: str, delay: str, gap_min: float = 90, offset: int = 2, arrival: str | None = None) -> DataFrame:
    """next_ts, rnk and carried: the delay ``offset`` events back, where the next event follows within the gap.

    The gap runs from the scheduled arrival to the next departure; without such a column, from departure to departure.
    A key of any number of events is dealt in segments.
    """
    df = segments.rank_by(df.where(F.col(key).isNotNull()), [key], [ts, tie], ts, "rnk")
    gap = (F.unix_timestamp(F.col("next_ts").cast("timestamp")) - F.unix_timestamp(F.col(arrival or ts).cast("timestamp"))) / 60
    steps = [
        lambda w: {"next_ts": F.lead(ts).over(w)},
        lambda w: {"_own": F.when(gap <= gap_min, F.col(delay)).otherwise(F.lit(0.0))},
        lambda w: {"carried": F.when(F.col("rnk") <= offset, 0.0).otherwise(F.coalesce(F.lag("_own", offset).over(w), F.lit(0.0)))},
    ]
    return segments.over_keys(df, [key], [ts, tie], steps, offset, 1).drop("_own")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], cols: list[str], max_rows: int = 250) -> DataFrame:
    """The last value that is not null among a row and the max_rows before; a key of any number of rows is dealt in segments."""
    fill = lambda w: {f"_f_{c}": F.last(c, ignorenulls=True).over(w.rowsBetween(-max_rows, 0)) for c in cols}
    out = segments.over_keys(df, keys, order, [fill], max_rows, 0)
    return out.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def top_n_per_group(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


def difference(df: DataFrame, key: str, order: list[str], value: str, lags: tuple = (12, 1)) -> DataFrame:
    steps = [lambda w, lag=lag: {"diff": F.col("diff") - F.lag("diff", lag).over(w)} for lag in lags]
    return segments.over_keys(df.withColumn("diff", F.col(value)), [key], order, steps, sum(lags), 0)


def top_bottom(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    top = df.orderBy(F.desc(value), key).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(value, key).limit(n).withColumn("side", F.lit("bottom")))


def percent_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    common = left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("common"))
    return common.crossJoin(left.select(key).distinct().agg(F.count("*").alias("n"))).select("common", F.round(F.try_divide(100.0 * F.col("common"), "n"), 6).alias("percent"))


# ---- samples
def sample_fraction(df: DataFrame, key: str, fraction: float, seed: str = "s") -> DataFrame:
    return df.where(hash_bucket(F.col(key), 10_000, seed) < int(fraction * 10_000))


def sample_n(df: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)


def hash_split(df: DataFrame, key: str, weights: list[float], seed: str = "s") -> DataFrame:
    edges, total = [], 0.0
    for w in weights[:-1]:
        total += w / sum(weights)
        edges.append(round(total * 10_000))
    return df.withColumn("split", sum((F.when(hash_bucket(F.col(key), 10_000, seed) >= e, 1).otherwise(0) for e in edges), F.lit(0)))
