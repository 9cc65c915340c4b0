"""Order statistics, windows and counts by keys of which one may hold most rows.

A window by key brings all rows of a key into one task. Here a key's rows are numbered in their order
over all tasks (range partitions are counted, then each gets its offset), and the numbers cut a large
key into segments of SEGMENT rows; a segment takes along the few rows before and after it that its
windows look at. Keys of at most SEGMENT rows have an ordinary window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarryline.sources.files import saved

#: Most rows of a key in one task.
SEGMENT = 200_000
#: Most rows of a side that is broadcast; a group of more than one in SHARES of all rows counts as heavy.
BROADCAST_ROWS, SHARES, SALTS = 100_000, 256, 16
#: Bins of a histogram, and the most values of a bin that are sorted.
BINS, SORTED = 4_096, 10_000


def _same(df: DataFrame, side: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(side[f"_s_{k}"]) for k in keys], F.lit(True))


def join_side(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins rows with the few rows of their key (null equals null), whatever share of the rows a key holds.

    ``side`` has been written, so that its count is cheap: up to BROADCAST_ROWS it is broadcast. Beyond, its rows are
    repeated for SALTS salts, and the rows are dealt by key and salt, whatever size Spark takes ``side`` for: its guess is
    that of compressed files, without the repeated rows.
    """
    own = side.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    gone = [f"_s_{k}" for k in keys]
    if side.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(own), _same(df, own, keys), how).drop(*gone)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    own = own.withColumn("_s_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(own.hint("merge"), _same(salted, own, keys) & (salted["_salt"] == own["_s_salt"]), how).drop(*gone, "_salt", "_s_salt")


def attach_counts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with the number of rows of their key: partial counts, joined back with the heavy keys apart.

    At most SHARES keys hold more than one in SHARES of all rows each: their counts are broadcast, so that their rows stay
    where they are. The other rows are dealt by key once.
    """
    counts = saved(df.groupBy(*keys).agg(F.count("*").alias("_n")), "key-counts")
    if counts.count() <= BROADCAST_ROWS:
        return join_side(df, counts, keys).withColumnRenamed("_n", name)
    least = (counts.agg(F.sum("_n")).first()[0] or 0) // SHARES
    heavy = counts.where(F.col("_n") > least).withColumnsRenamed({k: f"_s_{k}" for k in keys})
    rest = counts.where(F.col("_n") <= least).withColumnsRenamed({k: f"_s_{k}" for k in keys})
    marks = F.broadcast(heavy)
    apart = df.join(marks, _same(df, heavy, keys))
    others = df.join(marks, _same(df, heavy, keys), "left_anti")
    others = others.join(rest.hint("merge"), _same(others, rest, keys))
    return others.unionByName(apart).drop(*[f"_s_{k}" for k in keys]).withColumnRenamed("_n", name)


# ---- numbers in order
def number_rows(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Rows with their place, from 0, in their key's order (without keys, in the table's): two passes, no key in one task.

    The rows are range-partitioned by key and order and written; a key's parts are counted, and a part's rows are
    numbered after those of the parts before. Rows that are equal in key and order have any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = saved(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # A part goes on with one key at most, so these are no more rows than parts.
    later = saved(counts.withColumn("_before", before).where("_before > 0").drop("_n"), "offsets")
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    numbered = parts.withColumn("_inside", inside.cast("long"))
    return join_side(numbered, later, [*keys, "_part"], "left").withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside")).drop("_before", "_inside", "_part")


def largest_key(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def over_keys(df: DataFrame, keys: list[str], order: list, columns: list[Callable[[WindowSpec], dict[str, Column]]], before: int, after: int) -> DataFrame:
    """df with columns from windows by key, which look at most ``before`` rows back and ``after`` rows on in all.

    Each function takes the window (by key, in order) and gives columns; later ones may use earlier columns.
    """
    if largest_key(df, keys) <= SEGMENT:
        return reduce(lambda d, f: d.withColumns(f(Window.partitionBy(*keys).orderBy(*order))), columns, df)
    cut = with_segments(number_rows(df, keys, order, "_i"), before, after)
    return reduce(lambda d, f: d.withColumns(f(Window.partitionBy(*keys, "_segment").orderBy("_i"))), columns, cut).where("_home").drop("_i", "_segment", "_home")


def with_segments(numbered: DataFrame, before: int, after: int) -> DataFrame:
    """Rows numbered by ``_i`` in their ``_segment`` (``_home``), and again in the next or last one that looks at them."""
    at, place = F.floor(F.col("_i") / SEGMENT), F.col("_i") % SEGMENT
    whole = lambda d: at + F.lit(d).cast("long")
    # A segment may be shorter than what is looked at: then rows go on to several.
    reach = [F.when(place >= d * SEGMENT - before, whole(d)) for d in range(1, 2 + before // SEGMENT)]
    back = [F.when((place < after - (d - 1) * SEGMENT) & (at >= d), whole(-d)) for d in range(1, 2 + after // SEGMENT)]
    return numbered.withColumn("_segment", F.explode(F.array_compact(F.array(at, *reach, *back)))).withColumn("_home", F.col("_segment") == at)


def rank_by(df: DataFrame, keys: list[str], order: list, by: str, name: str) -> DataFrame:
    """df with ``rank()`` by key over the values of ``by``, the first of ``order``; ties share the rank of their first row."""
    if largest_key(df, keys) <= SEGMENT:
        return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(by)))
    cut = saved(with_segments(number_rows(df, keys, order, "_i"), 1, 0), "segments")
    w = Window.partitionBy(*keys, "_segment").orderBy("_i")
    starts = cut.withColumn("_start", F.when(~F.col(by).eqNullSafe(F.lag(by).over(w)) | (F.col("_i") == 0), F.col("_i"))).where("_home")
    # The last start of each segment reaches into the next ones: a row a segment.
    last = starts.groupBy(*keys, "_segment").agg(F.max("_start").alias("_last"))
    reaches = F.max("_last").over(Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1))
    carried = saved(last.withColumn("_carried", reaches).drop("_last"), "carried")
    own = F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = join_side(starts, carried, [*keys, "_segment"]).withColumn(name, (F.coalesce(own, "_carried") + 1).cast("int"))
    return ranked.drop("_i", "_segment", "_home", "_start", "_carried")


# ---- quantiles
def exact_quantiles(df: DataFrame, value: str, quantiles: list[float], by: list[str]) -> DataFrame:
    """(by..., q, value): quantiles of the values that are not null (nor NaN), straight lines between neighbours; exact.

    Every group's range is cut into BINS bins, which are counted; the bins that hold the wanted ranks are cut again, until
    a bin holds one value alone or at most SORTED values, which are sorted. No step gathers a group's values: what is
    shuffled are counts of bins, at most BINS for each group and rank, and in the end the values of small bins.
    """
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    groups = data.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    groups = saved(groups.where("_n > 0"), "quantile-groups")
    at = F.col("_q") * (F.col("_n") - 1)
    wanted = groups.select(*by, "_n", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("_q"))
    wanted = wanted.select(*by, "_q", at.alias("_at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_rank"))
    ranks = wanted.select(*by, "_rank").distinct()
    start = join_side(ranks, groups, by).select(*by, "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_m"))
    open_, done = saved(start, "quantile-ranges"), []
    small = (F.col("_lo") == F.col("_hi")) | (F.col("_m") <= SORTED)
    while True:
        done.append(open_.where(small))
        open_ = open_.where(~small)
        if open_.isEmpty():
            break
        ranges = saved(open_.groupBy(*by, "_lo", "_hi", "_below").agg(F.collect_set("_rank").alias("_ranks")), "quantile-open")
        inside = join_side(data, ranges, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        width = F.col("_hi") / BINS - F.col("_lo") / BINS
        bin_ = F.least(F.greatest(F.floor(F.try_divide(F.col("_v"), width) - F.try_divide(F.col("_lo"), width)), F.lit(0)), F.lit(BINS - 1))
        # The ends are apart in any arithmetic, so that every round narrows the range.
        bin_ = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), BINS - 1).otherwise(F.coalesce(bin_, F.lit(0)))
        counts = inside.withColumn("_bin", bin_.cast("int")).groupBy(*by, "_lo", "_hi", "_below", "_bin").agg(F.count("*").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("_ranks").alias("_ranks"))
        upto = F.sum("_m").over(Window.partitionBy(*by, "_lo", "_hi", "_below").orderBy("_bin"))
        counts = counts.withColumn("_under", F.col("_below") + upto - F.col("_m")).withColumn("_rank", F.explode("_ranks"))
        hit = (F.col("_rank") >= F.col("_under")) & (F.col("_rank") < F.col("_under") + F.col("_m"))
        open_ = saved(counts.where(hit).select(*by, "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_under").alias("_below"), "_m"), "quantile-ranges")
    found = saved(reduce(DataFrame.unionByName, done), "quantile-bins")
    sharp = found.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_value"))
    wide = found.where("_lo < _hi")
    bins = saved(wide.select(*by, "_lo", "_hi", "_below").distinct(), "quantile-last")
    values = join_side(data, bins, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*by, "_lo", "_hi", "_below").agg(F.array_sort(F.collect_list("_v")).alias("_values"))
    values = saved(values, "quantile-values")
    keys = [*by, "_lo", "_hi", "_below"]
    last = join_side(wide, values, keys).select(*by, "_rank", F.get("_values", (F.col("_rank") - F.col("_below")).cast("int")).alias("_value"))
    ranked = saved(sharp.unionByName(last), "quantile-ranks")
    both = join_side(wanted, ranked, [*by, "_rank"]).groupBy(*by, "_q").agg(F.min_by("_value", "_rank").alias("_x"), F.max_by("_value", "_rank").alias("_y"), F.first(F.col("_at") - F.floor("_at")).alias("_part"))
    # As the neighbours' weighted sum; equal ones are given as they are.
    return both.select(*by, F.col("_q").alias("q"), F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise(F.col("_x") * (1 - F.col("_part")) + F.col("_y") * F.col("_part")).alias("value"))
