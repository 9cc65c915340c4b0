"""Quality rules with robust multivariate outliers per language and source (operator 10).

Fixed rules come first. Documents that pass them get a Mahalanobis distance of their transformed
statistics from a minimum-covariance-determinant estimate of their group (language and source; the
leftover documents of small groups form one group per language, then one of all). Leftover documents
that are too few even so are judged by the estimate of all rows of their language, or, where those
are fewer than MIN_ROWS, of all rows of the table. Every estimate
has three deterministic starts: medians and median deviations, the covariance of the signs of
standardised rows, and the plain mean and covariance. Each takes concentration steps: the ``H``
share of rows nearest by the last estimate gives the next mean and covariance, so the determinant
falls. After FIRST_STEPS the start of the least determinant goes on until its logarithm falls by
less than CONVERGED; a group that has settled leaves the later steps. Each other group falls by as much in
every step and the determinant has a floor, so the steps end. Quantiles are Spark's approximate ones,
whose rank is off by one in a thousand at most. Rows are summed inside Spark with partial aggregation, one
matrix row per group is factored on the executors.

Defined results: a null or empty text has no words and fails the base rules; null languages and
sources are groups of their own; where fewer than MIN_ROWS rows of the whole table pass the base rules, the
method rejects nothing.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import BROADCAST_ROWS, join_groups, materialise, read, temporary
from quarryline.llm.textstats import with_stats

#: Statistics that are compared (places in textstats.FEATURES); repeats have a base rule of their own.
USED = [0, 1, 2, 3, 8]
#: Share of a group's rows in the estimate, steps of every start, the fall of the determinant's
#: logarithm that is too small to go on, rows that a group needs.
H, FIRST_STEPS, CONVERGED, MIN_ROWS = 0.75, 2, 1e-3, 200
#: Least standard deviation of a statistic, so that constant ones stay finite; squared distance, in
#: units of the median of its group (36: six times the median distance), beyond which a document is rejected.
FLOOR, CUTOFF = 0.25, 36.0


def base_rules(stats: DataFrame) -> Column:
    return (F.col("st_n_words") < 10) | (100 * F.col("st_n_repeat_words") > 20 * F.col("st_n_words"))


def _distance(p: int) -> Column:
    """Squared length of the whitened difference; ``mcd_w`` has the rows of the lower triangle."""
    z = [F.col("st_features")[USED[j]] - F.col("mcd_center")[j] for j in range(p)]
    at = lambda i, j: F.col("mcd_w")[i * (i + 1) // 2 + j]
    rows = [sum((at(i, j) * z[j] for j in range(1, i + 1)), at(i, 0) * z[0]) for i in range(p)]
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def whiten(center: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    """The center, the inverse Cholesky factor's lower triangle and the log determinant, from a covariance with a floor on its diagonal."""
    low = np.linalg.cholesky(cov + np.eye(len(cov)) * FLOOR**2)
    return center.tolist(), np.linalg.inv(low)[np.tril_indices(len(cov))].tolist(), 2 * float(np.log(np.diag(low)).sum())


def covariance(n: float, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from the count, the sums and the lower triangle of the cross products."""
    p, mean = len(s), s / n
    cov = np.zeros((p, p))
    cov[np.tril_indices(p)] = q / n
    cov = cov + np.tril(cov, -1).T - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    return mean, (vectors * np.maximum(values, 0)) @ vectors.T


def _factor(sums: DataFrame) -> DataFrame:
    """Estimates (grp, start, mcd_center, mcd_w, logdet) from sums; with ``med`` and ``scale``, from sums of signs."""

    def run(frames):
        for df in frames:
            out = []
            for row in df.itertuples(index=False):
                mean, cov = covariance(row.n, np.array(row.s), np.array(row.q))
                if len(row.med):
                    scale = np.array(row.scale)
                    # The signs' eigenvectors, with the spread that the median deviations have along them.
                    _, vectors = np.linalg.eigh(cov)
                    mean, cov = np.array(row.med), np.outer(scale, scale) * ((vectors * np.maximum(np.diag(vectors.T @ cov @ vectors) * len(scale), 1e-3)) @ vectors.T)
                out.append((row.grp, row.start, *whiten(mean, cov)))
            yield pd.DataFrame(out, columns=["grp", "start", "mcd_center", "mcd_w", "logdet"])

    return sums.mapInPandas(run, "grp string, start int, mcd_center array<double>, mcd_w array<double>, logdet double")


def outliers(stats: DataFrame) -> DataFrame:
    """stats (materialised, with lang, source, st_*) with ``mcd_d2``: squared distance over its group's median."""
    with temporary(stats.sparkSession) as keep:
        return _outliers(stats, keep)


def _outliers(stats: DataFrame, keep) -> DataFrame:
    p = len(USED)
    x = [F.col("st_features")[k] for k in USED]
    good = stats.where(~base_rules(stats))
    name = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    sizes = materialise(good.groupBy("lang", "source").count(), "mcd-sizes")
    few = F.col("count") < MIN_ROWS
    langs = sizes.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.sum(F.when(few, F.col("count"))).alias("lang_count"))
    langs = materialise(langs, "mcd-langs")
    unplaced = F.col("lang_count") < MIN_ROWS
    r = langs.agg(F.sum(F.when(unplaced, F.col("lang_count"))).alias("pool"), F.max(unplaced & (F.col("lang_total") < MIN_ROWS)).alias("rare")).first()
    pooled = (r["pool"] or 0) >= MIN_ROWS
    grouped = join_groups(sizes, langs, ["lang"], F.col("source"))
    wide = F.concat(F.lit("whole "), name("lang"))
    enough = F.col("lang_total") >= MIN_ROWS
    own = F.when(~few, name("lang", "source")).when(F.col("lang_count") >= MIN_ROWS, name("lang"))
    own = own.when(F.lit(pooled), F.lit("all"))
    grp = F.coalesce(own, F.when(enough, wide).otherwise("whole"))
    # A row counts in its own group's estimate and in the wide ones by which others are judged.
    widest = F.when(F.lit(bool(r["rare"]) and not pooled), F.lit("whole"))
    counts_in = F.array_compact(F.array(own, F.when(F.lit(not pooled) & unplaced & enough, wide), widest))
    named = keep(materialise(grouped.select("lang", "source", grp.alias("grp"), counts_in.alias("mcd_in")), "mcd-groups"))
    rows = join_groups(stats, named, ["lang", "source"], F.col("doc_id"))
    used = rows.where(~base_rules(rows)).withColumn("grp", F.explode("mcd_in")).drop("mcd_in")
    rows = rows.drop("mcd_in")

    def attach(df, params):
        return join_groups(df, params, ["grp"], F.col("doc_id"))

    def estimates(df, params):
        """Every row with each start of its group's estimate."""
        most = params.count()
        if most > BROADCAST_ROWS:
            starts = [params.where(F.col("start") == k) for k in range(3)]
            return functools.reduce(DataFrame.unionByName, [attach(df, materialise(one, "mcd-one")).where("mcd_w is not null") for one in starts])
        return df.join(F.broadcast(params.withColumnRenamed("grp", "_p")), F.col("grp") == F.col("_p")).drop("_p")

    def sums_of(df, v):
        products = F.array(*[F.sum(v[a] * v[b]) for a in range(p) for b in range(a + 1)])
        return df.groupBy("grp", "start").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in v]).alias("s"), products.alias("q"))

    used = materialise(used.select("grp", "doc_id", "st_features"), "mcd-used")
    medians = used.groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 1000).alias(f"m{j}") for j, c in enumerate(x)])
    medians = materialise(medians.where(F.col("n") >= MIN_ROWS).select("grp", F.array(*[f"m{j}" for j in range(p)]).alias("med")), "mcd-medians")
    spread = attach(used, medians).where("med is not null").groupBy("grp").agg(*[F.percentile_approx(F.abs(c - F.col("med")[j]), 0.5, 1000).alias(f"d{j}") for j, c in enumerate(x)])
    scales = F.array(*[F.sqrt(F.pow(F.col(f"d{j}") * 1.4826, 2) + FLOOR**2) for j in range(p)])
    middle = medians.select(F.col("grp").alias("_g"), "med")
    middle = materialise(spread.select("grp", scales.alias("scale")).join(middle, F.col("grp") == F.col("_g")).drop("_g"), "mcd-middle")
    # Sums of the three starts: of one constant row for the medians, of signs, of the rows themselves.
    none = F.array().cast("array<double>")
    constant = middle.select("grp", F.lit(0).alias("start"), F.lit(1).cast("long").alias("n"), F.col("med").alias("s"), F.array(*[F.col("med")[a] * F.col("med")[b] + (F.pow(F.col("scale")[a], 2) - FLOOR**2 if a == b else F.lit(0.0)) for a in range(p) for b in range(a + 1)]).alias("q"), none.alias("med"), none.alias("scale"))
    z = attach(used, middle).where("med is not null").withColumn("start", F.lit(1))
    z = z.withColumn("z", F.array(*[(c - F.col("med")[j]) / F.col("scale")[j] for j, c in enumerate(x)]))
    norm = F.sqrt(F.aggregate("z", F.lit(1e-12), lambda t, v: t + v * v))
    signs = sums_of(z.withColumn("z", F.transform("z", lambda v: v / norm)), [F.col("z")[j] for j in range(p)])
    signs = signs.join(middle.withColumnRenamed("grp", "_g"), F.col("grp") == F.col("_g")).drop("_g")
    plain = sums_of(attach(used, middle).where("med is not null").withColumn("start", F.lit(2)), x).withColumns({"med": none, "scale": none})
    params = materialise(_factor(constant.unionByName(signs).unionByName(plain)), "mcd-start")
    settled, step = [], 0
    while not params.isEmpty():
        near = estimates(used, params).withColumn("mcd_d2", _distance(p))
        limit = materialise(near.groupBy("grp", "start").agg(F.percentile_approx("mcd_d2", H, 1000).alias("limit")), "mcd-limit")
        kept = join_groups(near, limit, ["grp", "start"], F.col("doc_id")).where("mcd_d2 <= limit")
        new = materialise(_factor(sums_of(kept, x).withColumns({"med": none, "scale": none})), f"mcd-step{step}")
        step += 1
        if step == FIRST_STEPS:
            order = F.struct("logdet", "start")
            least = new.groupBy("grp").agg(F.min_by(F.struct(*new.columns[1:]), order).alias("b"))
            new = materialise(least.select("grp", "b.*"), "mcd-best")
        if step >= FIRST_STEPS:
            before = params.select(F.col("grp").alias("_g"), F.col("start").alias("_s"), F.struct(*params.columns).alias("old"))
            pairs = new.select("grp", "start", F.struct(*params.columns).alias("new")).join(before, (F.col("grp") == F.col("_g")) & (F.col("start") == F.col("_s")))
            fall = F.col("old.logdet") - F.col("new.logdet")
            pairs = materialise(pairs.select(F.when(fall >= 0, F.col("new")).otherwise(F.col("old")).alias("m"), (fall < CONVERGED).alias("ended")), "mcd-pairs")
            settled.append(pairs.where("ended").select("m.*"))
            new = pairs.where("not ended").select("m.*")
        params = new
    params = materialise(functools.reduce(DataFrame.unionByName, settled, params), "mcd-settled")
    params = params.drop("start", "logdet")
    near = attach(used, params).where("mcd_w is not null").withColumn("mcd_d2", _distance(p))
    unit = near.groupBy("grp").agg(F.percentile_approx("mcd_d2", 0.5, 1000).alias("mcd_unit"))
    final = keep(materialise(unit.join(params.withColumnRenamed("grp", "_g"), F.col("grp") == F.col("_g")).drop("_g"), "mcd-final"))
    out = attach(rows, final)
    d2 = _distance(p) / F.greatest("mcd_unit", F.lit(1.0))
    return out.withColumn("mcd_d2", d2).drop("grp", "mcd_w", "mcd_center", "mcd_unit")


def apply_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``mcd_d2`` and ``kept`` of every document."""
    whole = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    stats = materialise(with_stats(whole).drop("text"), "rules-stats")
    judged = outliers(stats).withColumn("base_failed", base_rules(stats))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("mcd_d2", F.lit(0.0)) <= cutoff))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base counts, whether the base rules fail it, and whether it is kept."""
    judged = apply_rules(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[F.col(f"st_{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")
