"""Mixing sources to target weights by a time-varying curriculum (operator 6).

Every source gets a target of words (its weight's share, at most twice what it has). Within a
source, documents follow each other in a fixed pseudo-random order, twice over (two epochs); the
mix takes the words up to the target, so that the last document may be cut. A source's weight
schedule, integrated over training time 0 to 1, gives its cumulative demand; inverting it at a
document's first word gives the document's training position, by which the mix is range-sorted.

No source is gathered anywhere: running sums are taken within buckets of the order's leading
digits, and bucket totals give their offsets, so one source may hold most rows.

Defined results: a null text has size 0; null is a source of its own, the last; repeated rows are
taken one after the other; no words at all give targets of 0; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import join_groups, materialise, read, temporary

#: Weights by a source's place in code-point order; words in the mix for each word there is.
WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
#: Weight schedules by weight: (time, factor) knots, joined by straight lines.
SCHEDULES = {5: [(0.0, 1.4), (1.0, 0.6)], 2: [(0.0, 1.0), (1.0, 1.0)], 1: [(0.0, 0.2), (0.5, 0.8), (1.0, 2.2)]}
ROWS_PER_BUCKET = 2_000
_SIZE = r"[^\x20\x09-\x0D]+"


def _targets(totals: DataFrame) -> DataFrame:
    """Per source: source_size, weight, target. ``totals`` has a row per source and bucket."""
    by_source = totals.groupBy("source").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_EPOCHS)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # In order of ratio, sources are at their cap up to the first whose level lies below its ratio.
    s = s.withColumn("free", F.max(F.when(F.col("level") < F.col("ratio"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("final", F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source")).over(Window.partitionBy("free")))
    return s.select("source", "source_size", "weight", F.when(F.col("free") == 1, F.col("final") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


#: Columns that ``plan`` and ``mix`` add; columns of the input with these names are replaced.
PLANNED = ["mix_size", "mix_source_size", "mix_weight", "mix_target", "mix_before", "mix_taken"]
MIXED = [*PLANNED, "mix_epoch", "mix_words", "mix_position"]


def plan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_weight, mix_target, mix_before (words of the source before) and mix_taken."""
    docs = docs.drop(*PLANNED)
    rows = docs.count()
    digits = next((d for d in range(1, 4) if rows <= ROWS_PER_BUCKET * 16**d), 4)
    # The text's digest is in the key, so that rows of one doc_id, null too, lie in many buckets.
    whole = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")))
    base = docs.withColumns({"mix_size": F.coalesce(F.regexp_count(text, F.lit(_SIZE)), F.lit(0)).cast("long"), "mix_key": F.md5(whole.cast("binary"))})
    base = base.withColumn("mix_bucket", F.substring("mix_key", 1, digits))
    with temporary(docs.sparkSession) as keep:
        starts = keep(_bucket_starts(base))
    joined = join_groups(base, starts, ["source", "mix_bucket"], F.col("mix_key"))
    inside = Window.partitionBy("source", "mix_bucket").orderBy("mix_key", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn("mix_before", F.col("mix_offset") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    taken = F.aggregate(_takes(), F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return out.withColumn("mix_taken", taken).drop("mix_key", "mix_bucket", "mix_offset")


def _bucket_starts(base: DataFrame) -> DataFrame:
    """Per source and bucket: the words of the source before it, and the source's target."""
    totals = materialise(base.groupBy("source", F.col("mix_bucket").alias("bucket")).agg(F.sum("mix_size").alias("words")), "mix-totals")
    offset = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("source", F.col("bucket").alias("mix_bucket"), offset.alias("mix_offset"))
    targets = materialise(_targets(totals), "mix-targets").withColumnsRenamed({"source_size": "mix_source_size", "weight": "mix_weight", "target": "mix_target"})
    return materialise(join_groups(starts, targets, ["source"], F.col("mix_bucket")), "mix-starts")


def _takes() -> Column:
    """The epochs in which the mix takes a row of ``plan``: array of epoch, words, share (of the source's demand before)."""
    budget = F.floor(F.col("mix_target") + 0.5)
    begins = lambda e: e * F.col("mix_source_size") + F.col("mix_before")
    every = F.array(*[F.struct(F.lit(e).alias("epoch"), F.least(F.col("mix_size"), budget - begins(e)).cast("long").alias("words"), (begins(e) / budget).alias("share")) for e in range(MOST_EPOCHS)])
    return F.filter(every, lambda x: x["words"] > 0)


def position(share: Column, weight: Column) -> Column:
    """The training time (0 to 1) at which a source of this weight has met this share of its demand.

    A schedule's integral is a parabola on each straight piece; the piece's is solved for its time.
    """
    out = F.lit(None).cast("double")
    for w, knots in SCHEDULES.items():
        areas = [(t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:])]
        for i, ((t0, m0), (t1, m1)) in enumerate(zip(knots, knots[1:])):
            area = share * sum(areas) - sum(areas[:i])
            root = F.sqrt(F.greatest(F.lit(0.0), m0**2 + 2 * (m1 - m0) / (t1 - t0) * area))
            out = F.when((weight == w) & (area >= 0), F.least(F.lit(1.0), t0 + 2 * area / (m0 + root))).otherwise(out)
    return out


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix: a row for each document and epoch taken, range-sorted by ``mix_position`` (0 to 1).

    A document that the target cuts keeps its first ``mix_words`` words; there is one in a source at most.
    """
    planned = plan(docs.drop(*MIXED), text)
    rows = planned.where("mix_taken > 0").withColumn("_e", F.explode(_takes()))
    rows = rows.withColumns({"mix_epoch": F.col("_e.epoch"), "mix_words": F.col("_e.words"), "mix_position": position(F.col("_e.share"), F.col("mix_weight"))})

    @F.pandas_udf("string")
    def first_words(texts: pd.Series, words: pd.Series) -> pd.Series:
        import re

        out = []
        for t, n in zip(texts, words):
            end = t and next((m.end() for i, m in enumerate(re.finditer(_SIZE, t), 1) if i == n), len(t))
            out.append(t and t[:end])
        return pd.Series(out, dtype=object)

    # Only the texts that are cut go to Python; all others are null there.
    cut = first_words(F.when(F.col("mix_words") < F.col("mix_size"), F.col(text)), "mix_words")
    rows = rows.withColumn(text, F.coalesce(cut, F.col(text))).select(*[c for c in docs.columns if c not in MIXED], *[c for c in MIXED if c not in ("mix_weight", "mix_before")])
    return rows.repartitionByRange("mix_position", "doc_id").sortWithinPartitions("mix_position", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, the words that the mix takes of it, and its
    training positions in both epochs (null where it is not taken), range-sorted by the first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    takes = plan(docs).withColumn("_e", F.transform(_takes(), lambda x: F.struct(x["epoch"].alias("epoch"), x["share"].alias("share"))))
    at = lambda e: F.round(position(F.try_element_at(F.filter("_e", lambda x: x["epoch"] == e), F.lit(1))["share"], F.col("mix_weight")), 6)
    rows = takes.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), at(0).alias("position"), at(1).alias("second_position"))
    return materialise(rows, "mix-positions").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def _position_sql() -> str:
    cases = []
    for w, knots in SCHEDULES.items():
        areas = [(t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:])]
        for i, ((t0, m0), (t1, m1)) in enumerate(zip(knots, knots[1:])):
            area = f"(share * {sum(areas)}::DOUBLE - {sum(areas[:i])}::DOUBLE)"
            root = f"sqrt(greatest(0, {m0**2}::DOUBLE + {2 * (m1 - m0) / (t1 - t0)}::DOUBLE * {area}))"
            cases.append(f"WHEN w = {w} AND {area} >= 0 THEN least(1, {t0}::DOUBLE + 2 * {area} / ({m0}::DOUBLE + {root}))")
    return f"CASE {' '.join(reversed(cases))} END"


#: DuckDB: the same order by windows over whole sources, and the inverted schedules.
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, n * 2.0::DOUBLE AS cap, n * 2.0::DOUBLE / w AS ratio FROM s),
l AS (SELECT *, (sum(n) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
  row_number() OVER o AS i FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
f AS (SELECT min(i) AS i FROM l WHERE level < ratio),
t AS (SELECT source, n, w, CASE WHEN l.i < coalesce(f.i, 1e9) THEN cap ELSE (SELECT level FROM l l2 WHERE l2.i = f.i) * w END AS target FROM l, f),
c AS (SELECT row_number() OVER () AS id, d.*, n, w, target, floor(target + 0.5) AS b, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT id, epoch, least(size, b - epoch * n - before) AS words, CASE WHEN b > 0 THEN (epoch * n + before)::DOUBLE / b END AS share, w FROM c, (VALUES (0), (1)) v(epoch)),
p AS (SELECT id, epoch, words, round({_position_sql()}, 6) AS position FROM e WHERE words > 0),
a AS (SELECT id, sum(words)::BIGINT AS taken, max(position) FILTER (epoch = 0) AS position, max(position) FILTER (epoch = 1) AS second_position FROM p GROUP BY id)
SELECT doc_id, size, n AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, position, second_position FROM c LEFT JOIN a USING (id)
"""
