"""The corpus pipeline: five stages, each an operator of quarryline.llm over all that came before.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs; all but the last return the columns of ``documents``.

Defined results, in every stage: an empty table gives an empty one; columns beyond doc_id, source,
text and n_chars pass through, whatever their names. A null or empty text is judged like any text
without words by the classifier; where it passes, near duplicates and decontamination keep it, and
the mix, in which it has no words to take, leaves it out. A null doc_id is a document like others;
it stays in a group of copies only where the whole group has none. Of repeated rows one stays
(texts without words all do). A null source is a source of its own.

A stage deletes the tables that its result does not read. ``run`` deletes, stage by stage, what a stage
has left and the rows of the stage before, so that its result alone stays. Stages called one by one leave
small tables, and the last its file of tokens, until the application ends: they may still be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate as leaks
from quarryline.llm import mixing, near, quality, tokens
from quarryline.llm.common import aside, back, discard, materialise, read, scratch, temporary

def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1."""
    judged = quality.classify(aside(docs, ["q_score", "q_predicted"]), read(spark, sf_dir, "labels"))
    return back(judged.where("q_predicted = 1").drop("q_score", "q_predicted")).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return near.keep_one(docs, k=5, num=80, den=100).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return leaks.decontaminate(docs, read(spark, sf_dir, "benchmark"), remove="documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order; a source's last document is cut at its target."""
    mixed = mixing.mix(aside(docs, mixing.MIXED))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.when(F.col("mix_words") < F.col("mix_size"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(mixed.drop(*mixing.MIXED)).select(*docs.columns)


#: Encoded pieces that a worker keeps: its executor still holds what the stages before have grown to.
CACHED = 200_000


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a file of directly addressable codes; the digest of what is read back."""
    path = scratch(spark, "tokens")
    tokens.write_tokens(docs, path, tokens.tokenizer_path(), cached=CACHED)
    return tokens.digests(spark, path)


STAGES = [("quality", classify), ("near duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("token codes", encode)]

#: The tokenizer and the trained classifier have no SQL; tests/llm/test_pipeline.py holds the stages against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    with temporary(spark) as keep_last:
        for name, stage in STAGES:
            with temporary(spark) as keep:
                docs = keep(materialise(stage(spark, docs, sf_dir), name.replace(" ", "-")))
            discard(*before)
            before = [docs]
        return keep_last(docs)
