"""Readers and writers with explicit schemas (S1 to S8)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NGRAMS = "ngram string, cnt long, pages long, books long"
LABELLED = "id string, label int, subject string, body string"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset and Spark is local, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", quote="")


def read_labelled_docs(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, LABELLED)


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, NGRAMS)


def parse_adjacency(lines: DataFrame) -> DataFrame:
    """Lines ``id \\t {'dst': n, ...}`` as edges (src, dst, weight)."""
    parts = F.split("value", "\t")
    links = F.from_json(F.regexp_replace(F.get(parts, F.lit(1)), "'", '"'), "map<string,int>")
    return lines.select(F.get(parts, F.lit(0)).try_cast("long").alias("src"), F.explode(links).alias("dst", "weight")).select("src", F.col("dst").try_cast("long").alias("dst"), F.col("weight").cast("long").alias("weight"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return parse_adjacency(read_lines(spark, path))


def read_tagged_csvs(spark: SparkSession, paths: dict[str, int], schema: str, sep: str = ";") -> DataFrame:
    """Files with the same header, each tagged with its flag."""
    out = None
    for path, flag in paths.items():
        part = spark.read.schema(schema).csv(path, sep=sep, header=True).withColumn("flag", F.lit(flag))
        out = part if out is None else out.unionByName(part)
    return out


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
