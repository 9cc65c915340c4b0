"""Shared folder, materialised steps and size-checked joins of the operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows of a side that is broadcast; beyond, the joins are left to a shuffle.
BROADCAST_ROWS = 50_000
#: A group that holds more than one in SHARES of all rows is joined by broadcast; there are at most SHARES of them.
SHARES = 256
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Paths of the scratch tables made inside the innermost ``temporary`` of this thread.
_mine: ContextVar[set[str] | None] = ContextVar("scratch tables", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    What is still there when the application ends is deleted then. Where the folder is unset and Spark
    runs in one process, as in tests, a local one is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (mine := _mine.get()) is not None:
        mine.add(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Deletes the scratch tables made inside, but for those given to the function that it yields.

    Kept tables belong to the ``temporary`` around it, if any. Each thread has its own.
    """
    outer, mine, kept = _mine.get(), set(), set()
    token = _mine.set(mine)

    def keep(*tables: DataFrame) -> DataFrame:
        kept.update(t.scratch_path for t in tables)
        return tables[0]

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _mine.reset(token)
        for path in sorted(mine - kept):
            delete(spark, path)
        if outer is not None:
            outer |= kept


def bound_batches(spark: SparkSession) -> None:
    """Python workers get batches of at most BATCH_BYTES, where the session does not say otherwise.

    Spark's own bound is a number of rows, which long texts fill with any amount of memory.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later steps depend on files alone."""
    path = path or scratch(df.sparkSession, name)
    bound_batches(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that no later step reads: what follows has been written itself."""
    for df in tables:
        delete(df.sparkSession, df.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_groups(df: DataFrame, groups: DataFrame, keys: list[str], salt: Column, how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins every row with the single row of its group; keys may be null and one key may hold most rows.

    ``groups`` has been written, so its count is cheap: up to ``most`` rows it is broadcast.
    Beyond that, its rows are repeated for 16 salts and both sides are shuffled by key and salt, whatever size
    Spark takes ``groups`` for: its guess is that of compressed files, without the repeated rows.
    """
    right = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = lambda: [df[k].eqNullSafe(right[f"_g_{k}"]) for k in keys]
    gone = [f"_g_{k}" for k in keys]
    if groups.count() <= most:
        return df.join(F.broadcast(right), same(), how).drop(*gone)
    df = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(16)))
    right = right.withColumn("_g_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return df.join(right.hint("merge"), [*same(), df["_salt"] == right["_g_salt"]], how).drop(*gone, "_salt", "_g_salt")


def join_shares(df: DataFrame, groups: DataFrame, key: str, rows: int, how: str) -> DataFrame:
    """Joins rows with the rows of their group; ``groups`` (written) has ``size``, its group's number of rows.

    ``rows`` is the number of rows in all. At most SHARES groups are larger than one in SHARES of them;
    these are broadcast, so that their rows stay where they are. All others are shuffled.
    """
    least = max(rows // SHARES, 1_000)
    right = groups.withColumnRenamed(key, "_g")
    large = right.where(F.col("size") > least)
    if large.isEmpty():
        return df.join(right.hint("merge"), F.col(key) == F.col("_g"), how).drop("_g")
    hot = large.select(F.col("_g").alias("_h")).distinct()
    apart = df.join(F.broadcast(large), F.col(key) == F.col("_g"), "inner").drop("_g")
    others = df.join(F.broadcast(hot), F.col(key) == F.col("_h"), "left_anti")
    return others.join(right.where(F.col("size") <= least).hint("merge"), F.col(key) == F.col("_g"), how).drop("_g").unionByName(apart)


def aside(df: DataFrame, names) -> DataFrame:
    """df with its columns of these names renamed, so that an operator may add its own; ``back`` undoes it."""
    return df.withColumnsRenamed({c: f"_own_{c}" for c in df.columns if c in names})


def back(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.removeprefix("_own_") for c in df.columns if c.startswith("_own_")})


def append_columns(df: DataFrame, make, ddl: str, column: str = "text") -> DataFrame:
    """df with the columns of ddl, which ``make(chunk)`` gives as Arrow arrays for a slice of rows.

    The slices hold about CHUNK_BYTES of ``column``, so memory does not follow the batch size.
    A column of df that has the name of a new one is replaced.
    """
    import pyarrow as pa

    from quarryline.llm.words import give_back, text_chunks

    more = T.StructType.fromDDL(ddl)
    bound_batches(df.sparkSession)
    df = df.drop(*more.names)

    def run(batches):
        for batch in batches:
            for chunk in text_chunks(batch, column):
                made = make(chunk)
                yield pa.RecordBatch.from_arrays([*chunk.columns, *made], [*chunk.schema.names, *more.names])
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more.fields]))


def long_array(values):
    import numpy as np
    import pyarrow as pa

    return pa.array(np.asarray(values, np.int64))
