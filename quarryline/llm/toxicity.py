"""Toxicity by compression distance (operator 4).

Two zstandard dictionaries are trained, one on words typical of toxic and one on words of ordinary
labelled documents. Every word of a text is a window: it is compressed with both dictionaries
between a fixed lead-in and tail that both dictionaries hold, so that the frame costs the same few
bytes and the difference of the two lengths is what the word itself costs. A text's differences
are counted above thresholds; a logistic curve through these counts, calibrated on the training
rows, gives the score.

The fit uses at most ``FIT_ROWS`` labelled rows of each class (in order of a hash of doc_id): a
documented bound. Word counts are taken over them in Spark; the driver gets at most TOP_WORDS
words of each class and one row of threshold counts for each training row.

Defined results: a null or empty text has no window and scores the calibrated curve at zero counts;
a null doc_id is not held out and has no label; without a toxic training row every score is 0,
without an ordinary one 1.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import append_columns, materialise, read, temporary

FIT_ROWS, TOP_WORDS, DICTIONARY_BYTES = 10_000, 4_000, 3_072
#: A toxic word's document rate is this many times the ordinary one, in this many documents at least.
RATIO, LEAST = 8, 3
THRESHOLDS, THRESHOLD = (3, 4, 5, 6, 7, 8), 0.3
FOLDS, HELD_OUT = 4, 2
_EDGE = b".,;:!?|\"'()"
#: Bytes that no text's word holds; they frame every window.
FRAME = bytes(np.random.default_rng(5).integers(1, 9, 40, dtype=np.uint8))
MEMO_WORDS = 200_000


def _fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def windows(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(_EDGE) for x in (text or "").lower().encode().split()) if w]


def train_dictionary(words: list[bytes], weights: list[float]) -> bytes:
    """A trained dictionary of the words; where there are too few to train on, the words themselves."""
    import zstandard

    if not words:
        return b""
    p = np.array(weights, float)
    rng = np.random.default_rng(0)
    picks = rng.choice(len(words), (3000, 14), p=p / p.sum())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [b" " + b" ".join(words[i] for i in row) + b" " for row in picks]).as_bytes()
    except zstandard.ZstdError:
        return (b" " + b" ".join(reversed(words)) + b" ")[-DICTIONARY_BYTES:]


class Distance:
    """Bytes that a word costs more with the ordinary dictionary than with the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        how = zstandard.ZstdCompressionParameters.from_level(5, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compress = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
        self.memo: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> list[int]:
        memo, (ordinary, toxic) = self.memo, self.compress
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            framed = b"%s %s %s" % (FRAME, w, FRAME[:16])
            memo[w] = len(ordinary(framed)) - len(toxic(framed))
        return [memo[w] for w in words]

    def features(self, text: str | None) -> np.ndarray:
        d = np.array(self.of(windows(text)), np.int64)
        n = max(1, len(d))
        return np.array([x for t in THRESHOLDS for x in (np.log1p((d >= t).sum()), (d >= t).sum() / np.sqrt(n))] + [max(d.max(initial=0), 0) / 4, np.log(n) / 4])


@functools.lru_cache(4)
def _distance(toxic: bytes, ordinary: bytes) -> Distance:
    return Distance(toxic, ordinary)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The two dictionaries and the weights of the curve, from the training rows."""
    with temporary(docs.sparkSession):
        return _fit(docs, labels)


def _fit(docs: DataFrame, labels: DataFrame) -> dict:
    train = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where((_fold() != HELD_OUT) & F.col("y").isin(0, 1))
    order = [F.crc32(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")).cast("binary")), F.col("doc_id")]
    picked = train.where("y = 1").orderBy(*order).limit(FIT_ROWS).unionByName(train.where("y = 0").orderBy(*order).limit(FIT_ROWS))
    picked = picked.withColumnRenamed("doc_id", "_id").dropDuplicates(["_id"])
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("y", "text"), "toxic-fit")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return {"constant": 1.0 if n.get(1) else 0.0}

    def count(batches):
        seen = Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((w, y) for w in set(windows(text)))
                if len(seen) > 500_000:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    counts = rows.mapInArrow(count, "word binary, y int, n long").groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("o"))
    typical = (F.col("t") >= LEAST) & (F.col("t") / n[1] > RATIO * (F.col("o") + 1) / n[0])
    counts = materialise(counts.where((F.col("t") >= LEAST) | (F.col("o") >= LEAST)).withColumn("typical", typical), "toxic-words")
    toxic = counts.where("typical").orderBy(F.desc("t"), "word").limit(TOP_WORDS).collect()
    ordinary = counts.where("not typical").orderBy(F.desc("o"), "word").limit(TOP_WORDS).collect()
    model = {"toxic": train_dictionary([bytes(r["word"]) for r in toxic], [r["t"] for r in toxic]), "ordinary": train_dictionary([bytes(r["word"]) for r in ordinary], [r["o"] for r in ordinary])}

    def features(batches):
        distance = _distance(model["toxic"], model["ordinary"])
        for batch in batches:
            x = np.array([distance.features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    data = rows.mapInArrow(features, "y int, x array<double>").toPandas()  # at most 2 x FIT_ROWS rows of counts
    return model | {"weights": logistic(np.stack(data["x"].to_numpy()), data["y"].to_numpy())}


def _counted(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in keys], pa.binary()), pa.array([y for _, y in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["word", "y", "n"])


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with ``tox_score``."""
    if "constant" in model:
        return docs.withColumn("tox_score", F.lit(model["constant"]))

    def make(chunk):
        distance = _distance(model["toxic"], model["ordinary"])
        x = np.array([distance.features(t) for t in chunk.column(text).to_pylist()])
        z = x @ model["weights"][:-1] + model["weights"][-1]
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))]

    return append_columns(docs, make, "tox_score double", text)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score and predicted toxicity."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(_fold() == HELD_OUT, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
