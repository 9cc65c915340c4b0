"""Secret scan: fixed patterns, and a randomness test battery for other strings (operator 5).

Runs of at least MIN_LENGTH encoding characters that touch no fixed pattern are candidates (in
shorter ones the battery tells random strings from words no more). Each gets the encoding that its
characters allow and four tests of randomness: chi-squared uniformity over the encoding's alphabet,
the number of runs above and below the alphabet's middle, and two of serial correlation: that of
neighbouring values, and that of neighbouring characters with the table's own text, the mean
logarithm of how often the second follows the first there (counted over all texts, case folded).
Words are told from random strings by the last. The tests of one string depend on each other, and in
short strings no limit distribution holds: Fisher's sum of their logarithms is therefore ranked among
NULLS random strings of the same alphabet and length, drawn once with a fixed seed. Beyond LONG
characters the limit distributions hold and the Cauchy combination, which dependence does not upset,
joins them.

Under randomness the joint p is uniform; ordinary strings have small ones. Within strata of length
(short strings have less power) the number of random strings is estimated from the p-values above
CLEAR of the whole table, and the smallest level is taken beyond which at most ALPHA of the strings
are expected to be ordinary: the false discovery rate of secrets. What lies beyond is a secret; where
no level holds that rate, nothing is reported.

Defined results: a null or empty text has no spans; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import append_columns, long_array, materialise, read
from quarryline.llm.words import raw_bytes, text_chunks

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_LENGTH = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}")
KINDS = ["assign", "access", "hex", "random"]
#: Alphabets by encoding, the narrowest that holds a string is its encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base26": "abcdefghijklmnopqrstuvwxyz",
    "BASE26": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
_VALUE = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
#: Share of ordinary strings among those found; p above which strings are taken to be random; strata of length (each sqrt(2) longer); bins of p.
ALPHA, CLEAR, STRATA, BINS = 0.1, 0.2, 9, 2_000
#: Characters of the table's text by which neighbours are counted: letters (case folded), digits, marks, all others.
CLASSES = "abcdefghijklmnopqrstuvwxyz0+/-_ "
#: Random strings that a short one is ranked among, and the longest that is.
NULLS, LONG = 2_000, 256


def _class_of(c: str) -> int:
    return CLASSES.index("0" if c.isdigit() else c.lower())


#: Of a byte of text, and of an alphabet's values: their place in CLASSES.
_BYTE_CLASS = np.array([CLASSES.find("0" if 48 <= b < 58 else chr(b).lower()) % len(CLASSES) if b < 128 else len(CLASSES) - 1 for b in range(256)], np.int64)
_CLASSES_OF = {name: np.array([_class_of(c) for c in a]) for name, a in ALPHABETS.items()}


def count_neighbours(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often a character of CLASSES follows another in the texts: a square of counts."""
    k = len(CLASSES)

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for chunk in text_chunks(batch, text):
                c = _BYTE_CLASS[raw_bytes(chunk.column(text))[0]]
                total += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total)], ["pair", "n"])

    out = np.zeros(k * k, np.int64)
    for r in docs.select(text).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # k x k rows
        out[r["pair"]] = r["n"]
    return out.reshape(k, k)


def follow_logs(counts: np.ndarray) -> np.ndarray:
    """The logarithm of how often each class follows another inside strings: digits and marks count a half each at least."""
    inner = counts[:-1, :-1] + 0.5
    return np.log(inner / inner.sum(1, keepdims=True))


def _statistics(x: np.ndarray, size: int, logs: np.ndarray | None = None, classes: np.ndarray | None = None) -> np.ndarray:
    """Of every row of x, values below ``size``: chi-squared, the runs' and the serial correlation's |z|, the mean logarithm of neighbours."""
    m, n = x.shape
    counts = np.zeros((m, size))
    np.add.at(counts, (np.arange(m)[:, None], x), 1)
    uniform = (counts * counts).sum(1) * size / n - n
    high = x >= size // 2
    n1 = high.sum(1).astype(float)
    mean = 2 * (n - n1) * n1 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = np.abs((high[:, 1:] != high[:, :-1]).sum(1) + 1 - mean)
    runs = np.where(var > 0, runs / np.sqrt(np.where(var > 0, var, 1)), np.where((n1 == 0) | (n1 == n), 1e3, 0))
    y = x - x.mean(1, keepdims=True)
    total = (y * y).sum(1)
    serial = np.abs(((y[:, 1:] * y[:, :-1]).sum(1) / np.where(total > 0, total, 1) + 1 / n) * math.sqrt(n))
    own = [uniform, runs, np.where(total > 0, serial, 1e3)]
    if logs is not None:
        c = classes[x]
        own.append(logs[c[:, :-1], c[:, 1:]].mean(1))
    return np.column_stack(own)


def _tails(null: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Share of the sorted null, and of the value itself, at or above each x."""
    return (len(null) - np.searchsorted(null, x, side="left") + 1) / (len(null) + 1)


@functools.lru_cache(512)  # some 80 KB each
def _null(name: str, n: int, model: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted statistics of NULLS random strings, their sorted Fisher sums, and the statistics' mean and deviation."""
    size = len(ALPHABETS[name])
    x = np.random.default_rng([size, n]).integers(0, size, (NULLS, n))
    stats = _statistics(x, size, _logs(model), _CLASSES_OF[name])
    each = np.sort(stats, axis=0)
    fisher = -sum(np.log(_tails(each[:, k], stats[:, k])) for k in range(stats.shape[1]))
    return each, np.sort(fisher), np.array([stats.mean(0), stats.std(0)])


def _logs(model: bytes | None) -> np.ndarray | None:
    return None if model is None else np.frombuffer(model).reshape(len(CLASSES) - 1, -1)


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail by the cube-root approximation of the chi-squared distribution."""
    z = (max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2 / (9 * df)) / math.sqrt(2))


def randomness(s: str, model: bytes | None = None) -> float:
    """Joint p-value of the tests: small where s is not a uniformly random string of its encoding.

    ``model`` holds the bytes of ``follow_logs``; without it the test by the table's own text is left out.
    """
    chars = set(s)
    name = next(k for k, v in _VALUE.items() if chars <= v.keys())
    size, x = len(_VALUE[name]), np.array([[_VALUE[name][c] for c in s]])
    stats = _statistics(x, size, _logs(model), _CLASSES_OF[name])[0]
    if len(s) <= LONG:
        each, sums, _ = _null(name, len(s), model)
        fisher = -sum(math.log(float(_tails(each[:, k], stats[k]))) for k in range(len(stats)))
        return float(_tails(sums, fisher - 1e-12))
    tails = [_chi2_tail(stats[0], size - 1), *(math.erfc(z / math.sqrt(2)) for z in stats[1:3])]
    if model is not None:
        _, _, (mean, sd) = _null(name, LONG, model)
        tails.append(0.5 * math.erfc((stats[3] - mean[3]) / (sd[3] * math.sqrt(LONG / len(s))) / math.sqrt(2)))
    cauchy = sum(math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-15)) * math.pi) for p in tails) / len(tails)
    return 0.5 - math.atan(cauchy) / math.pi


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; kind is a place in KINDS."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, string) of encoding runs that touch no fixed pattern's span."""
    return [(m.start(), m.end(), m.group()) for m in _CANDIDATE.finditer(text) if all(m.end() <= a or m.start() >= b for a, _, b in base)]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, without the text, with sec_assign, sec_access, sec_hex, sec_base_sha256 and ``sec_spans``
    (array of start, kind, end; kind is a place in KINDS), fixed and random."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    tested = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("p", pa.float64())])
    model = follow_logs(count_neighbours(docs, text)).tobytes()

    def make(chunk):
        counts, digests, bases, tests = [[], [], []], [], [], []
        for t in chunk.column(text).to_pylist():
            base = base_spans(t or "")
            for k in range(3):
                counts[k].append(sum(kind == k for _, kind, _ in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            tests.append([{"start": a, "end": b, "stratum": min(STRATA - 1, int(2 * math.log2(len(s) / MIN_LENGTH))), "p": randomness(s, model)} for a, b, s in candidates(t or "", base)])
        return [*map(long_array, counts), pa.array(digests, pa.string()), pa.array(bases, pa.list_(span)), pa.array(tests, pa.list_(tested))]

    ddl = "sec_assign long, sec_access long, sec_hex long, sec_base_sha256 string, sec_base array<struct<start: long, kind: int, end: long>>, sec_tests array<struct<start: long, end: long, stratum: int, p: double>>"
    found = materialise(append_columns(docs, make, ddl, text).drop(text), "secrets")
    limits = thresholds(found)
    limit = F.array(*[F.lit(x) for x in limits])
    random = F.transform(F.filter("sec_tests", lambda c: c["p"] >= limit[c["stratum"]]), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return found.withColumn("sec_spans", F.array_sort(F.concat("sec_base", random))).drop("sec_base", "sec_tests")


def thresholds(found: DataFrame) -> list[float]:
    """Per stratum, the level of p beyond which strings are secrets, from counts in BINS bins."""
    tests = found.select(F.explode("sec_tests").alias("t")).select("t.stratum", F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts = np.zeros((STRATA, BINS))
    for r in tests.groupBy("stratum", "bin").count().collect():  # at most STRATA x BINS rows
        counts[r["stratum"], r["bin"]] = r["count"]
    return [level(row) for row in counts]


def level(counts: np.ndarray) -> float:
    """The smallest p beyond which at most ALPHA of the strings are expected to be ordinary; above 1 where there is none.

    The p-values above CLEAR are taken to be of random strings, whose p is uniform.
    """
    bins = len(counts)
    beyond = counts[::-1].cumsum()[::-1]
    random = beyond[int(CLEAR * bins)] / (1 - CLEAR)
    for k in range(1, int(CLEAR * bins) + 1):
        if beyond[k] and 1 - random * (1 - k / bins) / beyond[k] <= ALPHA:
            return k / bins
    return 2.0


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fixed patterns found, their digest, and all spans."""
    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = F.array_join(F.transform("sec_spans", lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.col("sec_assign").alias("n_assign"), F.col("sec_access").alias("n_access"), F.col("sec_hex").alias("n_hex"), F.col("sec_base_sha256").alias("base_sha256"), joined.alias("spans"))
