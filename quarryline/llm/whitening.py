"""Embedding whitening by mixed-precision refinement of eigenvectors (operator 13).

Spark sums the table twice: the entries' sums, then products of the entries centred by the rounded
means. Both are sums of integers and exact: a task's products are float64 matrix products of blocks
so small that no sum passes 2**53. The covariance, from exact integers, is rounded once.

Eigenvectors are found in float32 and corrected in extended precision (numpy's long double; where
that is plain double, to double precision) by the iterations of Ogita and Aishima, which need matrix
products alone and square the error each time:

    R = I - X'X,  S = X'VX,  e_i = S_ii / (1 - R_ii),
    E_ij = (S_ij + e_j R_ij) / (e_j - e_i), or R_ij / 2 where e_i and e_j are of one cluster,
    X <- X + X E.

Of clustered eigenvalues the iteration finds the span of the vectors alone. The vectors of a cluster
are then found by a sub-solve: the covariance less the cluster's mean eigenvalue, projected on the
span in extended precision, is a small matrix on a scale of its own, where the eigenvalues lie apart;
it is solved in the same way (clusters within it by sub-solves again), and its eigenvectors turn the
span's.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; vectors
of another length than the table's most frequent (of ties the smallest) are dropped as well; a null
vec_id stays; repeated rows count as often as they stand there; an empty table gives an empty one;
directions without variance (to double precision) have no component; a deviation beyond a long is
null; entries are below 2**40. Other columns pass through ``whiten``, and one that has the name of a
new column is replaced; the query ignores them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import bound_batches, read

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows of a block in a task, and iterations of the refinement at most.
BLOCK_ROWS, STEPS = 4096, 12
#: Eigenvalues so close, in parts of the largest entry, are a cluster.
CLUSTER = 2.0**-14


# ---- eigenvectors
def _labels(e: np.ndarray, width: float) -> np.ndarray:
    """A number for each eigenvalue; those that follow each other by at most ``width`` share one."""
    order = np.argsort(e, kind="stable")
    out = np.empty(len(e), int)
    out[order] = np.cumsum(np.r_[0, np.diff(e[order]) > width])
    return out


def _spread(e: np.ndarray, label: np.ndarray) -> float:
    return max(float(np.ptp(e[label == k])) for k in np.unique(label))


def refine(v: np.ndarray, x: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and orthonormal vectors of the symmetric v (largest entry 1), from x with errors of about ``noise``.

    Eigenvalues closer than CLUSTER form a cluster, of which the iteration finds the span; it gets narrower where
    clusters would run together, as long as the error allows.
    """
    one, eps = np.eye(len(v), dtype=np.longdouble), float(np.finfo(np.longdouble).eps)
    width = CLUSTER
    for step in range(STEPS):
        r, s = one - x.T @ x, x.T @ v @ x
        e = np.diag(s) / (1 - np.diag(r))
        while step == 0 and width > 64 * noise and _spread(e, _labels(e, width)) > 1 / 8:
            width /= 4
        label = _labels(e, width)
        close = label[:, None] == label[None, :]
        correction = np.where(close, r / 2, (s + e[None, :] * r) / np.where(close, 1, e[None, :] - e[:, None]))
        x = x + x @ correction
        if float(np.abs(correction).max()) < 64 * eps:
            break
    for k in np.unique(label):
        own = np.flatnonzero(label == k)
        if len(own) > 1:
            x[:, own] = x[:, own] @ _sub_solve(v, x[:, own])
    return np.diag(x.T @ v @ x), x


def _sub_solve(v: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The eigenvectors of v within an orthonormal span, on the scale of what is left of v there."""
    middle = np.trace(span.T @ v @ span) / span.shape[1]
    small = span.T @ (v @ span - middle * span)
    return eigen((small + small.T) / 2, least=len(v) * float(np.finfo(np.longdouble).eps))[1]


def eigen(v: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors in columns: float32 first, then refined.

    A matrix whose entries are no larger than ``least`` is rounding alone: any vectors do.
    """
    scale = np.abs(v).max()
    if not scale > least:
        return np.diag(v).astype(np.longdouble), np.eye(len(v), dtype=np.longdouble)
    w = np.asarray(v, np.longdouble) / scale
    e, x = np.linalg.eigh(w.astype(np.float32))
    noise = float(np.finfo(np.float32).eps)
    if _spread(e, _labels(e, max(64 * noise, CLUSTER / 4096))) > 1 / 8:  # too dense for float32 to tell apart
        _, x = np.linalg.eigh(w.astype(float))
        noise = float(np.finfo(float).eps)
    e, x = refine(w, x.astype(np.longdouble), noise)
    order = np.argsort(-e, kind="stable")
    return e[order] * scale, x[:, order]


# ---- sums over the table
@dataclass
class Whitening:
    """n rows; per dimension the integer ``middle`` near the mean and the exact sum of x - middle; the
    components' vectors (columns), eigenvalues and the covariance's trace."""

    n: int
    middle: np.ndarray
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, z: np.ndarray) -> np.ndarray:
        return z - np.array([s / self.n for s in self.rest])

    def apply(self, z: np.ndarray) -> np.ndarray:
        return (self.centred(z) @ self.vectors) / np.sqrt(self.values)

    def deviation(self, z: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2, exact."""
        most = max((abs(s) for s in self.rest), default=0) + self.n * int(np.abs(z).max(initial=0))
        if len(self.rest) * most * most < 2**63:
            d = self.n * z.astype(np.int64) - np.array(self.rest, np.int64)
            return (d * d).sum(1).tolist()
        rows = [sum((self.n * int(k) - s) ** 2 for k, s in zip(row, self.rest)) for row in z.tolist()]
        return [d if d < 2**63 else None for d in rows]


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def _blocks(batch: pa.RecordBatch, column: str, d: int):
    """(rows of the batch, their entries as x - OFFSET in float64, exact) for blocks of BLOCK_ROWS."""
    for i in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(i, BLOCK_ROWS)
        c = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        yield part, np.floor(SCALE * c)


def _rows_for(z: np.ndarray) -> int:
    """Rows whose products sum below 2**53."""
    most = float(np.abs(z).max(initial=1))
    return max(1, int(2**53 // max(most * most, 1)))


def _sum_rows(vectors: DataFrame, run, ddl: str, keys: list[str]) -> list:
    """The sums of ``s`` by keys over what ``run`` gives for each task: exact, partial sums before the shuffle."""
    return vectors.mapInArrow(run, ddl).groupBy(*keys).agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()


def fit_whitening(rows: DataFrame, column: str, d: int, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of usable vectors of d entries; None if there are none.

    What reaches the driver are d sums and d (d + 1) / 2 products, whatever the number of rows.
    """
    vectors = rows.select(column)

    def totals(batches):
        n, sums = 0, [0] * d
        for batch in batches:
            for _, z in _blocks(batch, column, d):
                n += len(z)
                sums = [a + int(b) for a, b in zip(sums, z.astype(np.int64).sum(0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([n, *sums], pa.int64())], ["i", "s"])

    got = {r["i"]: int(r["s"]) for r in _sum_rows(vectors, totals, "i int, s long", ["i"])}
    n = got.get(-1, 0)
    if not n:
        return None
    middle = np.array([(2 * got[k] + n) // (2 * n) for k in range(d)], np.int64)
    rest = [got[k] - n * int(middle[k]) for k in range(d)]
    left, right = np.tril_indices(d)

    def products(batches):
        total = [0] * len(left)
        for batch in batches:
            for _, z in _blocks(batch, column, d):
                z -= middle
                step = _rows_for(z)
                for i in range(0, len(z), step):
                    own = z[i : i + step]
                    total = [a + b for a, b in zip(total, (own.T @ own)[left, right].astype(np.int64).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(total, pa.int64())], ["i", "j", "s"])

    v = np.zeros((d, d), np.longdouble)
    for r in _sum_rows(vectors, products, "i int, j int, s long", ["i", "j"]):
        whole = n * int(r["s"]) - rest[r["i"]] * rest[r["j"]]  # n**2 times the covariance, exact
        high = whole // n
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = (np.longdouble(high) + np.longdouble(whole - high * n) / n) / n
    e, x = eigen(v)
    few = int((e > d * np.finfo(float).eps * e[0]).sum()) if d and e[0] > 0 else 0
    few = min(few, most)
    sign = np.sign(x[np.abs(x).argmax(0), np.arange(d)])
    x = x * np.where(sign == 0, 1, sign)
    return Whitening(n, middle, rest, x[:, :few].astype(float), e[:few].astype(float), float(np.trace(v)))


def whiten(rows: DataFrame, column: str, model: Whitening) -> DataFrame:
    """rows (usable vectors) with ``whitened`` (array, one entry a component) and ``deviation``."""
    more = T.StructType.fromDDL("whitened array<double>, deviation long")
    kept = rows.drop(*more.names)
    bound_batches(rows.sparkSession)
    d, few = len(model.middle), len(model.values)

    def run(batches):
        for batch in batches:
            for part, z in _blocks(batch, column, d):
                z -= model.middle
                out = model.apply(z)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * few, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(model.deviation(z), pa.int64())], [*part.schema.names, *more.names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *more.fields]))


def identity_error(rows: DataFrame, column: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    d, few = len(model.middle), len(model.values)

    def run(batches):
        total = np.zeros((few + 1, few + 1))
        for batch in batches:
            for _, z in _blocks(batch, column, d):
                w = np.column_stack([model.apply(z - model.middle), np.ones(len(z))])
                total += w.T @ w
        i, j = np.tril_indices(few + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    sums = np.zeros((few + 1, few + 1))
    for r in rows.select(column).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r["i"], r["j"]] = sums[r["j"], r["i"]] = r["s"]
    # The vectors were centred before they were projected: the mean is rounding alone.
    mean = sums[few, :few] / model.n
    return float(np.abs(sums[:few, :few] / model.n - np.outer(mean, mean) - np.eye(few)).max(initial=0))


def vector_rows(table: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows with usable vectors of the most frequent length, and that length."""
    rows = table.where(usable(column))
    first = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = first["d"] if first else 0
    return rows.where(F.size(column) == d), d


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per usable row of ``embeddings`` and component: the whitened value, the share explained and the checks."""
    rows, d = vector_rows(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    model = fit_whitening(rows, "embedding", d) if d else None
    if model is None:
        model, rows = Whitening(0, np.zeros(0, np.int64), [], np.zeros((0, 0)), np.zeros(0), 0.0), rows.limit(0)
    error = identity_error(rows, "embedding", model) if model.n else 0.0
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    out = whiten(rows, "embedding", model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
