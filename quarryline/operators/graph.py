"""Link graphs (G): edges (src, dst, weight), vertices (id)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.segments import join_side
from quarryline.sources.files import saved


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def adjacency_list(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    own = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
    return vertices.join(own, "id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast(own.schema["neighbors"].dataType)))


def adjacency_matrix(edges: DataFrame, ids: list) -> DataFrame:
    """For small graphs of stated nodes."""
    return edges.groupBy("src").pivot("dst", ids).agg(F.lit(1)).na.fill(0)


def transition_probabilities(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("weight").alias("out_weight"))
    return edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out_weight")).alias("p"))


def dangling_nodes(edges: DataFrame) -> DataFrame:
    return nodes_of(edges).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def count_nodes(edges: DataFrame) -> DataFrame:
    return nodes_of(edges).agg(F.count("*").alias("nodes")).crossJoin(dangling_nodes(edges).agg(F.count("*").alias("dangling")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("weight").alias("out_degree"))


def degree_summary(edges: DataFrame, n: int = 10) -> DataFrame:
    d = degrees(edges)
    return d.orderBy(F.desc("out_degree"), "src").limit(n).crossJoin(d.agg(F.round(F.avg("out_degree"), 9).alias("mean_degree")))


def degree_sample(edges: DataFrame, n: int, seed: str = "s") -> DataFrame:
    """Out-degrees of n nodes that have edges, chosen by a hash of their id."""
    return degrees(edges).orderBy(F.md5(F.concat(F.lit(seed), F.col("src").cast("string")).cast("binary")), "src").limit(n)


def init_graph(edges: DataFrame) -> DataFrame:
    v = nodes_of(edges)
    return v.crossJoin(F.broadcast(v.agg((1 / F.count("*")).alias("rank"))))


#: Nodes of a block, and edges of a packed row.
NODES, EDGES = 50_000, 500_000
#: Size up to which ranks are broadcast, so that packed edges stay where they are.
RANK_BYTES = 16 << 20


class PackedGraph:
    """A graph as blocks of nodes and packed rows of edges, from which iterations move arrays of ranks alone.

    A node stands at a place of a block, by the hash of its id. The edges of a block of sources are packed into rows of
    about EDGES (sources and targets as places, and probabilities, in the order of targets): the row of a hub with more
    edges than that is cut by the targets' hash, and a hub that many edges reach is summed in each row first. An iteration
    joins rows of edges with their block's ranks, and deals one array of sums for each row and target block. Ranks are
    broadcast up to RANK_BYTES, by the number of nodes: equal ranks make files that say little about their size.
    """

    def __init__(self, edges: DataFrame):
        nodes = saved(nodes_of(edges), "nodes")
        self.n = nodes.count()
        self.blocks = max(1, -(-self.n // NODES))
        out = saved(edges.groupBy("src").agg(F.sum("weight").alias("_out")), "out-weights")
        placed = nodes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int"))
        order = Window.partitionBy("block").orderBy("id")
        flagged = join_side(placed, out.withColumnRenamed("src", "id"), ["id"], "left").withColumn("place", (F.row_number().over(order) - 1).cast("int"))
        self.places = saved(flagged.select("id", "block", "place", F.col("_out").isNull().alias("dangling")), "places")
        packed = self.places.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "id", "dangling"))).alias("v"))
        self.nodes = saved(packed.select("block", F.col("v.id").alias("ids"), F.col("v.dangling").alias("dangling")), "node-blocks")
        at = lambda x: self.places.select(F.col("id").alias(x), F.col("block").alias(f"{x}_block"), F.col("place").alias(f"{x}_place"))
        e = join_side(edges.select("src", "dst", "weight"), out, ["src"])
        e = join_side(join_side(e, at("src"), ["src"]), at("dst"), ["dst"]).withColumn("p", F.col("weight") / F.col("_out"))
        e = saved(e.select("src_block", "src_place", "dst_block", "dst_place", "p", F.pmod(F.hash("dst"), F.lit(1 << 20)).alias("h")), "placed-edges")
        sizes = saved(e.groupBy("src_block").agg(F.ceil(F.count("*") / EDGES).alias("pieces")), "edge-counts")
        cut = join_side(e, sizes, ["src_block"]).withColumn("piece", F.col("h") % F.col("pieces"))
        rows = cut.groupBy("src_block", "piece").agg(F.array_sort(F.collect_list(F.struct("dst_block", "dst_place", "src_place", "p"))).alias("e"))
        self.edges = saved(rows.select(F.col("src_block").alias("block"), *[F.col(f"e.{c}").alias(c) for c in ("dst_block", "dst_place", "src_place", "p")]), "edge-rows")

    def _sent(self, arrays: DataFrame) -> DataFrame:
        """Arrays with a number for each node: broadcast while they are small, else sorted and merged."""
        return F.broadcast(arrays) if 8 * self.n <= RANK_BYTES else arrays.hint("merge")

    def start(self, rank: float) -> DataFrame:
        return saved(self.nodes.select("block", F.transform("ids", lambda _: F.lit(rank)).alias("ranks")), "ranks")

    def gather(self, ranks: DataFrame) -> DataFrame:
        """Per block with edges into it, what its nodes get: (block, got)."""
        blocks = max(1, min(self.blocks, int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

        def spread(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    block, place, src, p, rank = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(5))
                    first = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(place) != 0)])
                    sums, block, place = np.add.reduceat(rank[src] * p, first), block[first], place[first]
                    cut = np.flatnonzero(np.r_[True, np.diff(block) != 0])
                    ends = pa.array(np.r_[cut, len(block)].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.ListArray.from_arrays(ends, pa.array(place)), pa.ListArray.from_arrays(ends, pa.array(sums))], ["block", "places", "sums"])

        def add(batches):
            now, got = None, np.zeros(0)
            for batch in batches:
                for k in range(batch.num_rows):
                    block, place, sums = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy()
                    if block != now:
                        if now is not None:
                            yield _block(now, got)
                        now, got = block, np.zeros(0)
                    if place[-1] >= len(got):
                        got = np.r_[got, np.zeros(place[-1] + 1 - len(got))]
                    got[place] += sums  # a row has each place once
            if now is not None:
                yield _block(now, got)

        rows = self.edges.join(self._sent(ranks), "block").select("dst_block", "dst_place", "src_place", "p", "ranks")
        parts = rows.mapInArrow(spread, "block int, places array<int>, sums array<double>")
        return parts.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(add, "block int, got array<double>")

    def step(self, ranks: DataFrame, new) -> DataFrame:
        """The next ranks: ``new`` of what each node gets (a column, 0 without edges)."""
        got = self.gather(ranks).withColumnRenamed("block", "_b")
        both = self.nodes.join(got.hint("merge"), F.col("block") == F.col("_b"), "left")
        each = F.transform("ids", lambda _, k: new(F.coalesce(F.get("got", k), F.lit(0.0))))
        return saved(both.select("block", each.alias("ranks")), "ranks")

    def mass(self, ranks: DataFrame) -> tuple[float, float]:
        """The ranks' total, and that of dangling nodes."""
        add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        lost = F.zip_with("ranks", "dangling", lambda x, is_: F.when(is_, x).otherwise(0.0))
        r = self.nodes.join(self._sent(ranks), "block").agg(F.sum(add("ranks")).alias("all"), F.sum(add(lost)).alias("lost")).first()
        return r["all"] or 0.0, r["lost"] or 0.0

    def unpack(self, ranks: DataFrame) -> DataFrame:
        return self.nodes.select("block", "ids").join(self._sent(ranks), "block").select(F.explode(F.arrays_zip("ids", "ranks")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.ranks").alias("rank"))


def _block(block: int, got: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(got)], pa.int32()), pa.array(got))], ["block", "got"])


def power_iteration(edges: DataFrame, n_iter: int) -> DataFrame:
    """x <- xT from 1/N; the mass of dangling nodes leaks."""
    g = PackedGraph(edges)
    ranks = g.start(1 / max(g.n, 1))
    for _ in range(n_iter):
        ranks = g.step(ranks, lambda got: got)
    return g.unpack(ranks)


def pagerank(edges: DataFrame, alpha: float = 0.15, max_iter: int = 10, mode: str = "mass", log: list | None = None) -> DataFrame:
    """Ranks (id, rank): ``mass`` shares dangling mass and keeps a total of 1, ``unnormalized`` starts at 1 and drops it.

    ``log`` gets (iteration, missing mass, total) for each iteration of ``mass``, from one-row aggregates.
    """
    g = PackedGraph(edges)
    ranks, missing = g.start(1 / max(g.n, 1) if mode == "mass" else 1.0), 0.0
    if mode == "mass":
        _, missing = g.mass(ranks)
    for i in range(max_iter):
        if mode == "mass":
            ranks = g.step(ranks, lambda got, m=missing: F.lit(alpha / g.n) + (1 - alpha) * (F.lit(m / g.n) + got))
            total, lost = g.mass(ranks)
            if log is not None:
                log.append((i, missing, total))
            missing = lost
        else:
            ranks = g.step(ranks, lambda got: F.lit(alpha) + (1 - alpha) * got)
    return g.unpack(ranks)


def airport_pagerank(facts: DataFrame, origin: str, dest: str, delay: str, max_iter: int = 5) -> DataFrame:
    """Ranks over one edge for each distinct (origin, destination, delay)."""
    edges = facts.select(F.col(origin).alias("src"), F.col(dest).alias("dst"), delay).distinct().groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return pagerank(edges, 0.15, max_iter, "unnormalized")
