"""Sides and ranks that are too many to broadcast are not broadcast by Spark's guess of their files' size either."""

from pyspark.sql import functions as F

from quarryline.operators import graph, segments
from quarryline.sources.files import saved


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_sides_are_shuffled(spark, monkeypatch):
    rows = spark.range(3_000).select((F.col("id") % 700).alias("k"), "id")
    side = saved(spark.range(600).select(F.col("id").alias("k"), F.lit(1).alias("v")), "side")
    few = {how: segments.join_side(rows, side, ["k"], how) for how in ("inner", "left")}
    monkeypatch.setattr(segments, "BROADCAST_ROWS", 10)
    for how, small in few.items():
        many = segments.join_side(rows, side, ["k"], how)
        assert "BroadcastHashJoin" in plan_of(small)
        assert "SortMergeJoin" in plan_of(many) and "Broadcast" not in plan_of(many)
        assert sorted(small.collect()) == sorted(many.collect())


def test_many_ranks_are_not_broadcast(spark, monkeypatch):
    edges = spark.range(2_000).select((F.col("id") % 90).alias("src"), (F.col("id") * 7 % 400).alias("dst")).distinct().withColumn("weight", F.lit(1).cast("long"))
    monkeypatch.setattr(graph, "NODES", 30)
    ranked = lambda: {r["id"]: r["rank"] for r in graph.pagerank(edges, max_iter=3).collect()}
    few = ranked()
    monkeypatch.setattr(graph, "RANK_BYTES", 0)
    g = graph.PackedGraph(edges)
    assert "Broadcast" not in plan_of(g.gather(g.start(1.0))) and "Broadcast" not in plan_of(g.unpack(g.start(1.0)))
    many = ranked()
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-12 for k in few)
    assert abs(sum(many.values()) - 1) < 1e-9
