"""Windows, counts, numbers and quantiles where one key holds most rows, against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.operators import relational as R
from quarryline.operators import segments


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(1)
    rows = []
    for i in range(6000):
        key = "hot" if i % 5 else rng.choice(["a", "b", "c", None])
        rows.append((i, key, rng.randrange(1500) if i % 9 else 77, rng.choice([None, float(rng.randrange(40))])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "event_id long, key string, at long, value double").withColumn("ts", F.timestamp_seconds(F.col("at") * 600)).repartition(7)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("segment", [10**6, 700, 130])
def test_windows_of_a_hot_key(events, monkeypatch, segment):
    monkeypatch.setattr(segments, "SEGMENT", segment)
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    known = events.where("key is not null")
    plain = known.withColumns({"next_ts": F.lead("ts").over(w), "rnk": F.rank().over(Window.partitionBy("key").orderBy("ts"))})
    own = F.when((F.unix_timestamp("next_ts") - F.unix_timestamp("ts")) / 60 <= 90, F.col("value")).otherwise(0.0)
    plain = plain.withColumn("own", own).withColumn("carried", F.when(F.col("rnk") <= 2, 0.0).otherwise(F.coalesce(F.lag("own", 2).over(w), F.lit(0.0))))
    got = R.carry_over_delay(events, "key", "ts", "event_id", "value", 90)
    assert rows(got, "event_id", "next_ts", "rnk", "carried") == rows(plain, "event_id", "next_ts", "rnk", "carried")
    assert set(got.columns) == {*events.columns, "next_ts", "rnk", "carried"}
    filled = events.withColumn("value", F.last("value", ignorenulls=True).over(w.rowsBetween(-250, 0)))
    assert rows(R.forward_fill(events, ["key"], ["ts", "event_id"], ["value"]), "event_id", "value") == rows(filled, "event_id", "value")
    want = events.withColumn("diff", F.col("value") - F.lag("value", 12).over(w))
    want = want.withColumn("diff", F.col("diff") - F.lag("diff", 1).over(w))
    assert rows(R.difference(events, "key", ["ts", "event_id"], "value"), "event_id", "diff") == rows(want, "event_id", "diff")


def test_numbers(events):
    got = segments.number_rows(events, ["key"], ["ts", "event_id"], "i")
    want = events.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id")) - 1)
    assert rows(got, "event_id", "i") == rows(want, "event_id", "i")
    places = rows(segments.number_rows(events, [], [F.desc("at"), "event_id"], "i"), "i", "at", "event_id")
    assert [p[0] for p in sorted(places)] == list(range(6000))
    assert sorted(places) == [(i, a, e) for i, (a, e) in enumerate(sorted(((a, e) for _, a, e in places), key=lambda x: (-x[0], x[1])))]


@pytest.mark.parametrize("broadcast", [100_000, 2])
def test_counts_of_a_hot_key(events, monkeypatch, broadcast):
    monkeypatch.setattr(segments, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(segments, "SHARES", 8)
    want = events.where("key is not null").withColumn("n", F.count("*").over(Window.partitionBy("key", F.col("at") % 5)))
    keyed = events.withColumn("m", F.col("at") % 5)
    assert rows(R.attach_group_count(keyed, ["key", "m"], "n"), "event_id", "n") == rows(want, "event_id", "n")


@pytest.mark.parametrize("bins, few, broadcast", [(4096, 10_000, 100_000), (8, 3, 100_000), (16, 5, 1)])
def test_exact_quantiles(spark, monkeypatch, bins, few, broadcast):
    monkeypatch.setattr(segments, "BINS", bins)
    monkeypatch.setattr(segments, "SORTED", few)
    monkeypatch.setattr(segments, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    values = {"hot": [rng.lognormvariate(0, 8) for _ in range(900)], "ties": [rng.choice([1.5, 1.5, 2.0]) for _ in range(200)], None: [-1e300, 1e300, 0.0, 5e-324, 1e-9], "one": [7.0], "none": [None, None], "mixed": [None, float("nan"), -2.0, 3.0]}
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, v double").repartition(5)
    got = {(r["k"], r["q"]): r["value"] for r in segments.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["k"]).collect()}
    want = {}
    for k, own in values.items():
        known = np.array([v for v in own if v is not None and v == v])
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            if len(known):
                want[(k, q)] = np.percentile(known, 100 * q)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=0) for k in want)


def test_describe_and_boxes_gather_nothing(events):
    plan = R.box_stats(events, "key", "value")._jdf.queryExecution().executedPlan().toString() + R.describe(events, ["value", "at"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    assert R.describe(events, ["value", "at"]).count() == 2
