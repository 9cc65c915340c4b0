"""Decontamination beyond the broadcast: passes by parts of the hashes, clashes, and no text shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.llm import decontaminate


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(rng.choice([3, 9, 14, 40]))) for k in range(25)] + [(None, prose(20)), (3, prose(12)), (90, None), (91, "")]
    docs = [(k, prose(rng.choice([0, 5, 60]))) for k in range(120)]
    for k in range(120, 200):
        w = items[k % 25][1].split()
        docs.append((k, prose(15) + " " + " ".join(w[: rng.choice([4, 10, 12, 40])]).upper() + ". " + prose(5)))
    docs += [(7, docs[130][1])] * 40 + [(None, docs[131][1]), (500, None), (501, "é " * 20000 + items[2][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"hit_items": F.lit("clash"), "size": F.lit(5), "_hit": F.lit(1)})
    return df.repartition(4), spark.createDataFrame(items, "item_id long, text string")


def rows(df):
    return sorted((repr((r["doc_id"], r["text"], r["hit_n_words"], list(r["hit_items"]), [tuple(s) for s in r["hit_spans"]])) for r in df.collect()))


@pytest.mark.parametrize("hash_rows, few", [(1 << 20, 10_000), (100, 10_000), (1 << 20, 5)])
def test_all_ways_agree(tables, monkeypatch, hash_rows, few):
    docs, bench = tables
    monkeypatch.setattr(decontaminate, "BROADCAST_FOUND", few)
    want = decontaminate.find_windows(docs, bench)
    got = decontaminate.find_windows(docs, bench, broadcast_bytes=0, hash_rows=hash_rows)
    assert got.columns == want.columns == ["doc_id", "text", "size", "_hit", "hit_n_words", "hit_items", "hit_spans"]
    assert rows(got) == rows(want) and sum(bool(r["hit_items"]) for r in want.collect()) > 50


def test_no_text_is_shuffled(tables):
    docs, bench = tables
    plan = decontaminate.find_windows(docs, bench, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
