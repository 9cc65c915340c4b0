"""Links behind a cloud of near copies that lie just beyond the radius from each other."""

import random

from quarryline.llm import near


def shingles(text, k=4):
    w = text.split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def test_links_behind_batches_without_pairs(spark):
    """The first batch of pivots gives no pair; the seed puts the two linked texts behind it in the only region."""
    rng, cloud = random.Random(9), 300
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    passage = [word() for _ in range(103)]
    texts = [" ".join(passage + [word() for _ in range(9)]) for _ in range(cloud)]
    longer = passage + [word(), word()]
    texts += [" ".join(longer + [word() for _ in range(9)]) for _ in range(2)]
    sets = [shingles(t) for t in texts]
    links = [(b, a) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert links == [(cloud, cloud + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = near.link_documents(docs, 4, 85, 100).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, min(i, cloud)) for i in range(cloud + 2)]
