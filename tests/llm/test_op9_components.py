"""Components of chains, stars, repeated and reversed links; a star takes no round, so no table is written for it."""

import random

from quarryline.llm import near


def plain(links):
    root = {x: x for link in links for x in link}
    while True:
        new = dict(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return {x: r for x, r in root.items() if x != r}
        root = new


def found(spark, links):
    rows = near.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_components_are_the_plain_ones(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 112)] + [(7, 3), (3, 7), (3, 7), (9, 9), (-4, 2), (2, 50)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    assert found(spark, links) == plain([x for x in links if x[0] != x[1]])


def test_stars_write_nothing(spark, monkeypatch):
    written, real = [], near.materialise
    monkeypatch.setattr(near, "materialise", lambda df, name, *more: written.append(name) or real(df, name, *more))
    links = [(1, i) for i in range(2, 40)] + [(60, 50), (50, 60), (70, 50)]
    assert found(spark, links) == plain(links)
    assert not written
    assert found(spark, [(1, 2), (2, 3)]) == {2: 1, 3: 1} and written
