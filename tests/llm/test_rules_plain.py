"""The minimum covariance determinant of the quality rules against a plain numpy version."""

import math
import random

import numpy as np
import pyarrow as pa

from quarryline.llm import rules, textstats


def texts(seed=6, least=15):
    rng = random.Random(seed)
    words = "the river runs past a quiet mill and turns beneath old stones while small birds call over green water".split()
    out = []
    for i in range(420):
        n = rng.randrange(least, 120)
        t = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
        t = "\n".join(x.capitalize() for x in t.split(". "))
        if i % 20 == 0:
            t = " ".join(f"%%{rng.randrange(10**6)}$$ #{rng.randrange(10**6)}|" for _ in range(40))
        out.append(t)
    return out


def rank(v, share):
    return np.sort(v)[max(1, math.ceil(share * len(v))) - 1]


def plain(x):
    p = x.shape[1]
    med = np.array([rank(c, 0.5) for c in x.T])
    scale = np.sqrt((np.array([rank(np.abs(c - m), 0.5) for c, m in zip(x.T, med)]) * 1.4826) ** 2 + rules.FLOOR**2)
    z = (x - med) / scale
    signs = z / np.sqrt(1e-12 + (z * z).sum(1))[:, None]
    _, v = np.linalg.eigh(np.cov(signs.T, bias=True))
    spread = np.maximum(np.diag(v.T @ np.cov(signs.T, bias=True) @ v) * p, 1e-3)
    starts = [(med, np.diag(scale**2 - rules.FLOOR**2)), (med, np.outer(scale, scale) * ((v * spread) @ v.T)), (x.mean(0), np.cov(x.T, bias=True))]

    def distance(center, cov):
        d = x - center
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov + np.eye(p) * rules.FLOOR**2), d)

    def step(center, cov):
        d2 = distance(center, cov)
        own = x[d2 <= rank(d2, rules.H)]
        return own.mean(0), np.cov(own.T, bias=True)

    def logdet(cov):
        return np.linalg.slogdet(cov + np.eye(p) * rules.FLOOR**2)[1]

    for _ in range(rules.FIRST_STEPS):
        starts = [step(*s) for s in starts]
    best = min(starts, key=lambda s: logdet(s[1]))
    dets = [logdet(best[1])]
    while len(dets) < 2 or dets[-2] - dets[-1] >= rules.CONVERGED:
        best = step(*best)
        dets.append(logdet(best[1]))
    assert all(b <= a + 1e-9 for a, b in zip(dets, dets[1:]))
    d2 = distance(*best)
    return d2 / max(rank(d2, 0.5), 1.0)


def test_verdicts_match_a_plain_version(spark):
    every = texts()
    rows = [(i, t, "en", "a") for i, t in enumerate(every)] + [(1000, None, "en", "a"), (1001, "few words", None, None), (1002, every[1], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'own' AS grp", "'own' AS mcd_d2", "'own' AS st_n_words")
    got = {r["doc_id"]: r for r in rules.apply_rules(docs.repartition(3)).collect()}
    counts = textstats.count_texts(pa.array([r[1] for r in rows], pa.string()))
    failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
    x = textstats.transform(counts)[:, rules.USED]
    own = np.array([r[2] == "en" for r in rows]) & ~failed
    want = dict(zip(np.array([r[0] for r in rows])[own].tolist(), plain(x[own]).tolist()))
    for k, (i, *_) in enumerate(rows):
        assert got[i]["base_failed"] == bool(failed[k])
        if i in want:
            assert math.isclose(got[i]["mcd_d2"], want[i], rel_tol=1e-6)
            assert got[i]["kept"] == (want[i] <= rules.CUTOFF)
        if failed[k]:
            assert not got[i]["kept"]
    assert 0 < sum(not got[i]["kept"] for i in want) < len(want) / 5


def test_every_group_settles_on_its_own(spark):
    """Three groups of other texts and sizes, one beside the others from the start: each has the estimate that it has alone.

    The groups have fewer than 500 rows, where the operator's approximate quantiles have the exact rank.
    """
    groups = {("en", "a"): texts(6), ("en", None): texts(9, 60)[:260], ("de", "a"): texts(12, 20)[:340]}
    rows = [(1000 * k + i, t, *g) for k, (g, every) in enumerate(groups.items()) for i, t in enumerate(every)]
    got = {r["doc_id"]: r for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()}
    for k, every in enumerate(groups.values()):
        counts = textstats.count_texts(pa.array(every, pa.string()))
        good = ~((counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"]))
        want = plain(textstats.transform(counts)[:, rules.USED][good])
        for i, d2 in zip(np.flatnonzero(good).tolist(), want.tolist()):
            assert math.isclose(got[1000 * k + i]["mcd_d2"], d2, rel_tol=1e-6), (k, i, got[1000 * k + i]["mcd_d2"], d2)
