"""Chains of licence matches against all chains there are, whole licence texts as a table, and what notices are labelled."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarryline.llm import licences
from tests.llm.test_licences_secrets import labels


@pytest.mark.parametrize(
    "text, want",
    [
        ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", {"cc-by-nc-nd-4.0"}),
        ("Creative Commons Attribution NoDerivatives 4.0 International License", {"cc-by-nd-4.0"}),
        ("licensed under a Creative Commons Attribution-Non-Commercial-Share Alike 3.0 Unported License", {"cc-by-nc-sa-3.0"}),
        ("Creative Commons Attribution-ShareAlike 2.5 Unported License", {"cc-by-sa-2.5"}),
        ("Creative Commons Attribution 4.0 International License", {"cc-by-4.0"}),
        ("Mozilla Public License Version 2.0", {"mpl-2.0"}),
        ("// SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}),
        ("# SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0"}),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("SPDX-License-Identifier: CC-BY-NC-ND-4.0", {"cc-by-nc-nd-4.0"}),
        ("SPDX-License-Identifier: something else", set()),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", {"isc"}),
        ("this license identifier is under the version of a public text", set()),
    ],
)
def test_notices(text, want):
    assert labels(text) == want


def every_chain(scanner, matches):
    """Of each template and last match, the most words of any chain: all subsets in order are tried."""
    best = {}
    for k in range(len(scanner.sizes)):
        own = [(start, size, end, j) for j, (start, size, ends) in enumerate(matches) for kk, end in ends if kk == k and size >= scanner.least[k]]
        for n in range(1, len(own) + 1):
            for chain in itertools.combinations(own, n):
                if all(a[3] < b[3] and a[0] + a[1] <= b[0] and b[0] - a[0] - a[1] <= licences.MAX_GAP and a[2] <= b[2] - b[1] for a, b in itertools.pairwise(chain)):
                    last = (k, chain[-1][0] + chain[-1][1])
                    best[last] = max(best.get(last, 0), sum(c[1] for c in chain))
    return best


def test_chains_against_all_chains():
    rng, tried = random.Random(11), 0
    for _ in range(300):
        texts = [[rng.choice("abcdef") + str(k) if rng.random() < 0.5 else rng.choice("pqrst") for _ in range(rng.randrange(4, 30))] for k in range(3)]
        scanner = licences.Scanner([(f"t{k}", "", " ".join(t)) for k, t in enumerate(texts)])
        words = []
        while len(words) < 30:
            t = rng.choice(texts)
            a = rng.randrange(len(t))
            words += t[a : a + rng.randrange(2, 14)] + ["other"] * rng.choice((0, 0, 1, 14))
        matches = scanner.places(words, 0)[1]
        if sum(len(e) for _, _, e in matches) > 24:
            continue
        tried += 1
        best = every_chain(scanner, matches)
        good = {(k, end): n for (k, end), n in best.items() if n >= licences.MIN_COVERAGE * scanner.sizes[k]}
        spans = scanner.chains(matches)
        for first, end, label, coverage in spans:
            k = int(label[1:])
            assert round(coverage * scanner.sizes[k]) == good[k, end]
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
        assert bool(good) == bool(spans)
        if good:
            assert max(good.values()) == max(round(c * scanner.sizes[int(x[1:])]) for _, _, x, c in spans)
        for (k, end), n in good.items():
            assert any(first < end and end - n < last for first, last, _, _ in spans)
    assert tried > 50


def test_whole_texts_as_a_table(spark):
    """A text of 3,000 words with some replaced, dropped and added words is one span; its first tenth is none."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    whole = {label: [rng.choice(names) for _ in range(3000)] for label in ("long-a", "long-b")}
    rows = [(label, "1.0" if label == "long-a" else None, " ".join(w).upper() + ".") for label, w in whole.items()] + [("none", None, " ,. "), (None, None, "x"), ("null", None, None)]
    templates = licences.templates_of(spark.createDataFrame(rows, "label string, version string, text string"))
    assert [(t[0], t[1], len(t[2].split())) for t in templates] == [("long-a", "1.0", 3000), ("long-b", "", 3000)]
    edited = list(whole["long-a"])
    for i in range(100, 2900, 60):
        edited[i] = rng.choice(["other", "", "two words"])
    docs = [(1, "Before " + ", ".join(edited) + " after"), (2, " ".join(whole["long-b"][:300])), (3, " ".join(whole["long-b"]) + " " + "licensed under the MIT license"), (4, None)]
    found = licences.scan_licences(spark.createDataFrame(docs, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit(""))), templates=licences.TEMPLATES + templates)
    spans = {r["doc_id"]: [(s["label"], s["coverage"]) for s in r["lic_spans"]] for r in found.collect()}
    assert [s[0] for s in spans[1]] == ["long-a-1.0"] and spans[1][0][1] > 0.97
    assert spans[2] == [] and spans[3] == [("long-b", 1.0), ("mit", 1.0)] and spans[4] == []


def test_too_many_words_raise(spark):
    with pytest.raises(ValueError):
        licences.templates_of(spark.sql(f"select 'x' label, '' version, repeat('abcdefgh ', {2 * licences.MOST_WORDS}) text"))
