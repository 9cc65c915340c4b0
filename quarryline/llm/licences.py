"""Licence scan with a generalised suffix automaton of licence words (operator 2).

The words of all templates and base phrases build one automaton. A text is streamed through it:
at every word the longest suffix that occurs in some template is known (matching statistics).
Maximal matches are chained, template by template, into covered spans; a template whose words are
covered to ``MIN_COVERAGE`` gives its label, with its version only where the version's words are
covered too. Only runs of words whose neighbours are neighbours in
some template are streamed: elsewhere every match is shorter than two words, and no phrase is.

Defined results: a null or empty text has no words, no places and score 0; repeated rows get equal
results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import append_columns, long_array, read
from quarryline.llm.words import ALNUM, Members, hash_window, hash_words, scan, windows

#: Base phrases and their labels: each place where the words stand consecutively counts.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}



def _spelled(kind: str, apart: bool) -> list[str]:
    """The words of a Creative Commons kind beyond attribution, each in one word or in two."""
    names = {"sa": "!share alike", "nc": "!non commercial", "nd": "!no derivatives"}
    words = [names[k] for k in kind.split("-") if k != "by"]
    return words if apart else [w.replace(" ", "") for w in words]


#: Public licence texts and notices: label without a version, version, words. A chain that leaves out a
#: word marked ``!`` gives no label; one that leaves out a word marked ``*`` gives the label without the version.
TEMPLATES = [
    ("mit", "", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "", "licensed under the !mit license"),
    ("apache", "2.0", "licensed under the !apache license version *2 *0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "2.0", "licensed under the !apache license version *2 *0"),
    ("bsd", "", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("gpl", "2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu !general public license as published by the free software foundation either version *2 of the license or at your option any later version"),
    ("gpl", "3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu !general public license as published by the free software foundation either version *3 of the license or at your option any later version"),
    ("lgpl", "2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu !lesser general public license as published by the free software foundation either version *2 *1 of the license or at your option any later version"),
    ("agpl", "3.0", "you can redistribute it and or modify it under the terms of the gnu !affero general public license as published by the free software foundation either version *3 of the license or at your option any later version"),
    ("gpl", "2.0", "licensed under the gnu !general public license version *2"),
    ("gpl", "3.0", "licensed under the gnu !general public license version *3"),
    ("lgpl", "3.0", "licensed under the gnu !lesser general public license version *3"),
    ("mpl", "2.0", "this source code form is subject to the terms of the !mozilla public license v *2 *0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "2.0", "!mozilla public license version *2 *0"),
    ("isc", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    *[
        (f"cc-{kind}", version, f"licensed under cc {' '.join('!' + k if k != 'by' else k for k in kind.split('-'))} *{version[0]} *{version[2]}")
        for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
        for version in ("2.0", "2.5", "3.0", "4.0")
    ],
    *[
        (f"cc-{kind}", version, " ".join(["licensed under a creative commons attribution", *_spelled(kind, apart), f"*{version[0]} *{version[2]}", "international" if version == "4.0" else "unported", "license"]))
        for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
        for apart in ((False, True) if kind != "by" else (False,))
        for version in ("2.0", "2.5", "3.0", "4.0")
    ],
    *[
        (label, version, f"spdx license identifier {words}")
        for label, version, words in (
            ("mit", "", "!mit"), ("isc", "", "!isc"), ("zlib", "", "!zlib"), ("unlicense", "", "!unlicense"),
            ("apache", "2.0", "!apache *2 *0"), ("bsd", "", "!bsd 2 clause"), ("bsd", "", "!bsd 3 clause"), ("mpl", "2.0", "!mpl *2 *0"),
            ("gpl", "2.0", "!gpl *2 *0"), ("gpl", "3.0", "!gpl *3 *0"), ("lgpl", "2.1", "!lgpl *2 *1"), ("lgpl", "3.0", "!lgpl *3 *0"),
            ("agpl", "3.0", "!agpl *3 *0"), ("cc0", "1.0", "!cc0 *1 *0"),
        )
    ],
    *[
        (f"cc-{kind}", version, f"spdx license identifier cc {' '.join('!' + k if k != 'by' else k for k in kind.split('-'))} *{version[0]} *{version[2]}")
        for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
        for version in ("2.0", "2.5", "3.0", "4.0")
    ],
    ("cc0", "1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "", "this is free and unencumbered software released into the public domain"),
]

#: Shortest match, in words, that a chain takes up, and in templates of more than LONG words; most words
#: between two matches of a chain; share of a template's words that a chain covers for its label.
MIN_MATCH, LONG_MATCH, LONG, MAX_GAP, MIN_COVERAGE = 2, 4, 20, 12, 0.6


#: Most words of the texts that one automaton is built of: every Python worker holds it.
MOST_WORDS = 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; states know where their strings end."""

    def __init__(self, texts: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]

        def state(length, nexts, link):
            self.next.append(nexts)
            self.length.append(length)
            self.link.append(link)
            ends.append(set())
            return len(self.next) - 1

        def clone_for(p, q, word):
            copy = state(self.length[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = copy
            while p != -1 and self.next[p].get(word) == q:
                self.next[p][word] = copy
                p = self.link[p]
            return copy

        for k, text in enumerate(texts):
            last = 0
            for i, word in enumerate(text):
                if word in self.next[last]:
                    q = self.next[last][word]
                    last = q if self.length[q] == self.length[last] + 1 else clone_for(last, q, word)
                else:
                    new, p = state(self.length[last] + 1, {}, 0), last
                    while p != -1 and word not in self.next[p]:
                        self.next[p][word] = new
                        p = self.link[p]
                    if p != -1:
                        q = self.next[p][word]
                        self.link[new] = q if self.length[q] == self.length[p] + 1 else clone_for(p, q, word)
                    last = new
                ends[last].add((k, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        #: For each state, the (text, end) pairs of its strings.
        self.ends = [sorted(e) for e in ends]

    def walk(self, words):
        """(state, matched words) after each word: the longest suffix that occurs in some text."""
        s, n = 0, 0
        for word in words:
            while s and word not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if word in self.next[s]:
                s, n = self.next[s][word], n + 1
            yield s, n

    def find(self, words: list[str]) -> int:
        s = 0
        for word in words:
            s = self.next[s][word]
        return s


class Scanner:
    def __init__(self, templates=None):
        self.templates = TEMPLATES if templates is None else templates
        phrases = [p.split() for p in BASE]
        marked = [t.split() for _, _, t in self.templates]
        texts = [[w.lstrip("!*") for w in t] for t in marked] + phrases
        self.automaton = a = SuffixAutomaton(texts)
        self.sizes = [len(t) for t in marked]
        #: Places that a label needs, and that its version needs besides.
        self.needed = [[frozenset(i for i, w in enumerate(t) if w[0] == sign) for sign in "!*"] for t in marked]
        self.marks = [sorted(always | version) for always, version in self.needed]
        self.least = [LONG_MATCH if len(t) > LONG else MIN_MATCH for t in marked]
        pairs = {tuple(t[i : i + 2]) for t in texts for i in range(len(t) - 1)}
        self.pairs = Members([hash_window([x.encode() for x in p]) for p in pairs])
        words = sorted({w for t in texts for w in t})
        self.names = dict(zip(hash_words([w.encode() for w in words]).tolist(), words))
        home = {}
        for p, label in zip(phrases, BASE.values()):
            home.setdefault(a.find(p), []).append((len(p), label))
        #: For each state, the base phrases that end its strings, as (words, label).
        self.base: list[list[tuple[int, str]]] = []
        for s in range(len(a.next)):
            found, t = [], s
            while t > 0:
                found += home.get(t, [])
                t = a.link[t]
            self.base.append(found)

    def places(self, words: list[str], at: int):
        """Of one run of words that begins at word ``at``: base places, and maximal matches in each template.

        A match is (first word, words, its (template, end) pairs): it is maximal in these templates, as the
        text's next word goes on in none of them.
        """
        base, matches, s, n, i = [], [], 0, 0, 0
        ends = self.automaton.ends
        for i, (t, m) in enumerate(self.automaton.walk(words)):
            if n >= MIN_MATCH:
                if m <= n:
                    matches.append((at + i - n, n, ends[s]))
                elif len(ends[t]) < len(ends[s]):
                    go_on = set(ends[t])
                    matches.append((at + i - n, n, [(k, end) for k, end in ends[s] if (k, end + 1) not in go_on]))
            base += [(at + i + 1 - size, label) for size, label in self.base[t] if size <= m]
            s, n = t, m
        if n >= MIN_MATCH:
            matches.append((at + i + 1 - n, n, ends[s]))
        return base, matches

    def _label(self, k: int, covered: frozenset) -> str | None:
        family, version, _ = self.templates[k]
        always, for_version = self.needed[k]
        if not always <= covered:
            return None
        return f"{family}-{version}" if version and for_version <= covered else family

    def chains(self, matches: list[tuple[int, int, list]]) -> list[tuple[int, int, str, float]]:
        """Covered spans (first word, end, label, coverage) from the matches of one text, in order.

        A chain of a template takes up matches in the order of both the text and the template. Of
        overlapping chains the one with more words stays, then the one with fewer words between its matches,
        then the one that covers more of its template, then the one with a version.
        """
        best = []  # words matched, words between matches, coverage, has a version, first word, end, label
        recent = []  # template, its end, end in text, matched, first word, marked places covered
        for start, size, ends in matches:
            recent = [r for r in recent if start - r[2] <= MAX_GAP]
            new = []
            for k, end in ends:
                if k >= len(self.sizes) or size < self.least[k]:
                    continue
                own = frozenset(i for i in self.marks[k] if end - size <= i < end)
                matched, first, covered = size, start, own
                for rk, rend, rtext, rmatched, rfirst, rcovered in recent:
                    if rk == k and rend <= end - size and rtext <= start and rmatched + size > matched:
                        matched, first, covered = rmatched + size, rfirst, rcovered | own
                new.append((k, end, start + size, matched, first, covered))
            recent += new
            for k, _, end, matched, first, covered in new:
                label = self._label(k, covered) if matched >= MIN_COVERAGE * self.sizes[k] else None
                if label:
                    best.append((matched, end - first - matched, matched / self.sizes[k], label != self.templates[k][0], first, end, label))
        taken: list[tuple[int, int]] = []
        spans = []
        for _, _, coverage, _, first, end, label in sorted(best, key=lambda b: (-b[0], b[1], -b[2], not b[3], b[4], b[6])):
            i = bisect.bisect_left(taken, (first, end))
            if (i == 0 or taken[i - 1][1] <= first) and (i == len(taken) or taken[i][0] >= end):
                taken.insert(i, (first, end))
                spans.append((first, end, label, coverage))
        return sorted(spans)


@functools.lru_cache(2)
def _scanner(templates: tuple | None = None) -> Scanner:
    return Scanner(templates)


def templates_of(texts: DataFrame) -> list[tuple[str, str, str]]:
    """Templates from a table of whole licence texts (label, version, text), one row each; null versions are none.

    Words are lower-cased and cut as in documents; texts without words are left out. The table is the list of
    licences, so its size does not follow the corpus: more than MOST_WORDS words raise an error.
    """
    rows = texts.select("label", F.coalesce("version", F.lit("")).alias("version"), "text").where("label is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if total > 16 * MOST_WORDS:
        raise ValueError(f"{total} characters of licence texts; at most {16 * MOST_WORDS} make one automaton")
    cut = ((r["label"], r["version"], " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].translate(_LOWER)))) for r in rows.orderBy("label", "version", "text").collect())
    return [t for t in cut if t[2]]


def scan_licences(docs: DataFrame, text: str = "text", templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """docs with ``lic_words``, ``lic_base`` (array of start, label) and ``lic_spans`` (array of start, end, label, coverage).

    ``templates`` (label, version, words) take the place of TEMPLATES; ``TEMPLATES + templates_of(texts)`` adds whole texts.
    """
    chosen = None if templates is None else tuple(templates)

    def make(chunk):
        scanner, w = _scanner(chosen), scan(chunk.column(text), ALNUM)
        count = w.count()
        h, valid = windows(w, 2)
        at, _ = scanner.pairs.find(h)
        at = at[valid[at]]
        cut = np.flatnonzero(np.diff(at) != 1) + 1
        found: dict[int, tuple[list, list]] = {}
        for a, b in zip(at[np.r_[0, cut]].tolist() if len(at) else [], at[np.r_[cut - 1, len(at) - 1]].tolist() if len(at) else []):
            doc = int(np.searchsorted(w.first, a, side="right")) - 1
            base, matches = scanner.places([scanner.names[x] for x in w.hash[a : b + 2].tolist()], a - int(w.first[doc]))
            own = found.setdefault(doc, ([], []))
            own[0].extend(base)
            own[1].extend(matches)
        base_rows, span_rows = [], []
        for k in range(len(count)):
            base, matches = found.get(k, ((), ()))
            base_rows.append([{"start": s, "label": x} for s, x in sorted(base)])
            span_rows.append([{"start": a, "end": b, "label": x, "coverage": c} for a, b, x, c in (scanner.chains(matches) if matches else ())])
        long, text_, double = pa.int64(), pa.string(), pa.float64()
        return [long_array(count), pa.array(base_rows, pa.list_(pa.struct([("start", long), ("label", text_)]))), pa.array(span_rows, pa.list_(pa.struct([("start", long), ("end", long), ("label", text_), ("coverage", double)])))]

    return append_columns(docs, make, "lic_words long, lic_base array<struct<start: long, label: string>>, lic_spans array<struct<start: long, end: long, label: string, coverage: double>>", text)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base places, labels of base phrases and covered templates, and a score.

    The score is what the largest coverage of a template leaves open, cut to a tenth by each base place, from 1.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = scan_licences(docs)
    base, spans = F.col("lic_base"), F.col("lic_spans")
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    return found.select(
        "doc_id",
        F.col("lic_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        labels(base["label"]).alias("base_labels"),
        labels(base["label"], spans["label"]).alias("labels"),
        (1 - (1 - F.coalesce(F.array_max(spans["coverage"]), F.lit(0.0))) * F.pow(F.lit(0.1), F.size(base))).alias("score"),
    )
