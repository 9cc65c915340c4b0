"""Periodic runs of words, found by recursive frequency splitting and a lag scan (operator 12).

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, 2 q) words
that no neighbouring word extends keeping the period. Every word of a run stands in it twice or
more, so a word that stands once in a segment of text is in none of the segment's runs: it splits
the segment. Counts fall in the smaller parts, which are split again, until no part changes; parts
of fewer than LEAST words are given up. Prose is used up by this; what survives is scanned by lags.

The lags below 2**DIRECT are compared at every place. For a lag q from 2**k on, a run has q places in a
row or more at which words q apart are equal, so it holds one of the blocks of 2**(k-1) words that
begin at multiples of that length, and the same block again q words on. Such blocks are found among
the classes of equal stretches of 2**(k-1) words (built by doubling, exact, without hashes); from each,
the stretch is extended to both sides by comparing classes of ever shorter stretches. Of lags that
give the same stretch, the smallest is its period. Work grows as n log(n)**2 with a text's words in
the worst case (one word repeated), memory as n log(n).

The words of a whole chunk of texts are split and scanned together: texts are kept apart by borders
that equal nothing.

Defined results: a null, empty or blank text has no runs; repeated rows get equal results; an empty
table gives an empty one; other columns pass through, and a column that has the name of a new one is
replaced. A null doc_id (in the query) plants nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import append_columns, long_array, read
from quarryline.llm.words import SOLID, distinct_words, scan

#: Fewest words of a run.
LEAST = 12
#: Lags below this power of two are compared at every place.
DIRECT = 4
#: Rounds of splitting; parts that still change (one word a round, in made-up texts) go to the scan as they are.
ROUNDS = 256
#: Most pairs of equal blocks that are extended at a time.
PAIRS = 1 << 18
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split_rare(word: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(begin, end) of the parts that are left, rows in order: ``word`` has ids, ``first`` the texts' first words."""
    parts = np.column_stack([first[:-1], first[1:]])
    parts, settled = parts[parts[:, 1] - parts[:, 0] >= least], []
    for _ in range(ROUNDS):
        if not len(parts):
            break
        size = parts[:, 1] - parts[:, 0]
        ends = np.cumsum(size)
        which = np.repeat(np.arange(len(parts)), size)
        at = np.repeat(parts[:, 0] - (ends - size), size) + np.arange(ends[-1])
        key = which * np.int64(word.max() + 1) + word[at]
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[place] > 1
        same = np.logical_and.reduceat(often, ends - size)
        settled.append(parts[same])
        edge = np.flatnonzero(np.diff(np.r_[-2, which[often]]) | (np.diff(np.r_[-2, at[often]]) != 1))
        kept = at[often]
        parts = np.column_stack([kept[edge], kept[np.r_[edge[1:], len(kept)] - 1] + 1]) if len(kept) else parts[:0]
        whole = np.isin(parts[:, 0], settled[-1][:, 0])  # parts without a change
        parts = parts[~whole & (parts[:, 1] - parts[:, 0] >= least)]
    settled.append(parts)
    out = np.concatenate(settled)
    return out[np.argsort(out[:, 0], kind="stable")]


def _classes(word: np.ndarray, longest: int) -> list[np.ndarray]:
    """Level k: the class of the 2**k words from each place on."""
    out = [word]
    while 2 ** len(out) <= longest:
        half, own = 2 ** (len(out) - 1), out[-1]
        if len(own) <= half:
            break
        key = own[:-half].astype(np.int64) * np.int64(int(own.max()) + 1) + own[half:]
        out.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
    return out


def _extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from i and j on, or before them; at most 2**len(levels) - 1."""
    n = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        own, step = levels[k], 2**k
        while True:  # the longest level may fit several times
            a, b = (i - n - step, j - n - step) if back else (i + n, j + n)
            fits = (a >= 0) & (b < len(own))
            ok = np.zeros(len(i), bool)
            ok[fits] = own[a[fits]] == own[b[fits]]
            n[ok] += step
            if k + 1 < len(levels) or not ok.any():
                break
    return n


def _lag_pairs(own: np.ndarray, block: int, low: int, high: int, last: int):
    """Places a (multiples of block, up to ``last``) and lags q in [low, high) with the same class at a and a + q.

    Of blocks side by side that agree at one lag, the first alone.
    """
    order = np.argsort(own, kind="stable")
    rank = own[order].astype(np.int64) * (len(own) + high + 1) + order  # sorted: classes, then places
    for begin in range(0, last, PAIRS):
        a = np.arange(begin, min(begin + PAIRS, last), block)
        base = own[a].astype(np.int64) * (len(own) + high + 1) + a
        lo, hi = np.searchsorted(rank, base + low), np.searchsorted(rank, base + high)
        some = hi > lo
        a, lo, n = a[some], lo[some], (hi - lo)[some]
        ends = np.cumsum(n)
        cut = 0
        while cut < len(a):
            stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS, side="right")))
            m, e = n[cut:stop], np.cumsum(n[cut:stop])
            b = order[np.repeat(lo[cut:stop] - (e - m), m) + np.arange(e[-1])]
            x = np.repeat(a[cut:stop], m)
            new = (x < block) | (own[np.maximum(x - block, 0)] != own[np.maximum(b - block, 0)])
            yield x[new], (b - x)[new]
            cut = stop


def find_runs(word: np.ndarray, least: int = LEAST, most: int | None = None) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of ids, by start, then period; none has more than ``most`` words."""
    most, found = min(len(word), most or len(word)), []
    longest = most // 2
    top = max(least, 1)
    for q in range(1, min(2**DIRECT - 1, longest) + 1):
        same = word[:-q] == word[q:]
        step = np.flatnonzero(np.diff(np.r_[False, same, False])).reshape(-1, 2)
        found.append(np.column_stack([step[:, 0], step[:, 1] + q, np.full(len(step), q)])[step[:, 1] - step[:, 0] + q >= max(top, 2 * q)])
    if longest >= 2**DIRECT:
        levels = _classes(word, most)
        for k in range(DIRECT, longest.bit_length()):
            block = 2 ** (k - 1)
            own = levels[k - 1]
            for a, q in _lag_pairs(own, block, 2**k, 2 ** (k + 1), len(own)):
                s = a - _extend(levels, a, a + q, True)
                e = a + q + _extend(levels, a, a + q, False)
                ok = e - s >= np.maximum(top, 2 * q)
                found.append(np.column_stack([s, e, q])[ok])
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.r_[True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)] if len(runs) else np.zeros(0, bool)
    runs = runs[first]  # the same stretch at a multiple of its period
    runs[:, 1] -= runs[:, 0]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(word: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(text, start, length, period) of the runs of all texts of a chunk."""
    none = np.zeros((0, 4), np.int64)
    if not len(word):
        return none
    parts = split_rare(word, first, least)
    if not len(parts):
        return none
    size = parts[:, 1] - parts[:, 0]
    begin = np.cumsum(size + 1) - size - 1  # a border after every part
    joined = np.full(int(begin[-1] + size[-1] + 1), -1, np.int64)
    joined[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = word[np.repeat(parts[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    border = np.flatnonzero(joined < 0)
    joined[border] = int(word.max()) + 1 + np.arange(len(border))
    found = []
    # Parts of like length are scanned together, so that a long one does not lengthen the others' scan.
    scale = np.ceil(np.log2(size)).astype(int)
    for k in np.unique(scale):
        own = np.flatnonzero(scale == k)
        at = np.concatenate([np.arange(begin[p], begin[p] + size[p] + 1) for p in own.tolist()])
        runs = find_runs(np.unique(joined[at], return_inverse=True)[1].astype(np.int32), least, int(size[own].max()))
        if len(runs):
            here = at[runs[:, 0]]
            part = np.searchsorted(begin, here, side="right") - 1
            start = here - begin[part] + parts[part, 0]
            text = np.searchsorted(first, start, side="right") - 1
            found.append(np.column_stack([text, start - first[text], runs[:, 1], runs[:, 2]]))
    out = np.concatenate(found) if found else none
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def find_periods(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with ``run_list`` (start, length, period; by start, then period), ``run_n_words`` and
    ``collapsed``: the text's words but those that stand in a run after its first period, one space apart."""

    def make(chunk):
        w = scan(chunk.column(text), SOLID, lower=False, hashes=False)
        word = distinct_words(w).indices.to_numpy()
        runs = runs_of_texts(word, w.first, least)
        edge = np.zeros(len(word) + 1, np.int64)
        begin = w.first[runs[:, 0]] + runs[:, 1]
        np.add.at(edge, begin + runs[:, 3], 1)
        np.add.at(edge, begin + runs[:, 2], -1)
        keep = np.cumsum(edge[:-1]) == 0
        # The bytes of kept words, each followed by a space that takes the place of what followed it.
        size = (w.end - w.start)[keep] + 1
        ends = np.cumsum(size)
        out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        fill = np.ones(len(out), bool)
        fill[ends - 1] = False
        inside = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(inside, w.start[keep], 1)
        np.add.at(inside, w.end[keep], -1)
        out[fill] = w.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        border = np.r_[0, ends][np.r_[0, np.cumsum(keep)][w.first]]
        some = np.diff(border) > 0
        raw = out.tobytes()
        collapsed = [raw[a : b - 1] if c else b"" for a, b, c in zip(border[:-1].tolist(), border[1:].tolist(), some.tolist())]
        per_text = np.searchsorted(runs[:, 0], np.arange(len(w.first)))
        lists = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN)))
        return [lists, long_array(w.count()), pa.array(collapsed, pa.binary()).cast(pa.string())]

    return append_columns(docs, make, "run_list array<struct<start: long, length: long, period: long>>, run_n_words long, collapsed string", text)


def planted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The query's texts: in every tenth document by the digest of doc_id, the words from a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    hot = docs.withColumns({"_h": h, "_words": F.when(h % 10 == 0, words)}).withColumns({"_g": F.floor(F.col("_h") / 10), "_n": F.size("_words")})
    some = F.col("_n") > 0
    hot = hot.withColumn("_a", F.when(some, (F.col("_g") % F.col("_n")).cast("int")))
    hot = hot.withColumn("_p", F.when(some, (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")))
    again = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), again), F.lit(1), F.col("_n")), " ")
    return hot.withColumn(text, F.when(some, made).otherwise(F.col(text))).select(*docs.columns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = find_periods(planted(read(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    best = F.get(F.array_sort(F.transform("run_list", lambda r: F.struct((-r["length"]).alias("longest"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    lines = F.array_join(F.transform("run_list", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("run_list").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
