"""Counts of whole texts, shared by the quality classifier and the quality rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.llm.common import append_columns, long_array
from quarryline.llm.words import SOLID, Members, borders, mix, scan, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_letters", "n_digits", "n_points", "n_lines", "n_distinct"]
REPEAT_WORDS = 5


def _class(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _POINT = _class(b"#*$%&|<>"), _class(range(65, 91)), _class(range(48, 58)), _class(b".,;:!?'\"()-")
_LETTER = _class([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])
_CONTINUES = _class(range(0x80, 0xC0))


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text of a chunk, as int64 arrays.

    Words are ``[^\\x20\\x09-\\x0D]+``; n_dup_lines counts lines with a word that equal an earlier
    line; n_repeat_words counts words inside a 5-word window that stands twice or more in its text.
    """
    w = scan(texts, SOLID, lower=False)
    at, n = borders(texts), w.count()

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    first_byte = ~_CONTINUES[w.data]
    doc = np.repeat(np.arange(len(n)), n)
    own = mix(np.arange(len(n)).astype(np.uint64) + np.uint64(1))[doc]
    _, places = np.unique(w.hash ^ own, return_index=True)
    h, valid = windows(w, REPEAT_WORDS)
    key = h ^ own
    ordered = np.sort(key[valid])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    repeat = np.zeros(len(n), np.int64)
    if len(twice):
        hit, _ = Members(twice).find(key)
        hit = hit[valid[hit]]
        edge = np.zeros(len(key) + 1, np.int32)
        edge[hit] += 1
        np.subtract.at(edge, hit + REPEAT_WORDS, 1)
        repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(n))
    n_lines, dup = [], []
    raw = w.data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
        n_lines.append(len(lines))
        dup.append(len(lines) - len(set(lines)))
    made = [n, total(SOLID[w.data] & first_byte), total(_SYMBOL[w.data]), dup, repeat, total(first_byte), total(_UPPER[w.data]), total(_LETTER[w.data]), total(_DIGIT[w.data]), total(_POINT[w.data]), n_lines, np.bincount(doc[places], minlength=len(n))]
    return dict(zip(COUNTS, [np.asarray(x, np.int64) for x in made]))


def transform(c: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics whose spread does not follow the text's length: a row of FEATURES for each text."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    root = lambda x, y: np.sqrt(x / np.maximum(y, 1))
    return np.column_stack([
        c["word_chars"] / words / 4,
        root(c["n_upper"], c["n_letters"]) * 4,
        root(c["n_symbols"], chars) * 6,
        root(c["n_points"], chars) * 6,
        root(c["n_digits"], chars) * 6,
        root(c["n_dup_lines"], c["n_lines"]) * 4,
        root(c["n_repeat_words"], words) * 4,
        np.log1p(c["n_words"]) / 2,
        np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)),
        np.log((c["n_distinct"] + 1) / (words + 1)) + 0.1 * np.log(words),
    ])


FEATURES = ["word_length", "upper", "symbols", "points", "digits", "dup_lines", "repeats", "length", "line_length", "variety"]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``st_<count>`` for COUNTS and ``st_features`` (array<double>)."""

    def make(chunk):
        c = count_texts(chunk.column(text))
        f = transform(c)
        return [*[long_array(c[k]) for k in COUNTS], pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1]), pa.int32()), pa.array(f.ravel()))]

    return append_columns(docs, make, ", ".join(f"st_{k} long" for k in COUNTS) + ", st_features array<double>", text)
