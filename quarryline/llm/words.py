"""Words and word hashes of whole Arrow columns of text, without a Python object per word.

A chunk is a slice of an Arrow column. Its bytes are classified by a 256-entry table, word
borders come from the changes of class, and every word gets a 64-bit hash from prefix sums
of ``T[byte] * B**position``. UTF-8 bytes of 0x80 and above always belong to a word, so both
word classes below are exact on bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BLOCK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text with A-Z lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

_rng = np.random.default_rng(20240229)
_T = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * _BLOCK), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * _BLOCK:
            _powers[kind] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a chunk: byte borders in ``data``, hash of each, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def words(self, i: int, n: int) -> list[bytes]:
        return [self.word(k) for k in range(i, i + n)]


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of the batch whose texts hold about ``most`` bytes (one text may hold more)."""
    at = batch.schema.get_field_index(column)
    _, offsets = _buffers(batch.column(at))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def give_back() -> None:
    """Returns freed memory to the system: a worker waits for its next task, beside others, without it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has it on Linux alone
        ctypes.CDLL(None).malloc_trim(0)


def _buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    is_binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    texts = texts.cast(pa.large_binary() if is_binary else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if is_binary else "")
    _, off, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def raw_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a chunk, and where each begins and the last ends; null is empty."""
    return _buffers(texts)


def borders(texts) -> np.ndarray:
    """Byte offset of each text of a chunk in ``Words.data``."""
    return _buffers(texts)[1]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, which follow each other without overlap."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_T[data[a:b]] * _power("B", _B, b - a)[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * _power("inv", _INV, b - a)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def scan(texts: pa.Array, is_word: np.ndarray, lower: bool = True, hashes: bool = True) -> Words:
    """All words of a chunk of texts; a null text has none."""
    raw, offsets = _buffers(texts)
    data = _LOWER[raw] if lower else raw
    here = is_word[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = here[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = here[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(here & ~before)
    end = np.flatnonzero(here & ~after) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, hash_spans(data, start, end) if hashes else np.zeros(0, np.uint64), first)


_A = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the ``n`` words from each word on; valid where they lie in one text."""
    h = words.hash
    size = len(h)
    out = np.zeros(size, np.uint64)
    for k in range(min(n, size)):
        out[: size - k] += h[k:] * _A[k % 64] ** np.uint64(1 + k // 64)
    count = words.count()
    left = np.repeat(words.first[1:], count) - np.arange(size)
    return mix(out + np.uint64(n)), left >= n


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that ``scan`` gives these words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    return hash_spans(np.frombuffer(b"".join(words), np.uint8), end - size, end)


def hash_window(words: list[bytes]) -> int:
    """The hash that ``windows`` gives these words."""
    h = hash_words(words)
    total = np.zeros(1, np.uint64)
    for k in range(len(h)):
        total += h[k : k + 1] * _A[k % 64] ** np.uint64(1 + k // 64)
    return int(mix(total + np.uint64(len(h)))[0])


def split_words(text: str | None, is_word: np.ndarray, lower: bool = True) -> list[bytes]:
    """Words of one short text, as ``scan`` finds them."""
    w = scan(pa.array([text or ""], pa.large_string()), is_word, lower, hashes=False)
    return w.words(0, len(w.start))


class Members:
    """Which hashes are in a fixed set: a bitmap of 20 bits first, then a search among the sorted."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(np.asarray(hashes, np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.sorted >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of members, and the place of each among the sorted."""
        at = np.flatnonzero(self.bits[h >> np.uint64(44)])
        if not len(self.sorted):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == h[at]
        return at[hit], place[hit]


def distinct_words(w: Words) -> pa.DictionaryArray:
    """The chunk's SOLID words as a dictionary of bytes, exact."""
    offsets = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(w.end - w.start, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(offsets), pa.py_buffer(w.data[SOLID[w.data]])]).dictionary_encode()


class Table:
    """Ids of keys: runs of one growing array."""

    def __init__(self):
        self.row: dict = {}
        self.start, self.count, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 14, np.int32), 0
        self.taken = np.zeros(1024, np.int64)

    def add(self, keys: list, start: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.row)
        while n + len(keys) > len(self.start):
            self.start, self.count, self.taken = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.taken))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[n : n + len(keys)], self.count[n : n + len(keys)] = self.used + start, count
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.row.update(zip(keys, range(n, n + len(keys))))

    def take(self, keys: list, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys (of keys[which]), one after the other, and where each key's begin and the last end."""
        row = np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))
        self.taken[row] += 1
        row = row if which is None else row[which]
        n = self.count[row]
        ends = np.zeros(len(row) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        return self.ids[np.repeat(self.start[row] - ends[:-1], n) + np.arange(int(ends[-1]))], ends

    def repeated(self) -> Table:
        """A new table of the keys that more than one call has taken."""
        keys = [k for k, n in zip(self.row, self.taken.tolist()) if n > 1]
        out, (ids, ends) = Table(), self.take(keys)
        out.add(keys, ends[:-1], np.diff(ends), ids)
        return out
