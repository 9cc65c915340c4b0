"""Byte-level BPE encoding and decoding with padded matrices (operator 11).

A text is cut into pieces by the vocabulary's pattern. A piece that is a token is done; the other
different pieces of a chunk are put, by length, into matrices of token ids, a row for each piece,
padded at the end. In every round each row of a matrix merges its leftmost pair of least rank: the
ranks of neighbours are found in a hash table of all pairs that make a token, the argmin of a row
is its merge, and the matrix loses one column. Rows without a pair that merges leave the matrix.

A piece of more than WIDEST bytes (a long run of letters or spaces) has a matrix of its own and
merges, in a round, the places of its least pair from left to right, up to the first merge that
makes a pair of lower rank: what single merges would do, in as many rounds as there are merges of
different kinds.

Texts are cut into units before each space that follows other characters, where the pattern always
cuts; a worker keeps tables of encoded units and pieces, so that the pattern sees units and the merges
see pieces that are new.
Decoding gathers the tokens' bytes from one array.

Defined results: a null or empty text has no ids and decodes to no bytes; null ids decode to no
bytes; repeated rows get equal results; an empty table gives an empty one; all other columns
pass through, and a column that has the name of a new one is replaced.
"""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import append_columns, long_array, read
from quarryline.llm.words import SOLID, Table, raw_bytes

#: Widths of the padded matrices; longer pieces merge alone.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128)
WIDEST = WIDTHS[-1]
#: Most cells of one matrix.
CELLS = 1 << 20
#: Ids that are decoded at a time: the gather's indexes are larger than the bytes.
DECODED = 1 << 18
#: A worker's table of encoded units is emptied when it holds about so many bytes.
TABLE_BYTES = 64 << 20
#: Its table of encoded pieces is emptied when it holds so many (some 200 bytes each).
TABLE_PIECES = 300_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of every pair of tokens whose bytes together are a token: open addressing, linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(rank) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several at one slot the last stays
            own = self.keys[slot[todo]] == key[todo]
            self.ranks[slot[todo[own]]] = rank[todo[own]]
            todo = todo[~own]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, _NONE for those that make no token; an id below 0 makes none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out, slot = np.full(len(key), _NONE, np.int32), self._slot(key)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            at = slot[todo]
            found = self.keys[at]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (found != -1)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out


class Bpe:
    """Ids of byte strings by a table of ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            size[r] = len(t)
        self.size, self.start = size, np.cumsum(size) - size
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.bytes = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self.units, self.pieces, self.held = Table(), Table(), 0

    # ---- merges
    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each piece merged pair by pair in the order of ranks: where its ids start, how many they are, and all ids."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start, count, pool = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, np.int32)]
        used = 0

        def put(which, n, ids):
            nonlocal used
            count[which] = n
            start[which] = used + np.cumsum(n) - n
            pool.append(ids)
            used += len(ids)

        order = np.argsort(size, kind="stable")
        cut = np.searchsorted(size[order], [0, *WIDTHS], side="right")
        for k, width in enumerate(WIDTHS):
            here = order[cut[k] : cut[k + 1]]
            step = max(1, CELLS // width)
            for i in range(0, len(here), step):
                self._bucket(pieces, here[i : i + step], size, width, put)
        for i in order[cut[-1] :].tolist():
            ids = self._long(pieces[i])
            put([i], np.array([len(ids)]), ids)
        return start, count, np.concatenate(pool)

    def _bucket(self, pieces: list[bytes], here: np.ndarray, size: np.ndarray, width: int, put) -> None:
        flat = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in here.tolist()]), np.uint8)]
        ids = np.full((len(here), width), -1, np.int32)
        ids[np.arange(width) < size[here][:, None]] = flat
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(here), width - 1)
        while len(here):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(here), np.int64)
            best = rank[np.arange(len(here)), at] if rank.shape[1] else np.full(len(here), _NONE)
            done = best == _NONE
            if done.any():
                over = ids[done]
                put(here[done], (over >= 0).sum(1), over[over >= 0])
                go = ~done
                here, ids, rank, at, best = here[go], ids[go], rank[go], at[go], best[go]
            m = len(here)
            if not m:
                return
            rows, width = np.arange(m), ids.shape[1]
            ids[rows, at] = best
            stays = np.ones((m, width), bool)
            stays[rows, at + 1] = False
            ids = ids[stays].reshape(m, width - 1)
            stays = np.ones((m, width - 1), bool)
            stays[rows, at] = False
            rank = rank[stays].reshape(m, width - 2)
            before, after = at > 0, at + 1 < width - 1
            found = self.pairs.find(np.r_[ids[rows[before], at[before] - 1], best[after]], np.r_[best[before], ids[rows[after], at[after] + 1]])
            rank[rows[before], at[before] - 1] = found[: before.sum()]
            rank[rows[after], at[after]] = found[before.sum() :]

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank):
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            # Of places side by side (a a a) every other one merges, from the left.
            new = np.r_[True, np.diff(at) > 1]
            run = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            made = np.full(len(at), best, np.int32)
            # The left neighbour as it stands when this place merges, the right one as it was.
            joined = np.r_[False, at[1:] == at[:-1] + 2]
            left = np.where(joined, best, np.where(at > 0, ids[at - 1], -1))
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = np.flatnonzero((self.pairs.find(left, made) < best) | (self.pairs.find(made, right) < best))
            if len(lower):
                at = at[: lower[0] + 1]
            ids[at] = best
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            place = np.cumsum(stays)[at] - 1
            ids = ids[stays]
            rank = np.r_[rank, _NONE][stays][: len(ids) - 1]  # the rank at a place is that of the pair which begins there
            touched = np.unique(np.r_[place - 1, place])
            touched = touched[(touched >= 0) & (touched < len(rank))]
            rank[touched] = self.pairs.find(ids[touched], ids[touched + 1])
        return ids

    # ---- texts
    def _add(self, units: list[bytes]) -> None:
        """Encodes the units and puts them into the table: pieces by the pattern, then merges of new ones."""
        if len(self.pieces.row) > TABLE_PIECES:
            self.pieces = Table()
        split = [self.pattern.findall(u.decode()) for u in units]
        new = [p for p in dict.fromkeys(itertools.chain.from_iterable(split)) if p not in self.pieces.row]
        raw = [p.encode() for p in new]
        own = np.fromiter((self.ranks.get(b, -1) for b in raw), np.int64, len(raw))
        self.pieces.add([p for p, r in zip(new, own.tolist()) if r >= 0], np.arange((own >= 0).sum()), np.ones((own >= 0).sum(), np.int64), own[own >= 0])
        rest = np.flatnonzero(own < 0).tolist()
        self.pieces.add([new[i] for i in rest], *self.merge([raw[i] for i in rest]))
        made, of_piece = self.pieces.take(list(itertools.chain.from_iterable(split)))
        border = of_piece[np.cumsum([0, *map(len, split)])]
        self.units.add(units, border[:-1], np.diff(border), made)
        self.held += sum(map(len, units)) + 4 * len(made) + 150 * len(units)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; null is empty."""
        data, offsets = raw_bytes(texts)
        start = unit_starts(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, len(data)]), pa.py_buffer(data)]).dictionary_encode()
        each = units.dictionary.to_pylist()
        if self.held > TABLE_BYTES:
            self.units, self.held = Table(), 0
        lacking = [u for u in each if u not in self.units.row]
        if lacking:
            self._add(lacking)
        ids, ends = self.units.take(each, units.indices.to_numpy())
        return ids, np.diff(ends[np.searchsorted(start, offsets)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' tokens, one after the other."""
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.start[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


#: Unicode's white space of two and three bytes in UTF-8.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at the texts' starts, and at each space after something else than white space.

    There the pattern always cuts: a piece that holds a space and what stands before it holds white space alone.
    """
    at = np.flatnonzero(data == 32)
    at = at[(at > 0)]
    at = at[SOLID[data[at - 1]]]
    value = data[at - 1].astype(np.int64)
    high = np.flatnonzero(value >= 128)
    near = at[high]
    two = value[high] | data[near - 2].astype(np.int64) << 8
    three = two | np.where(near > 2, data[near - 3], 0).astype(np.int64) << 16
    wide = np.isin(two, [int.from_bytes(b) for b in _WIDE_SPACES if len(b) == 2]) | np.isin(three, [int.from_bytes(b) for b in _WIDE_SPACES if len(b) == 3])
    begins = np.zeros(len(data), bool)
    begins[at] = True
    begins[near[wide]] = False
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begins)


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines: a token in base64, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(2)
def _bpe(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def with_token_ids(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ``token_ids`` (binary: unsigned 32-bit, little-endian) and ``n_tokens``.

    ``ranks`` is the path of a file of ranks on every machine.
    """

    def make(chunk):
        ids, n = _bpe(ranks, pattern).encode(chunk.column(text))
        return [_binary(ids.astype("<u4").view(np.uint8), 4 * n), long_array(n)]

    return append_columns(docs, make, "token_ids binary, n_tokens long", text)


def with_decoded(encoded: DataFrame, ranks: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """The rows with ``decoded``, the bytes of the tokens of ``ids``."""

    def make(chunk):
        bpe, out, n = _bpe(ranks, pattern), [], []
        for raw in chunk.column(ids).to_pylist():
            own = np.frombuffer(raw or b"", "<u4").astype(np.int64)
            made = [bpe.decode(own[i : i + DECODED]) for i in range(0, len(own), DECODED)]
            out += made
            n.append(sum(map(len, made)))
        return [_binary(np.concatenate(out) if out else np.zeros(0, np.uint8), np.array(n, np.int64))]

    return append_columns(encoded, make, "decoded binary", ids)


def _binary(data: np.ndarray, n: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    raw = data.tobytes()  # one row alone is as long: it fails in any column of bytes
    return pa.array([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text of ``documents``, decodes the ids, and returns the digests of both."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = with_token_ids(read(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary).drop("text")
    return with_decoded(ids, *vocabulary).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
