"""Token ids as directly addressable codes (operator 1).

Texts are encoded with a public tokenizer and written, in ascending doc_id order, as segments.
A segment holds the ids of whole documents as directly addressable codes: every id is cut into
chunks of ``chunk_bits`` bits; level 0 has the lowest chunk of every id, level k the next chunk
of those that need it. A bitmap at each level marks the ids that continue, and a rank directory
(ones before every 256th bit) leads from an id's place at one level to its place at the next, so
that any token is read from a few bytes of its segment, without decoding what stands before it.

Segments are rows of an uncompressed Parquet table (``part``, ``seq``, ``start_in_part``,
``total``, ``doc_ids``, ``n_tokens``, ``payload``): Spark's committer then keeps the file whole
when tasks are retried, on whatever store the path names. The index columns can be read without
the payload. Payload layout (little-endian): ``DAC1``, u16 chunk bits, u16 levels, u64 number of
ids at each level; then for each level its chunks, and for all but the last level its bitmap
(whole 32-byte blocks) and its u32 rank directory.

Defined results: a null text is empty (only the end id); a null doc_id comes first; equal doc_ids
keep one row each, side by side; a text of any length is encoded whole, in one piece of memory, and
may fill a segment of its own; an empty table gives an empty file; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import bound_batches, join_groups, materialise, read, scratch
from quarryline.llm.words import SOLID, Table, distinct_words, give_back, scan, text_chunks

#: A segment is closed at the first document end at or after this many ids.
SEGMENT_TOKENS = 1 << 18
#: Entries of a worker's table of encoded pieces (some 200 bytes each) at which it is reduced to those met again.
CACHE_WORDS = 800_000
#: Pieces that the library encodes in one call: each of its results takes more memory than the ids.
PIECES = 2_000
#: Bytes of text whose different pieces are looked up together.
ENCODED_BYTES = 4 << 20
_BLOCK_BITS = 256
_DTYPE = {8: np.uint8, 16: np.uint16}
SEGMENTS = "part int, seq int, start_in_part long, total long, doc_ids array<long>, n_tokens array<long>, payload binary"


def encode_dac(ids: np.ndarray, chunk_bits: int = 8) -> bytes:
    """Directly addressable codes of unsigned ids below 2**32."""
    if chunk_bits not in _DTYPE:
        raise ValueError("chunk_bits is 8 or 16")
    left, sizes, body = np.asarray(ids, np.uint32), [], []
    while True:
        more = left >> np.uint32(chunk_bits)
        sizes.append(len(left))
        body.append((left & np.uint32((1 << chunk_bits) - 1)).astype(_DTYPE[chunk_bits]).tobytes())
        on = more > 0
        if not on.any():
            break
        bits = np.zeros(-(-len(left) // _BLOCK_BITS) * _BLOCK_BITS, bool)
        bits[: len(left)] = on
        per_block = bits.reshape(-1, _BLOCK_BITS).sum(1)
        body += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(per_block) - per_block).astype("<u4").tobytes()]
        left = more[on]
    return b"DAC1" + struct.pack(f"<HH{len(sizes)}Q", chunk_bits, len(sizes), *sizes) + b"".join(body)


class Dac:
    """Reads codes in place: ``dac[i]`` is one id, ``dac.slice(a, b)`` a run of them."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        self.bits, levels = struct.unpack_from("<HH", payload, 4)
        self.sizes = struct.unpack_from(f"<{levels}Q", payload, 8)
        at, self.levels = 8 + 8 * levels, []
        for k, n in enumerate(self.sizes):
            chunks = np.frombuffer(payload, _DTYPE[self.bits], n, at)
            at += chunks.nbytes
            bitmap = ranks = None
            if k + 1 < levels:
                blocks = -(-n // _BLOCK_BITS)
                bitmap = np.frombuffer(payload, np.uint8, blocks * _BLOCK_BITS // 8, at)
                ranks = np.frombuffer(payload, "<u4", blocks, at + bitmap.nbytes)
                at += bitmap.nbytes + ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.sizes[0]

    def _rank(self, k: int, i: int) -> int:
        _, bitmap, ranks = self.levels[k]
        if i >= len(ranks) * _BLOCK_BITS:
            return self.sizes[k + 1]
        block, rest = divmod(i, _BLOCK_BITS)
        word = int.from_bytes(bitmap[block * 32 : block * 32 + 32].tobytes(), "little")
        return int(ranks[block]) + (word & ((1 << rest) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (k * self.bits)
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        out, place = np.zeros(b - a, np.uint32), np.arange(b - a)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            out[place] |= chunks[a:b].astype(np.uint32) << np.uint32(k * self.bits)
            if bitmap is None:
                break
            on = np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            place, a, b = place[on], self._rank(k, a), self._rank(k, b)
        return out


class Encoder:
    """Whole-text ids by a tokenizer of the tokenizers library, with a table of encoded words.

    Where the tokenizer drops white space, ends words by a suffix and keeps runs of letters apart
    from other characters, the ids of a text are those of its lower-cased pieces between ASCII white
    space. Those of a piece of letters and final punctuation are the ids of the letters, then of the
    punctuation, if the letters are still letters alone when the normalizer has made them lower-case
    and composed: a mark would join the punctuation. Other pieces go to the library whole, and so does
    all that the table lacks. Any other tokenizer gets the texts as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads take memory each
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.suffix = spec["model"].get("end_of_word_suffix")
        lower = any(x["type"] == "Lowercase" for x in (spec["normalizer"] or {}).get("normalizers", []))
        self.by_word = bool(self.suffix) and split.get("invert") is True and r"[\p{L}]+" in (split.get("pattern") or {}).get("Regex", "") and lower
        self.words: dict[bytes, bytes] = {}
        self.table, self.cached = Table(), CACHE_WORDS
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            #: Whether lower-case ASCII letters reach the model as they are, so that it can be asked directly.
            sample = ["abcdefghijklm", "nopqrstuvwxyz", "tokenization"]
            self.plain = sys.byteorder == "little" and [[t.id for t in self.tokenizer.model.tokenize(w)] for w in sample] == self._encode(sample)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(self.suffix)]] = True

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> None:
        """Fills the cache with lower-case words of letters: by the library's model, or many to a text, where word ends show in the ids."""
        if self.plain:
            tokenize = self.tokenizer.model.tokenize
            for w in words:
                if w.isascii():
                    self.words[w.encode()] = array("I", [t.id for t in tokenize(w)]).tobytes()
            words = [w for w in words if not w.isascii()]
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self._encode([" ".join(part)])[0], "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):  # a word that the normalizer takes apart
                for w, x in zip(part, self._encode(part)):
                    self.words[w.encode()] = np.array(x, "<u4").tobytes()
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, (cut * 4).tolist()):
                self.words[w.encode()] = raw[at:end]
                at = end

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of different pieces, as little-endian bytes."""
        self.words = {}
        letters, rest, made, known = set(), set(), [], self.table
        for piece in pieces:
            core = piece.rstrip(b".,;:!?|")
            if (core.isalpha() if core.isascii() else self._are_letters(core.decode())):
                tail = piece[len(core) :]
                if tail:
                    made.append((piece, core, tail))
                    rest.add(tail)
                if core not in known.row:
                    letters.add(core)
                elif core not in self.words:
                    at = known.row[core]
                    self.words[core] = known.ids[known.start[at] : known.start[at] + known.count[at]].tobytes()
            else:
                rest.add(piece)
        self._letters([x.decode() for x in sorted(letters)])
        whole = sorted(rest)
        for i in range(0, len(whole), PIECES):
            part = whole[i : i + PIECES]
            for x, ids in zip(part, self._encode([x.decode() for x in part])):
                self.words[x] = np.array(ids, "<u4").tobytes()
        for piece, core, tail in made:
            self.words[piece] = self.words[core] + self.words[tail]
        return self.words

    def _are_letters(self, text: str) -> bool:
        """Whether a piece is one run of letters to the library: also after the normalizer, which may make marks of letters."""
        return text.isalpha() and (text.isascii() or self.tokenizer.normalizer.normalize_str(text).isalpha())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; null is empty."""
        if not self.by_word:
            every = self._encode([t or "" for t in texts.to_pylist()])
            return np.array([i for ids in every for i in ids], "<u4"), np.array([len(ids) for ids in every], np.int64)
        w = scan(texts, SOLID, hashes=False)
        pieces = distinct_words(w)
        each = pieces.dictionary.to_pylist()
        if len(self.table.row) > self.cached:
            self.table = self.table.repeated()
            if len(self.table.row) > self.cached // 2:
                self.table = Table()
        if lacking := [p for p in each if p not in self.table.row]:
            made = self._learn(lacking)
            # The letters of pieces with punctuation are kept too: they come with other punctuation.
            new = [p for p in made if p not in self.table.row]
            raw = [made[p] for p in new]
            count = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            self.table.add(new, np.cumsum(count) - count, count, np.frombuffer(b"".join(raw), "<i4"))
        values, ends = self.table.take(each, pieces.indices.to_numpy())
        return values.view("<u4"), np.diff(ends[w.first])


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, chunk_bits: int = 8, segment_tokens: int = SEGMENT_TOKENS, cached: int = CACHE_WORDS) -> None:
    """Encodes ``text`` of every row and writes the segments to path in ascending doc_id order.

    ``tokenizer`` is the path of a file for the tokenizers library on every machine. ``cached`` bounds
    each worker's table of encoded pieces between chunks: fewer take less memory and more time, and give the same ids.
    """
    bound_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The text's hash orders rows of one doc_id and lets a range end among them.
    ordered = ordered.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches):
        from pyspark import TaskContext

        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        encoder.cached = cached
        seq = before = held = 0
        doc_ids, sizes, ids = [], [], []

        def segment():
            values = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([encode_dac(values, chunk_bits)], pa.binary())],
                ["part", "seq", "start_in_part", "total", "doc_ids", "n_tokens", "payload"],
            )

        for batch in batches:
            for chunk in text_chunks(batch, most=ENCODED_BYTES):
                values, count = encoder.encode(chunk.column(1))
                give_back()
                if end_id is not None:
                    values, count = np.insert(values, np.cumsum(count), end_id), count + 1
                at = 0
                for doc_id, n in zip(chunk.column(0).to_pylist(), count.tolist()):
                    doc_ids.append(doc_id)
                    sizes.append(n)
                    ids.append(values[at : at + n])
                    at, held = at + n, held + n
                    if held >= segment_tokens:
                        yield segment()
                        seq, before, held = seq + 1, before + held, 0
                        doc_ids, sizes, ids = [], [], []
        if doc_ids:
            yield segment()
        give_back()

    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the ids of all segments before: one row for each write task is summed."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("total").alias("part_total"))
    offsets = materialise(parts.select("part", (F.sum("part_total").over(Window.orderBy("part")) - F.col("part_total")).alias("part_start")), "dac-parts")
    return join_groups(segments, offsets, ["part"], F.col("seq")).withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part_start")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids (array<int>), decoded from the file."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dac, at = Dac(row["payload"]), 0
                sizes = row["n_tokens"]
                for i in range(0, len(sizes), 256):
                    part = sizes[i : i + 256]
                    n = sum(part)
                    offsets = np.cumsum([0, *part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][i : i + 256], pa.int64()), pa.array(row["start"] + at + offsets[:-1]), pa.array(part, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(dac.slice(at, at + n).astype(np.int32)))],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    at += n

    return read_segments(spark, path).select("doc_ids", "n_tokens", "payload", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """The ids at the positions of a table (column ``position``, from 0 over all documents): position, id.

    A position meets the segment that holds it by the segments' starts alone; only payloads of asked
    segments are read on, and of those only the bytes that lead to each id.
    """
    index = read_segments(spark, path).select("part", "seq", "start", "total")
    starts = materialise(index.where("total > 0"), "dac-index")
    width = 1 + (starts.agg(F.max("total")).first()[0] or 0)
    # A segment is no longer than ``width``, so it touches two cells of that width at most.
    cells = starts.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("total") - 1) / width)))))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position is not null").distinct().withColumn("_cell", F.floor(F.col("position") / width))
    asked = asked.join(cells, (F.col("_cell") == F.col("cell")) & (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("total")))
    asked = asked.groupBy(F.col("part").alias("_part"), F.col("seq").alias("_seq")).agg(F.first("start").alias("start"), F.collect_list("position").alias("positions"))
    segments = spark.read.schema(SEGMENTS).parquet(path).select("part", "seq", "payload")
    found = segments.join(asked, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))).select("start", "positions", "payload")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dac = Dac(row["payload"])
                yield pa.RecordBatch.from_arrays([pa.array(row["positions"], pa.int64()), pa.array([dac[p - row["start"]] for p in row["positions"]], pa.int64())], ["position", "id"])

    return found.mapInArrow(run, "position long, id long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the file: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dac, at, crc = Dac(row["payload"]), 0, []
                ids = dac.slice(0, len(dac)).astype("<u4")
                for n in row["n_tokens"]:
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at += n
                sizes = np.array(row["n_tokens"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_segments(spark, path).select("doc_ids", "n_tokens", "payload", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes ``documents``, writes the file, and returns the digest of what is read back from it."""
    path = scratch(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path, tokenizer_path())
    return digests(spark, path)
