"""Benchmark decontamination by a broadcast hash set of word n-grams (operator 3).

Every window of ``n`` consecutive words of a benchmark item (a shorter item is one window) is
hashed; documents are scanned with the same windows, hits are verified word by word, and hit words
or whole documents are removed. The set is broadcast only if the benchmark's texts hold at most
``broadcast_bytes``. Of a larger benchmark the windows' 8-byte hashes are broadcast, ``hash_rows`` at
a time, with a pass over the documents for each part; only document windows with such a hash are
carried on to the exact check, which is a join. Results are the same.

Defined results: a null text has no words and no hits; a null item_id is written ``null``; items
with the same id count once; repeated documents keep a row each; an empty benchmark hits nothing; a
text of any length is scanned whole, in one piece of memory; other columns pass through, and one that
has the name of a new column is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import append_columns, aside, back, join_groups, long_array, materialise, read, temporary
from quarryline.llm.words import ALNUM, Members, borders, give_back, raw_bytes, scan, text_chunks, windows

N = 10
#: Largest total of benchmark text, in characters, whose windows are broadcast.
BROADCAST_BYTES = 4 << 20
#: Most window hashes (8 bytes each) that are broadcast at a time, and the least number worth a pass.
HASH_ROWS, LEAST_HASHES = 8 << 20, 8
#: Most documents with hits that are broadcast, and bits of the bitmap that stands for more (64 MB).
BROADCAST_FOUND, MOST_BITS = 10_000, 29
FOUND = "hit_n_words long, hit_items array<string>, hit_spans array<struct<start: long, end: long>>"
FOUND_NAMES = ["hit_n_words", "hit_items", "hit_spans"]
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _sizes(count: np.ndarray, n: int) -> np.ndarray:
    """For every word's text, the length of its windows."""
    return np.minimum(count, n)


class WindowSet:
    """The windows of benchmark items, by length, with their words for the exact check."""

    def __init__(self, items: list[str], texts: list[str], n: int):
        self.words = w = scan(pa.array(texts, pa.large_string()), ALNUM)
        self.items = items
        count = w.count()
        size_of = np.repeat(_sizes(count, n), count)
        item_of = np.repeat(np.arange(len(texts)), count)
        self.by_size: dict[int, tuple[Members, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(size_of).tolist():
            h, valid = windows(w, size)
            at = np.flatnonzero(valid & (size_of == size))
            order = at[np.argsort(h[at], kind="stable")]
            known = Members(h[order])
            first = np.searchsorted(h[order], known.sorted)
            self.by_size[size] = (known, order, np.r_[first, len(order)], item_of)
        self.memo: dict[tuple[int, int], dict[tuple, set[str]]] = {}

    def verified(self, size: int, place: int, words: list[bytes]) -> set[str] | None:
        """The items that hold exactly these words as a window, None if none does."""
        known = self.memo.get((size, place))
        if known is None:
            _, order, first, item_of = self.by_size[size]
            known = {}
            for at in order[first[place] : first[place + 1]].tolist():
                known.setdefault(tuple(self.words.words(at, size)), set()).add(self.items[item_of[at]])
            self.memo[(size, place)] = known
        return known.get(tuple(words))


def find_windows(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, hash_rows: int = HASH_ROWS) -> DataFrame:
    """docs with ``hit_n_words``, ``hit_items`` (ids as strings, sorted) and ``hit_spans`` (runs of hit words)."""
    spark, docs = docs.sparkSession, docs.drop(*FOUND_NAMES)
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("item_text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("item_text") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    if size > broadcast_bytes:
        return back(_by_shuffle(aside(docs, ["_hit", "_key", "_text_key"]), bench, n, text, hash_rows))
    rows = bench.collect()  # at most broadcast_bytes
    shared = spark.sparkContext.broadcast(([r["item"] for r in rows], [r["item_text"] for r in rows]))
    sets: list[WindowSet] = []

    def make(chunk):
        if not sets:
            sets.append(WindowSet(*shared.value, n))
        w = scan(chunk.column(text), ALNUM)
        count = w.count()
        edge = np.zeros(len(w.hash) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for size, (known, *_) in sets[0].by_size.items():
            h, valid = windows(w, size)
            at, place = known.find(h)
            ok = valid[at]
            at, place = at[ok], place[ok]
            doc_of = np.searchsorted(w.first, at, side="right") - 1
            for i, p, d in zip(at.tolist(), place.tolist(), doc_of.tolist()):
                if found := sets[0].verified(size, p, w.words(i, size)):
                    edge[i] += 1
                    edge[i + size] -= 1
                    items.setdefault(d, set()).update(found)
        hit = np.zeros(len(w.hash) + 2, np.int8)
        hit[1:-1] = np.cumsum(edge[:-1]) > 0
        return [long_array(count), pa.array([sorted(items.get(k, ())) for k in range(len(count))], pa.list_(pa.string())), _spans(hit[1:-1].astype(bool), w.first, items)]

    return append_columns(docs, make, FOUND, text)


def _spans(hit: np.ndarray, first: np.ndarray, items: dict) -> pa.Array:
    out = []
    for k in range(len(first) - 1):
        if k not in items:
            out.append([])
            continue
        own = np.r_[False, hit[first[k] : first[k + 1]], False]
        step = np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2)
        out.append([{"start": a, "end": b} for a, b in step.tolist()])
    return pa.array(out, pa.list_(_SPAN))


def _item_windows(bench: DataFrame, n: int) -> DataFrame:
    """Rows (hash, size, window, item) for every window of every item."""

    def run(batches):
        for batch in batches:
            for chunk in text_chunks(batch, "item_text"):
                w = scan(chunk.column("item_text"), ALNUM)
                items = chunk.column("item").to_pylist()
                size_of, item_of = np.repeat(_sizes(w.count(), n), w.count()), np.repeat(np.arange(len(items)), w.count())
                for size in np.unique(size_of).tolist():
                    h, valid = windows(w, size)
                    yield from _batches(w, np.flatnonzero(valid & (size_of == size)), size, h, lambda at: pa.array([items[k] for k in item_of[at]], pa.string()), "item")

    return bench.select("item", "item_text").mapInArrow(run, "hash long, size int, window string, item string").distinct()


def _batches(w, at: np.ndarray, size: int, h: np.ndarray, more, name: str):
    for a in range(0, len(at), 8192):
        own = at[a : a + 8192]
        words = pa.array([b" ".join(w.words(k, size)).decode() for k in own.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array([size] * len(own), pa.int32()), words, more(own)], ["hash", "size", "window", name])


def _document_windows(docs: DataFrame, text: str, sizes: list[int], known) -> DataFrame:
    """Rows (hash, size, window, at) of document windows whose hash is among ``known`` (a broadcast array).

    ``at`` is the text's digest and the window's first word; no other column and no text is carried on.
    """
    members: list[Members] = []

    def run(batches):
        members[:] = members or [Members(known.value)]
        for batch in batches:
            for chunk in text_chunks(batch, text):
                w = scan(chunk.column(text), ALNUM)
                raw, offsets = raw_bytes(chunk.column(text))
                keys: dict[int, bytes] = {}

                def place(at, keys=keys, w=w, raw=raw, offsets=offsets):
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    for d in set(doc.tolist()) - keys.keys():
                        keys[d] = hashlib.sha256(raw[offsets[d] : offsets[d + 1]].tobytes()).digest()
                    return pa.StructArray.from_arrays([pa.array([keys[d] for d in doc.tolist()], pa.binary()), pa.array(at - w.first[doc])], ["key", "pos"])

                for size in sizes:
                    h, valid = windows(w, size)
                    at, _ = members[0].find(h)
                    yield from _batches(w, at[valid[at]], size, h, place, "at")
        give_back()

    rows = docs.select(F.coalesce(text, F.lit("")).alias(text)).mapInArrow(run, "hash long, size int, window string, at struct<key: binary, pos: long>")
    return rows.select("hash", "size", "window", "at.key", "at.pos")


def _by_shuffle(docs: DataFrame, bench: DataFrame, n: int, text: str, hash_rows: int) -> DataFrame:
    """The same result for a benchmark of any size.

    The benchmark's window hashes are broadcast ``hash_rows`` at a time, one pass over the documents for each part, and
    only document windows with such a hash are carried on, by the digest of their text. They are verified by a join on
    the windows' words, in which a frequent window is salted. What is found joins the documents by digest: broadcast
    while it is small; beyond that, only documents whose digest is in a bitmap of those found are shuffled.
    """
    spark = docs.sparkSession
    with temporary(spark) as keep:
        known = materialise(_item_windows(bench, n), "leak-windows")
        sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most n lengths
        hashes = materialise(known.select("hash").distinct(), "leak-hashes")
        hits = None
        for part, parts in ((k, m) for m in [-(-hashes.count() // max(hash_rows, LEAST_HASHES))] for k in range(m)):
            own = hashes.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == part).toArrow().column("hash").to_numpy()
            shared = spark.sparkContext.broadcast(np.sort(own.view(np.uint64)))
            new = materialise(_document_windows(docs, text, sizes, shared), f"leak-hits{part}")
            shared.unpersist()
            hits = new if hits is None else hits.unionByName(new)
        if hits is None:
            return _count_words(docs.withColumn("hit_items", F.array().cast("array<string>")), text).select(*docs.columns, *FOUND_NAMES)
        items = materialise(known.groupBy("window", "size").agg(F.array_sort(F.collect_set("item")).alias("items")), "leak-items")
        good = join_groups(hits.select("window", "size", "key", "pos"), items, ["window", "size"], F.col("key"), "inner")
        # A text's copies give the same rows: the sets of a task are merged, whatever their number.
        found = good.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("hit_items"), F.collect_set(F.struct("pos", "size")).alias("_hit"))
        found = keep(materialise(found.withColumnsRenamed({"key": "_key"}), "leak-found"))
        count = found.count()
    keyed = docs.withColumn("_text_key", F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)))
    match = F.col("_text_key") == F.col("_key")
    if count <= BROADCAST_FOUND:
        joined = keyed.join(F.broadcast(found), match, "left")
    else:
        maybe = _in_bitmap(found.select("_key"), count)
        some = keyed.where(maybe("_text_key")).join(found.hint("merge"), match, "left")
        joined = some.unionByName(keyed.where(~maybe("_text_key")).withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in found.columns}))
    return _count_words(joined.drop("_key", "_text_key").withColumn("hit_items", F.array_sort(F.coalesce("hit_items", F.array().cast("array<string>")))), text).select(*docs.columns, *FOUND_NAMES)


def _in_bitmap(keys: DataFrame, count: int):
    """A condition that holds for all of the keys and few others: a bitmap of their leading bits, MOST_BITS at most."""
    bits = min(MOST_BITS, max(16, (8 * count).bit_length()))
    place = lambda c: F.shiftrightunsigned(F.conv(F.hex(F.substring(c, 1, 4)), 16, 10).cast("long"), 32 - bits)
    rows = keys.select(place("_key").alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    # One row of 4 KB for each part: 64 MB at most.
    words = {r["part"]: bytes(r["bits"]) for r in rows.collect()}
    shared = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def has(p: pd.Series) -> pd.Series:
        x = p.to_numpy(np.int64)
        out = np.zeros(len(x), bool)
        for part in np.unique(x >> 15).tolist():
            own = x >> 15 == part
            raw = np.frombuffer(shared.value.get(part, bytes(4096)), np.uint8)
            low = x[own] & 32767
            out[own] = raw[low >> 3] >> (low & 7) & 1
        return pd.Series(out)

    return lambda c: has(place(c))


def _count_words(joined: DataFrame, text: str) -> DataFrame:
    """Adds the number of words, and the runs of hit words from the places and lengths of hit windows (``_hit``)."""
    if "_hit" not in joined.columns:
        joined = joined.withColumn("_hit", F.lit(None).cast("array<struct<pos: long, size: int>>"))

    def make(chunk):
        w = scan(chunk.column(text), ALNUM, hashes=False)
        hit, items = np.zeros(len(w.start), bool), {}
        for k, own in enumerate(chunk.column("_hit").to_pylist()):
            if own:
                edge = np.zeros(int(w.first[k + 1] - w.first[k]) + 1, np.int64)
                at, size = np.array([x["pos"] for x in own]), np.array([x["size"] for x in own])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                hit[w.first[k] : w.first[k + 1]] = np.cumsum(edge[:-1]) > 0
                items[k] = True
        return [long_array(w.count()), _spans(hit, w.first, items)]

    names = [c for c in joined.columns if c not in ("_hit", "hit_n_words", "hit_spans")]
    out = append_columns(joined, make, "hit_n_words long, hit_spans array<struct<start: long, end: long>>", text)
    return out.select(*names, "hit_n_words", "hit_spans")


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents of ``find_windows`` with every run of hit words cut from the text (a space stays)."""

    def make(chunk):
        w, out, begins = scan(chunk.column(text), ALNUM, lower=False, hashes=False), [], borders(chunk.column(text))
        for k, (whole, spans) in enumerate(zip(chunk.column(text).to_pylist(), chunk.column("hit_spans").to_pylist())):
            if not spans:
                out.append(whole)
                continue
            raw, at, parts = whole.encode(), 0, []
            base = int(begins[k])
            for s in spans:
                parts.append(raw[at : int(w.start[w.first[k] + s["start"]]) - base])
                at = int(w.end[w.first[k] + s["end"] - 1]) - base
            out.append(b" ".join([*parts, raw[at:]]).decode())
        return [pa.array(out, pa.string())]

    cut = append_columns(found, make, "_cut string", text)
    return cut.withColumn(text, F.col("_cut")).drop("_cut", "hit_n_words", "hit_items", "hit_spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N) -> DataFrame:
    """docs without contaminated documents (``documents``) or without the hit words (``spans``)."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found = find_windows(aside(docs, FOUND_NAMES), benchmark, n)
    left = remove_spans(found) if remove == "spans" else found.where(F.size("hit_spans") == 0).drop(*FOUND_NAMES)
    return back(left).select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and their digest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_windows(docs, read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("hit_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: DuckDB: the same rows from lists of words; n_hit counts words inside any occurring window.
OP3_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
own AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, own.n, item FROM own JOIN win ON own.s = win.s AND own.n = win.n),
cnt AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cnt USING (r) LEFT JOIN its USING (r)
"""
