"""Word counts, co-occurrence, similarity and Naive Bayes (T, N)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.columns import tokens, tokens_ws
from quarryline.operators.relational import BROADCAST_ROWS, attach_group_count, lookup, percent_overlap, top_bottom
from quarryline.sources.files import saved

#: Items of a feature that are paired in one place; the items of a more frequent one are paired block by block.
PAIRED = 1_000
#: Bytes of text that are cut into words at once, and the most pairs and words that a worker keeps before it hands them on.
CHUNK_BYTES, KEPT_PAIRS, KEPT_WORDS = 8 << 20, 4_000_000, 1_000_000
#: Sides of the grid of cells that pairs are dealt to.
GRID = 32


def word_count(df: DataFrame, text: str, lower: bool = True) -> DataFrame:
    pattern = "[a-z]+" if lower else "[A-Za-z]+"
    return df.select(F.explode(tokens(F.col(text), pattern, lower)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def ngrams(df: DataFrame, text: str, n: int = 5) -> DataFrame:
    """Every window of n words of a text, as (ngram, cnt): counted over the table."""
    w = tokens(F.col(text))
    window = lambda i: F.concat(F.get("w", i), *[x for k in range(1, n) for x in (F.lit(" "), F.get("w", i + k))])
    rows = df.select(w.alias("w")).where(F.size("w") >= n).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), window)).alias("ngram"))
    return rows.groupBy("ngram").agg(F.count("*").alias("cnt"))


# ---- counts over the n-grams of texts, from the texts themselves: no table of n-grams is made
def _cut_words(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Words (runs of a to z) of the texts with n words or more: different words, each word's number among them, its text, its place there."""
    for batch in batches:
        texts = batch.column(0).cast(pa.large_string())
        at = 0
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, "right")) - 1)
            own, at = ends[at : to + 1], to
            if own[0] == own[-1]:
                continue
            raw = np.frombuffer(texts.buffers()[2], np.uint8)[own[0] : own[-1]]
            letter = (raw - np.uint8(97)) < 26
            first = letter.copy()
            first[1:] &= ~letter[:-1]
            begins = (own[:-1] - own[0])[own[:-1] < own[-1]]
            first[begins] = letter[begins]  # a text may end and the next begin with a letter
            starts = np.flatnonzero(first[letter])
            if not len(starts):
                continue
            letters = raw[letter]
            coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.r_[starts, len(letters)]), pa.py_buffer(letters)]).dictionary_encode()
            text = np.searchsorted(own[1:] - own[0], np.flatnonzero(first), "right")
            size = np.bincount(text)
            place = np.arange(len(text)) - (np.cumsum(size) - size)[text]
            long = size[text] >= n
            yield coded.dictionary, coded.indices.to_numpy()[long], text[long], place[long], size[text[long]]


def text_word_count(df: DataFrame, text: str, n: int = 5) -> DataFrame:
    """``ngram_word_count(ngrams(df, text, n))``: a word counts once for each window of n words that its place is in."""

    def count(batches):
        for words, code, _, place, size in _cut_words(batches, n):
            windows = np.minimum(place, size - n) - np.maximum(place - n + 1, 0) + 1
            times = np.bincount(code, windows, len(words)).astype(np.int64)
            found = np.flatnonzero(times)
            for k in range(0, len(found), 100_000):
                part = found[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(part)).cast(pa.string()), pa.array(times[part])], ["word", "n"])

    rows = df.select(F.lower(text).alias("text")).dropna()
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique`` by sorting: numpy's own way hashes, which takes several times as long here."""
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _met_pairs(batches, n: int, listed: frozenset | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Words, and pairs of different ones (w1 before w2, as numbers among them) less than n apart: each once, up to some KEPT_PAIRS at a time."""
    ids, met = {}, np.zeros(0, np.int64)
    for words, code, doc, place, _ in _cut_words(batches, n):
        own = np.array([ids.setdefault(w, len(ids)) if listed is None or w in listed else -1 for w in words.to_pylist()], np.int64)[code]
        if listed is not None:
            kept = own >= 0
            own, doc, place = own[kept], doc[kept], place[kept]
        new = [met]
        for k in range(1, n):
            a, b = own[:-k], own[k:]
            near = (doc[:-k] == doc[k:]) & (place[k:] - place[:-k] < n) & (a != b)
            new.append(np.minimum(a, b)[near] << 32 | np.maximum(a, b)[near])
        met = _distinct(np.concatenate(new))
        if len(met) > KEPT_PAIRS or len(ids) > KEPT_WORDS:
            yield _in_order(ids, met)
            ids, met = {}, np.zeros(0, np.int64)
    yield _in_order(ids, met)


def _in_order(ids: dict[str, int], pairs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    words = pa.array(ids, pa.string(), size=len(ids))
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(words).to_numpy()] = np.arange(len(ids))
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    turned = order[a] > order[b]
    return words, np.where(turned, b, a), np.where(turned, a, b)


def text_pairs(df: DataFrame, text: str, among: DataFrame, n: int = 5) -> DataFrame:
    """Different pairs (w1 before w2) of words of ``among`` (word) that stand in one window of n words.

    Up to BROADCAST_ROWS words, they are picked before pairs are made.
    """
    listed = [r["word"] for r in among.select("word").distinct().limit(BROADCAST_ROWS + 1).collect()]
    listed = frozenset(listed) if len(listed) <= BROADCAST_ROWS else None

    def pair(batches):
        for words, a, b in _met_pairs(batches, n, listed):
            for k in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([words.take(pa.array(x[k : k + 100_000])) for x in (a, b)], ["w1", "w2"])

    pairs = df.select(F.lower(text).alias("text")).dropna().mapInArrow(pair, "w1 string, w2 string").distinct()
    if listed is None:
        for w in ("w1", "w2"):
            pairs = lookup(pairs, among.select(F.col("word").alias(w)).distinct(), w, "left_semi")
    return pairs


def text_neighbor_counts(df: DataFrame, text: str, n: int = 5) -> DataFrame:
    """``neighbor_counts(word_pairs(ngrams(df, text, n)))``: different words in one window of n words with each word.

    Nearly every pair is a new one, so pairs move as packed words, not as rows: into a cell of a grid by the hashes of
    both words, where they are made distinct and counted. A frequent word's pairs lie in many cells, a cell's
    counts are added up.
    """

    def pack(batches):
        for words, a, b in _met_pairs(batches, n):
            side = np.array([zlib.crc32(w.encode()) % GRID for w in words.to_pylist()], np.int32)
            cell = side[a] * GRID + side[b]
            order = np.argsort(cell, kind="stable")
            cell, two = cell[order], np.column_stack([a[order], b[order]])
            cuts = np.flatnonzero(np.r_[True, np.diff(cell) != 0]) if len(cell) else []
            for k, to in zip(cuts, [*cuts[1:], len(cell)]):
                taken = words.take(pa.array(two[k:to].ravel()))
                ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1]
                yield pa.RecordBatch.from_arrays([pa.array([cell[k]], pa.int32()), pa.array([taken.buffers()[2].to_pybytes()[: ends[-1]]], pa.binary()), pa.array([np.diff(ends).tobytes()], pa.binary())], ["cell", "letters", "lengths"])

    def distinct(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
        coded = pa.chunked_array(parts, pa.large_string()).combine_chunks().dictionary_encode()
        two = coded.indices.to_numpy().astype(np.int64)
        pairs = _distinct(two[::2] << 32 | two[1::2])
        return coded.dictionary, np.column_stack([pairs >> 32, pairs & 0xFFFFFFFF]).ravel()

    def counted(parts: list[pa.Array]):
        words, two = distinct(parts)
        times = np.bincount(two, minlength=len(words))
        for k in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([words[k : k + 100_000].cast(pa.string()), pa.array(times[k : k + 100_000])], ["word", "n"])

    def count(batches):
        now, parts, size, limit = None, [], 0, KEPT_PAIRS
        for batch in batches:
            for cell, letters, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != now and parts:
                    yield from counted(parts)
                    parts, size, limit = [], 0, KEPT_PAIRS
                now = cell
                ends = np.r_[0, np.cumsum(np.frombuffer(lengths, np.int32), dtype=np.int64)]
                parts.append(pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)]))
                size += len(ends) // 2
                if size > limit:
                    words, two = distinct(parts)
                    parts, size = [words.take(pa.array(two))], len(two) // 2
                    limit = KEPT_PAIRS + size
        if parts:
            yield from counted(parts)

    packed = df.select(F.lower(text).alias("text")).dropna().mapInArrow(pack, "cell int, letters binary, lengths binary")
    cells = packed.repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ngram_word_count(grams: DataFrame) -> DataFrame:
    return grams.select(F.explode(tokens_ws(F.col("ngram"))).alias("word"), "cnt").groupBy("word").agg(F.sum("cnt").alias("n"))


def vocabulary_summary(grams: DataFrame, n: int = 10) -> DataFrame:
    counts = saved(ngram_word_count(grams), "word-counts")  # read three times
    return top_bottom(counts, "n", "word", n).crossJoin(counts.agg(F.count("*").alias("vocabulary")))


def word_pairs(grams: DataFrame) -> DataFrame:
    """Different pairs (w1 before w2) of words of an n-gram."""
    words = F.array_sort(F.array_distinct(tokens_ws(F.col("ngram"))))
    one = grams.select(words.alias("w")).select("w", F.posexplode("w").alias("k", "w1"))
    return one.select("w1", F.explode(F.slice("w", F.col("k") + 2, F.size("w"))).alias("w2")).distinct()


def neighbor_counts(pairs: DataFrame) -> DataFrame:
    """Different words beside each word: every pair (w1, w2) is there once, in one order, and counts for both."""
    return pairs.select(F.explode(F.array("w1", "w2")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def ranking_overlap(counts: DataFrame, neighbors: DataFrame, n: int) -> DataFrame:
    """How many of the n most frequent words are among the n with most neighbours, and the percentage."""
    top = lambda df, name: saved(df.orderBy(F.desc("n"), "word").limit(n), name)
    return percent_overlap(top(counts, "most-frequent"), top(neighbors, "most-neighbors"), "word")


def get_vocab(counts: DataFrame, n_total: int, n_basis: int, stopwords: DataFrame) -> DataFrame:
    """The n_total most frequent words left by the stop words, with rank; the last n_basis are the basis."""
    top = lookup(counts, stopwords, "word", "left_anti").orderBy(F.desc("n"), "word").limit(n_total)
    ranked = top.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1)
    return ranked.withColumn("basis", F.col("rnk") >= n_total - n_basis)


def build_stripes(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Long form (item, feature): vocabulary words with the basis words beside them, from pairs in one order."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("w1").alias("item"), F.col("w2").alias("feature")), F.struct(F.col("w2").alias("item"), F.col("w1").alias("feature")))).alias("x")).select("x.*")
    items = lookup(both, vocab.select(F.col("word").alias("item")), "item", "left_semi")
    return lookup(items, vocab.where("basis").select(F.col("word").alias("feature")), "feature", "left_semi").select("item", "feature")


def similarity(items: DataFrame) -> DataFrame:
    """Pairs a < b of items that share a feature (long form, distinct; no nulls): counts and four scores.

    The items of a feature are cut into blocks of about PAIRED by their hash, and blocks are paired with blocks: the pairs
    of a frequent feature are made in many tasks, each of PAIRED squared at most, and counted there before the shuffle.
    """
    sized = attach_group_count(items.select("item", "feature"), ["item"], "size")
    sized = attach_group_count(sized, ["feature"], "_m").withColumn("_blocks", F.ceil(F.col("_m") / PAIRED))
    sized = sized.withColumn("_own", F.pmod(F.xxhash64("item"), F.col("_blocks")))
    cells = F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)
    # A block is the first of a cell with itself and those after it, the second with itself and those before.
    first = sized.select("feature", F.col("item").alias("a"), F.col("size").alias("n_a"), F.col("_own").alias("i"), F.explode(F.filter(cells, lambda c: c >= F.col("_own"))).alias("j"))
    second = sized.select("feature", F.col("item").alias("b"), F.col("size").alias("n_b"), F.explode(F.filter(cells, lambda c: c <= F.col("_own"))).alias("i"), F.col("_own").alias("j"))
    met = first.join(second, ["feature", "i", "j"]).where("i < j OR a < b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    p = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common"))
    c, n1, n2 = F.col("common"), F.col("n_a"), F.col("n_b")
    scores = {"cosine": c / F.sqrt(n1 * n2), "jaccard": c / (n1 + n2 - c), "overlap": c / F.least(n1, n2), "dice": 2 * c / (n1 + n2)}
    p = p.withColumns({"mean_score": F.round(sum(scores.values()) / 4, 9)} | {k: F.round(v, 9) for k, v in scores.items()})
    return p.select("a", "b", "common", *scores, "mean_score")


def similarity_extremes(items: DataFrame, n: int, score: str = "cosine") -> DataFrame:
    """The n most and the n least similar pairs by a score (ties by the items), with their rank from 1."""
    pairs = similarity(items).select("a", "b", score)
    best = {"top": [F.desc(score), F.asc("a"), F.asc("b")], "bottom": [F.asc(score), F.asc("a"), F.asc("b")]}
    # Each part has n rows when it is numbered.
    parts = [pairs.orderBy(*order).limit(n).withColumns({"side": F.lit(side), "rn": F.row_number().over(Window.orderBy(*order))}) for side, order in best.items()]
    return parts[0].unionByName(parts[1])


def document_items(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("item"), F.explode(F.array_distinct(tokens_ws(F.col(text)))).alias("feature"))


def cooccurrence_matrix(stripes: DataFrame, features: list[str]) -> DataFrame:
    return stripes.groupBy("item").pivot("feature", features).agg(F.count(F.lit(1))).na.fill(0)


def term_cosine_all_pairs(stripes: DataFrame) -> DataFrame:
    """All pairs of a vocabulary that has been cut to a stated size, zeros included."""
    terms = stripes.select("item").distinct()
    pairs = terms.select(F.col("item").alias("a")).join(terms.select(F.col("item").alias("b")), F.expr("a < b"))
    return pairs.join(similarity(stripes).select("a", "b", "cosine"), ["a", "b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def word_class_counts(df: DataFrame, text: str, label: str, lower: bool = False) -> DataFrame:
    """A row for each word and each class 0 and 1, zero counts included."""
    pattern = "[a-z]+"
    words = df.select(F.explode(tokens(F.col(text), pattern, lower)).alias("word"), F.col(label).alias("y"))
    wide = words.groupBy("word").agg(F.count_if(F.col("y") == 0).alias("0"), F.count_if(F.col("y") == 1).alias("1"))
    return wide.unpivot("word", ["0", "1"], "class", "n").withColumn("class", F.col("class").cast("int"))


# ---- Naive Bayes
def nb_priors(docs: DataFrame, label: str) -> DataFrame:
    n = [F.count_if(F.col(label) == k) for k in (0, 1)]
    return docs.agg(n[0].alias("docs0"), n[1].alias("docs1"), (n[0] / F.count(label)).alias("prior0"), (n[1] / F.count(label)).alias("prior1"))


def nb_train(docs: DataFrame, text: str, label: str, smoothing: float | None = None) -> DataFrame:
    """Model (word, n0, n1, p0, p1); Laplace smoothing takes the vocabulary size from the data."""
    words = docs.select(F.explode(tokens(F.col(text))).alias("word"), F.col(label).alias("y"))
    counts = words.groupBy("word").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    totals = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count("*").alias("v"))
    k = smoothing or 0.0
    m = counts.crossJoin(F.broadcast(totals))
    return m.select("word", "n0", "n1", *[F.try_divide(F.col(f"n{c}") + F.lit(k), F.col(f"t{c}") + F.lit(k) * F.col("v")).alias(f"p{c}") for c in (0, 1)])


def nb_classify(docs: DataFrame, key: str, text: str, model: DataFrame, priors: DataFrame) -> DataFrame:
    """(key, log0, log1, pred): unknown words add 0, a zero probability -inf, ties go to class 0."""
    log = lambda c: F.when(F.col(c) > 0, F.ln(c)).otherwise(F.lit(float("-inf")))
    words = docs.select(F.col(key), F.explode_outer(tokens(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("times"))
    scored = words.join(model.select("word", log("p0").alias("l0"), log("p1").alias("l1")), "word", "left")
    sums = scored.groupBy(key).agg(*[F.sum(F.coalesce(F.col(f"l{c}") * F.col("times"), F.lit(0.0))).alias(f"s{c}") for c in (0, 1)])
    out = sums.crossJoin(F.broadcast(priors)).select(key, *[(F.col(f"s{c}") + log(f"prior{c}")).alias(f"log{c}") for c in (0, 1)])
    return out.withColumn("pred", F.when(F.col("log0") >= F.col("log1"), 0).otherwise(1))


def binary_metrics(df: DataFrame, label: str, pred: str, n: str | None = None) -> DataFrame:
    """Of rows, or of rows that stand for ``n`` each."""
    y, p = F.col(label), F.col(pred)
    times = (lambda c: F.coalesce(F.sum(F.when(c, F.col(n).cast("long"))), F.lit(0).cast("long"))) if n else F.count_if
    c = df.agg(times((y == 1) & (p == 1)).alias("tp"), times((y == 0) & (p == 0)).alias("tn"), times((y == 0) & (p == 1)).alias("fp"), times((y == 1) & (p == 0)).alias("fn"))
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    return c.select("*", r(F.try_divide(tp + tn, tp + tn + fp + fn)).alias("accuracy"), r(F.try_divide(tp, tp + fp)).alias("prec"), r(F.try_divide(tp, tp + fn)).alias("recall"), r(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def nb_top_words(model: DataFrame, n: int) -> DataFrame:
    dominant = model.withColumns({"class": F.when(F.col("p1") > F.col("p0"), 1).otherwise(0), "p": F.greatest("p0", "p1")})
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("p"), "word"))
    return dominant.withColumn("rn", rank).where(F.col("rn") <= n).select("class", "word", F.round("p", 9).alias("p"), "rn")
