"""Operators 11 to 13 against the library, brute force over all lags, and plain eigenvectors."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import bpe, periods, whitening

SOLID = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Bpe(ranks, public_tokenizers.PATTERN)


def odd_texts(rng, n):
    alphabets = ["abcdefghijklmnop", "eéèİiıß", "  \t\n\r　\xa0 ", "0123456789٣", "'s't're've", "中文日本語한국", "#*!?.,-_", "a", "\x00\x7f\U0001f600‍\x1c\x85 ", " the and ing"]
    for _ in range(n):
        source = "".join(rng.sample(alphabets, rng.choice([1, 1, 2, 3])))
        yield "".join(rng.choice(source) for _ in range(rng.choice([0, 1, 3, 10, 40, 200, 900])))


def test_byte_bpe_is_the_library(tiktoken_encoding):
    library, own = tiktoken_encoding
    rng = random.Random(4)
    for _ in range(150):
        texts = list(odd_texts(rng, 6))
        ids, n = own.encode(pa.array(texts, pa.string()))
        want = [library.encode_ordinary(t) for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and n.tolist() == list(map(len, want)), texts
        assert own.decode(ids).tobytes() == "".join(texts).encode()


def test_byte_bpe_long_pieces_and_any_ranks(tiktoken_encoding):
    library, own = tiktoken_encoding
    rng = random.Random(5)
    for t in ("a" * 5000, " " * 3001 + "x", "ab" * 2000, "".join(rng.choice("etaoin") for _ in range(6000))):
        assert own.encode(pa.array([t]))[0].tolist() == library.encode_ordinary(t)
    # Ranks in no order of merging: what one merge makes may go before it.
    for _ in range(60):
        made = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(25)}
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(rng.sample(sorted(made), len(made)))}
        small = bpe.Bpe(ranks, r"\S+|\s+")
        for _ in range(10):
            piece = "".join(rng.choice("abc") for _ in range(rng.choice([3, 9, 40, 300]))).encode()
            parts = [bytes([b]) for b in piece]
            while True:
                pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
                if not pairs:
                    break
                k = min(pairs)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            want = [ranks[p] for p in parts]
            start, count, ids = small.merge([piece])
            assert ids[start[0] : start[0] + count[0]].tolist() == want and small._long(piece).tolist() == want


def test_op11_query(spark, tiktoken_encoding, tmp_path):
    library, _ = tiktoken_encoding
    rng = random.Random(6)
    rows = list(enumerate([*odd_texts(rng, 40), None, "", "very long " * 30000])) + [(3, "same id"), (3, "same id"), (None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "decoded": F.lit(1)}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.op11_byte_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def plain_runs(w, least=12):
    """Every lag at every place; the smallest lag of a stretch is its period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def word_lists(rng):
    n, letters = rng.choice([0, 1, 5, 11, 12, 13, 30, 80, 200]), rng.choice([1, 2, 3, 5, 40])
    w = [rng.randrange(letters) for _ in range(n)]
    kind = rng.randrange(6)
    if kind == 1 and n > 3:
        p = rng.randrange(1, n)
        w = [w[i % p] for i in range(n)]
    if kind == 2 and n > 3:
        a = rng.randrange(n)
        p = rng.randrange(1, n - a + 1)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    if kind == 3:
        w = w + w + w[: rng.randrange(n + 1)]
    if kind == 4:
        w = w[:10] * rng.randrange(1, 8) + w + w[5:20] * 3
    if kind == 5:
        a, w = [0], [0, 1]
        while len(w) < n:
            a, w = w, w + a
    return w


def test_runs_of_texts():
    rng = random.Random(8)
    for _ in range(250):
        texts = [word_lists(rng) for _ in range(rng.choice([1, 3, 8]))]
        first = np.r_[0, np.cumsum([len(x) for x in texts])]
        got = periods.runs_of_texts(np.array([x for t in texts for x in t], np.int32), first)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, x in enumerate(texts) for r in plain_runs(x)]


def test_long_texts_of_few_words():
    n = 60_000
    assert periods.runs_of_texts(np.zeros(n, np.int32), np.array([0, n])).tolist() == [[0, 0, n, 1]]
    assert periods.runs_of_texts(np.tile([3, 1, 2], n // 3).astype(np.int32), np.array([0, n])).tolist() == [[0, 0, n, 3]]


def test_op12_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(f"wé{x}" for x in word_lists(rng))) for i in range(150)]
    rows += [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 14, 90, 400])))) for i in range(200, 320)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "very long " * 30000), (None, "a b " * 10), (None, None), (7, "x y z " * 5), (7, "x y z " * 5), (-5, "p q " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"run_list": F.lit("clash"), "_n": F.lit(1), "start": F.lit(2)})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = SOLID.findall(t or "")
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w) if i != 403 else [(0, n, 2)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        kept = " ".join(x for k, x in enumerate(w) if k not in dropped)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((i, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    got = periods.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 50


# ---- whitening
@pytest.mark.parametrize("values", [[9, 5, 3, 1], [7, 7, 7, 2, 1], [5, 5 + 1e-9, 3, 3 - 1e-12, 1], [1e6, 1, 1, 1e-3], [4, 4, 4, 4], [2, 1, 0, 0]])
def test_refined_eigenvectors(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    q = q.astype(np.longdouble)
    v = (q * np.array(values, np.longdouble)) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.eigen(v)
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-15
    assert np.abs(v @ x - x * e).max() < 1e-15 * max(values)
    assert np.abs(e - np.sort(np.array(values, np.longdouble))[::-1]).max() < 1e-14 * max(values)


def test_refinement_of_many_and_clustered():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(5000, 64))
    a[:, 40:] = a[:, 16:40]  # 24 directions without variance
    v = np.cov(a.T, bias=True)
    e, x = whitening.eigen(v)
    assert np.abs(x.T @ x - np.eye(64)).max() < 1e-15 and np.abs(v @ x - x * e).max() < 1e-14
    assert np.abs(e.astype(float) - np.linalg.eigvalsh(v)[::-1]).max() < 1e-12


def test_op13_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 40)) * np.linspace(1, 3, 40) + rng.normal(size=40)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [rows[5], (None, rows[6][1]), (7, rows[8][1])]
    odd = [(900, None), (901, [None] * 40), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] + [0.0] * 39), (904, [1.0, 2.0]), (905, []), (906, [-float("inf")] * 40)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"whitened": F.lit("clash"), "n": F.lit(1)}).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_whitening(spark, str(tmp_path)).collect()
    n = len(rows)
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    s = x.sum(0)
    cov = np.cov((x - s / n).T, bias=True)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    w = (x - s / n) @ u[:, :32] / np.sqrt(e[:32])
    dev = ((n * x - s) ** 2).sum(1)
    assert len(got) == 32 * n and {r["component"] for r in got} == set(range(1, 33)) and {r["n"] for r in got} == {n}
    assert all(abs(r["explained"] - e[r["component"] - 1] / np.trace(cov)) < 1e-9 for r in got)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    own = {i: k for k, (i, _) in enumerate(rows) if sum(i == j for j, _ in rows) == 1}
    sign = {}
    for r in got:
        if r["vec_id"] in own:
            k, c = own[r["vec_id"]], r["component"] - 1
            assert r["deviation"] == dev[k]
            sign.setdefault(c, np.sign(r["whitened"] * w[k, c]))
            assert abs(r["whitened"] - sign[c] * w[k, c]) < 1e-8 * (1 + abs(w[k, c]))
    assert sorted(r["vec_id"] is None for r in got).count(True) == 32


def test_op13_one_row_and_no_variance(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert whitening.op13_whitening(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(4)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    got = whitening.op13_whitening(spark, f"{tmp_path}/b").collect()
    assert len(got) == 4 and {r["explained"] for r in got} == {1.0}


def test_deviation_beyond_a_long():
    model = whitening.Whitening(10**9, np.zeros(2, np.int64), [0, 0], np.eye(2), np.ones(2), 1.0)
    assert model.deviation(np.array([[1.0, 2.0], [1000.0, 5000.0]])) == [5 * 10**18, None]
