"""The pipeline's stages against plain versions, on a table with nulls, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import mixing, quality, textstats, tokens

SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = ["q_score", "hit_spans", "mix_size", "mix_position", "did", "tid", "key", "_near_d", "grp"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(300)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("pipeline"))
    texts = [prose(rng, rng.choice([15, 40, 90])) for _ in range(60)]
    texts = [t if i % 4 else re.sub(" ", " %% ", t) for i, t in enumerate(texts)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t + " tail") for i, t in enumerate(texts[:12])] + [(200 + i, t) for i, t in enumerate(texts[5:9])]
    passage = " ".join(texts[21].split()[2:14])
    rows += [(300, prose(rng, 20) + " " + passage + " " + prose(rng, 20)), (301, None), (302, ""), (303, " \n "), (None, texts[1]), (None, prose(rng, 30)), (7, texts[7]), (7, prose(rng, 25)), (304, "a very long text " * 20000)]
    rows = [(i, t, "en", f"s{k % 3}" if k % 9 else None, len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(CLASH):
        df = df.withColumn(name, F.lit(f"own {k}"))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(bool(i % 4)), 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, labels


def run_stage(spark, name, docs, path):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, path)
    if name != "token codes":
        assert out.columns == docs.columns
        assert all(r[c] == f"own {k}" for r in out.collect() for k, c in enumerate(CLASH))
    return out


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_stages(spark, tables, tmp_path):
    path, labels = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = rows_of(docs)

    # quality: Gaussian log densities with determinants and inverses of the same shrunk covariances
    kept = run_stage(spark, "quality", docs, path)
    kept.write.parquet(f"{tmp_path}/1")
    import pyarrow as pa

    x = textstats.transform(textstats.count_texts(pa.array([r[1] for r in before], pa.string())))
    by_id = dict(zip([r[0] for r in before], range(len(before))))
    known = [(k, y) for k, r in enumerate(before) for i, y, _ in labels if r[0] == i and zlib.crc32(str(i).encode()) % 5 != 0]
    assert len(known) > len(by_id) // 2
    parts, pooled = {}, 0
    for y in (0, 1):
        own = x[[k for k, v in known if v == y]]
        parts[y] = (own.mean(0), np.cov(own.T, bias=True), len(own))
        pooled = pooled + parts[y][1] * len(own) / len(known)
    logs = []
    for y in (0, 1):
        mean, cov, n = parts[y]
        s = (1 - quality.TO_POOLED) * cov + quality.TO_POOLED * pooled
        s = (1 - quality.TO_IDENTITY) * s + quality.TO_IDENTITY * (np.trace(pooled) / len(s) + 1e-3) * np.eye(len(s))
        d = x - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + np.log(n / len(known)))
    score = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40)))
    want = [r for r, p in zip(before, score) if p >= quality.THRESHOLD]
    assert sorted(rows_of(kept), key=repr) == sorted(want, key=repr) and 0 < len(want) < len(before)

    # near duplicates, over all documents
    def shingles(t):
        w = SOLID.findall(lower(t))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in before]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k, s in enumerate(sets):
        groups.setdefault(root(k) if s else ("alone", k), []).append(k)
    one = run_stage(spark, "near duplicates", docs, path)
    got = rows_of(one)
    assert len(got) == len(groups)
    for members in groups.values():
        ids = [before[k][0] for k in members]
        stays = [r for r in got if r in [before[k] for k in members]]
        least = min((i for i in ids if i is not None), default=None)
        assert any(r[0] == least for r in stays)
    one.write.parquet(f"{tmp_path}/2")

    # decontamination
    passage = spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 1").first()["text"]
    item = ALNUM.findall(lower(passage))
    n = min(10, len(item))
    windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}

    def clean(t):
        w = ALNUM.findall(lower(t))
        return not any(tuple(w[i : i + n]) in windows for i in range(len(w) - n + 1))

    left = run_stage(spark, "decontamination", docs, path)
    want = [r for r in before if clean(r[1])]
    assert sorted(rows_of(left), key=repr) == sorted(want, key=repr) and 300 not in [r[0] for r in want]

    # mixing: the order by digest, taken up to the target, positions by numeric integration
    mixed = run_stage(spark, "mixing", docs, path)
    mixed.write.parquet(f"{tmp_path}/4")
    got = rows_of(mixed)
    assert sorted(got, key=repr) == sorted(((i, t, lang, s, c) for _, i, t, lang, s, c in plain_mix(before)), key=repr)
    for (i, t, *_), (_, j, u, *_) in zip(got, plain_mix(before)):
        assert (i, t) == (j, u)

    # token codes
    codes = run_stage(spark, "token codes", docs, path).collect()
    tokenizer = tokens.Encoder(tokens.tokenizer_path()).tokenizer
    raw = {}
    for i, t, *_ in before:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        raw.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in sorted(codes, key=lambda r: r["start"]):
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in raw[r["doc_id"]]
        at += r["n_tokens"]
    assert len(codes) == len(before)


def plain_mix(rows):
    """(position, doc_id, text, lang, source, n_chars) of the mix in training order."""
    size = lambda t: len(SOLID.findall(t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        free -= full
    out = []
    for s in sources:
        def key(r):
            digest = hashlib.md5((r[1]).encode()).hexdigest() if r[1] is not None else ""
            return hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}:{digest}".encode()).hexdigest()

        own = sorted((r for r in rows if r[3] == s), key=key)
        budget, done = int(target[s] + 0.5), 0
        grid = np.linspace(0, 1, 200_001)
        knots = mixing.SCHEDULES[weight[s]]
        rate = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
        demand = np.r_[0, np.cumsum((rate[1:] + rate[:-1]) / 2)]
        demand /= demand[-1]
        for i, t, lang, source, c in own + own:
            n = size(t)
            take = min(n, budget - done)
            if take > 0:
                cut = t if take == n else t[: list(SOLID.finditer(t))[take - 1].end()]
                out.append((float(np.interp(done / budget, demand, grid)), i, cut, lang, source, c if take == n else len(cut)))
            done += n
    return sorted(out, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def test_positions_match_integration(spark):
    for w, knots in mixing.SCHEDULES.items():
        grid = np.linspace(0, 1, 400_001)
        rate = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
        demand = np.r_[0, np.cumsum((rate[1:] + rate[:-1]) / 2)]
        demand /= demand[-1]
        shares = np.linspace(0, 1, 101)
        df = spark.createDataFrame([(float(x),) for x in shares], "share double")
        got = [r[0] for r in df.select(mixing.position(F.col("share"), F.lit(w))).collect()]
        assert np.allclose(got, np.interp(shares, demand, grid), atol=1e-5)


def test_run_whole(spark, tables):
    path, _ = tables
    got = corpus_pipeline.run(spark, path).orderBy("start").collect()
    assert got and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))
    assert [tuple(r) for r in got] == [tuple(r) for r in corpus_pipeline.run(spark, path).orderBy("start").collect()]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tokens_by_position(spark, tables, tmp_path):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    where = f"{tmp_path}/codes"
    tokens.write_tokens(docs, where, tokens.tokenizer_path(), segment_tokens=2000)
    every = np.concatenate([np.array(r["ids"]) for r in tokens.read_tokens(spark, where).orderBy("start").collect()])
    asked = [0, 1, 1999, 2000, 2001, len(every) // 2, len(every) - 1]
    table = spark.createDataFrame([(p,) for p in asked + [len(every), -1, None, 0]], "position long")
    got = {r["position"]: r["id"] for r in tokens.tokens_at(spark, where, table).collect()}
    assert got == {p: int(every[p]) for p in asked}


def scratch_folders(spark):
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return {x for x in os.listdir(base)}


def test_runs_do_not_touch_each_other(spark, tables, tmp_path):
    """Two runs in two threads, a stage's result read after another stage has run, and nothing left but results."""
    from concurrent.futures import ThreadPoolExecutor

    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    near_result = stages["near duplicates"](spark, docs, path)
    n = near_result.count()
    stages["decontamination"](spark, docs.where("doc_id > 3"), path).count()
    stages["mixing"](spark, docs, path).count()
    assert near_result.count() == n
    before = scratch_folders(spark)
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(lambda _: corpus_pipeline.run(spark, path), range(2))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr) and one.count() > 0
    assert {x.rsplit("-", 1)[0] for x in scratch_folders(spark) - before} == {"token-codes"} and len(scratch_folders(spark) - before) == 2
    assert near_result.count() == n


def test_a_failed_run_leaves_nothing(spark, tables, monkeypatch):
    from quarryline.llm import tokens as t

    path, _ = tables
    before = scratch_folders(spark)
    monkeypatch.setattr(t, "digests", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, path)
    assert scratch_folders(spark) == before
