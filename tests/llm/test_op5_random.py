"""Random strings among ordinary ones that dominate every stratum."""

import random
import string

from quarryline.llm import secrets


def test_random_strings_are_found(spark):
    rng = random.Random(2)
    words = ["configuration", "management", "international", "development", "environment", "application", "performance"]
    ordinary = ["".join(rng.choice(words) for _ in range(rng.randint(3, 4))) for _ in range(6000)]
    planted = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(32, 48))) for _ in range(600)]
    rows = [(i, f"see {s} here") for i, s in enumerate(ordinary + planted)]
    found = {r["doc_id"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).where("size(sec_spans) > 0").collect()}
    assert sum(i >= len(ordinary) for i in found) >= 0.96 * len(planted)
    assert sum(i < len(ordinary) for i in found) <= 0.2 * len(ordinary)


def test_planted_keys_in_the_given_texts(spark):
    """Keys of many lengths and alphabets among whole documents: nine of ten are found, one in ten found is a word at most."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(7)
    alphabets = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase]
    rows, planted = [], set()
    for i, t in enumerate(texts):
        if i % 4 == 0:
            key = "".join(rng.choice(alphabets[i // 4 % len(alphabets)]) for _ in range(rng.randint(24, 80)))
            planted.add((i, len(t or "") + 1, len(t or "") + 1 + len(key)))
            t = f"{t or ''} {key}"
        rows.append((i, t))
    found = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "sec_spans").collect()
    random_spans = {(r["doc_id"], s["start"], s["end"]) for r in found for s in r["sec_spans"] if secrets.KINDS[s["kind"]] == "random"}
    assert len(planted & random_spans) >= 0.9 * len(planted)
    assert len(random_spans - planted) <= 0.1 * len(random_spans)


def test_words_alone_give_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = secrets.scan_secrets(docs).selectExpr("explode(sec_spans) AS s").where(f"s.kind = {secrets.KINDS.index('random')}").count()
    assert found <= 2  # the strings that pass the fixed patterns by are syllables
