"""Documents of groups and languages that are too small for an estimate of their own are judged too."""

import random

import pytest

from quarryline.llm import rules


@pytest.mark.parametrize("rare_lang", ["en", "xx"])
def test_small_groups_are_judged(spark, tmp_path, rare_lang):
    """One hot group; a rare group of its language (judged by the language) or of a rare one (by the table)."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 8)))
    fine = lambda: " ".join(word() for _ in range(rng.randint(60, 120)))
    garbage = lambda: " ".join(word() * 30 + "#$%&|" * 40 for _ in range(40))
    rows = [(i, fine(), "en", "hot") for i in range(600)] + [(1000 + i, fine(), rare_lang, "rare") for i in range(30)]
    rows += [(2000 + i, garbage(), rare_lang, "rare") for i in range(15)] + [(3000, garbage(), "en", "hot")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in rules.op10_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and not any(r["base_failed"] for r in got.values())
    assert [i for i in range(2000, 2015) if got[i]["kept"]] == [] and not got[3000]["kept"]
    assert sum(got[1000 + i]["kept"] for i in range(30)) >= 29 and sum(got[i]["kept"] for i in range(600)) >= 590
