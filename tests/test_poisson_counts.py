"""Every count has its row in the Poisson check, beyond 20 too."""

import math

from quarryline.operators import models


def test_counts_beyond_20(spark):
    counts = [0, 0, 3, 20, 21, 25, 25, 180, None]
    got = {r["x"]: r for r in models.poisson_fit_check(spark.createDataFrame([(c,) for c in counts], "c long"), "c").collect()}
    known = [c for c in counts if c is not None]
    m = sum(known) / len(known)
    assert set(got) == set(known) and sum(r["n"] for r in got.values()) == len(known)
    for x, r in got.items():
        assert abs(r["observed"] - known.count(x) / len(known)) < 1e-8
        assert abs(r["expected"] - math.exp(x * math.log(m) - m - math.lgamma(x + 1))) < 1e-8
