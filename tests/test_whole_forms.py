"""m1 returns the vectors of all rows; g2 and t10 have long forms over all nodes and features."""

import os

import pytest

from quarryline.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_m1_returns_vectors(spark):
    got = CATALOG["m1_features"][0](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert {len(r["features"]) for r in got} == {3 + 2 + 1} and len({tuple(r["features"]) for r in got}) > 100


def test_long_forms_hold_every_feature(spark):
    got = CATALOG["t10_cooccurrence_long"][0](spark, SF).select("feature").distinct().count()
    assert got == spark.read.parquet(f"{SF}/customer.parquet").select("c_nationkey").distinct().count() > 2
    assert CATALOG["g2_adjacency_long"][0](spark, SF).select("dst").distinct().count() > 2
