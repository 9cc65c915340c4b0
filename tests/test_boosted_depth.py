"""The boosted trees have the survey's depth and iterations."""

from quarryline.operators import models


def test_boosted_depth(spark):
    m = models.CLASSIFIERS["boosted"]("label")
    assert (m.getMaxDepth(), m.getMaxIter()) == (10, 10)
