"""Node impurities of a binary label, shared by the stumps and the level-wise grower."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def impurity(n: Column, n1: Column, kind: str) -> Column:
    """gini or entropy of ``n1`` positives among ``n`` (NULL where n is 0)."""
    p1 = F.try_divide(n1, n)
    p0 = F.try_divide(n - n1, n)
    if kind == "gini":
        return F.lit(1.0) - p1 * p1 - p0 * p0

    def term(p):
        return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
    return term(p1) + term(p0)
