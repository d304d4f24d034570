"""Vote combiners over per-tree probabilities (ENS4, ENS5, ENS6, ENS8).

Input: a frame with ``p1s array<double>``, the P(minority) of every tree for
the row.  All combiners are higher-order array expressions evaluated inside
the row, so scoring needs no shuffle (a long (row, tree) table would need a
group-by on the row id).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clipped_ln
from ..schema import FRAUD, LEGAL

STRATEGIES = ("soft", "hard", "mean")


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, p: acc + f(p))


def vote_count(p1s: Column) -> Column:
    """Trees whose leaf predicts the minority: p1 > 0.5 (a tie votes majority)."""
    return F.size(F.filter(p1s, lambda p: p > 0.5))


def log_sums(p1s: Column) -> tuple[Column, Column]:
    """(L1, L0) = sums of clipped ln(p1_t) and ln(1 - p1_t)."""
    return _sum(p1s, clipped_ln), _sum(p1s, lambda p: clipped_ln(F.lit(1.0) - p))


def soft_probabilities(p1s: Column, strict: bool = False) -> tuple[Column, Column]:
    """Product rule: P1 = e^L1 / (e^L1 + e^L0).

    Default: the overflow-free form P1 = 1 / (1 + e^(L0 - L1)).  ``strict``
    evaluates the product literally; when both products underflow to 0 the
    result is undefined (NULL here, NaN in a plain double division).
    """
    return soft_of_sums(*log_sums(p1s), strict)


def soft_of_sums(l1: Column, l0: Column, strict: bool = False) -> tuple[Column, Column]:
    """(P0, P1) of :func:`soft_probabilities` from the sums of logarithms."""
    if strict:
        e1, e0 = F.exp(l1), F.exp(l0)
        return F.try_divide(e0, e1 + e0), F.try_divide(e1, e1 + e0)
    return (F.lit(1.0) / (F.lit(1.0) + F.exp(l1 - l0)),
            F.lit(1.0) / (F.lit(1.0) + F.exp(l0 - l1)))


def combine(df: DataFrame, strategy: str = "soft", p1s: str = "p1s",
            minority: int = FRAUD, majority: int = LEGAL,
            strict: bool = False) -> DataFrame:
    """Add ``p0, p1, n_trees, n_votes, predicted_label`` from ``p1s``.

    soft: product rule; the minority wins if P1 > P0 **or** a majority of
          trees votes for it (ties -> majority).
    hard: P1 = share of trees voting minority; minority iff P1 > P0.
    mean: P1 = mean leaf probability; minority iff P1 > P0.
    Unknown strategies warn and fall back to soft (strategy names are
    case-insensitive).
    """
    # Each sum over the trees is a column, so the probabilities and the label share it.
    name = (strategy or "").lower()
    if name not in STRATEGIES:
        warnings.warn(f"unknown vote strategy {strategy!r}; using soft", stacklevel=2)
        name = "soft"
    arr = F.col(p1s)
    df = df.withColumns({"n_trees": F.size(arr), "n_votes": vote_count(arr)})
    n, ones, p0, p1 = (F.col(c) for c in ("n_trees", "n_votes", "p0", "p1"))
    if name == "soft":
        sums = dict(zip(("_l1", "_l0"), log_sums(arr)))
        of_sums = soft_of_sums(*map(F.col, sums), strict)
        df = df.withColumns(sums).withColumns(dict(zip(("p0", "p1"), of_sums))).drop(*sums)
        wins = (F.coalesce(~F.isnan(p1) & (p1 > p0), F.lit(False))) | (ones > n - ones)
    elif name == "hard":
        df = df.withColumns({"p0": (n - ones) / n, "p1": ones / n})
        wins = p1 > p0
    else:
        df = df.withColumn("_mean", _sum(arr, lambda p: p) / n)
        df = df.withColumns({"p0": F.lit(1.0) - F.col("_mean"), "p1": F.col("_mean")}).drop("_mean")
        wins = p1 > p0
    return df.withColumn("predicted_label", F.when(wins, F.lit(minority)).otherwise(F.lit(majority)))
