"""Poisson counts by inverse CDF of a per-row uniform.

The CDF table depends only on the mean, so it is computed once (a one-row
frame holding K+1 doubles) and enters the rows' expression as literals; a
row's count is the number of CDF values <= u.  K is chosen so that the CDF
equals 1.0 in double precision, so no tail is cut off.  A large mean would
underflow exp(-mean): its count is the sum of independent draws of equal
smaller means (:func:`draws_for`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binding import bind


# Largest mean of a single draw: exp(-256) is far from underflow.
MAX_MEAN = 256.0


def draws_for(mean: float) -> int:
    """Independent draws whose means add up to ``mean`` and are at most ``MAX_MEAN``."""
    return max(1, math.ceil(mean / MAX_MEAN))


def cdf_length(lam: Column) -> Column:
    """Number of terms after which the Poisson CDF is 1.0 in doubles."""
    return F.ceil(lam + F.lit(12.0) * F.sqrt(lam) + F.lit(30.0)).cast("int")


def poisson_cdf_frame(spark: SparkSession, lam: Column) -> DataFrame:
    """One row, column ``cdf``: [CDF(0), CDF(1), ..., CDF(K)] for mean ``lam``.

    pmf(k) = pmf(k-1) * lam / k, accumulated left to right.  ``lam`` may be a
    scalar subquery; it is projected first because lambdas cannot hold one.
    """
    m = F.col("lam")
    start = F.struct(F.exp(-m).alias("pmf"), F.exp(-m).alias("cdf"),
                     F.array(F.exp(-m)).alias("acc"))

    def step(s, k):
        pmf = s["pmf"] * m / k
        cdf = s["cdf"] + pmf
        return F.struct(pmf.alias("pmf"), cdf.alias("cdf"),
                        F.array_append(s["acc"], cdf).alias("acc"))

    seq = F.sequence(F.lit(1), cdf_length(m))
    return (spark.range(1).select(lam.alias("lam"))
            .select(F.aggregate(seq, start, step)["acc"].alias("cdf")))


def poisson_count(u: Column, cdf: Column) -> Column:
    """#{k >= 0 : CDF(k) <= u}: a Poisson draw for the uniform ``u``, computed once and not per step."""
    return bind(u, lambda v: F.size(F.filter(cdf, lambda c: c <= v)))
