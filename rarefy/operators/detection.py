"""Detection-score evaluators (EVA12-EVA20).

Likelihood ratios, per-class Gaussian KDE of the ratio, equal-error rate and
per-class cumulative score curves.  Class roles: ``flag`` 1 = minority
(fraud), 0 = majority (legal).  Global scalars (class sizes, score range,
minimum gap) are one-row aggregates of a written (materialised) table, read
once and used as literals; ordered scans use distributed running totals.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rounded_lr
from ..schema import FRAUD
from .score_table import AXIS_STEP, score_table

# Fixed values.
CURVE_POINTS = 150
CLASS_NAMES = {1: "Fraude", 0: "Legal"}


def with_lr(df: DataFrame, p0: str = "p0", p1: str = "p1", inverse: bool = True,
            label: str = "label", minority: int = FRAUD) -> DataFrame:
    """EVA12: add ``lr`` (ln(p1/p0), 9 digits) and ``flag`` (1 = minority)."""
    return (df.withColumn("lr", rounded_lr(F.col(p0), F.col(p1), inverse))
            .withColumn("flag", (F.col(label) == minority).cast("int")))


def class_counts(df: DataFrame, flag: str = "flag") -> DataFrame:
    """EVA19: one row (n_fraud, n_legal)."""
    return df.agg(F.count_if(F.col(flag) == 1).alias("n_fraud"),
                  F.count_if(F.col(flag) == 0).alias("n_legal"))


def score_range(df: DataFrame, score: str = "lr") -> DataFrame:
    """EVA18: global (lo, hi) of a score over both classes."""
    return df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))


def bandwidth(df: DataFrame, score: str = "lr", flag: str = "flag") -> DataFrame:
    """EVA13/EVA20: per class n, population stddev and h = sd*(4/(3n))^(1/5)."""
    n = F.count(score)
    sd = F.stddev_pop(score)
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.col(flag).alias("flag"))
            .agg(n.alias("n"), sd.alias("sd"),
                 (sd * F.pow(F.lit(4.0) / (F.lit(3.0) * n), F.lit(0.2))).alias("h")))


def axis_values(start: int, end: int) -> list[float]:
    """EVA15: start..end inclusive in steps of 0.5 (built from integers)."""
    return [i * AXIS_STEP for i in range(2 * start, 2 * end + 1)]


def density(df: DataFrame, start: int = -10, end: int = 10, score: str = "lr",
            flag: str = "flag", digits: int | None = 8,
            fixed_bandwidth: float | None = None) -> DataFrame:
    """EVA14: Gaussian KDE of ``score`` per class at the axis points.

    Rows are first reduced to (class, distinct score, count).  One aggregate
    then sums each distinct score's contribution to every axis point, a sum a
    point (the axis is a parameter): no generator and no join against the axis.
    Zero bandwidth (all scores equal) gives NULL densities unless
    ``fixed_bandwidth`` replaces the rule-of-thumb h for every class.
    """
    axis = axis_values(start, end)
    bw = bandwidth(df, score, flag)
    if fixed_bandwidth is not None:
        if fixed_bandwidth <= 0:
            raise ValueError("fixed_bandwidth must be positive")
        bw = bw.withColumn("h", F.lit(float(fixed_bandwidth)))
    groups = (df.where(F.col(score).isNotNull())
              .groupBy(F.col(flag).alias("flag"), F.col(score).alias("s")).count())
    # bw has one row per class: a bounded table.
    staged = groups.join(F.broadcast(bw), "flag")
    sums = [F.sum(F.col("count") * F.exp(
        -F.pow(F.try_divide(F.lit(float(x)) - F.col("s"), F.col("h")), F.lit(2.0)) / F.lit(2.0))) for x in axis]
    # A row a class from here on.
    summed = (staged.groupBy("flag").agg(F.array(*sums).alias("ks"), F.first("n").alias("n"), F.first("h").alias("h"))
              .select("flag", "n", "h", F.posexplode("ks").alias("i", "k")))
    dens = F.try_divide(F.col("k"), F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi)))
    dens = F.when(F.col("h") > 0, dens)
    x = F.lit(float(axis[0])) + F.col("i").cast("double") * F.lit(AXIS_STEP)
    names = F.when(F.col("flag") == 1, F.lit(CLASS_NAMES[1])).otherwise(F.lit(CLASS_NAMES[0]))
    return summed.select(
        F.round(x, 1).alias("x"),
        (F.round(dens, digits) if digits is not None else dens).alias("y"),
        names.alias("type"))


def eer(df: DataFrame, mode: str = "standard", score: str = "lr", flag: str = "flag",
        buckets: int | None = None) -> DataFrame:
    """EVA16: equal-error rate -> one row (eer [percent], lr, state).

    standard: over distinct scores in ascending order, Pmiss = cumFraud/nF,
      Pfa = (nL - cumLegal)/nL, evaluated at the end of each tie group.
    reference: row by row in the order (score, fraud first) with
      0-based position i, Pmiss = (i - cumFraud)/nF and Pfa = (nL - cumFraud)/nL.
    The minimum of |Pmiss - Pfa| is found on the exact integer
    |a*nL - b*nF|; among the minimisers the lower median row is returned;
    state = 1 iff the minimum is within 1e-5.  An empty class gives one row
    with NULL eer/lr and state 0.  Rows without a score or class take no part.
    """
    one = df.sparkSession.range(1).select(F.col("id").alias("_set"))
    sets = df.select(F.lit(0).cast("bigint").alias("_set"), F.col(score).alias("_score"), F.col(flag).alias("_flag"))
    table = score_table(sets, ["_set"], F.col("_score"), F.col("_flag") == 1, buckets=buckets, write=False)
    return one.join(table.eer(mode), "_set", "left").select(
        "eer", "lr", F.coalesce("state", F.lit(0)).alias("state"))


def score_curves(df: DataFrame, points: int = CURVE_POINTS, score: str = "lr",
                 flag: str = "flag", digits: int | None = 9) -> DataFrame:
    """EVA17: per-class cumulative share of scores below each of ``points`` edges.

    Edges run evenly from the global minimum to the maximum (the last edge is
    the maximum itself).  y at edge i is count(score < edge_i)/n for i < last
    and 1 at the last edge (closed last bucket).  Rows are reduced to
    (class, bucket) counts; the running sum runs over the small
    (class x points) table.  A zero range puts every row in the last bucket.
    """
    s = df.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), F.col(flag).alias("flag"))
    # Two numbers, read once by the driver and used as literals.
    rng = score_range(s, "s").first()
    lo, hi = F.lit(rng["lo"]).cast("double"), F.lit(rng["hi"]).cast("double")
    last = points - 2
    width = (hi - lo) / F.lit(float(points - 1))
    bucket = F.when(width == 0, F.lit(last)).otherwise(
        F.least(F.floor((F.col("s") - lo) / width), F.lit(last))).cast("int")
    hist = s.groupBy("flag", bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    spark = df.sparkSession
    edges = spark.range(points).select(
        F.col("id").cast("int").alias("i"),
        F.explode(F.array(F.lit(1), F.lit(0))).alias("flag"))
    joined = edges.join(hist.withColumn("i", F.col("b") + 1), ["flag", "i"], "left")
    w = Window.partitionBy("flag").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cum = joined.withColumn("cum", F.sum(F.coalesce(F.col("c"), F.lit(0))).over(w))
    tot = Window.partitionBy("flag")
    y = F.try_divide(F.col("cum").cast("double"), F.max("cum").over(tot).cast("double"))
    x = F.when(F.col("i") == points - 1, hi).otherwise(lo + width * F.col("i"))
    names = F.when(F.col("flag") == 1, F.lit("fraude")).otherwise(F.lit("legal"))
    return cum.select(
        F.col("i"), (F.round(x, digits) if digits is not None else x).alias("x"),
        (F.round(y, digits) if digits is not None else y).alias("y"), names.alias("type"))
