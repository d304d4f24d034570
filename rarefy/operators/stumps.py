"""Depth-1 trees on binary features, all trees in one aggregate (ENS1 at depth 1).

For every tree of the balanced ensemble and every binary feature the
weighted class counts of the two sides come from one group-by over the long
balanced table (tree, w, y, features) unpivoted to (tree, feature, value);
gains follow from those counts, and each tree keeps its best split (highest
gain, rounded to 12 digits; ties -> lowest feature index).  This is one level
of a level-wise grower: the work is one pass over the balanced rows for all
trees together, and the aggregated table has trees x features x 2 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .impurity import impurity as _impurity

GAIN_DIGITS = 12


def stump_splits(balanced: DataFrame, features: Sequence[str], impurity: str = "gini",
                 digits: int | None = 9) -> DataFrame:
    """Best depth-1 split per tree.

    ``balanced``: (tree, w, y, <binary features with values 0/1>).
    Output: (tree, feature_index, feature, gain, left_p1, right_p1), one row
    per tree that has a split with positive gain; left = value 0.
    """
    kind = impurity.lower()
    cells = F.array(*[F.struct(F.lit(i).alias("fi"), F.col(c).cast("int").alias("x"))
                      for i, c in enumerate(features)])
    long = balanced.select("tree", "w", "y", F.explode(cells).alias("c"))
    sides = (long.groupBy("tree", F.col("c.fi").alias("fi"))
             .agg(F.sum(F.when(F.col("c.x") == 0, F.col("w")).otherwise(0)).cast("double").alias("nl"),
                  F.sum(F.when(F.col("c.x") == 0, F.col("w") * F.col("y")).otherwise(0))
                   .cast("double").alias("n1l"),
                  F.sum(F.when(F.col("c.x") != 0, F.col("w")).otherwise(0)).cast("double").alias("nr"),
                  F.sum(F.when(F.col("c.x") != 0, F.col("w") * F.col("y")).otherwise(0))
                   .cast("double").alias("n1r")))
    n = F.col("nl") + F.col("nr")
    n1 = F.col("n1l") + F.col("n1r")
    gain = (_impurity(n, n1, kind)
            - F.col("nl") / n * _impurity(F.col("nl"), F.col("n1l"), kind)
            - F.col("nr") / n * _impurity(F.col("nr"), F.col("n1r"), kind))
    scored = (sides.where((F.col("nl") > 0) & (F.col("nr") > 0))
              .withColumn("gain", F.round(gain, GAIN_DIGITS)))
    best = Window.partitionBy("tree").orderBy(F.col("gain").desc(), F.col("fi"))
    names = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("fi") + 1)

    def r(c):
        return F.round(c, digits) if digits is not None else c
    return (scored.withColumn("_rk", F.row_number().over(best))
            .where((F.col("_rk") == 1) & (F.col("gain") > 0))
            .select("tree", F.col("fi").alias("feature_index"), names.alias("feature"),
                    r(F.col("gain")).alias("gain"),
                    r(F.col("n1l") / F.col("nl")).alias("left_p1"),
                    r(F.col("n1r") / F.col("nr")).alias("right_p1")))


def stump_nodes(splits: DataFrame) -> DataFrame:
    """Node table of the stumps (root split + two leaves) for importances."""
    root = splits.select("tree", F.lit(0).alias("id"), "feature_index", "gain",
                         F.lit(1).alias("left_child"))
    leaves = splits.select("tree", F.explode(F.array(F.lit(1), F.lit(2))).alias("id"),
                           F.lit(None).cast("int").alias("feature_index"),
                           F.lit(None).cast("double").alias("gain"),
                           F.lit(-1).alias("left_child"))
    return root.unionByName(leaves)
