"""Feature importances from a node table (IMP1, IMP2).

Per tree, the raw split gains are summed per feature (not weighted by node
size) and normalised to 1; the per-tree vectors are summed and normalised
again.  Trees without a split are skipped.  Everything is a group-by over the
node table, whose size is the model size (trees x nodes), not the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def importances(nodes: DataFrame) -> DataFrame:
    """IMP1: (feature_index, importance) for features used in some split.

    ``nodes``: (tree, feature_index, gain, left_child); internal nodes have
    left_child >= 0.
    """
    per_tree = (nodes.where(F.col("left_child") >= 0)
                .groupBy("tree", "feature_index").agg(F.sum("gain").alias("g")))
    tree_total = F.sum("g").over(Window.partitionBy("tree"))
    normed = (per_tree.withColumn("t", tree_total).where(F.col("t") != 0)
              .select("feature_index", (F.col("g") / F.col("t")).alias("v")))
    summed = normed.groupBy("feature_index").agg(F.sum("v").alias("v"))
    grand = summed.select(F.sum("v")).scalar()
    return summed.select("feature_index",
                         F.when(grand != 0, F.col("v") / grand).otherwise(F.col("v"))
                         .alias("importance"))


def named_importances(nodes: DataFrame, feature_names: Sequence[str],
                      digits: int | None = 9) -> DataFrame:
    """IMP2: (variable, importance) for every feature, 0.0 when never used."""
    spark = nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(feature_names)), "feature_index int, variable string")
    imp = importances(nodes)
    # Both sides have at most one row per feature (bounded by the schema width).
    out = names.join(imp, "feature_index", "left")
    val = F.coalesce(F.col("importance"), F.lit(0.0))
    return out.select("feature_index", "variable",
                      (F.round(val, digits) if digits is not None else val).alias("importance"))
