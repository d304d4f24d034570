"""K-means sub-sampling of the majority class (BAL2) and the strategy switch (BAL5).

The majority rows are clustered with Spark ML KMeans.  ``k`` is a parameter
that does not follow the class sizes, so the work stays rows x k.  Every
cluster gets a quota in proportion to its size; the quotas sum to the number
of minority rows, so each sample balances the classes.

* ``nearest``: the quota rows closest to the cluster's mean (ties -> lowest id);
* ``stratified``: per tree, quota rows per cluster drawn with replacement by a
  hash of (seed, tree, cluster, draw), so every tree sees a different sample.

Centroids are the means of the assigned rows, one aggregate.  Rows are numbered
by distributed running totals (range-partitioned on the cluster first), so a
cluster holding a third of all rows costs no more than any other: no window
over a cluster, no collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..schema import FRAUD, ID, LABEL, is_minority
from ..sources.tables import materialise
from .prefix import running_totals
from .sampling import balance_plan

DIGITS = 9


# Clusters when the caller does not say: independent of the class sizes.
DEFAULT_K = 32


def fit_clusters(majority: DataFrame, k: int = DEFAULT_K, features: str = "indexedFeatures",
                 seed: int = 1, max_iter: int = 20):
    return KMeans(k=k, featuresCol=features, predictionCol="cluster", seed=seed,
                  maxIter=max_iter).fit(majority)


def assigned_rows(majority: DataFrame, model, features: str = "indexedFeatures",
                  idn: str = ID, keep: Sequence[str] = ()) -> DataFrame:
    """(idn, cluster, x) of the majority rows under a fitted model, written once.

    ``keep``: columns that go along in a struct ``kept``.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    return materialise(model.transform(majority).select(
        F.col(idn).alias("idn"), "cluster", vector_to_array(features).alias("x"), *kept))


def cluster_quotas(assigned: DataFrame, n_minor: int) -> DataFrame:
    """(cluster, m, quota): sizes and quotas by largest remainder, summing to ``n_minor``.

    One row per cluster (a parameter), so the ordered windows are small.
    """
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = sizes.withColumn("total", F.sum("m").over(every)).select(
        "cluster", "m", F.expr(f"({n_minor} * m) div total").alias("whole"),
        F.expr(f"({n_minor} * m) % total").alias("rest"))
    rank = F.row_number().over(Window.orderBy(F.col("rest").desc(), "cluster"))
    left = F.lit(n_minor) - F.sum("whole").over(every)
    return share.select("cluster", "m",
                        (F.col("whole") + F.when(rank <= left, 1).otherwise(0)).cast("bigint").alias("quota"))


def cluster_means(assigned: DataFrame) -> DataFrame:
    """(cluster, center): mean of every coordinate."""
    cells = assigned.select("cluster", F.posexplode("x").alias("i", "v"))
    means = cells.groupBy("cluster", "i").agg(F.avg("v").alias("v"))
    return (means.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
            .select("cluster", F.transform("c", lambda s: s["v"]).alias("center")))


def nearest_picks(assigned: DataFrame, n_minor: int) -> DataFrame:
    """(cluster, idn, dist2): each cluster's quota of rows closest to its mean.

    ``assigned``: a written (idn, cluster, x) table.
    """
    joined = assigned.join(cluster_means(assigned), "cluster")
    d2 = F.aggregate(F.zip_with("x", "center", lambda a, b: (a - b) * (a - b)),
                     F.lit(0.0), lambda acc, v: acc + v)
    far = joined.select("cluster", "idn", F.round(d2, DIGITS).alias("dist2"),
                        F.monotonically_increasing_id().alias("_row"))
    placed = materialise(running_totals(far, ["cluster", "dist2", "idn", "_row"], {}, position="pos"))
    starts = placed.groupBy("cluster").agg(F.min("pos").alias("start"))
    limits = starts.join(cluster_quotas(assigned, n_minor), "cluster")
    return (placed.join(limits, "cluster").where(F.col("pos") < F.col("start") + F.col("quota"))
            .select("cluster", "idn", "dist2"))


def stratified_picks(assigned: DataFrame, n_minor: int, n_trees: int, seed: str = "0") -> DataFrame:
    """Per tree, each cluster's quota of rows drawn with replacement: (tree, idn, w).

    Rows get a global position in (cluster, id) order from distributed
    running totals, so cluster c occupies positions start_c .. start_c+m_c-1.
    Each draw is a position from a hash of (seed, tree, cluster, draw number),
    and an equi-join on the position fetches the row: rows of one id, or
    without one, are drawn each for itself.  A struct ``kept`` of ``assigned``
    goes along.  Work is O(rows + n_minor x trees), not O(rows x trees).
    """
    whole = [c for c in ("cluster", "idn", "kept") if c in assigned.columns]
    # The row number splits ids of many rows over the ranges.
    rows = assigned.select(*whole, F.monotonically_increasing_id().alias("_row"))
    numbered = materialise(running_totals(rows, ["cluster", "idn", "_row"], {}, position="pos"))
    starts = numbered.groupBy("cluster").agg(F.min("pos").alias("start"))
    limits = starts.join(cluster_quotas(assigned, n_minor), "cluster").where("quota > 0")
    per_tree = limits.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    draws = per_tree.select("cluster", "start", "m", "tree",
                            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("quota"))).alias("j"))
    u = hash_uniform("km:", seed, ":", F.col("tree"), ":", F.col("cluster"), ":", F.col("j"))
    at = draws.select(F.col("tree").cast("int").alias("tree"),
                      (F.col("start") + F.floor(F.col("m") * u)).alias("pos"))
    counted = at.groupBy("tree", "pos").agg(F.count(F.lit(1)).cast("int").alias("w"))
    return counted.join(numbered.drop("cluster", "_row"), "pos").select("tree", "w", *whole[1:])


def kmeans_balanced_sets(df: DataFrame, features: str = "indexedFeatures", k: int | None = None,
                         n_trees: int | None = None, seed: str = "0", label: str = LABEL,
                         minority: int = FRAUD, idn: str = ID,
                         keep: list[str] | None = None) -> DataFrame:
    """Long table (tree, w, <keep>) with the k-means sample as each tree's majority.

    The weights of a tree's majority sum to the number of minority rows.
    """
    keep = keep or df.columns
    plan = balance_plan(df, label, minority).first()
    n_minor = int(plan["n_minor"] or 0)
    if n_minor == 0:
        raise ValueError("no minority row: cannot plan a balanced ensemble")
    trees = n_trees if n_trees is not None else int(plan["n_trees"])
    majority = df.where(~is_minority(label, minority))
    model = fit_clusters(majority, k or DEFAULT_K, features)
    picks = stratified_picks(assigned_rows(majority, model, features, idn, keep), n_minor, trees, seed)
    major = picks.select("tree", "w", "kept.*")
    minor = (df.where(is_minority(label, minority))
             .select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
                     F.lit(1).alias("w"), *keep))
    return minor.unionByName(major)


STRATEGIES = ("balanced", "kmeans", "smote", "enn")


def check_strategy(name: str) -> str:
    """BAL5: ``balanced`` (bootstrap), ``kmeans``, or a bootstrap after ``smote`` oversampling or
    ``enn`` instance selection; anything else raises."""
    s = (name or "").lower()
    if s not in STRATEGIES:
        raise ValueError(f"unknown balancing strategy {name!r}; expected one of {STRATEGIES}")
    return s
