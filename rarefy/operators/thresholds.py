"""Candidate thresholds of the level-wise grower (ENS1).

Pooled: of all trees' balanced rows together (:func:`feature_thresholds`).
By tree: of each tree's own rows, by weight (:func:`tree_thresholds`):

1. a pooled grid of ``GRID_FACTOR`` x ``max_bins`` cells per feature;
2. one aggregate of (tree, feature, cell) into the weight and the least and
   greatest value of a cell: sums and extremes, so partial results merge
   exactly, whatever the partitioning, and fractional weights count as such;
3. a running weight over a tree's cells of a feature (a window of at most
   ``GRID_FACTOR`` x ``max_bins`` rows): all borders between non-empty cells
   where these are at most ``max_bins``, else the borders where the running
   weight passes a multiple of 1 / ``max_bins`` of the whole.

A threshold lies midway between the values of the tree next to its border.  A
feature whose distinct values fit the grid has exact weighted quantiles; else
a rank is off by less than the weight of one cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..sources.tables import materialise

QUANTILE_ACCURACY = 10000
# Cells of the pooled grid per bin of a tree.
GRID_FACTOR = 32


def feature_thresholds(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Per feature, at most ``max_bins - 1`` split thresholds (``x <= t`` goes left).

    Midpoints between all distinct values where there are at most ``max_bins``
    of them, else distinct approximate quantiles.  The distinct values are
    listed only for features whose approximate count is small, so what the
    driver reads is bounded by features x max_bins; quantiles are taken of
    the others only.
    """
    if not features:
        return []
    cols = [F.col(c).cast("double") for c in features]
    row = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    few = [i for i in range(len(features)) if row[f"d{i}"] <= 2 * max_bins]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), cols[i].alias("v")) for i in few]))
        found = df.select(cells.alias("c")).select("c.*").where("v is not null and not isnan(v)")
        for r in found.distinct().collect():
            values[r["f"]].append(r["v"])
    many = [i for i in range(len(features)) if i not in values or len(values[i]) > max_bins]
    quantiles = {}
    if many:
        # One folded literal, however many quantiles.
        qs = F.split(F.lit(",".join(repr(i / max_bins) for i in range(1, max_bins))), ",").cast("array<double>")
        quantiles = df.agg(*[F.percentile_approx(cols[i], qs, QUANTILE_ACCURACY).alias(f"q{i}") for i in many]).first()
    out = []
    for i in range(len(features)):
        vals = sorted(values.get(i, []))
        if i in many:
            out.append(sorted({float(v) for v in quantiles[f"q{i}"] or [] if v is not None and not math.isnan(v)}))
        else:
            out.append([a + (b - a) / 2 for a, b in zip(vals, vals[1:])])
    return out


def bin_columns(df: DataFrame, features: Sequence[str], thresholds: list[list[float]],
                output: str = "bins") -> DataFrame:
    """Add ``bins array<int>``: per feature, the number of thresholds < x."""
    cut = [i for i, ts in enumerate(thresholds) if ts]  # a feature of one value has one bin
    staged = df.select("*", *[F.col(features[i]).cast("double").alias(f"_x_{i}") for i in cut])
    if cut:
        splits = [[-math.inf, *[math.nextafter(t, math.inf) for t in thresholds[i]], math.inf] for i in cut]
        staged = Bucketizer(splitsArray=splits, inputCols=[f"_x_{i}" for i in cut],
                            outputCols=[f"_bin_{i}" for i in cut], handleInvalid="error").transform(staged)
    bins = [F.col(f"_bin_{i}").cast("int") if i in cut else F.lit(0) for i in range(len(features))]
    return (staged.withColumn(output, F.array(*bins).cast("array<int>"))
            .drop(*[f"{kind}_{i}" for i in cut for kind in ("_x", "_bin")]))


def tree_thresholds(balanced: DataFrame, features: Sequence[str], max_bins: int,
                    grid_factor: int = GRID_FACTOR, grid: list[list[float]] | None = None) -> DataFrame:
    """(tree, f, thresholds): per tree and feature, at most ``max_bins - 1`` sorted thresholds.

    ``balanced`` holds (tree, w, <features>).  NULL and NaN values take no part; a
    feature with one value in a tree has no row.  The result is a written
    table of the size of the model; the caller discards it.  ``grid``: the pooled
    grid, where it is known already.
    """
    if grid is None:
        grid = feature_thresholds(balanced, features, grid_factor * max_bins)
    known = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in features])
    filled = balanced.select("tree", F.col("w").cast("double").alias("w"), known.alias("x"))
    names = [f"_v{i}" for i in range(len(features))]
    # Invalid values are put into the first cell here and left out below.
    cells = bin_columns(filled.select("*", *[F.nanvl(F.col("x")[i], F.lit(-math.inf)).alias(n)
                                             for i, n in enumerate(names)]), names, grid, "cell")
    cells = (cells.select("tree", "w", F.posexplode(F.arrays_zip("cell", "x")).alias("f", "v"))
             .select("tree", "w", "f", "v.cell", "v.x").where(~F.isnan("x")))
    summary = cells.groupBy("tree", "f", "cell").agg(
        F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    by_cell = Window.partitionBy("tree", "f").orderBy("cell")
    whole = Window.partitionBy("tree", "f")
    runs = summary.where("w > 0").select(
        "tree", "f", "w", "hi", F.lead("lo").over(by_cell).alias("above"), F.sum("w").over(by_cell).alias("cum"),
        F.sum("w").over(whole).alias("total"), F.count("w").over(whole).alias("n_cells"))
    full = F.floor(F.col("cum") * F.lit(float(max_bins)) / F.col("total"))
    before = F.floor((F.col("cum") - F.col("w")) * F.lit(float(max_bins)) / F.col("total"))
    cuts = (runs.where(F.col("above").isNotNull() & ((F.col("n_cells") <= max_bins) | (full > before)))
            .select("tree", "f", (F.col("hi") + (F.col("above") - F.col("hi")) / 2).alias("t")))
    return materialise(cuts.groupBy("tree", "f").agg(F.array_sort(F.collect_list("t")).alias("thresholds")))


def _steps(max_size: int) -> list[int]:
    """Powers of two, descending, whose sum reaches ``max_size``."""
    return [1 << k for k in reversed(range(max(1, max_size).bit_length()))]


def bin_by_tree(balanced: DataFrame, features: Sequence[str], cuts: DataFrame,
                output: str = "bins") -> DataFrame:
    """Add ``bins array<int>``: per feature, the number of the tree's thresholds < x.

    A binary search inside the row; NULL and NaN lie above every threshold.
    The thresholds come by an equi-join on the tree.
    """
    most = cuts.agg(F.max(F.size("thresholds"))).first()[0] or 0
    steps = F.array(*[F.lit(k) for k in _steps(most)])
    per_tree = cuts.groupBy("tree").agg(
        F.map_from_entries(F.collect_list(F.struct("f", "thresholds"))).alias("_cuts"))

    def place(i: int) -> Column:
        x = F.coalesce(F.col(features[i]).cast("double"), F.lit(math.nan))
        ts = F.coalesce(F.try_element_at("_cuts", F.lit(i)), F.array().cast("array<double>"))
        # Looked up once per row, and not in every step of the search.
        return bind(F.struct(ts.alias("ts"), x.alias("x")), lambda own: F.aggregate(
            steps, F.lit(0), lambda at, k: F.when(F.get(own["ts"], at + k - 1) < own["x"], at + k).otherwise(at)))

    found = balanced.join(per_tree, "tree", "left")
    return found.withColumn(output, F.array(*[place(i) for i in range(len(features))])).drop("_cuts")


def side_bin(name: str, thresholds: Sequence[float]) -> Column:
    """Bin of a feature with at most one threshold; NULL and NaN lie above it."""
    if not thresholds:
        return F.lit(0)
    return F.when(F.col(name).cast("double") <= F.lit(thresholds[0]), F.lit(0)).otherwise(F.lit(1))


def category_bins(name: str) -> Column:
    """The code of a categorical feature as its bin; -1 for NULL, NaN and negative values."""
    x = F.col(name).cast("double")
    return F.when((x >= 0) & ~F.isnan(x), x.cast("int")).otherwise(F.lit(-1))
