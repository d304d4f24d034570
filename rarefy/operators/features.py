"""Feature preparation (FEA1-FEA5).

Binary / categorical detection needs no distinct shuffle: a column has at
most two values iff no value differs from both its minimum and maximum, so
two fused single-row aggregates (min/max, then a conditional count) decide
arity for every column at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import IGNORE, feature_columns


def assemble(df: DataFrame, features: Sequence[str] | None = None,
             output: str = "features", handle_invalid: str = "error") -> DataFrame:
    """FEA1: assemble numeric feature columns into one vector column."""
    cols = list(features or feature_columns(df))
    return VectorAssembler(inputCols=cols, outputCol=output,
                           handleInvalid=handle_invalid).transform(df)


def labelled_points(df: DataFrame, features: Sequence[str] | None = None,
                    label: str = "label", keep: Sequence[str] = ("idn",)) -> DataFrame:
    """FEA2: (keep..., label double, features vector)."""
    assembled = assemble(df, features)
    return assembled.select(*keep, F.col(label).cast("double").alias("label"), "features")


def feature_arity(df: DataFrame, features: Sequence[str] | None = None,
                  max_categories: int = 2) -> DataFrame:
    """FEA3/FEA4/FEA5: per feature (index, feature, min, max, arity, categorical).

    ``arity`` is the number of distinct non-NULL values when it is at most
    ``max_categories`` (two at least), else NULL; ``categorical`` = arity <=
    max_categories.  Above two, an approximate count first leaves out the
    features with far more values; the values of the others are then counted
    exactly, a group of at most a few times ``max_categories`` per feature.
    """
    cols = list(features or feature_columns(df, IGNORE))
    if max_categories > 2:
        return _wide_arity(df, cols, max_categories)
    bounds = df.agg(*[F.min(c).cast("double").alias(f"lo_{i}") for i, c in enumerate(cols)],
                    *[F.max(c).cast("double").alias(f"hi_{i}") for i, c in enumerate(cols)])
    # One row of 2 x features numbers, read once and used as literals.
    b = bounds.first()
    lo = {i: F.lit(b[f"lo_{i}"]).cast("double") for i in range(len(cols))}
    hi = {i: F.lit(b[f"hi_{i}"]).cast("double") for i in range(len(cols))}
    third = df.agg(*[
        F.count_if((F.col(c).cast("double") != lo[i]) & (F.col(c).cast("double") != hi[i]))
         .alias(f"x_{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(i).alias("feature_index"), F.lit(c).alias("feature"),
                              lo[i].alias("min_value"), hi[i].alias("max_value"),
                              F.col(f"x_{i}").alias("others"))
                     for i, c in enumerate(cols)])
    out = third.select(F.explode(rows).alias("r")).select("r.*")
    arity = (F.when(F.col("min_value").isNull(), F.lit(0))
             .when(F.col("others") > 0, F.lit(None))
             .when(F.col("min_value") == F.col("max_value"), F.lit(1))
             .otherwise(F.lit(2)))
    return out.select("feature_index", "feature", "min_value", "max_value",
                      arity.cast("int").alias("arity"),
                      F.coalesce(arity <= max_categories, F.lit(False)).alias("categorical"))


def _wide_arity(df: DataFrame, cols: Sequence[str], max_categories: int) -> DataFrame:
    """:func:`feature_arity` for more than two values."""
    values = [F.col(c).cast("double") for c in cols]
    row = df.agg(*[F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(values)],
                 *[F.min(v).alias(f"lo{i}") for i, v in enumerate(values)],
                 *[F.max(v).alias(f"hi{i}") for i, v in enumerate(values)]).first()
    few = [i for i in range(len(cols)) if row[f"d{i}"] <= 2 * max_categories]
    all_features = df.sparkSession.createDataFrame(
        [(i, c, row[f"lo{i}"], row[f"hi{i}"], 0 if row[f"d{i}"] == 0 else None) for i, c in enumerate(cols)],
        "feature_index int, feature string, min_value double, max_value double, none int")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("feature_index"), values[i].alias("v"))
                                          for i in few] or [F.lit(None).cast("struct<feature_index:int,v:double>")]))
                      .alias("c")).select("c.*").where("v is not null").distinct()
    counts = cells.groupBy("feature_index").agg(F.count("v").cast("int").alias("counted"))
    arity = F.coalesce("none", F.when(F.col("counted") <= max_categories, F.col("counted")))
    return (all_features.join(counts, "feature_index", "left")
            .select("feature_index", "feature", "min_value", "max_value", arity.alias("arity"),
                    arity.isNotNull().alias("categorical")))


def fit_indexer(df: DataFrame, input_col: str = "features", output_col: str = "indexedFeatures",
                max_categories: int = 2, handle_invalid: str = "error"):
    """FEA3 with Spark's VectorIndexer (category maps per feature index).

    ``handle_invalid="keep"`` gives a value unseen in ``df`` a category of its own.
    """
    return VectorIndexer(inputCol=input_col, outputCol=output_col, maxCategories=max_categories,
                         handleInvalid=handle_invalid).fit(df)


def category_arity(model) -> dict[int, int]:
    """FEA4: feature index -> number of categories from a fitted indexer."""
    return {int(k): len(v) for k, v in model.categoryMaps.items()}
