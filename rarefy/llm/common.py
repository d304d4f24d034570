"""Helpers shared by the operators: row ids, staged tables, worker functions."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise, read_table

__all__ = ["WORD", "SPACE", "read_table", "materialise", "on_workers", "public_vocabulary",
           "text_or_empty", "word_count", "with_row_id", "number_rows", "buckets_for",
           "free_name", "quoted", "scaled_components", "finite_vector", "list_matrix"]

# Fixed patterns of the contracts: a word and the ASCII white space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

EXACT_DOUBLE = float(1 << 53)

ROOT = str(Path(__file__).resolve().parents[2])


def on_workers(fn: Callable, *args, **kwargs) -> Callable:
    """``fn`` of an importable module as a function for ``mapInArrow`` / ``applyInPandas``.

    The worker imports the module by name, so module-level caches (a loaded
    vocabulary, encoded words) live as long as the reused worker process.
    """
    module, name, root = fn.__module__, fn.__qualname__, ROOT

    def run(rows):
        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), name)(rows, *args, **kwargs)
    return run


def public_vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file (every node has the package)."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Words of the whole text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("bigint")


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A unique id per row.  Stable only once the frame is written: stage it."""
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def buckets_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def number_rows(df: DataFrame, within: Sequence[str], row: str, name: str,
                buckets: int | None = None) -> DataFrame:
    """Gapless numbers from 0 inside each ``within`` group, however large a group is.

    A window over the group alone would number a group holding a third of all
    rows in one task.  Rows are dealt into hash buckets of their unique
    ``row`` id; buckets are counted (one small row per group and bucket),
    their offsets are summed inside the group, and rows are numbered inside
    (group, bucket).
    """
    n = buckets or 4 * buckets_for(df.sparkSession)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(row), F.lit(n)).cast("int"))
    counts = dealt.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*within).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*within, "_bucket",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*within, "_bucket").orderBy(row)
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1)
    return (ranked.join(offsets, [*within, "_bucket"])
            .withColumn(name, (F.col("_offset") + F.col("_in")).cast("bigint"))
            .drop("_bucket", "_in", "_offset"))


def scaled_components(embedding: str, scale: int) -> Column:
    """floor(scale * x) of every component, as whole doubles."""
    def floor(v):
        # From 2^53 on every double is whole (and may be beyond 64 bits).
        scaled = F.lit(float(scale)) * v.cast("double")
        return F.when(F.abs(scaled) < EXACT_DOUBLE, F.floor(scaled).cast("double")).otherwise(scaled)
    return F.transform(F.col(embedding), floor)


def finite_vector(embedding: str) -> Column:
    """No component is null, infinite or no number."""
    return F.forall(F.col(embedding), lambda v: F.coalesce(
        F.abs(v.cast("double")) < F.lit(float("inf")), F.lit(False)))


def list_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors count as padded with zeros."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values).astype(np.float64, copy=False)
    n = np.diff(offsets)
    if len(n) and (n == width).all():
        return values[offsets[0]:offsets[-1]].reshape(-1, width)
    out = np.zeros((len(n), width))
    for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, :e - s] = values[s:e]
    return out
