"""Distributed running totals in a global order.

A window ordered without a partition key moves every row into one task.
Instead the rows are range-partitioned on the full sort key (so even a tie
group holding a third of all rows is split by the later key columns), each
range bucket is summed (one row per bucket, a bounded table), bucket offsets
are prefix-summed on that small table and broadcast, and the running total
inside a bucket is an ordinary partitioned window plus its offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise

# Bits of a row's place in its partition, of ``monotonically_increasing_id``.
PLACE_BITS = 33


def running_totals(df: DataFrame, order: Sequence[Column | str],
                   sums: Mapping[str, Column | str] | None = None,
                   position: str = "pos", buckets: int | None = None) -> DataFrame:
    """Add ``position`` (1-based global row number) and inclusive running sums.

    ``order`` must be a total order (append a unique key to break ties).
    ``sums`` maps output column name -> column to accumulate.  ``buckets``
    defaults to the session's shuffle partitions.

    The ranged rows are written once, bucket number included: bucket totals and
    bucket rows are then read from one table.  Derived from the lazy frame,
    each would sample its own range bounds and offsets would belong to other
    buckets than the rows.
    """
    sums = dict(sums or {})
    n = buckets or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    vals = {name: (F.col(v) if isinstance(v, str) else v) for name, v in sums.items()}
    staged = df.select("*", *[v.alias(f"_v_{name}") for name, v in vals.items()])
    ranged = materialise(staged.repartitionByRange(n, *order_cols)
                         .withColumn("_bucket", F.spark_partition_id()))
    totals = ranged.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_t_n"),
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in vals])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket",
        F.coalesce(F.sum("_t_n").over(before), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
          for name in vals])
    # ``offsets`` has one row per range bucket: its size is bounded by ``buckets``.
    joined = ranged.join(F.broadcast(offsets), "_bucket")
    inside = (Window.partitionBy("_bucket").orderBy(*order_cols)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = joined.withColumn(position, F.row_number().over(
        Window.partitionBy("_bucket").orderBy(*order_cols)) + F.col("_o_n"))
    for name in vals:
        out = out.withColumn(name, F.sum(f"_v_{name}").over(inside) + F.col(f"_o_{name}"))
    drop = ["_bucket", "_o_n"] + [f"_o_{n}" for n in vals] + [f"_v_{n}" for n in vals]
    return out.drop(*drop)


def positions(df: DataFrame, order: Sequence[Column | str], position: str = "pos",
              buckets: int | None = None) -> DataFrame:
    """``df`` with ``position`` only, as :func:`running_totals` gives it: rows are numbered as they are written.

    One shuffle and one sort.  A window by bucket needs a second of each, and as hashes of
    few bucket numbers collide, some of its tasks sort several buckets.
    """
    n = buckets or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialise(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("_at", F.monotonically_increasing_id()))
    bucket = F.shiftright("_at", PLACE_BITS)
    totals = ranged.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_t_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range bucket: its size is bounded by ``buckets``.
    offsets = totals.select("_bucket", F.coalesce(F.sum("_t_n").over(before), F.lit(0)).alias("_o_n"))
    joined = ranged.withColumn("_bucket", bucket).join(F.broadcast(offsets), "_bucket")
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return joined.withColumn(position, place + F.lit(1) + F.col("_o_n")).drop("_bucket", "_o_n", "_at")
