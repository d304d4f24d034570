"""Scans of the input tables (SRC1-SRC7)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..schema import NON_NUMERIC
from ..session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (``<dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan(df: DataFrame, columns: Sequence[str] | None = None,
         filters: str = "", partitions: int | None = None) -> DataFrame:
    """SRC1/SRC2/SRC3/SRC7: projection by name, optional SQL filter string.

    The filter is a Catalyst expression right on the scan, so it reaches the
    Parquet reader as a pushed filter.  ``partitions`` coalesces only when
    asked; AQE sizes partitions otherwise.
    """
    out = df.select(*columns) if columns else df
    if filters and filters.strip():
        out = out.where(filters)
    if partitions:
        out = out.coalesce(partitions)
    return out


def numeric_view(df: DataFrame) -> DataFrame:
    """SRC4: the scan without the non-feature response columns."""
    return df.drop(*NON_NUMERIC)


def materialise(df: DataFrame, path: str | None = None, table: str | None = None,
                group_bytes: int | None = None) -> DataFrame:
    """SRC5/SRC6: cut lineage by writing a table and reading it back.

    ``table``: a catalog name; ``path``: a folder on shared storage.  Without
    either, a fresh folder under the shared ``spark.checkpoint.dir`` is used.
    Writing Parquet computes the frame once (a reliable ``checkpoint()`` of
    an unpersisted frame computes it twice) and the re-read scan carries file
    sizes, so the planner sees real statistics.  A table in that folder is
    deleted by ``session.discard`` or at the end of a ``scratch_scope``.
    ``group_bytes``: size of the row groups, for tables of large values.
    """
    spark = df.sparkSession
    if table:
        df.write.mode("overwrite").saveAsTable(table)
        return spark.table(table)
    target = path or scratch_path(spark, f"table-{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(target)
    out = spark.read.parquet(target)
    if not path:
        out._scratch = target  # what session.discard deletes
    return out


def reuse_or_build(spark: SparkSession, table: str, build) -> DataFrame:
    """SRC5: read a precomputed catalog table when present, else build and save it."""
    if spark.catalog.tableExists(table):
        return spark.table(table)
    return materialise(build(), table=table)
