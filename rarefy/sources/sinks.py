"""Sinks: feature CSV export (SNK1) and report folders (SNK4).

Model persistence (SNK2/SNK3) lives with the model in
:mod:`rarefy.operators.ensemble`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators.sampling import hash_sample
from ..schema import IGNORE, feature_columns, labelled


def feature_export_rows(df: DataFrame, rate: float, seed="0",
                        ignore: Sequence[str] = IGNORE) -> DataFrame:
    """SNK1 row set: labelled filter -> Bernoulli sample -> drop non-features."""
    sample = hash_sample(labelled(df), rate, seed)
    return sample.select(*feature_columns(sample, ignore))


def export_features_csv(df: DataFrame, path: str, rate: float, num_files: int | None = None,
                        seed="0") -> None:
    """SNK1: write the sampled feature rows as CSV with a header; target overwritten.

    ``num_files`` coalesces the output (no shuffle); left unset, every task
    writes its own file.
    """
    rows = feature_export_rows(df, rate, seed)
    if num_files:
        rows = rows.coalesce(num_files)
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_reports(reports: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """SNK4: one sub-folder per report; CSV with header or Parquet."""
    for name, frame in reports.items():
        writer = frame.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(f"{folder.rstrip('/')}/{name}")
        else:
            writer.parquet(f"{folder.rstrip('/')}/{name}")
