"""Column roles of a transaction table (D1-D3, PRJ1-PRJ3, FLT1-FLT2, RLB1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that are never features.
IGNORE = ("idn", "label", "resp_code", "fraude", "nolabel")
# Response columns dropped by the numeric view.
NON_NUMERIC = ("resp_code", "fraude", "nolabel")
# Label domain.
FRAUD = 1
LEGAL = -1
UNLABELLED = 0
# Answered response codes kept by the labelled filter.
ANSWERED_CODES = (1, 2)

ID = "idn"
LABEL = "label"


def feature_columns(df: DataFrame, ignore: Sequence[str] = IGNORE) -> list[str]:
    """PRJ2: every column that is not in the ignore list, in table order."""
    skip = set(ignore)
    return [c for c in df.columns if c not in skip]


def labelled(df: DataFrame) -> DataFrame:
    """FLT1: labelled and answered rows, ``label <> 0 AND resp_code IN (1, 2)``."""
    return df.where((F.col(LABEL) != UNLABELLED)
                    & F.col("resp_code").isin(*ANSWERED_CODES))


def is_minority(label: Column | str = LABEL, minority: int = FRAUD) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return c == minority


def to_binary(label: Column | str = LABEL, minority: int = FRAUD) -> Column:
    """RLB1: minority -> 1.0, anything else -> 0.0 (the training label)."""
    return F.when(is_minority(label, minority), F.lit(1.0)).otherwise(F.lit(0.0))
