"""Deterministic per-row uniforms built from md5, identical in Spark and DuckDB.

A seeded ``randomSplit``/``sample`` changes with the input partitioning; a
hash of (tag, key) does not, so splits, samples and bootstrap counts are
reproducible on any cluster size and checkable by SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits of md5 give a 52-bit integer, scaled by 2^52.
HEX_DIGITS = 13
TWO_POW_52 = 4503599627370496.0


def _as_col(part) -> Column:
    if isinstance(part, Column):
        return F.coalesce(part.cast("string"), F.lit(""))
    return F.lit(str(part))


def hash_uniform(*parts) -> Column:
    """u in [0, 1): ``conv(substr(md5(concat(parts)), 1, 13), 16, 10) / 2^52``.

    Strings are literal tags (``'label:'``), Columns are row values; a NULL
    value counts as empty, so rows without an id share one draw and are never
    dropped by a comparison with NULL.
    """
    text = F.concat(*[_as_col(p) for p in parts])
    return (F.conv(F.substr(F.md5(text), F.lit(1), F.lit(HEX_DIGITS)), 16, 10)
            .cast("double") / F.lit(TWO_POW_52))


def hash_uniform_sql(*parts: str) -> str:
    """DuckDB form of :func:`hash_uniform`; ``parts`` are SQL expressions."""
    inner = ", ".join(parts)
    return (f"(('0x' || substr(md5(concat({inner})), 1, {HEX_DIGITS}))::BIGINT::DOUBLE"
            f" / {TWO_POW_52}::DOUBLE)")
