"""A value computed once for all its uses inside a higher-order expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda's body is evaluated for every element, with all it holds: an outer
    value that costs more than a look-up belongs in here.
    """
    return F.transform(F.array(value), body)[0]
