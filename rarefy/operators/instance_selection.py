"""Instance selection (BAL4): edited nearest neighbours on the neighbour join.

A row whose k nearest neighbours of either class mostly belong to the other
one is noise or lies beyond the class border.  A round judges all rows by the
same table and removes all such rows at once; rounds go on until one removes
none.  Rows only go, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FRAUD, ID, LABEL
from ..session import discard
from ..sources.tables import materialise
from .curve_blocks import numbered, outvoted
from .neighbours import BLOCK, TABLES, coordinate_scale, points, standardised

NEIGHBOURS = 3


def disagreeing(near: Column, y: Column) -> Column:
    """How many neighbours are of another class."""
    return F.size(F.filter(near, lambda s: ~s["y"].eqNullSafe(y)))


def edit_verdicts(rows: DataFrame, near: DataFrame, spare: int | None = None) -> DataFrame:
    """``_row, id, y, n_near, n_other, kept`` of one round.

    A row goes if more than half of its neighbours are of another class; a tie
    and a row without neighbours stay, and so do rows of the class ``spare``.
    """
    joined = rows.select("_row", "id", "y").join(near, "_row", "left")
    n = F.greatest(F.coalesce(F.size("near"), F.lit(0)), F.lit(0))
    other = F.when(n > 0, disagreeing(F.col("near"), F.col("y"))).otherwise(F.lit(0))
    out = joined.select("_row", "id", "y", n.alias("n_near"), other.alias("n_other"))
    kept = 2 * F.col("n_other") <= F.col("n_near")
    if spare is not None:
        kept = kept | F.col("y").eqNullSafe(F.lit(spare))
    return out.withColumn("kept", kept)


def edited(df: DataFrame, k: int = NEIGHBOURS, features: str = "indexedFeatures", label: str = LABEL,
           idn: str = ID, spare: int | None = FRAUD, rounds: int | None = None, block: int = BLOCK,
           tables: int = TABLES) -> DataFrame:
    """The rows of ``df`` that stand after ``rounds`` rounds (none given: until nothing changes).

    ``spare``: a class whose rows are never removed (the rare class by
    default; None edits both).  Coordinates are divided by their standard
    deviation in ``df``.  Repeated rows and null ids are rows of their own;
    rows without a usable vector stay.  Each round's rows are written once, and
    the round before it is deleted.
    """
    staged = points(df, None, features, idn, label, keep=df.columns)
    usable = staged.where("x is not null")
    scale = coordinate_scale(usable)
    live = numbered(standardised(usable.select("_row", "id", "y", "x"), scale)) if scale.mean else None
    done = 0
    n = live.count() if live else 0
    while n and (rounds is None or done < rounds):
        # Rows that stay anyway are searched for nothing.
        gone = outvoted(live, coordinate_scale(live), n, k, block, tables, skip=spare)
        after = materialise(live.join(gone, "ord", "left_anti"))
        discard(live)
        discard(gone)
        live, before, done = after, n, done + 1
        n = live.count()
        if n == before:
            break
    stay = staged.where("x is null").select("kept")
    if live is not None:
        stay = stay.unionByName(staged.join(live.select("_row"), "_row", "left_semi").select("kept"))
    return stay.select("kept.*")
