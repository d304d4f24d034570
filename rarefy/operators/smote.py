"""SMOTE minority oversampling (BAL3) on the neighbour join.

New rows lie between a minority row and one of its k nearest minority
neighbours: ``a + u (b - a)``.  Every choice is an md5 uniform of (tag, seed,
row id, number), so the same table gives the same rows on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..schema import FRAUD, ID, LABEL, is_minority
from ..sources.tables import materialise
from .neighbours import BLOCK, TABLES, coordinate_scale, nearest_neighbours, points, standardised
from .prefix import running_totals

NEIGHBOURS = 5


def smote_draws(near: DataFrame, n_new: int, seed: str = "0") -> DataFrame:
    """``_row, id, j, to, to_id, gap``: which neighbour each of ``n_new`` new rows goes to, and how far.

    ``near``: a written (``_row, id, near``).  New rows are dealt evenly: in the
    order of (id, row), each row gets the whole part of its share and the rest
    falls at equal distances.  A row without neighbours goes to itself.
    """
    placed = running_totals(near, ["id", "_row"], position="_pos")
    n = near.count()
    share = F.expr(f"(_pos * {int(n_new)}) div {max(n, 1)} - ((_pos - 1) * {int(n_new)}) div {max(n, 1)}")
    each = (placed.withColumn("_n", share).where("_n > 0")
            .select("_row", "id", "near", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("j")))
    size = F.coalesce(F.size("near"), F.lit(0))
    pick = F.floor(F.greatest(size, F.lit(0)) * hash_uniform("smote:", seed, ":", F.col("id"), ":", F.col("j")))
    chosen = F.try_element_at("near", (pick + 1).cast("int"))
    return (each.withColumn("_to", F.when(size > 0, chosen))
            .select("_row", "id", "j", F.coalesce("_to.row", "_row").alias("to"),
                    F.when(F.col("_to").isNull(), F.col("id")).otherwise(F.col("_to.id")).alias("to_id"),
                    hash_uniform("gap:", seed, ":", F.col("id"), ":", F.col("j")).alias("gap")))


def interpolate(draws: DataFrame, rows: DataFrame, nominal: Sequence[int] = ()) -> DataFrame:
    """``draws`` with the new rows' coordinates ``x``; ``rows``: (``_row, x``).

    Coordinates in ``nominal`` are codes, not amounts: they come from the nearer end.
    """
    a = rows.select("_row", F.col("x").alias("a"))
    b = rows.select(F.col("_row").alias("to"), F.col("x").alias("b"))
    gap = F.col("gap")

    def mix(pair, i):
        between = pair["a"] + gap * (pair["b"] - pair["a"])
        if not nominal:
            return between
        code = F.when(gap < 0.5, pair["a"]).otherwise(pair["b"])
        return F.when(i.isin(*nominal), code).otherwise(between)
    return (draws.join(a, "_row").join(b, "to")
            .withColumn("x", F.transform(F.arrays_zip("a", "b"), mix)).drop("a", "b"))


def nominal_features(df: DataFrame, features: str = "indexedFeatures") -> list[int]:
    """Indices of the features that an indexer marked as categories."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    return sorted(a["idx"] for kind in ("nominal", "binary") for a in attrs.get(kind, []))


def smote(df: DataFrame, percent: int = 100, k: int = NEIGHBOURS, features: str = "indexedFeatures",
          label: str = LABEL, minority: int = FRAUD, idn: str = ID, seed: str = "0",
          block: int = BLOCK, tables: int = TABLES) -> DataFrame:
    """``df``'s (id, label, features) and ``percent`` per cent as many new minority rows.

    Neighbours are searched among minority rows, each coordinate divided by its
    standard deviation.  New rows have a null id.  Repeated rows take part
    each; minority rows whose vector is null or not finite stay and give no
    new rows; without usable minority rows nothing is added.
    """
    own = points(df.where(is_minority(label, minority)), None, features, idn, label)
    usable = own.where("x is not null")
    n = usable.count()
    base = df.select(idn, label, features)
    if not n or percent <= 0:
        return base
    scaled = materialise(standardised(usable, coordinate_scale(usable)))
    near = nearest_neighbours(scaled, k, block=block, tables=tables)
    found = materialise(usable.select("_row", "id").join(near, "_row", "left"))
    made = interpolate(smote_draws(found, n * percent // 100, seed), usable, nominal_features(df, features))
    kinds = dict(df.dtypes)
    new = made.select(F.lit(None).cast(kinds[idn]).alias(idn), F.lit(minority).cast(kinds[label]).alias(label),
                      array_to_vector("x").alias(features))
    return base.unionByName(new)
