"""One ordered score table behind all evaluators (EVA1-EVA20, O1, O3-O7).

The rows of any number of scored sets, told apart by key columns, are reduced
once to (keys, distinct score) with their class and confusion counts.  One range
exchange orders them and gives the running class counts inside each set.
Every evaluator is then an aggregate of that table, grouped by the keys, so the
number of jobs does not follow the number of scored sets.

Along the order the value of the error balance only grows: by the number of
minority rows or of majority rows a row.  So the rows that come nearest to zero
are at most two, the lower median is the first of them, and inside a group of
equal scores they are found by one division instead of row by row.

Rows without a label take no part.  NULL scores are ranked lowest in the areas
and left out of the rest.  A set is one row of the totals table: its size is
the number of scored sets, so joins to it are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FRAUD, LEGAL
from ..sources.tables import materialise
from .prefix import running_totals

# Fixed values.
EER_TOLERANCE = 1e-5
AXIS_STEP = 0.5
EXACT = "decimal(38,0)"
EER_MODES = ("standard", "reference")


@dataclass
class ScoreTable:
    """``rows``: keys, s, nf, nl, cf, cl (inclusive, inside the set) and the set's ``totals``."""
    rows: DataFrame
    totals: DataFrame
    keys: list[str]

    def confusion(self) -> DataFrame:
        """EVA1: keys, tp, fn, tn, fp."""
        return self.totals.select(*self.keys, "tp", "fn", "tn", "fp")

    def hard_area(self) -> DataFrame:
        """EVA11 of the predicted label: keys, auc."""
        tp, fn, tn, fp = (F.col(c).cast(EXACT) for c in ("tp", "fn", "tn", "fp"))
        double = fp * tp + tn * (F.lit(2) * tp + fn)
        return self.totals.select(*self.keys, _area(double, F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")))

    def area(self) -> DataFrame:
        """EVA11 of the score: keys, auc."""
        twice = F.lit(2) * (F.col("n_f") - F.col("cf")) + F.col("nf")
        sums = self.rows.groupBy(*self.keys).agg(
            F.sum(F.col("nl").cast(EXACT) * twice.cast(EXACT)).alias("num"),
            F.first("n_f").alias("n_f"), F.first("n_l").alias("n_l"))
        return sums.select(*self.keys, _area(F.col("num"), F.col("n_f"), F.col("n_l")))

    def hard_roc(self) -> DataFrame:
        """EVA10 of the predicted label: keys, pos, fpr, tpr, with the frame points."""
        n_pos, n_neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
        high, low = F.col("tp") + F.col("fp") > 0, F.col("fn") + F.col("tn") > 0

        def point(pos: Column, fp: Column, tp: Column) -> Column:
            return F.struct(pos.cast("bigint").alias("pos"), fp.cast("double").alias("fpr"), tp.cast("double").alias("tpr"))
        ups, downs = high.cast("int"), low.cast("int")
        found = F.array(
            point(F.lit(0), F.lit(0), F.lit(0)),
            F.when(high, point(F.lit(1), F.try_divide(F.col("fp").cast("double"), n_neg),
                               F.try_divide(F.col("tp").cast("double"), n_pos))),
            F.when(low, point(ups + 1, F.try_divide(n_neg.cast("double"), n_neg),
                              F.try_divide(n_pos.cast("double"), n_pos))),
            point(ups + downs + 1, F.lit(1), F.lit(1)))
        return self.totals.select(*self.keys, F.explode(F.filter(found, lambda p: p.isNotNull())).alias("p")).select(
            *self.keys, "p.*")

    def eer(self, mode: str = "standard") -> DataFrame:
        """EVA16: keys, eer (per cent), lr, state; see :func:`rarefy.operators.detection.eer`."""
        if mode not in EER_MODES:
            raise ValueError(f"unknown EER mode {mode!r}")
        n_f, n_l = (F.col(c).cast(EXACT) for c in ("s_f", "s_l"))
        both = (F.col("s_f") > 0) & (F.col("s_l") > 0)
        cf, cl = F.col("cf") - (F.col("n_f") - F.col("s_f")), F.col("cl") - (F.col("n_l") - F.col("s_l"))

        def candidate(gap: Column, place: Column, missed: Column) -> Column:
            return F.struct(gap.cast(EXACT).alias("gap"), F.col("s").alias("s"), place.cast("bigint").alias("place"),
                            F.try_divide(missed.cast("double"), F.col("s_l").cast("double")).alias("pfa"))
        if mode == "standard":
            missed = F.col("s_l") - cl
            best = candidate(F.abs(cf.cast(EXACT) * n_l - missed.cast(EXACT) * n_f), F.lit(0), missed)
        else:
            # Before the group: minority rows come first in it, then majority rows.
            f0, l0 = cf - F.col("nf"), cl - F.col("nl")
            start = (l0 - 1).cast(EXACT) * n_l - (F.col("s_l") - f0).cast(EXACT) * n_f
            after = (start + F.col("nf").cast(EXACT) * n_f).cast(EXACT)

            def turn(value: Column, step: Column, size: Column) -> list[Column]:
                """The places 1..size whose value + place * step lies next to zero."""
                value, end = value.cast(EXACT), (value + size.cast(EXACT) * step).cast(EXACT)
                whole = F.call_function("div", (-value).cast(EXACT), step.cast(EXACT))
                low = F.when(value >= 0, F.lit(1)).when(end <= 0, size).otherwise(F.greatest(whole, F.lit(1)))
                return [low, F.least(low + 1, size)]
            tries = [(F.col("nf") > 0, place, F.abs(start + place.cast(EXACT) * n_f), F.col("s_l") - f0 - place, place)
                     for place in turn(start, n_f, F.col("nf"))]
            tries += [(F.col("nl") > 0, place, F.abs(after + place.cast(EXACT) * n_l), F.col("s_l") - cf, place + F.col("nf"))
                      for place in turn(after, n_l, F.col("nl"))]
            best = F.array_min(F.filter(F.array(*[F.when(there, candidate(gap, place, missed))
                                                  for there, _, gap, missed, place in tries]), lambda c: c.isNotNull()))
        picked = (self.rows.where(F.col("s").isNotNull() & both).select(*self.keys, best.alias("best"))
                  .groupBy(*self.keys).agg(F.min("best").alias("best")))
        share = F.col("best.gap").cast("double") / (F.col("s_f").cast("double") * F.col("s_l").cast("double"))
        return self.totals.join(picked, self.keys, "left").select(
            *self.keys, F.round(F.col("best.pfa") * F.lit(100.0), 6).alias("eer"), F.col("best.s").alias("lr"),
            F.when(share <= F.lit(EER_TOLERANCE), F.lit(1)).otherwise(F.lit(0)).alias("state"))

    def by_class(self) -> DataFrame:
        """keys, flag, s, c: the non-NULL scores of each class with their counts."""
        sides = [self.rows.where(F.col("s").isNotNull() & (F.col(c) > 0)).select(
            *self.keys, F.lit(flag).alias("flag"), "s", F.col(c).alias("c")) for flag, c in ((1, "nf"), (0, "nl"))]
        return sides[0].unionByName(sides[1])

    def bandwidth(self) -> DataFrame:
        """EVA13/EVA20: keys, flag, n, sd, h; deviations from the class mean, so equal scores give 0."""
        own, key = self.by_class(), [*self.keys, "flag"]
        low = own.groupBy(*key).agg(F.min("s").alias("low"))
        mean = (own.join(F.broadcast(low), key).groupBy(*key)
                .agg(F.sum("c").alias("n"), (F.first("low") + F.sum(F.col("c") * (F.col("s") - F.col("low"))) / F.sum("c"))
                     .alias("mean")))
        off = F.col("s") - F.col("mean")
        sd = F.sqrt(F.sum(F.col("c") * off * off) / F.first("n"))
        return (own.join(F.broadcast(mean), key).groupBy(*key).agg(F.first("n").alias("n"), sd.alias("sd"))
                .withColumn("h", F.col("sd") * F.pow(F.lit(4.0) / (F.lit(3.0) * F.col("n")), F.lit(0.2))))

    def density(self, start: int, end: int) -> DataFrame:
        """EVA14: keys, flag, x, y; NULL where a class has one score only."""
        axis = [i * AXIS_STEP for i in range(2 * start, 2 * end + 1)]
        key = [*self.keys, "flag"]
        staged = self.by_class().join(F.broadcast(self.bandwidth().select(*key, "n", "h")), key)
        sums = [F.sum(F.col("c") * F.exp(-F.pow(F.try_divide(F.lit(x) - F.col("s"), F.col("h")), F.lit(2.0)) / F.lit(2.0)))
                for x in axis]
        summed = (staged.groupBy(*key).agg(F.array(*sums).alias("ks"), F.first("n").alias("n"), F.first("h").alias("h"))
                  .select(*key, "n", "h", F.posexplode("ks").alias("i", "mass")))
        y = F.try_divide(F.col("mass"), F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi)))
        x = F.lit(axis[0]) + F.col("i").cast("double") * F.lit(AXIS_STEP)
        return summed.select(*key, F.round(x, 1).alias("x"), F.when(F.col("h") > 0, y).alias("y"))

    def curves(self, points: int) -> DataFrame:
        """EVA17: keys, flag, i, x, y; edges from the set's least to its greatest score."""
        last, key = points - 2, [*self.keys, "flag", "i"]
        width = (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
        edges = (self.totals.select(*self.keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
                 .withColumn("flag", F.explode(F.array(F.lit(1), F.lit(0)))))
        bucket = F.when(width == 0, F.lit(last)).otherwise(
            F.least(F.floor((F.col("s") - F.col("lo")) / width), F.lit(last))).cast("int")
        hist = (self.by_class().join(F.broadcast(self.totals.select(*self.keys, "lo", "hi")), self.keys)
                .groupBy(*self.keys, "flag", (bucket + 1).alias("i")).agg(F.sum("c").alias("c")))
        whole = Window.partitionBy(*self.keys, "flag")
        cum = edges.join(hist, key, "left").withColumn("cum", F.sum(F.coalesce("c", F.lit(0))).over(
            whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
        x = F.when(F.col("i") == points - 1, F.col("hi")).otherwise(F.col("lo") + width * F.col("i"))
        y = F.try_divide(F.col("cum").cast("double"), F.max("cum").over(whole).cast("double"))
        return cum.select(*key, x.alias("x"), y.alias("y"))


def _area(double: Column, n_pos: Column, n_neg: Column) -> Column:
    return F.try_divide(double.cast("double"), F.lit(2.0) * n_pos.cast("double") * n_neg.cast("double")).alias("auc")


def score_table(df: DataFrame, keys: Sequence[str], score: Column, minor: Column, predicted: Column | None = None,
                minority: int = FRAUD, majority: int = LEGAL, buckets: int | None = None,
                write: bool = True) -> ScoreTable:
    """The ordered table of all scored sets in ``df``.

    ``minor``: whether a row is of the minority class.  ``predicted``: the predicted
    label, where the confusion counts are wanted.  ``write``: keep the ordered rows as
    a table, for several evaluators; a single one reads them once anyway.
    """
    keys = list(keys)
    hit = F.lit(None).cast("int") if predicted is None else predicted
    groups = materialise(
        df.select(*keys, score.alias("s"), minor.alias("_m"), hit.alias("_p")).where(F.col("_m").isNotNull())
        .groupBy(*keys, "s").agg(
            F.count_if("_m").alias("nf"), F.count_if(~F.col("_m")).alias("nl"),
            F.count_if(F.col("_m") & (F.col("_p") == minority)).alias("tp"),
            F.count_if(F.col("_m") & (F.col("_p") == majority)).alias("fn"),
            F.count_if(~F.col("_m") & (F.col("_p") == majority)).alias("tn"),
            F.count_if(~F.col("_m") & (F.col("_p") == minority)).alias("fp")))
    scored = F.col("s").isNotNull()
    sums = groups.groupBy(*keys).agg(
        F.sum("nf").alias("n_f"), F.sum("nl").alias("n_l"), *[F.sum(c).alias(c) for c in ("tp", "fn", "tn", "fp")],
        F.coalesce(F.sum(F.when(scored, F.col("nf"))), F.lit(0)).alias("s_f"),
        F.coalesce(F.sum(F.when(scored, F.col("nl"))), F.lit(0)).alias("s_l"),
        F.min("s").alias("lo"), F.max("s").alias("hi"))
    # A row a scored set: a window over all of them is bounded by their number.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = materialise(sums.withColumn("o_f", F.coalesce(F.sum("n_f").over(before), F.lit(0)))
                         .withColumn("o_l", F.coalesce(F.sum("n_l").over(before), F.lit(0))))
    ranked = running_totals(groups.select(*keys, "s", "nf", "nl"), [*keys, "s"], {"cf": "nf", "cl": "nl"},
                            buckets=buckets)
    rows = (ranked.join(F.broadcast(totals.select(*keys, "n_f", "n_l", "s_f", "s_l", "o_f", "o_l")), keys)
            .select(*keys, "s", "nf", "nl", (F.col("cf") - F.col("o_f")).alias("cf"),
                    (F.col("cl") - F.col("o_l")).alias("cl"), "n_f", "n_l", "s_f", "s_l"))
    return ScoreTable(materialise(rows) if write else rows, totals.drop("o_f", "o_l"), keys)
