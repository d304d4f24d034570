"""Confusion metrics, ROC curve and area under it (EVA1-EVA11).

Inputs carry ``label`` and ``predicted_label`` in the label domain (+1
minority / -1 majority) and, for the score ROC, a numeric score column.
All metrics come from one fused aggregate; the ROC groups by distinct score
first (map-side partial aggregation), then uses distributed running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import pct
from ..schema import FRAUD, LEGAL
from ..sources.tables import materialise
from .prefix import running_totals

DIGITS = 9


def confusion_counts(df: DataFrame, label: str = "label", predicted: str = "predicted_label",
                     positive: int = FRAUD, negative: int = LEGAL) -> DataFrame:
    """EVA1: one row (tp, fn, tn, fp) from a single pass."""
    y, p = F.col(label), F.col(predicted)
    return df.agg(
        F.count_if((y == positive) & (p == positive)).alias("tp"),
        F.count_if((y == positive) & (p == negative)).alias("fn"),
        F.count_if((y == negative) & (p == negative)).alias("tn"),
        F.count_if((y == negative) & (p == positive)).alias("fp"))


def with_rates(counts: DataFrame, digits: int | None = DIGITS, keys: Sequence[str] = ()) -> DataFrame:
    """EVA2-EVA9 from (<keys>, tp, fn, tn, fp); undefined ratios are NULL.

    TPR, SPC, PPV, ACC in percent; F1 from the percentages; MGEO =
    sqrt(TPR*SPC); PEXC = (tp*tn - fn*fp)/((fn+tp)(tn+fp)); MCC in doubles.
    """
    tp, fn, tn, fp = (F.col(c).cast("double") for c in ("tp", "fn", "tn", "fp"))
    sens = pct(tp, tp + fn)
    spc = pct(tn, fp + tn)
    pre = pct(tp, tp + fp)
    acc = pct(tp + tn, tp + fn + fp + tn)
    f1 = F.try_divide(F.lit(2.0) * pre * sens, pre + sens)
    mgeo = F.sqrt(sens * spc)
    pexc = F.try_divide(tp * tn - fn * fp, (fn + tp) * (tn + fp))
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt((fn + tp) * (tn + fp) * (fp + tp) * (fn + tn)))

    def r(c):
        return F.round(c, digits) if digits is not None else c
    return counts.select(
        *keys, "tp", "fn", "tn", "fp",
        r(sens).alias("tpr"), r(spc).alias("spc"), r(pre).alias("ppv"), r(acc).alias("acc"),
        r(f1).alias("f1"), r(mgeo).alias("mgeo"), r(pexc).alias("pexc"), r(mcc).alias("mcc"))


def confusion_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted_label",
                      positive: int = FRAUD, negative: int = LEGAL,
                      digits: int | None = DIGITS) -> DataFrame:
    return with_rates(confusion_counts(df, label, predicted, positive, negative), digits)


def _score_groups(df: DataFrame, score: str, label: str, positive: int) -> DataFrame:
    return (df.groupBy(F.col(score).alias("score"))
            .agg(F.count_if(F.col(label) == positive).alias("tp"),
                 F.count_if(F.col(label) != positive).alias("fp")))


def roc_points(df: DataFrame, score: str, label: str = "label", positive: int = FRAUD,
               digits: int | None = DIGITS, buckets: int | None = None) -> DataFrame:
    """EVA10: ROC points (pos, fpr, tpr) over distinct scores, high to low.

    Frame points (0,0) at pos 0 and (1,1) after the last score are added, as
    in the classic binary-classification metrics.
    """
    # Distinct scores only, written once: they feed the totals and the running sums.
    g = materialise(_score_groups(df, score, label, positive))
    st = g.agg(F.sum("tp"), F.sum("fp"), F.count(F.lit(1))).first()
    n_pos, n_neg = F.lit(st[0] or 0).cast("bigint"), F.lit(st[1] or 0).cast("bigint")
    n_groups = F.lit(st[2]).cast("bigint")
    cum = running_totals(g, [F.col("score").desc()], {"ctp": "tp", "cfp": "fp"},
                         buckets=buckets)
    spark = df.sparkSession

    def r(c):
        return F.round(c, digits) if digits is not None else c
    pts = cum.select(F.col("pos").cast("bigint").alias("pos"),
                     r(F.try_divide(F.col("cfp").cast("double"), n_neg)).alias("fpr"),
                     r(F.try_divide(F.col("ctp").cast("double"), n_pos)).alias("tpr"))
    frame = spark.range(2).select(
        F.when(F.col("id") == 0, F.lit(0).cast("bigint")).otherwise(n_groups + 1).alias("pos"),
        F.col("id").cast("double").alias("fpr"), F.col("id").cast("double").alias("tpr"))
    return pts.unionByName(frame)


def auc(df: DataFrame, score: str, label: str = "label", positive: int = FRAUD,
        digits: int | None = DIGITS, buckets: int | None = None) -> DataFrame:
    """EVA11: trapezoid area under the ROC of ``score`` (one row, ``auc``).

    Each distinct score contributes fp * (2*cum_tp - tp) / (2 * P * N): the
    previous point is the running total minus the group itself, so no lag
    window is needed, and the numerator is an exact integer sum.
    """
    g = materialise(_score_groups(df, score, label, positive))
    cum = running_totals(g, [F.col("score").desc()], {"ctp": "tp"}, buckets=buckets)
    num = cum.agg(F.sum(F.col("fp").cast("decimal(38,0)")
                        * (F.lit(2) * F.col("ctp") - F.col("tp")).cast("decimal(38,0)"))
                  .alias("num"),
                  F.sum("tp").alias("n_pos"), F.sum("fp").alias("n_neg"))
    area = F.try_divide(F.col("num").cast("double"),
                        F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    return num.select((F.round(area, digits) if digits is not None else area).alias("auc"))
