"""Column expressions for scores: clipped logs, likelihood ratio, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: probability used in place of an exact zero before taking a log.
SMALL = 1e-13
# Fixed value: digits kept for likelihood ratios used as sort / group keys.
LR_DIGITS = 9


def clipped_ln(p: Column) -> Column:
    """ln(p), with an exact 0 replaced by 1e-13 (the soft-vote log rule)."""
    return F.ln(F.when(p == 0.0, F.lit(SMALL)).otherwise(p))


def likelihood_ratio(p0: Column, p1: Column, inverse: bool = True) -> Column:
    """ln(p1/p0) (``inverse``) or ln(p0/p1); a single zero side becomes 1e-13.

    Both sides zero gives NULL (the undefined case).
    """
    num, den = (p1, p0) if inverse else (p0, p1)
    small = F.lit(SMALL)
    return (F.when((num == 0.0) & (den == 0.0), F.lit(None).cast("double"))
            .when(num == 0.0, F.ln(F.try_divide(small, den)))
            .when(den == 0.0, F.ln(F.try_divide(num, small)))
            .otherwise(F.ln(F.try_divide(num, den))))


def rounded_lr(p0: Column, p1: Column, inverse: bool = True) -> Column:
    """Likelihood ratio rounded to 9 digits, the key used for ordering."""
    return F.round(likelihood_ratio(p0, p1, inverse), LR_DIGITS)


def pct(num: Column, den: Column) -> Column:
    """(num / den) * 100 as double (ratio first); NULL when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)
