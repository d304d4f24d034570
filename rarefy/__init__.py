"""rarefy: DataFrame operators for imbalanced binary classification at scale.

Balanced tree ensembles (all minority rows plus a bootstrap or k-means
sub-sample of the majority per tree), soft / hard / mean voting, and
detection-score evaluation (confusion metrics, ROC/AUC, likelihood-ratio
densities, equal-error rate, cumulative score curves, importances).

Every operator takes and returns DataFrames.  Scalars (counts, ranges, minima)
are one-row aggregates that the driver reads once; they enter later plans as
literals.
"""

__version__ = "0.1.0"
