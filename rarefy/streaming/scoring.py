"""Scoring a stream with a fitted ensemble.

The reference is a batch job and has no streaming code; this module only
shows that ensemble scoring (ENS7) is a stateless, row-local transform, so
the same plan runs unchanged on a Structured Streaming source: no state, no
watermark, each micro-batch scored independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.features import assemble


def score_stream(model, stream: DataFrame, indexer=None,
                 strategy: str = "soft") -> DataFrame:
    """Streaming DataFrame of transactions -> (idn, label, p0, p1, predicted_label).

    ``model`` is a fitted ensemble of either engine.  ``indexer`` is the fitted VectorIndexerModel of the training run (a
    stateless transform as well); without it the assembled vector is used.
    """
    vec = assemble(stream, model.feature_names)
    if indexer is not None:
        vec = indexer.transform(vec)
    elif model.features_col != "features":
        vec = vec.withColumnRenamed("features", model.features_col)
    return (model.predict(vec, strategy)
            .select("idn", "label", "p0", "p1", "predicted_label"))
