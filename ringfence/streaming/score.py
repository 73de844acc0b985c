"""Scoring a stream against a frozen detector: stateless, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ringfence.functions.columns import flag
from ringfence.operators.score import score
from ringfence.plans.train import Detector
from ringfence.session import key_join


def score_stream(stream: DataFrame, detector: Detector, **options) -> DataFrame:
    """``score``, ``tau`` and ``is_anomaly`` for every event; the detector does not change."""
    scored = score(detector.vectors(stream), detector.models, detector.spec.features, detector.keys, **options)
    if detector.keys:
        with_tau = key_join(scored, detector.taus.select(*detector.keys, "tau"), detector.keys, "left")
    else:
        with_tau = scored.withColumn("tau", F.lit(detector.taus.first()["tau"]))
    return with_tau.withColumn("is_anomaly", flag(F.col("score"), F.col("tau"), detector.spec.margin))
