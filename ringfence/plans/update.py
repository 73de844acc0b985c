"""Continuing a stored detector with new rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ringfence.operators.fit import fit_steps
from ringfence.operators.score import score
from ringfence.operators.threshold import threshold
from ringfence.plans.train import Detector, load
from ringfence.session import cut, key_join
from ringfence.sources.models import latest_version, save_models
from ringfence.spec import DatasetSpec


def update(
    detector: Detector,
    df: DataFrame,
    order_col: str,
    ties: Sequence[str] = (),
    invert_max: str = "batch",
    threshold_scope: str = "new",
    earlier: DataFrame | None = None,
    batch_rows: int | None = None,
    chunk_rows: int | None = None,
) -> Detector:
    """Learn ``df`` with the frozen scaler and take a new threshold.

    ``threshold_scope="new"`` uses the new rows only; ``"all"`` also rescores
    ``earlier``. A key without new rows keeps its model and threshold.
    """
    if threshold_scope not in ("new", "all") or (threshold_scope == "all" and earlier is None):
        raise ValueError("threshold_scope is 'new', or 'all' together with the earlier rows")
    keys, names = detector.keys, list(detector.spec.features)
    ids = [order_col, *ties]
    by = keys or ["_all"]
    wide = detector.vectors(df, invert_max).select(*dict.fromkeys([*keys, *ids, *names]))
    vectors = wide if keys else wide.withColumn("_all", F.lit(0))
    old = detector.models if keys else detector.models.withColumn("_all", F.lit(0))
    models, steps = fit_steps(
        vectors, names, by, order_col, ties, detector.sigma, models=old, batch_rows=batch_rows, chunk_rows=chunk_rows
    )
    models = models if keys else models.drop("_all")
    rows = vectors.select(*keys, *names)
    if threshold_scope == "all":
        rows = rows.unionByName(detector.vectors(earlier, invert_max).select(*keys, *names))
    scored = cut(score(rows, models, names, keys, keep=()), "scores")
    taus = threshold(scored, detector.spec.quantile, keys)
    if keys:
        taus = key_join(detector.taus.withColumnRenamed("tau", "_old"), taus, keys, "full").select(
            *keys, F.coalesce("tau", "_old").alias("tau")
        )
    return replace(detector, models=models, taus=cut(taus, "tau"), steps=steps)


def update_stored(
    spark: SparkSession, path: str, spec: DatasetSpec, df: DataFrame, order_col: str, ties: Sequence[str] = (),
    keys: Sequence[str] = (), source: str | None = None, **options,
) -> Detector:
    """Load the latest version, update it with ``df`` and append the result as the next version."""
    version = latest_version(spark, path, spec.name)
    if version is None:
        raise ValueError(f"no model '{spec.name}' at {path}")
    newer = update(load(spark, path, spec, version, keys), df, order_col, ties, **options)
    # the scaler stays with the version that fitted it
    save_models(
        newer.models, path, spec.name, version + 1, newer.keys, spec.features, newer.taus, None, None,
        parent=version, source=source, new_rows=df.count(), mode=newer.mode,
    )
    return newer
