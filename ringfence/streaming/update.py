"""Learning from micro-batches: rows are tested in parallel, only those outside reach the model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ringfence.plans.train import load
from ringfence.plans.update import update
from ringfence.sources.models import latest_version, save_models
from ringfence.spec import DatasetSpec


def learn_batches(
    stream: DataFrame, path: str, spec: DatasetSpec, order_col: str, ties: Sequence[str] = (), keys: Sequence[str] = (), **options
):
    """A stream writer that stores one model version per micro-batch.

    Micro-batch b turns version b into version b + 1 (the trained model being
    version 0), so a replayed batch rewrites the same version. Call
    ``.option("checkpointLocation", ...)`` and ``.start()`` on the result.
    """

    def learn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        # an empty earlier batch leaves a gap: continue the newest version before this one
        before = latest_version(spark, path, spec.name, below=batch_id + 1)
        newer = update(load(spark, path, spec, before, keys), batch, order_col, ties, invert_max="stored", **options)
        save_models(
            newer.models, path, spec.name, batch_id + 1, newer.keys, spec.features, newer.taus, parent=before,
            source=f"batch {batch_id}", new_rows=batch.count(), mode=newer.mode,
        )

    return stream.writeStream.foreachBatch(learn)
