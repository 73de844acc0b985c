"""Training in batches with checkpoints: stopped at any point, it goes on where the last checkpoint is.

The rows are prepared, scaled and numbered once and kept as a table. Batch 0 has ``spec.initial_batch`` rows per
key, each later one ``spec.incremental_batch``. With ``spec.checkpoints`` the model is saved as a version after batch 0
and whenever ``spec.checkpoint_every`` batches are done, else after batch 0 and the last one. Every leg between two
checkpoints starts from the saved model, so a resumed run and an unbroken one read the same numbers and
end in the same model. Legs that together fit a task are learned in one job, which writes the version of each of them:
the number of jobs grows with the rows over ``rows_per_task``, not with the checkpoints. Beside the model tables lie

* ``training_rows``: key, position, batch and scaled features,
* ``training_plan``: what was fitted before the batches (scaler, maxima, width), written last: without it the rows are made anew,
* ``training_batches``: per key and batch the rows processed, support vectors added and removed, and their number after it,
* ``training_trace``: the radius after every learned row, the objective's history.

The header of a version is its manifest: it is written last, so a version counts only when whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ringfence.operators.fit import MODEL_COLUMNS, batch_stats, fit_legs, fit_steps, number_rows, objective_trace, rows_per_task
from ringfence.operators.prep import Scaler, fit_maxima, fit_scaler, prepare
from ringfence.operators.sampling import resolve_sigma
from ringfence.operators.score import score
from ringfence.operators.threshold import threshold
from ringfence.plans.train import Detector
from ringfence.session import cut
from ringfence.sources.models import latest_version, load_header, load_models, save_models
from ringfence.spec import DatasetSpec

_ALL = "all_rows"
# Legs, and so versions, that one job learns at most.
LEGS_PER_JOB = 256


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _prepare(df: DataFrame, spec: DatasetSpec, home: str, order_col: str, ties: Sequence[str], by: list[str]) -> None:
    """Write the numbered rows and then the plan."""
    spark, names, ids = df.sparkSession, list(spec.features), [order_col, *ties]
    base = df if by != [_ALL] else df.withColumn(_ALL, F.lit(0))
    maxima = fit_maxima(base, spec)
    ready = prepare(base.select(*dict.fromkeys([*by, *ids, *names])), spec, maxima)
    scaler = fit_scaler(ready, names)
    vectors = scaler.transform(ready)
    sigma = resolve_sigma(spec.sigma_method, spec.sigma, vectors, names, ids)
    rows = number_rows(vectors, names, by, order_col, ties, "position")
    late = F.expr(f"(position - {spec.initial_batch}) div {spec.incremental_batch}") + 1
    batch = F.when(F.col("position") < spec.initial_batch, 0).otherwise(late).cast("long")
    every = spec.checkpoint_every if spec.checkpoints else None
    leg = F.when(F.col("batch") == 0, 0).otherwise(1 + (F.expr(f"batch div {every}") if every else F.lit(0))).cast("long")
    rows = rows.withColumn("batch", batch).withColumn("leg", leg)
    # rows of a leg lie together, so that a leg reads its own row groups
    ordered = rows.repartitionByRange("leg", *by).sortWithinPartitions("leg", *by, "position")
    ordered.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{home}/training_rows")
    legs = spark.read.parquet(f"{home}/training_rows").agg(F.max("leg")).first()[0]
    plan = [(f, m, s, maxima.get(f), float(sigma), -1 if legs is None else legs, spec.incremental_batch) for f, m, s in scaler.rows()]
    schema = "feature string, mean double, scale double, top double, sigma double, legs long, batch_rows long"
    spark.createDataFrame(plan, schema).coalesce(1).write.mode("overwrite").parquet(f"{home}/training_plan")


def train_batches(
    df: DataFrame, spec: DatasetSpec, path: str, order_col: str, ties: Sequence[str] = (), keys: Sequence[str] = (),
    legs: int | None = None, chunk_rows: int | None = None,
) -> Detector | None:
    """Train ``spec`` on ``df`` into the model tables at ``path``, going on from the last checkpoint there.

    ``legs`` ends this call after so many legs (None: when all rows are learned). The detector, or None while rows are
    left. Equal to the pass of :func:`ringfence.plans.train.train` in mode ``by_key`` or ``single``. ``df`` and ``spec`` must be
    those the folder was begun with; a finished folder gives its detector without training.
    """
    spark, keys, names = df.sparkSession, list(keys), list(spec.features)
    by, home = keys or [_ALL], f"{path}/{spec.name}"
    plan = _read(spark, f"{home}/training_plan")
    if plan is None:
        _prepare(df, spec, home, order_col, ties, by)
        plan = spark.read.parquet(f"{home}/training_plan")
    kept = {r["feature"]: r for r in plan.collect()}
    scaler = Scaler({f: kept[f]["mean"] for f in names}, {f: kept[f]["scale"] for f in names})
    maxima = {f: kept[f]["top"] for f in names if kept[f]["top"] is not None}
    sigma, last, batch_rows = (kept[names[0]][c] for c in ("sigma", "legs", "batch_rows"))
    rows = spark.read.parquet(f"{home}/training_rows")
    done = latest_version(spark, path, spec.name) if _read(spark, f"{home}/model_header") is not None else None
    upto = last if legs is None else min(last, (-1 if done is None else done) + legs)
    # legs of a key that one task may learn; 0: a leg alone may be too long, then it is learned in chunks
    leg_rows = spec.checkpoint_every * batch_rows if spec.checkpoints else None
    span = min(LEGS_PER_JOB, (chunk_rows or rows_per_task(names)) // leg_rows) if leg_rows else 0
    leg = 0 if done is None else done + 1
    while leg <= upto:
        if leg and span > 1:
            end = min(leg + span - 1, upto)
            _train_legs(rows, spec, path, names, by, sigma, batch_rows, leg, end, last)
            leg = end + 1
            continue
        part = rows.filter(F.col("leg") == leg)
        before = load_models(spark, path, spec.name, leg - 1, by) if leg else None
        models, steps = fit_steps(
            part, names, by, "position", (), sigma, models=before, batch_rows=spec.initial_batch if not leg else batch_rows, trace=True, chunk_rows=chunk_rows)
        first = part.groupBy(*by).agg(F.min("batch").alias("_first"))
        stats = batch_stats(steps, by).join(first, by).withColumn("batch", F.col("batch") + F.col("_first")).drop("_first")
        stats.write.mode("overwrite").parquet(f"{home}/training_batches/leg={leg}")
        objective_trace(steps, by).write.mode("overwrite").parquet(f"{home}/training_trace/leg={leg}")
        if before is not None:  # keys that have no rows left keep their model
            absent = before.join(first, by, "left_anti").select(*models.columns)
            models = models.join(first, by, "left_semi").unionByName(absent)
        new = part.count()
        save_models(cut(models, "models"), path, spec.name, leg, by, names, None, scaler if not leg else None, maxima if not leg else None,
                    parent=leg - 1 if leg else None, source=f"leg {leg} of {last}", new_rows=new, mode="batches")
        leg += 1
    if upto < last:
        return None
    # the finished detector is a version of its own, with thresholds over all rows
    if done is None or done <= last:
        models = cut(load_models(spark, path, spec.name, last, by), "models")
        taus = cut(threshold(cut(score(rows, models, names, by, keep=()), "scores"), spec.quantile, by), "tau")
        save_models(models, path, spec.name, last + 1, by, names, taus, parent=last, source="finished", new_rows=0, mode="batches")
    models = load_models(spark, path, spec.name, last + 1, by)
    taus = load_header(spark, path, spec.name, last + 1).select(*by, "tau")
    models, taus = (models, taus) if keys else (models.drop(_ALL), taus.drop(_ALL))
    return Detector(spec, scaler, maxima, models, taus, sigma, keys, None, "batches")


def _train_legs(rows: DataFrame, spec: DatasetSpec, path: str, names, by: list[str], sigma, batch_rows: int, start: int, end: int, last: int) -> None:
    """Learn the legs ``start`` to ``end`` in one job and write batches, trace and a version for each of them."""
    spark, home = rows.sparkSession, f"{path}/{spec.name}"
    part = rows.filter(F.col("leg").between(start, end))
    before = load_models(spark, path, spec.name, start - 1, by)
    steps = cut(fit_legs(part, names, by, "position", "leg", before, sigma, batch_rows).withColumn("chunk", F.lit(0).cast("long")), "step")
    known = F.lit(True)  # as in a leg of its own: batches of a NULL key are not listed
    for k in by:
        known = known & F.col(k).isNotNull()
    ahead = F.greatest(F.lit(1), (F.col("leg") - 1) * spec.checkpoint_every)
    stats = batch_stats(steps.filter(known), [*by, "leg"]).withColumn("batch", F.col("batch") + ahead)

    def write(table: DataFrame, name: str) -> None:
        out = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("leg").parquet(f"{home}/{name}")

    write(stats, "training_batches")
    write(objective_trace(steps, [*by, "leg"]), "training_trace")
    # a version holds every key: the model of its last leg so far
    taken = before.select(*by, F.lit(start - 1).cast("long").alias("leg"), *MODEL_COLUMNS).unionByName(steps.select(*by, "leg", *MODEL_COLUMNS))
    after = F.coalesce(F.lead("leg").over(Window.partitionBy(*by).orderBy("leg")), F.lit(end + 1))
    held = taken.withColumn("_after", after).filter(F.col("_after") > F.greatest("leg", F.lit(start)))
    models = held.withColumn("version", F.explode(F.sequence(F.greatest("leg", F.lit(start)), F.col("_after") - 1))).drop("leg", "_after")
    new = {r["leg"]: r["count"] for r in part.groupBy("leg").count().collect()}
    counts = F.array(*[F.lit(new.get(v, 0)) for v in range(start, end + 1)])
    version = F.col("version")
    save_models(cut(models, "models"), path, spec.name, None, by, names, parent=version - 1,
                source=F.concat(F.lit("leg "), version.cast("string"), F.lit(f" of {last}")),
                new_rows=F.get(counts, (version - start).cast("int")), mode="batches")


def training_history(spark: SparkSession, path: str, spec: DatasetSpec) -> tuple[DataFrame, DataFrame]:
    """(batches, trace) written so far."""
    return spark.read.parquet(f"{path}/{spec.name}/training_batches"), spark.read.parquet(f"{path}/{spec.name}/training_trace")
