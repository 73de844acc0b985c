"""Per-session window features from raw samples, in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SLOTS = 64


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def window_features(
    df: DataFrame,
    session: Sequence[str],
    ts: str,
    quality: str,
    bitrate: str,
    stalled: Column,
    seconds: float = 5.0,
    ties: Sequence[str] = (),
    slots: int = SLOTS,
) -> DataFrame:
    """One row per session and window of ``seconds``:

    ``n_samples``, ``quality_mean``, ``quality_std`` (sample), ``quality_mad`` (mean
    absolute difference of successive samples), ``bitrate_mean``, ``stall_ratio`` and
    ``tsl_end`` (seconds from the last stall, of any earlier window too, to the
    window's end; NULL before the first stall).

    Means and shares combine map-side. Successive differences are taken inside
    short time slots and joined up at slot borders, so a busy session is spread
    over its slots rather than ordered in one task.
    """
    session = list(session)
    width = int(round(seconds * 1_000_000 / slots))
    base = df.withColumns({"_us": _micros(ts), "_stall": F.when(stalled, 1).otherwise(0)})
    base = base.withColumn("_slot", F.floor(F.col("_us") / F.lit(width)).cast("long"))
    base = base.withColumn("_win", F.floor(F.col("_slot") / F.lit(slots)).cast("long"))
    keys = [*session, "_win"]

    plain = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(quality).alias("quality_mean"),
        F.stddev(quality).alias("quality_std"),
        F.avg(bitrate).alias("bitrate_mean"),
        F.avg("_stall").alias("stall_ratio"),
        F.max(F.when(F.col("_stall") == 1, F.col("_us"))).alias("_last_stall"),
    )

    order = F.struct("_us", *ties)
    near = Window.partitionBy(*keys, "_slot").orderBy("_us", *ties)
    steps = base.filter(F.col(quality).isNotNull()).select(
        *keys, "_slot", "_us", *[t for t in ties], F.col(quality).cast("double").alias("_q")
    ).withColumn("_step", F.abs(F.col("_q") - F.lag("_q").over(near)))
    cells = steps.groupBy(*keys, "_slot").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_step").alias("_inner"),
        F.min_by("_q", order).alias("_open"),
        F.max_by("_q", order).alias("_close"),
    )
    border = F.abs(F.col("_open") - F.lag("_close").over(Window.partitionBy(*keys).orderBy("_slot")))
    mad = cells.withColumn("_border", border).groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.coalesce("_inner", F.lit(0.0))) + F.sum(F.coalesce("_border", F.lit(0.0))),
            (F.sum("_n") - 1).cast("double"),
        ).alias("quality_mad")
    )

    match = None
    renamed = mad.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "quality_mad")
    for k in keys:
        cond = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        match = cond if match is None else match & cond
    joined = plain.join(renamed, match, "left")
    so_far = Window.partitionBy(*session).orderBy("_win").rowsBetween(Window.unboundedPreceding, 0)
    end = (F.col("_win") + 1) * F.lit(width * slots)
    return joined.withColumn("_seen", F.max("_last_stall").over(so_far)).select(
        *session,
        F.timestamp_micros(F.col("_win") * F.lit(width * slots)).alias("window_start"),
        F.timestamp_micros(end).alias("window_end"),
        "n_samples", "quality_mean", "quality_std", "quality_mad", "bitrate_mean", "stall_ratio",
        ((end - F.col("_seen")) / F.lit(1e6)).alias("tsl_end"),
    )
