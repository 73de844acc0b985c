"""Feature preparation: clip, log, invert, project, standardise, label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ringfence.functions.columns import invert, known, prepared
from ringfence.spec import DatasetSpec


def transform(
    df: DataFrame,
    clip: Sequence[str] = (),
    log: Sequence[str] = (),
    invert_cols: Sequence[str] = (),
    clip_min: float | None = 0.0,
    clip_max: float | None = None,
    caps: Mapping[str, tuple[float, float]] | None = None,
    maxima: Mapping[str, float] | None = None,
) -> DataFrame:
    """Clip, then log1p, then ``max - x``. Listed columns that are absent are skipped.

    ``maxima=None`` inverts against the maximum of this very batch, read through
    a scalar subquery (one row, no join). Give fitted ``maxima`` for streams and
    for scoring with the values seen in training.
    """
    out = df.withColumns(prepared(df.columns, clip, log, clip_min, clip_max, caps))
    wanted = [c for c in invert_cols if c in df.columns]
    if not wanted:
        return out
    if maxima is None:
        tops = out.agg(F.struct(*[F.max(known(F.col(c))).alias(c) for c in wanted])).scalar()
        return out.withColumns({c: invert(known(F.col(c)), tops[c]) for c in wanted})
    return out.withColumns({c: invert(known(F.col(c)), maxima[c]) for c in wanted})


def fit_maxima(df: DataFrame, spec: DatasetSpec) -> dict[str, float]:
    """Maxima of the inverted columns after clip and log: one row to the driver."""
    wanted = [c for c in spec.invert if c in df.columns]
    if not wanted:
        return {}
    ready = df.withColumns(
        prepared(df.columns, spec.clip, spec.log, spec.clip_min, spec.clip_max, spec.caps)
    )
    return ready.agg(*[F.max(known(F.col(c))).alias(c) for c in wanted]).first().asDict()


def prepare(df: DataFrame, spec: DatasetSpec, maxima: Mapping[str, float] | None = None) -> DataFrame:
    """The spec's preparation of a batch or stream; other columns are kept."""
    if df.isStreaming and spec.invert and maxima is None:
        raise ValueError("a stream has no batch maximum: pass fitted maxima for " + ", ".join(spec.invert))
    return transform(df, spec.clip, spec.log, spec.invert, spec.clip_min, spec.clip_max, spec.caps, maxima)


def check_width(names: Sequence[str], spec: DatasetSpec) -> None:
    """Plan-time width check of a feature list against the spec."""
    if len(names) != len(spec.features):
        raise ValueError(f"Length mismatch: {len(names)} values but {len(spec.features)} feature names")


def project(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Features in spec order as doubles, plus the columns to keep."""
    missing = [c for c in (*features, *keep) if c not in df.columns]
    if missing:
        raise ValueError("Missing columns: " + ", ".join(missing))
    return df.select(*keep, *[known(F.col(c)).alias(c) for c in features])


def label(df: DataFrame, spec: DatasetSpec, name: str = "label") -> DataFrame:
    if not spec.target or spec.target not in df.columns:
        raise ValueError(f"no target column '{spec.target}' to label with")
    return df.withColumn(name, spec.rule.column(spec.target))


@dataclass(frozen=True)
class Scaler:
    """Column means and population standard deviations; width-1 scale for constants."""

    mean: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (known(F.col(c)) - F.lit(m)) / F.lit(self.scale[c]) for c, m in self.mean.items()}
        )

    def rows(self) -> list[tuple[str, float, float]]:
        return [(c, m, self.scale[c]) for c, m in self.mean.items()]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "feature string, mean double, scale double")


def scaler_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature (feature, mean, scale), from a single aggregation pass."""
    aggs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(known(F.col(c))).alias("mean"),
            F.stddev_pop(known(F.col(c))).alias("std"),
        )
        for c in features
    ]
    return (
        df.agg(F.array(*aggs).alias("stats"))
        .select(F.inline("stats"))
        .select("feature", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("scale"))
    )


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """Fit on ``df``; one row per feature reaches the driver and becomes literals."""
    stats = {r["feature"]: r for r in scaler_stats(df, features).collect()}
    empty = [c for c in features if stats[c]["mean"] is None]
    if empty:
        raise ValueError("no values to fit a scaler on: " + ", ".join(empty))
    return Scaler({c: stats[c]["mean"] for c in features}, {c: stats[c]["scale"] for c in features})
