"""Group k-fold validation and parameter grids, all folds in one set of jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ringfence.operators.fit import fit_steps
from ringfence.operators.metrics import decisions, ranking, spread
from ringfence.operators.score import score
from ringfence.operators.splits import fold_count, with_folds
from ringfence.operators.threshold import flagged, threshold
from ringfence.session import cut, key_join

FOLD_METRICS = ("AUC", "AP", "F1", "precision", "recall", "flag_rate")


def _folded(df, features, group, label, order_col, ties, folds, seed):
    names = [features] if isinstance(features, str) else list(features)
    k = folds or fold_count(df.select(group).distinct().count())
    keep = list(dict.fromkeys([group, label, order_col, *ties, *names]))
    return k, cut(with_folds(df.select(*keep), group, k, seed), "folds")


def _training(base: DataFrame, k: int, label: str) -> DataFrame:
    """Normal rows, once for every fold they do not belong to, keyed by ``cv``."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    return base.filter(F.col(label) == 0).withColumn("cv", F.explode(others))


def cross_validate(
    df: DataFrame,
    features: Sequence[str] | str,
    group: str,
    label: str,
    order_col: str,
    sigma: float,
    q: float,
    ties: Sequence[str] = (),
    folds: int | None = None,
    seed: int = 42,
    chunk_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(fold records, scored test rows). Each fold is fitted on the normal rows of the others.

    The threshold of a fold is the ``q`` quantile of its training scores. Test rows
    come back with ``cv``, ``score``, ``tau`` and ``is_anomaly``.
    """
    k, base = _folded(df, features, group, label, order_col, ties, folds, seed)
    train = _training(base, k, label)
    models, steps = fit_steps(train, features, ["cv"], order_col, ties, sigma, chunk_rows=chunk_rows)
    learned = cut(score(train, models, features, ["cv"], keep=()), "learned")
    taus = cut(threshold(learned, q, ["cv"]), "tau")
    test = base.withColumn("cv", F.col("fold").cast("int"))
    names = [features] if isinstance(features, str) else list(features)
    kept = [c for c in test.columns if c not in names or c in (label, group)]
    tested = cut(flagged(score(test, models, features, ["cv"], kept, timed=True), taus, ["cv"]), "tested")

    fits = steps.groupBy("cv").agg(F.sum("fit_seconds").alias("t_train_s"))
    times = tested.groupBy("cv").agg(F.sum("score_seconds").alias("t_score_s"))
    rates = decisions(tested, label=label, by=["cv"])
    rank = ranking(tested, label=label, by=["cv"])
    out = (
        # a fold without a normal row to learn from has test rows only
        rates.join(rank, "cv").join(taus, "cv", "left").join(fits, "cv", "left").join(times, "cv", "left")
        .join(learned.groupBy("cv").agg(F.count(F.lit(1)).alias("n_train")), "cv", "left")
        .select(
            (F.col("cv") + 1).alias("fold"), F.coalesce("n_train", F.lit(0)).alias("n_train"), F.col("n_rows").alias("n_test"),
            F.col("auc").alias("AUC"), F.col("ap").alias("AP"), "precision", "recall", F.col("f1").alias("F1"),
            "flag_rate", "tau", "t_train_s", "t_score_s",
        )
    )
    return out, tested


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the six fold metrics."""
    return spread(folds, FOLD_METRICS)


def timing_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(
        F.avg("t_train_s").alias("train_avg_s"), F.avg("t_score_s").alias("score_avg_s"),
        (F.sum("t_train_s") + F.sum("t_score_s")).alias("total_s"),
    )


def grid_search(
    df: DataFrame,
    features: Sequence[str] | str,
    group: str,
    label: str,
    order_col: str,
    sigmas: Sequence[float],
    quantiles: Sequence[float],
    ties: Sequence[str] = (),
    folds: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mean fold metrics for every (sigma, quantile); one fit per (sigma, fold) in the same jobs."""
    k, base = _folded(df, features, group, label, order_col, ties, folds, seed)
    widths = F.array(*[F.lit(float(s)) for s in sigmas])
    train = _training(base, k, label).withColumn("width", F.explode(widths))
    keys = ["width", "cv"]
    models, _ = fit_steps(train, features, keys, order_col, ties, "width")
    learned = cut(score(train, models, features, keys, keep=()), "learned")
    test = base.withColumn("cv", F.col("fold").cast("int")).withColumn("width", F.explode(widths))
    tested = cut(score(test, models, features, keys, keep=[label]), "tested")
    rank = ranking(tested, label=label, by=keys)
    parts = []
    for q in quantiles:
        rates = decisions(flagged(tested, threshold(learned, q, keys), keys), label=label, by=keys)
        parts.append(key_join(rates, rank, keys).withColumn("quantile", F.lit(float(q))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(F.col("width").alias("sigma"), "quantile").agg(
        F.avg("auc").alias("AUC"), F.avg("ap").alias("AP"), F.avg("f1").alias("F1"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("flag_rate").alias("flag_rate"),
    )


def best_setting(grid: DataFrame, metric: str = "AUC") -> DataFrame:
    """The (sigma, quantile) with the highest metric; the smaller pair on a tie."""
    return grid.agg(
        F.max_by(F.struct("sigma", "quantile"), F.struct(metric, -F.col("sigma"), -F.col("quantile"))).alias("s"),
        F.max(metric).alias(metric),
    ).select("s.sigma", "s.quantile", metric)
