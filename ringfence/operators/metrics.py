"""Ranking and decision metrics, exact and distributed.

Every ranking metric starts from the counts of positives and negatives per
distinct score, so ties are handled by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ringfence.functions.columns import ratio, ratio_or_zero
from ringfence.operators.rank import ROWS_PER_BUCKET, cut_points, quantiles, running_totals, value_histogram
from ringfence.session import key_join


def ranked_scores(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
    rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    previous: bool = False,
) -> DataFrame:
    """Per distinct score: pos, neg, their counts below, and totals per group."""
    if rows is None:
        rows = df.count()
    cuts = cut_points(df, F.nullif(F.col(score).cast("double"), F.lit(float("nan"))), rows, rows_per_bucket)
    return running_totals(value_histogram(df, score, by, label), score, ["pos", "neg"], by, cuts, previous)


def ranking(df: DataFrame, score="score", label="label", by: Sequence[str] = (), **rank) -> DataFrame:
    """ROC AUC (ties count half) and average precision (step sum), with class counts.

    A group with one class only has NULL ``auc``; one without positives NULL ``ap``.
    """
    r = ranked_scores(df, score, label, by, **rank)
    above_pos = F.col("pos_total") - F.col("pos_before")
    above_neg = F.col("neg_total") - F.col("neg_before")
    out = r.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("_wins"),
        F.sum(F.col("pos") * ratio(above_pos, above_pos + above_neg)).alias("_steps"),
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
    )
    return out.select(
        *by,
        "n_pos",
        "n_neg",
        ratio(F.col("_wins"), F.col("n_pos") * F.col("n_neg")).alias("auc"),
        ratio(F.col("_steps"), F.col("n_pos")).alias("ap"),
    )


def roc_auc(df, score="score", label="label", by=(), **rank) -> DataFrame:
    return ranking(df, score, label, by, **rank).select(*by, "auc", "n_pos", "n_neg")


def average_precision(df, score="score", label="label", by=(), **rank) -> DataFrame:
    return ranking(df, score, label, by, **rank).select(*by, "ap", "n_pos")


def roc_points(df, score="score", label="label", by: Sequence[str] = (), drop_collinear: bool = True, **rank) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the starting point (0, 0) with a NULL threshold.

    ``drop_collinear`` leaves out points on the straight line between their neighbours.
    """
    r = ranked_scores(df, score, label, by, previous=True, **rank)
    if drop_collinear:
        # the next lower score adds the same counts: this point is halfway along a line
        same = (F.col("pos_prev") == F.col("pos")) & (F.col("neg_prev") == F.col("neg"))
        r = r.filter(F.col("pos_prev").isNull() | ~same)
    points = r.select(
        *by,
        F.col(score).alias("threshold"),
        ratio(F.col("neg_total") - F.col("neg_before"), F.col("neg_total")).alias("fpr"),
        ratio(F.col("pos_total") - F.col("pos_before"), F.col("pos_total")).alias("tpr"),
    )
    return points.unionByName(_anchor(df, by, score, fpr=0.0, tpr=0.0))


def pr_points(df, score="score", label="label", by: Sequence[str] = (), **rank) -> DataFrame:
    """(threshold, precision, recall) for every distinct score, plus the end point (1, 0)."""
    r = ranked_scores(df, score, label, by, **rank)
    pos, neg = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    points = r.select(
        *by,
        F.col(score).alias("threshold"),
        ratio(pos, pos + neg).alias("precision"),
        ratio(pos, F.col("pos_total")).alias("recall"),
    )
    return points.unionByName(_anchor(df, by, score, precision=1.0, recall=0.0))


def _anchor(df, by, score, **values):
    known = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    one = known.select(*by).distinct() if by else known.limit(1).select()
    return one.withColumns(
        {"threshold": F.lit(None).cast("double"), **{n: F.lit(v) for n, v in values.items()}}
    )


def decisions(df: DataFrame, pred="is_anomaly", label="label", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and the flagged share of rows."""
    hit, truth = F.col(pred) == 1, F.col(label) == 1
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~F.coalesce(truth, F.lit(False))).alias("fp"),
        F.count_if(truth & ~F.coalesce(hit, F.lit(False))).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(
        *by,
        "n_rows", "tp", "fp", "fn",
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(tp * 2, tp * 2 + fp + fn).alias("f1"),
        ratio_or_zero(tp + fp, F.col("n_rows")).alias("flag_rate"),
    )


def auc_by_group(df, group: str, score="score", label="label", least: int = 5, **rank) -> DataFrame:
    """AUC of every group with at least ``least`` rows; NULL where a group has one class."""
    return (
        roc_auc(df, score, label, [group], **rank)
        .filter((F.col("n_pos") + F.col("n_neg") >= least) & F.col(group).isNotNull())
        .withColumn("n_rows", F.col("n_pos") + F.col("n_neg"))
        .select(group, "auc", "n_rows")
        .orderBy(group)
    )


def session_scores(df, session: str, score="score", label="label", q: float = 0.95, **rank) -> DataFrame:
    """One row per session: a high quantile of its scores and whether any row is positive."""
    high = quantiles(df, score, {"session_score": q}, [session], **rank)
    truth = df.groupBy(session).agg(F.max(F.coalesce(F.col(label), F.lit(0))).alias("session_label"))
    return key_join(high, truth, session)


def session_auc(df, session: str, score="score", label="label", q: float = 0.95, **rank) -> DataFrame:
    sessions = session_scores(df, session, score, label, q, **rank)
    return roc_auc(sessions, "session_score", "session_label")


def classes_present(df: DataFrame, label="label") -> DataFrame:
    """One row (n_pos, n_neg, single_class): the guard before ranking metrics."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    ).withColumn("single_class", (F.col("n_pos") == 0) | (F.col("n_neg") == 0))


def spread(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation of metric columns, one row per metric."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = df.selectExpr(*by, f"stack({len(metrics)}, {pairs}) as (metric, value)")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"))
