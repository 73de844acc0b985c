"""Correlations, profiles, comparisons and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ringfence.functions.columns import known
from ringfence.operators.rank import quantiles
from ringfence.operators.score import matrix
from ringfence.session import cut, key_join
from ringfence.spec import AnomalyRule

# Limits of the rule diagnosis.
WEAK, FEW_GOOD, STRONG_NEGATIVE, ALL_WEAK = 0.1, 100, -0.5, 0.3


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per ordered pair (feature_a, feature_b): rows where both are known, and sums over them.

    Values are taken relative to the column means, so that the sums do not cancel.
    Every task adds up its own d x d matrices and hands on one row per pair.
    """
    names, d = list(columns), len(columns)
    lean = df.select(*[known(F.col(c)).alias(f"c{i}") for i, c in enumerate(names)])
    stats = lean.agg(
        *[F.avg(f"c{i}").alias(f"m{i}") for i in range(d)], *[F.max(F.abs(f"c{i}")).alias(f"x{i}") for i in range(d)]
    ).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    # below this, a spread is rounding noise of a constant
    floor = [(1e-12 * (stats[f"x{i}"] or 0.0)) ** 2 for i in range(d)]
    at = np.indices((d, d)).reshape(2, -1)

    def run(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            x = matrix(batch, batch.schema.names)
            have = np.isfinite(x)
            x = np.where(have, x - mean, 0.0)
            have = have.astype(float)
            total += np.array([have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x])
        yield pa.RecordBatch.from_pydict({
            "a": at[0].astype(np.int32), "b": at[1].astype(np.int32),
            **{n: t.ravel() for n, t in zip(("n", "sx", "sxx", "sxy"), total)},
        })

    cells = lean.mapInArrow(run, "a int, b int, n double, sx double, sxx double, sxy double")
    sums = cells.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")])
    label = F.array(*[F.lit(c) for c in names])
    low = F.array(*[F.lit(v) for v in floor])
    spread = F.greatest(F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n")), F.lit(0.0))
    return sums.select(
        F.get(label, "a").alias("feature_a"), F.get(label, "b").alias("feature_b"), "n", "sx", "sxy",
        F.when(spread > F.col("n") * F.get(low, "a"), spread).otherwise(0.0).alias("spread"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long Pearson matrix (feature_a, feature_b, r); NULL for a constant column.

    Every pair uses the rows where both values are known.
    """
    cells = cut(moments(df, columns), "moments")  # one row per pair of columns
    other = cells.select(
        F.col("feature_a").alias("feature_b"), F.col("feature_b").alias("feature_a"),
        F.col("sx").alias("sy"), F.col("spread").alias("spread_b"),
    )
    co = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    return cells.join(other, ["feature_a", "feature_b"]).select(
        "feature_a", "feature_b", F.try_divide(co, F.sqrt(F.col("spread") * F.col("spread_b"))).alias("r")
    )


def target_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, r) with the target, strongest positive first."""
    pairs = correlations(df, [*features, target])
    return pairs.filter((F.col("feature_b") == target) & (F.col("feature_a") != target)).select(
        F.col("feature_a").alias("feature"), "r"
    ).orderBy(F.desc_nulls_last("r"), "feature")


def class_means(df: DataFrame, features: Sequence[str], label: str | Column, name: str = "label") -> DataFrame:
    key = F.col(label) if isinstance(label, str) else label
    return df.groupBy(key.alias(name)).agg(*[F.avg(known(F.col(c))).alias(c) for c in features])


def split_profile(df: DataFrame, target: str, rule: AnomalyRule, by: Sequence[str] = ()) -> DataFrame:
    """Rows, good and bad rows, range and mean of the target (per split)."""
    y = known(F.col(target))
    bad = rule.column(y) == 1
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(y.isNotNull() & ~bad).alias("n_good"),
        F.count_if(bad).alias("n_bad"),
        F.min(y).alias("target_min"),
        F.max(y).alias("target_max"),
        F.avg(y).alias("target_mean"),
    )


def diagnosis(df: DataFrame, features: Sequence[str], target: str, rule: AnomalyRule, key_features: Sequence[str] = ()) -> DataFrame:
    """One row of warnings: weak key features, few good rows, strong negative and overall weak correlation."""
    key_features = list(key_features) or list(features)
    corr = target_correlations(df, features, target).agg(
        F.max(F.when(F.col("feature").isin(key_features), F.abs("r"))).alias("key_r"),
        F.min("r").alias("min_r"),
        F.min_by("feature", "r").alias("min_feature"),
        F.max("r").alias("max_r"),
    )
    good = split_profile(df, target, rule).select("n_good").scalar()
    return corr.withColumn("n_good", good).select(
        F.coalesce(F.col("key_r") < WEAK, F.lit(False)).alias("weak_correlations"),
        (F.col("n_good") < FEW_GOOD).alias("few_good_rows"),
        F.coalesce(F.col("min_r") < STRONG_NEGATIVE, F.lit(False)).alias("strong_negative"),
        F.coalesce(F.col("max_r") < ALL_WEAK, F.lit(False)).alias("all_weak"),
        "min_feature", "min_r", "max_r", "n_good",
    )


def feature_screen(df: DataFrame, features: Sequence[str], target: str, least: float = 0.2, most: float = 0.9) -> DataFrame:
    """(feature, r, kept, reason): drop weak features and the weaker one of a redundant pair."""
    matrix = cut(correlations(df, [*features, target]), "corr")  # one row per pair, read several times
    to_target = matrix.filter((F.col("feature_b") == target) & (F.col("feature_a") != target)).select(
        F.col("feature_a").alias("feature"), "r"
    )
    strength = F.abs(F.col("r"))
    pairs = matrix.filter(
        (F.col("feature_a") != F.col("feature_b")) & (F.col("feature_b") != target) & (F.col("feature_a") != target)
        & (F.abs("r") > most)
    ).select(F.col("feature_a").alias("feature"), F.col("feature_b").alias("rival"))
    rivals = to_target.select(F.col("feature").alias("rival"), F.abs("r").alias("rival_r"))
    beaten = (
        pairs.join(rivals, "rival").join(to_target, "feature")
        .filter((F.col("rival_r") > strength) | ((F.col("rival_r") == strength) & (F.col("rival") < F.col("feature"))))
        .filter(F.col("rival_r") > least)
        .select("feature").distinct().withColumn("redundant", F.lit(True))
    )
    weak = ~F.coalesce(strength > least, F.lit(False))
    return to_target.join(beaten, "feature", "left").select(
        "feature", "r",
        F.when(weak | F.col("redundant"), 0).otherwise(1).alias("kept"),
        F.when(weak, "weak").when(F.col("redundant"), "redundant").otherwise("ok").alias("reason"),
    )


def comparison_table(records: DataFrame) -> DataFrame:
    """Metric records as a comparison table, one row per dataset; missing values stay NULL."""
    # Report headings.
    headings = {
        "dataset": "Dataset", "auc": "AUC", "ap": "AP", "f1": "F1", "precision": "Precision", "recall": "Recall",
        "flag_rate": "Flag Rate (%)", "threshold": "Threshold", "num_sv": "Support Vectors",
        "train_samples": "Train Samples",
    }
    have = set(records.columns)
    return records.select(
        *[(F.col(c) if c in have else F.lit(None).cast("double")).alias(h) for c, h in headings.items()]
    )


def rendered(table: DataFrame, missing: str = "N/A") -> DataFrame:
    """Every column as text with ``missing`` for NULL, for the CSV report."""
    return table.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)).alias(c) for c in table.columns])


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, mean, std, min, max) with non-numeric text coerced to NULL; std is the sample one."""
    pairs = ", ".join(f"'{c}', try_cast(cast(`{c}` as string) as double)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) as (metric, value)")
    v = known(F.col("value"))
    return long.groupBy("metric").agg(
        F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def pivot_metric(df: DataFrame, row: str, column: str, values: Sequence, metric: str) -> DataFrame:
    """One row per ``row``, one column per entry of ``values``; first known metric in each cell."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(metric, ignorenulls=True))


def report_order(df: DataFrame, first: str, second: str, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.asc(first), F.asc(second) if ascending else F.desc(second))


def latency_summary(df: DataFrame, by: Sequence[str], seconds: str, **rank) -> DataFrame:
    """Mean and p99 milliseconds and rows per second from per-row times."""
    tail = quantiles(df, seconds, {"p99_s": 0.99}, by, **rank)
    base = df.groupBy(*by).agg(
        F.avg(seconds).alias("mean_s"), F.count(seconds).alias("n"), F.sum(seconds).alias("total_s")
    )
    return key_join(base, tail, by).select(
        *by,
        (F.col("mean_s") * 1000).alias("mean_ms"),
        (F.col("p99_s") * 1000).alias("p99_ms"),
        F.try_divide(F.col("n").cast("double"), F.col("total_s")).alias("rows_per_s"),
    )


def stacked(tables: Mapping[str, DataFrame] | Sequence[DataFrame], name: str = "source") -> DataFrame:
    """Union by column name; a mapping also tags rows with their source."""
    if isinstance(tables, Mapping):
        tables = [t.withColumn(name, F.lit(k)) for k, t in tables.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def array_profile(df: DataFrame, arrays: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per array column (and group): type, values, first five of the first row, min, max, mean, population std."""
    kinds = dict(df.dtypes)
    parts = []
    for c in arrays:
        values = df.select(*by, F.explode(F.col(c)).alias("v"))
        parts.append(
            values.groupBy(*by).agg(
                F.count(F.lit(1)).alias("n_values"),
                F.min(F.col("v").cast("double")).alias("v_min"),
                F.max(F.col("v").cast("double")).alias("v_max"),
                F.avg(F.col("v").cast("double")).alias("v_mean"),
                F.stddev_pop(F.col("v").cast("double")).alias("v_std"),
            ).withColumns({"key": F.lit(c), "dtype": F.lit(kinds[c])})
        )
    return stacked(parts)


def array_head(df: DataFrame, arrays: Sequence[str], keep: Sequence[str], n: int = 5) -> DataFrame:
    """Length and first values of each array of each row."""
    return stacked([
        df.select(*keep, F.lit(c).alias("key"), F.size(c).alias("size"), F.slice(c, 1, n).alias("head")) for c in arrays
    ])


def key_sets(df: DataFrame, keys: Column) -> DataFrame:
    """(key_set, n_rows): consistent when there is one row."""
    return df.groupBy(F.concat_ws(",", F.array_sort(keys)).alias("key_set")).agg(F.count(F.lit(1)).alias("n_rows"))


def consistent(df: DataFrame, keys: Column) -> DataFrame:
    sets = key_sets(df, keys)
    return sets.agg(F.count(F.lit(1)).alias("n_key_sets"), F.sum("n_rows").alias("n_rows")).withColumn(
        "consistent", F.when(F.col("n_key_sets") == 1, 1).otherwise(0)
    )
