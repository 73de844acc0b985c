"""Row filters and splits that keep groups together."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, functions as F

from ringfence.operators.rank import (
    ROWS_PER_BUCKET, as_position, cut_points, order_statistics, row_index, running_totals, value_histogram,
)
from ringfence.operators.sampling import hash_number
from ringfence.session import cut, join_small
from ringfence.spec import DatasetSpec


def normal_only(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows the spec's rule does not call anomalous."""
    return df.filter(spec.rule.column(spec.target) == 0)


def members(df: DataFrame, column: str, keep: DataFrame | Sequence) -> DataFrame:
    """Rows whose ``column`` is in a short list, or in the same-named column of a table."""
    if isinstance(keep, DataFrame):
        return df.join(keep.select(column), column, "left_semi")
    return df.filter(F.col(column).isin(list(keep)))


def distinct_groups(df: DataFrame, group: str) -> DataFrame:
    return df.select(group).dropna().distinct()


def last_groups(df: DataFrame, group: str, order_col: str, n: int = 3) -> DataFrame:
    """The ``n`` groups that appear last, by the first row of each."""
    firsts = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(order_col).alias("first_seen"))
    return firsts.orderBy(F.desc("first_seen"), F.desc(group)).limit(n)


def holdout_last_groups(df: DataFrame, group: str, order_col: str, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(train, test): test holds the last ``n`` groups; rows without a group stay in train."""
    held = F.broadcast(last_groups(df, group, order_col, n).select(group))  # n rows
    return df.join(held, group, "left_anti"), df.join(held, group, "left_semi")


def holdout_tail(
    df: DataFrame, order_col: str, ties: Sequence[str] = (), share: float = 0.8, rows_per_bucket: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, DataFrame]:
    """(train, test): test starts at row int(share * n) in (``order_col``, ``ties``) order, by value.

    Only the first test row is looked up; the rows themselves are filtered, not
    moved. Positions as doubles find the neighbourhood; the columns themselves decide
    in it, so large integers are told apart. Rows without an order value stay in train.
    """
    kind = dict(df.dtypes)[order_col]
    at = as_position(F.col(order_col), kind) + F.lit(0.0)
    known = F.nullif(at, F.lit(float("nan"))).isNotNull()
    rows = df.filter(known).count()
    first = int(rows * share)
    if first >= rows:
        return df, df.limit(0)
    edge, below, same = order_statistics(df.filter(known).select(at.alias("_at")), "_at", [first], rows, rows_per_bucket)[first]
    late = at >= edge
    if same > 1:
        place = F.struct(order_col, *ties)
        inside = row_index(df.filter(known & (at == edge)).select(*dict.fromkeys([order_col, *ties])), order_col, ties, (), same, rows_per_bucket, "_i", None)
        limit = cut(inside.filter(F.col("_i") == first - below).select(place.alias("_place")), "edge")
        late = (at > edge) | ((at == edge) & (place >= limit.scalar()))
    late = F.coalesce(late & known, F.lit(False))
    return df.filter(~late), df.filter(late)


def min_group_size(df: DataFrame, group: str, least: int = 5) -> DataFrame:
    """Rows of groups with at least ``least`` rows; groups are counted before they are joined back."""
    big = df.groupBy(group).count().filter(F.col("count") >= least).select(group)
    return df.join(big, group, "left_semi")


def group_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): ceil(test_share * groups) groups go to test, whole.

    Groups are taken in hash order up to one cut-off number, so the rows
    themselves are only filtered: no join and no shuffle, whatever a group's size.
    """
    groups = distinct_groups(df, group).select(hash_number([group], seed).cast("double").alias("h"))
    total = groups.count()
    wanted = ceil(test_share * total - 1e-9)
    if not wanted:
        return df, df.limit(0)
    ranked = running_totals(value_histogram(groups, "h"), "h", ["n"], (), cut_points(groups, F.col("h"), total))
    edge = ranked.filter((F.col("n_before") < wanted)).agg(F.max("h")).first()[0]
    own = hash_number([group], seed)
    held = F.col(group).isNotNull() & (own <= int(edge))
    return df.filter(~held), df.filter(held)


def fold_count(groups: int, most: int = 5) -> int:
    return most if groups >= most else max(2, groups)


def _level(classes: list[tuple[int, int]], folds: int) -> list[tuple[int, list[int]]]:
    """Groups per fold for each (size, how many) class, largest size first, lightest fold first."""
    load = [0] * folds
    plan = []
    for size, many in classes:
        take = [0] * folds
        # fill to a common level in one step, then hand out the rest one by one
        if many > 4 * folds:
            top = max(load)
            for f in range(folds):
                take[f] = (top - load[f]) // size
            spare = many - sum(take)
            if spare >= 0:
                take = [t + spare // folds for t in take]
                many = spare % folds
            else:
                take = [0] * folds
            load = [w + t * size for w, t in zip(load, take)]
        for _ in range(many):
            f = load.index(min(load))
            load[f] += size
            take[f] += 1
        plan.append((size, take))
    return plan


def group_folds(df: DataFrame, group: str, folds: int | None = None, seed: int = 42) -> DataFrame:
    """(group, n_rows, fold): largest groups first, each to the lightest fold, 0-based.

    Groups of equal size are interchangeable, so only the histogram of sizes is
    planned on the driver (fewer than sqrt(2 * rows) entries), not the groups.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    classes = [(r["n_rows"], r["many"]) for r in
               sizes.groupBy("n_rows").agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("n_rows")).collect()]
    k = folds or fold_count(sum(m for _, m in classes))
    spans = []
    for size, take in _level(classes, k):
        at = 0
        for f, t in enumerate(take):
            if t:
                spans.append((size, f, at, at + t))
                at += t
    plan = df.sparkSession.createDataFrame(spans or [(0, 0, 0, 0)], "n_rows bigint, fold int, lo bigint, hi bigint")
    ranked = row_index(
        sizes.withColumn("_h", hash_number([group], seed)), "_h", [group], ["n_rows"], sum(m for _, m in classes),
        name="_at", total=None,
    )
    return (
        join_small(ranked, plan, "n_rows")
        .filter((F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi")))
        .select(group, "n_rows", "fold")
    )


def with_folds(df: DataFrame, group: str, folds: int | None = None, seed: int = 42) -> DataFrame:
    """Add ``fold``; a group never straddles folds. A NULL group counts as one group."""
    table = cut(group_folds(df, group, folds, seed).select(F.col(group).alias("_g"), "fold"), "folds")
    return join_small(df, table, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
