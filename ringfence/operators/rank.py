"""Ordered cumulative sums, row positions and exact quantiles without one giant task.

A window ordered over a whole table runs in a single task. Here the value range
is cut at sketch quantiles, each bucket is summed on its own, and the running
total of the buckets before it enters the bucket as a header row. A bucket is a
function of the value, or, for row positions, of the range of (order, ties) in
which the row was written, so a retried task sees the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ringfence.session import cut, join_small

ROWS_PER_BUCKET = 2_000_000

_FIRST = Window.unboundedPreceding


# One sketch is asked for at most this many ranges; more come from a sketch inside each range.
RANGES = 1_000


def _even(value: Column, parts: int) -> Column:
    return F.percentile_approx(value, [i / parts for i in range(1, parts)], max(10_000, 8 * parts))


def cut_points(
    df: DataFrame, value: Column, rows: int, rows_per_bucket: int = ROWS_PER_BUCKET, ranges: int = RANGES
) -> list[float]:
    """Sketch quantiles of ``value`` cutting ``rows`` rows into even buckets; repeats mark hot values.

    Many buckets are found in two levels: ``ranges`` coarse ones, then even cuts inside each of them, by one
    sketch per range, so that no sketch grows with the table. The driver gets one number a bucket.
    """
    buckets = ceil(rows / rows_per_bucket)
    if buckets <= 1:
        return []
    found = sorted(df.agg(_even(value, min(buckets, ranges)).alias("cuts")).first()["cuts"] or [])
    if buckets <= ranges or not found:
        return found
    # rows at a cut are left out, so that a hot value does not use up the cuts of its range
    between = df.select(value.alias("_cut")).filter(~F.col("_cut").isin(sorted(set(found))))
    placed = _with_bucket(between, "_cut", found, "_range")
    inside = placed.groupBy("_range").agg(_even(F.col("_cut"), ceil(buckets / ranges)).alias("cuts"))
    return sorted([*found, *(c for r in inside.collect() for c in r["cuts"] or [])])


def _with_bucket(df: DataFrame, value: str, cuts: Sequence[float], out: str) -> DataFrame:
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    coded = Bucketizer(splits=splits, inputCol=value, outputCol=out).transform(df)
    return coded.withColumn(out, F.col(out).cast("int"))


def value_histogram(df: DataFrame, value: str, by: Sequence[str] = (), positive: str | None = None) -> DataFrame:
    """Rows per distinct value (and group): the map-side combine before any ranking.

    With ``positive`` (a 0/1 column) the counts are split into ``pos`` and ``neg``.
    NULL and NaN values are left out.
    """
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cell = known.groupBy(*by, (F.col(value).cast("double") + F.lit(0.0)).alias(value))
    if positive is None:
        return cell.agg(F.count(F.lit(1)).alias("n"))
    hit = F.col(positive) == 1
    return cell.agg(F.count_if(hit).alias("pos"), F.count_if(~hit | F.col(positive).isNull()).alias("neg"))


def running_totals(
    hist: DataFrame,
    value: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    cuts: Sequence[float] = (),
    previous: bool = False,
) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller values of the group) and ``<m>_total``.

    ``hist`` has one row per value and group. With ``previous`` the measures of
    the next smaller value come along as ``<m>_prev``.
    """
    by = list(by)
    if not cuts:
        group = Window.partitionBy(*(by or [F.lit(0)]))
        ordered = group.orderBy(value)
        added = {}
        for m in measures:
            added[f"{m}_before"] = F.coalesce(F.sum(m).over(ordered.rowsBetween(_FIRST, -1)), F.lit(0))
            added[f"{m}_total"] = F.sum(m).over(group.rowsBetween(_FIRST, Window.unboundedFollowing))
            if previous:
                added[f"{m}_prev"] = F.lag(m).over(ordered)
        return hist.withColumns(added)

    placed = _with_bucket(hist, value, cuts, "_bucket")
    keys = [*by, "_bucket"]
    sums = placed.groupBy(*keys).agg(
        *[F.sum(m).alias(m) for m in measures],
        F.max_by(F.struct(*measures), value).alias("_last"),
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    ordered = group.orderBy("_bucket")
    heads = sums.select(
        *keys,
        F.lit(0).alias("_body"),
        *[F.coalesce(F.sum(m).over(ordered.rowsBetween(_FIRST, -1)), F.lit(0)).alias(m) for m in measures],
        *[F.sum(m).over(group.rowsBetween(_FIRST, Window.unboundedFollowing)).alias(f"{m}_total") for m in measures],
        F.lag("_last").over(ordered).alias("_mine"),
    )
    body = placed.withColumns({"_body": F.lit(1), "_mine": F.struct(*measures)})
    both = body.unionByName(heads, allowMissingColumns=True)
    inside = Window.partitionBy(*keys).orderBy("_body", value)
    added = {}
    for m in measures:
        added[f"{m}_before"] = F.sum(m).over(inside.rowsBetween(_FIRST, -1))
        added[f"{m}_total"] = F.first(f"{m}_total").over(inside.rowsBetween(_FIRST, 0))
    if previous:
        added["_prev"] = F.lag("_mine").over(inside)
    out = both.withColumns(added).filter(F.col("_body") == 1)
    if previous:
        out = out.withColumns({f"{m}_prev": F.col("_prev")[m] for m in measures})
    return out.drop("_bucket", "_body", "_mine", "_prev")


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, each lengthened by underscores until it is none of ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def as_position(c: Column, dtype: str) -> Column:
    """Order column as a double: numbers as they are, times as microseconds."""
    if dtype.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if dtype == "date":
        return F.unix_date(c).cast("double")
    return c.cast("double")


def row_index(
    df: DataFrame,
    order_col: str,
    ties: Sequence[str] = (),
    by: Sequence[str] = (),
    rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    name: str = "row_idx",
    total: str | None = "n_rows",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the 0-based position of each row by ``order_col`` and the row count, per group.

    Rows are in order of (``order_col``, ``ties``) by value, NULL first and NaN last, at
    every size; together these columns must identify a row. Long tables are
    written in ranges of (``by``, ``order_col``, ``ties``), so neither a hot group nor a hot
    value fills a task. ``keep`` names the columns to return next to the keys (default: all); others are not written.
    """
    by, ties = list(by), list(ties)
    order = [order_col, *ties]
    kept = df.columns if keep is None else list(dict.fromkeys([*by, *keep]))
    rows = df.count() if rows is None else rows
    buckets = ceil(rows / rows_per_bucket)
    if buckets <= 1:
        group = Window.partitionBy(*(by or [F.lit(0)]))
        added = {name: F.row_number().over(group.orderBy(*order)).cast("long") - 1}
        if total:
            added[total] = F.count(F.lit(1)).over(group)
        return df.withColumns(added).select(*kept, *added)

    # the columns made on the way must not be among the caller's: a key may well be called "_all"
    bucket, below, every, count, at = unused([*df.columns, name, total or name], "_bucket", "_below", "_all", "_n", "_at")
    # a range is sorted as it is written, and its rows are numbered then, so that they move and are sorted once only
    ranges = df.repartitionByRange(buckets, *by, *order).sortWithinPartitions(*by, *order)
    # the number's upper bits are the range again
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(ranges.select(*kept, F.spark_partition_id().alias(bucket), place.alias(at)), "ranges")
    keys = [*by, bucket]
    group = Window.partitionBy(*(by or [F.lit(0)]))
    # rows of a group are consecutive in their range, from the smallest number on
    heads = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), F.min(at).alias(below)).select(
        *keys,
        (F.coalesce(F.sum(count).over(group.orderBy(bucket).rowsBetween(_FIRST, -1)), F.lit(0)) - F.col(below)).alias(below),
        F.sum(count).over(group).alias(every),
    )
    out = join_small(placed, cut(heads, "heads"), keys).withColumn(name, F.col(at) + F.col(below))
    if total:
        out = out.withColumn(total, F.col(every))
    return out.drop(bucket, below, every, at)


def _ranked(df: DataFrame, value: str, by: list[str], rows_per_bucket: int, rows: int | None) -> DataFrame:
    """Values with their counts and the counts below; buckets by all rows, as groups may lie in narrow ranges."""
    rows = df.count() if rows is None else rows
    known = df.filter(~F.isnan(F.col(value).cast("double")))
    cuts = cut_points(known, F.col(value).cast("double"), rows, rows_per_bucket)
    return running_totals(value_histogram(df, value, by), value, ["n"], by, cuts)


# A sketch places a wanted rank within rows / SKETCH; the bracket around it is SLACK times wider.
SKETCH, SLACK = 10_000, 3


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int], rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> dict[int, tuple[float, int, int]]:
    """rank -> (value, rows below it, rows equal to it) for close 0-based ranks of a whole column.

    A sketch gives a bracket around the ranks; one pass counts the rows under it,
    and only the values inside it are shuffled. ``rows`` is the number of known values.
    """
    v = F.col("_v")
    known = df.select(F.nullif(F.col(value).cast("double") + F.lit(0.0), F.lit(float("nan"))).alias("_v")).filter(v.isNotNull())
    low, high = min(ranks), max(ranks)
    brackets = [(float("-inf"), float("inf"))]
    if rows > rows_per_bucket:
        ends = [max(0.0, low / rows - SLACK / SKETCH), min(1.0, high / rows + SLACK / SKETCH)]
        found = known.agg(F.percentile_approx(v, ends, SKETCH)).first()[0]
        # the wide bracket stays as the answer to a sketch that missed
        brackets.insert(0, (float("-inf") if ends[0] == 0 else found[0], float("inf") if ends[1] == 1 else found[1]))
    for lo, hi in brackets:
        below = 0 if lo == float("-inf") else known.filter(v < lo).count()
        near = known.filter((v >= lo) & (v <= hi))
        expected = rows if lo == float("-inf") and hi == float("inf") else int(rows * 4 * SLACK / SKETCH) + high - low
        cuts = cut_points(near, v, expected, rows_per_bucket)
        cells = running_totals(value_histogram(near, "_v"), "_v", ["n"], (), cuts)
        first, after = F.col("n_before") + below, F.col("n_before") + F.col("n") + below
        wanted = F.lit(False)
        for r in ranks:
            wanted = wanted | ((first <= r) & (F.lit(r) < after))
        hits = cells.filter(wanted).select("_v", first.alias("first"), "n").collect()
        out = {}
        for r in ranks:
            out.update({r: (h["_v"], h["first"], h["n"]) for h in hits if h["first"] <= r < h["first"] + h["n"]})
        if len(out) == len(set(ranks)):
            return out
    raise ValueError(f"ranks {list(ranks)} are not among {rows} known values of '{value}'")


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one output column per entry of ``probs``.

    Unlike ``percentile``, no task holds all distinct values of a group. NULL and
    NaN are left out.
    """
    by = list(by)
    if not by:
        known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
        if known > rows_per_bucket:
            return _whole_quantiles(df, value, probs, known, rows_per_bucket)
    ranked = _ranked(df, value, by, rows_per_bucket, rows)
    first, after, v = F.col("n_before"), F.col("n_before") + F.col("n"), F.col(value)
    aggs = []
    for name, q in probs.items():
        spot = F.lit(float(q)) * (F.col("n_total") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        aggs += [
            F.max(F.when((first <= low) & (low < after), v)).alias(f"{name}_low"),
            F.max(F.when((first <= high) & (high < after), v)).alias(f"{name}_high"),
            F.max(spot - low).alias(f"{name}_part"),
        ]
    picked = ranked.groupBy(*by).agg(*aggs)
    return picked.select(
        *by,
        *[
            (F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n)
            for n in probs
        ],
    )


def _whole_quantiles(df, value, probs, rows, rows_per_bucket) -> DataFrame:
    """Quantiles of a whole long column from bracketed order statistics; one row."""
    found = {}
    for name, q in probs.items():
        spot = q * (rows - 1)
        low = int(spot)
        ranks = sorted({low, min(low + 1, rows - 1)})
        got = order_statistics(df, value, ranks, rows, rows_per_bucket)
        a, b = got[ranks[0]][0], got[ranks[-1]][0]
        found[name] = a + (b - a) * (spot - low)
    return df.sparkSession.range(1).select(*[F.lit(v).alias(n) for n, v in found.items()])
