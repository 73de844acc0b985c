"""Row samples, kernel width and mini-batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ringfence.operators.rank import row_index
from ringfence.operators.score import matrix
from ringfence.session import cut

# Sample sizes of the width heuristic and of the latency report.
SIGMA_SAMPLE = 2000
LATENCY_SAMPLE = 1000


def hash_number(ids: Sequence[str], seed: int = 42) -> Column:
    """Pseudo-random 52-bit number that depends only on a row's identity and the seed."""
    text = F.concat_ws("#", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def lowest_hashed(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hash, which stays in column ``_h``.

    A long table is first cut by a hash bound that leaves somewhat more than ``n``
    rows, so that its partitions do not each send their own ``n`` to the final sort.
    """
    hashed = df.withColumn("_h", hash_number(ids, seed))
    rows = df.count()
    if rows > 20 * n:
        bound = int(2**52 * min(1.0, (1.5 * n + 1000) / rows))
        few = cut(hashed.filter(F.col("_h") < bound), "lowest")  # hashed once, then counted and sorted
        if few.count() >= n:
            hashed = few
    return hashed.orderBy("_h", *ids).limit(n)


def sample(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows without replacement (all, if fewer); a top-n by hash, the same on every run."""
    return lowest_hashed(df, n, ids, seed).drop("_h")


def median_sigma(df: DataFrame, features: Sequence[str] | str, ids: Sequence[str], n: int = SIGMA_SAMPLE, seed: int = 42) -> DataFrame:
    """One row (sigma): median positive pairwise distance of a sample over sqrt(2), at least 1e-6.

    The sample of at most ``n`` rows is the heuristic's own definition; it meets
    in one task as an n x n matrix, so no pairs travel through Spark.
    """
    names = [features] if isinstance(features, str) else list(features)
    small = sample(df.select(*dict.fromkeys([*ids, *names])), n, ids, seed).select(*names)

    def width(table):
        x = matrix(table, features)
        dist = np.zeros((len(x), len(x)))
        for j in range(x.shape[1]):
            step = x[:, j, None] - x[None, :, j]
            dist += step * step
        dist = np.sqrt(dist[np.triu_indices(len(x), 1)])
        dist = dist[dist > 0]
        value = max(1e-6, float(np.median(dist)) / np.sqrt(2.0)) if len(dist) else 1e-6
        return pa.table({"sigma": [value], "sample_rows": [len(x)]})

    return small.groupBy().applyInArrow(width, "sigma double, sample_rows bigint")


def resolve_sigma(method: str, value: float | None, df=None, features=None, ids=None, seed: int = 42) -> float:
    """Kernel width of a spec: its fixed value, or the median heuristic on ``df``."""
    if method == "fixed":
        return float(value)
    if method == "median_heuristic":
        return median_sigma(df, features, ids, seed=seed).first()["sigma"]
    raise ValueError(f"Unknown sigma method: {method}")


def mini_batches(df: DataFrame, size: int, order_col: str, ties=(), by=(), **rank) -> DataFrame:
    """Add ``batch_id``: consecutive slices of ``size`` rows."""
    out = row_index(df, order_col, ties, by, name="_at", total=None, **rank)
    return out.withColumn("batch_id", F.floor(F.col("_at") / size)).drop("_at")


def pseudo_groups(df: DataFrame, order_col: str, ties=(), size: int = 100, **rank) -> DataFrame:
    """Add ``pseudo_group`` for tables without a grouping column: blocks of ``size`` rows."""
    return mini_batches(df, size, order_col, ties, **rank).withColumnRenamed("batch_id", "pseudo_group")
