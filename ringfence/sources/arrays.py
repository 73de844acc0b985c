"""Session files that hold one array per measured quantity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def flatten(df: DataFrame, arrays: Sequence[str], keep: Sequence[str] = (), position: str = "pos") -> DataFrame:
    """One row per array position, cut to the shortest array of the row.

    Rows lacking one of the arrays are left out, as is a whole column that is absent.
    """
    absent = [c for c in arrays if c not in df.columns]
    if absent:
        raise ValueError("Missing columns: " + ", ".join(absent))
    whole = df.dropna(subset=list(arrays))
    sizes = [F.size(c) for c in arrays]
    shortest = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    cut = [F.slice(c, F.lit(1), shortest).alias(c) for c in arrays]
    zipped = whole.select(*keep, F.posexplode(F.arrays_zip(*cut)).alias(position, "_cell"))
    return zipped.select(*keep, position, *[F.col("_cell")[c].cast("double").alias(c) for c in arrays])


def unwrap_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Arrays stored as a 1 x N matrix become plain arrays of N values."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.flatten(c) for c in columns if kinds[c].startswith("array<array<")})
