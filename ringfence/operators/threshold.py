"""Decision thresholds: quantile of scores, flags, recent buffer, moving threshold."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ringfence.functions.columns import flag
from ringfence.operators.rank import quantiles, row_index
from ringfence.session import cut, join_small, new_path

EWMA_CHUNK = 1_000_000
LAST_SALTS = 64


def threshold(scored: DataFrame, q: float, by: Sequence[str] = (), score: str = "score", **rank) -> DataFrame:
    """Exact ``q`` quantile of the scores as ``tau``: one row, or one per key."""
    return quantiles(scored, score, {"tau": q}, by, **rank)


def flagged(scored: DataFrame, taus: DataFrame | float, by: Sequence[str] = (), margin: float = 0.0, score: str = "score") -> DataFrame:
    """Add ``tau`` and ``is_anomaly`` (0/1). Without keys the threshold comes in as one scalar."""
    if isinstance(taus, DataFrame):
        if by:
            out = join_small(scored, taus.select(*by, "tau"), list(by), "left")
        else:
            out = scored.withColumn("tau", taus.select("tau").scalar())
    else:
        out = scored.withColumn("tau", F.lit(float(taus)))
    return out.withColumn("is_anomaly", flag(F.col(score), F.col("tau"), margin))


def last_n(df: DataFrame, by: Sequence[str], order_col: str, n: int = 500, ties: Sequence[str] = ()) -> DataFrame:
    """The latest ``n`` rows per key, with ``age`` 1 for the newest.

    Spark pushes the rank limit below the shuffle, so a hot key sends at most ``n``
    rows per map task; those are first thinned out over ``LAST_SALTS`` tasks.
    """
    order = [F.desc(order_col), *[F.desc(t) for t in ties]]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order_col, *ties), F.lit(LAST_SALTS)))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    few = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n).drop("_r", "_salt")
    return few.withColumn("age", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("age") <= n)


# -- moving threshold ---------------------------------------------------------
#
# An accepted score s (s <= tau) moves tau to (1-a) tau + a s; any other leaves
# it. As a function of tau one row is min(tau, (1-a) tau + a s), and a run of
# rows is a minimum of lines whose slopes are powers of (1-a). The intercepts of
# those lines summarise a chunk of rows, so chunks can be summarised in parallel,
# chained, and replayed in parallel from their exact starting values.


def _summary(scores: np.ndarray, a: float) -> np.ndarray:
    depth = ceil(log(1e-18) / log(1.0 - a)) if a < 1 else 1
    lines = np.full(depth + 1, np.inf)
    lines[0] = 0.0
    for s in scores:
        moved = (1.0 - a) * lines + a * s
        lines[1:] = np.minimum(lines[1:], moved[:-1])
        lines[-1] = min(lines[-1], moved[-1])
    return lines


def _apply_summary(lines: np.ndarray, a: float, tau: float) -> float:
    slopes = (1.0 - a) ** np.arange(len(lines))
    return float((slopes * tau + lines).min())


def _replay(scores: np.ndarray, a: float, tau: float, margin: float):
    before, after, took = np.empty(len(scores)), np.empty(len(scores)), np.zeros(len(scores), np.int32)
    for i, s in enumerate(scores.tolist()):
        before[i] = tau
        if s == s and not s > tau + margin:
            tau = (1.0 - a) * tau + a * s
            took[i] = 1
        after[i] = tau
    return before, after, took


def _replayed(placed: DataFrame, by: list[str], last: int, finish, tau0: float, out: T.StructType) -> DataFrame:
    """Chunk by chunk: every key's chunk starts where its one before ended."""
    spark = placed.sparkSession
    path, starts = new_path(spark, "replayed"), None
    schema = T.StructType([*out.fields, T.StructField("_idx", T.LongType())])

    def step(left, right):
        start = left.column("tau_after")[0].as_py() if left.num_rows else tau0
        return finish(right, start).append_column("_idx", right.sort_by("_idx").column("_idx")) if right.num_rows else right.slice(0, 0)

    for c in range(last + 1):
        part = placed.filter(F.col("_chunk") == c)
        if starts is None:  # as a table, so that the two sides are told apart
            starts = cut(part.limit(0).select(*by, F.lit(0.0).alias("tau_after")), "starts")
        rows = starts.groupBy(*by).cogroup(part.groupBy(*by)).applyInArrow(step, schema)
        done = cut(rows, "replayed-chunk")
        done.select(*out.names).write.mode("append").parquet(path)
        starts = done.groupBy(*by).agg(F.max_by("tau_after", "_idx").alias("tau_after"))
    return spark.read.schema(out).parquet(path)


def moving_threshold(
    df: DataFrame,
    score: str,
    by: Sequence[str],
    order_col: str,
    tau0: float,
    alpha: float = 0.1,
    margin: float = 0.0,
    ties: Sequence[str] = (),
    skip_override: bool = False,
    chunk_rows: int = EWMA_CHUNK,
    **rank,
) -> DataFrame:
    """Add ``tau_used``, ``tau_after`` and ``accepted`` for every row, per key and in order.

    Rows scoring above ``tau_used + margin`` do not move the threshold, nor do
    missing scores, nor (``skip_override``) forced scores of -1. Keys longer than
    ``chunk_rows`` are summarised and replayed in chunks with the same result; with a
    margin, which no line describes, the chunks of a key are replayed one after another.
    """
    by = list(by)
    top = df.groupBy(*by).count().agg(F.max("count").alias("top"), F.sum("count").alias("all")).first()
    placed = row_index(df, order_col, ties, by, rows=top["all"] or 0, name="_idx", total=None, **rank)
    placed = placed.withColumn("_chunk", F.floor(F.col("_idx") / chunk_rows))
    out = T.StructType(
        [f for f in df.schema.fields]
        + [T.StructField("tau_used", T.DoubleType()), T.StructField("tau_after", T.DoubleType()),
           T.StructField("accepted", T.IntegerType())]
    )
    kept = df.columns

    def values(table):
        s = np.array(table.column(score).to_numpy(), dtype=float)
        return np.where(s == -1.0, np.nan, s) if skip_override else s

    def finish(table, start):
        table = table.sort_by("_idx")
        before, after, took = _replay(values(table), alpha, start, margin)
        made = table.select(kept)
        for name, col in (("tau_used", before), ("tau_after", after), ("accepted", took)):
            made = made.append_column(name, pa.array(col))
        return made

    if (top["top"] or 0) <= chunk_rows:
        return placed.groupBy(*by).applyInArrow(lambda table: finish(table, tau0), out)
    if margin:
        return _replayed(cut(placed, "placed"), by, int((top["top"] - 1) // chunk_rows), finish, tau0, out)

    kinds = {f.name: f for f in df.schema.fields}
    keys = [T.StructField(k, kinds[k].dataType) for k in by]

    def summarise(key, table):
        s = values(table.sort_by("_idx"))
        lines = _summary(s[~np.isnan(s)], alpha)
        cols = [pa.array([k.as_py()], type=k.type) for k in key]
        return pa.table([*cols, pa.array([lines.tolist()])], names=[*by, "_chunk", "lines"])

    def chain(table):
        table = table.sort_by("_chunk")
        tau, starts = tau0, []
        for lines in table.column("lines"):
            starts.append(tau)
            tau = _apply_summary(np.array(lines.as_py()), alpha, tau)
        return table.select([*by, "_chunk"]).append_column("start", pa.array(starts, type=pa.float64()))

    long = T.StructField("_chunk", T.LongType())
    sums = placed.groupBy(*by, "_chunk").applyInArrow(
        summarise, T.StructType([*keys, long, T.StructField("lines", T.ArrayType(T.DoubleType()))])
    )
    starts = sums.groupBy(*by).applyInArrow(chain, T.StructType([*keys, long, T.StructField("start", T.DoubleType())]))
    return starts.groupBy(*by, "_chunk").cogroup(placed.groupBy(*by, "_chunk")).applyInArrow(
        lambda left, right: finish(right, left.column("start")[0].as_py()), out
    )
