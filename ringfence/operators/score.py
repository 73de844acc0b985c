"""Scoring rows against one model or one model per key.

Models below a checked size are broadcast and applied to Arrow batches without
a shuffle. Keyed models beyond it are joined on the key and evaluated by JVM
expressions, so neither the driver nor a task ever holds all of them.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ringfence.functions.kernel import from_fields, judge, similarity
from ringfence.session import cut, key_join

BROADCAST_BYTES = 64 << 20
OUTSIDE_EPS = 1e-6
# Distances are taken this many cells (rows x support vectors) at a time.
CELLS_PER_STEP = 4_000_000

_DETAIL = ("raw_score", "max_sim", "zone")


def matrix(batch: pa.Table | pa.RecordBatch, features: Sequence[str] | str, width: int | None = None) -> np.ndarray:
    """Feature columns, or one array column, as a float64 matrix; NULL becomes NaN.

    With ``width`` given, an array that is missing or of another length is a row of NaN; without, an error.
    """
    if isinstance(features, str):
        col = batch.column(features)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        if len(col) == 0:
            return np.empty((0, 0))
        if width is not None:
            fits = pc.equal(pc.list_value_length(col), width).fill_null(False)
            out = np.full((len(col), width), np.nan)
            out[fits.to_numpy(zero_copy_only=False)] = col.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)
            return out
        widths = np.diff(col.offsets.to_numpy())
        if (widths != widths[0]).any() or col.null_count:
            raise ValueError(f"vectors in '{features}' differ in length or are missing")
        return col.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(col), -1)
    return np.column_stack(
        [np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch)
                    else batch.column(c).to_numpy(), dtype=float) for c in features]
    )


def _apply(model, x: np.ndarray, flag_far: bool):
    """score, raw, best similarity for a matrix, in steps of bounded size."""
    step = max(1, CELLS_PER_STEP // max(1, len(model.alpha)))
    outs = [np.empty(len(x)) for _ in range(3)]
    for a in range(0, len(x), step):
        part = judge(similarity(x[a : a + step], model.sv, model.sigma), model.alpha, model.radius, model.near, model.far)
        for out, values in zip(outs, part):
            out[a : a + step] = values
    if flag_far:
        far = outs[2] < model.far
        outs[0][far] = outs[1][far]
    return outs


def model_bytes(models: DataFrame) -> int:
    """Size of the scoring part of all models: support vectors and weights."""
    total = models.agg(F.sum((F.col("n_sv").cast("long") * (F.col("dim") + 1)) * 8 + 64)).first()[0]
    return int(total or 0)


def _detail_fields() -> list[T.StructField]:
    return [
        T.StructField("raw_score", T.DoubleType()),
        T.StructField("max_sim", T.DoubleType()),
        T.StructField("zone", T.StringType()),
    ]


def _zone(best: Column, near: Column, far: Column) -> Column:
    return F.when(best.isNull(), None).when(best < far, "far").when(best > 1 - near, "duplicate").otherwise("scored")


def score(
    df: DataFrame,
    models: DataFrame,
    features: Sequence[str] | str,
    by: Sequence[str] = (),
    keep: Sequence[str] | None = None,
    attach: Sequence[str] = (),
    detail: bool = False,
    flag_far: bool = False,
    timed: bool = False,
    outside_only: bool = False,
    outside_eps: float = OUTSIDE_EPS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``score``: radius minus weighted similarity, positive outside the boundary.

    A row very far from every support vector, or equal to one, scores -1;
    ``flag_far`` lets far rows keep their raw score. ``detail`` adds
    ``raw_score``, ``max_sim`` and ``zone``. ``attach`` copies columns of the
    model. Rows with a missing feature, or whose key has no model, score NULL.
    ``keep`` names the columns to return next to the keys (default: all); others are
    not read, or not sent back from Python.
    ``timed`` adds ``score_seconds``, a row's share of the time its batch took in the kernel.
    ``outside_only`` keeps just the rows scoring above ``outside_eps``.
    """
    by, attach = list(by), list(attach)
    names = [features] if isinstance(features, str) else list(features)
    kept = df.columns if keep is None else list(dict.fromkeys([*by, *keep]))
    df = df.select(*dict.fromkeys([*kept, *by, *names]))
    if model_bytes(models) <= broadcast_bytes:
        return _score_broadcast(df, models, features, by, kept, attach, detail, flag_far, timed, outside_only, outside_eps)
    if not by:
        raise ValueError("a single model larger than the broadcast limit: its k x k inverse could not have been fitted")
    out = score_joined(df, models, features, by, attach, detail, flag_far)
    out = out.drop(*[c for c in df.columns if c not in kept])
    if timed:
        # JVM expressions have no clock of their own: a row's share of the time that all rows took
        clock = time.perf_counter()
        out = cut(out, "timed")
        out = out.withColumn("score_seconds", F.lit((time.perf_counter() - clock) / max(1, out.count())))
    return out.filter(F.col("score") > outside_eps) if outside_only else out


def _score_broadcast(df, models, features, by, kept, attach, detail, flag_far, timed, outside_only, eps) -> DataFrame:
    spark = df.sparkSession
    fields = ["sv", "alpha", "radius", "sigma", "eps_near", "eps_far", "seen", "n_sv", "dim"]
    rows = models.select(*by, *attach, *fields).collect()
    shared = {}
    for r in rows:
        shared[tuple(r[k] for k in by)] = (
            _Scorer(r),
            tuple(r[a] for a in attach),
        )
    box = spark.sparkContext.broadcast(shared)
    kinds = {f.name: f for f in models.schema.fields}
    own = {f.name: f for f in df.schema.fields}
    schema = T.StructType(
        [own[c] for c in kept]
        + [kinds[a] for a in attach]
        + [T.StructField("score", T.DoubleType())]
        + (_detail_fields() if detail else [])
        + ([T.StructField("score_seconds", T.DoubleType())] if timed else [])
    )
    attach_types = [pa.int64() if isinstance(kinds[a].dataType, T.LongType) else None for a in attach]
    by_list, names = list(by), list(features) if not isinstance(features, str) else features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = box.value
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            clock = time.perf_counter()
            plain = None if isinstance(names, str) else matrix(batch, names)
            outs = [np.full(n, np.nan) for _ in range(3)]
            zones = np.full(n, None, dtype=object)
            extra = [np.full(n, None, dtype=object) for _ in attach]
            if by_list:
                keys = batch.select(by_list).to_pandas()
                groups = keys.groupby(by_list if len(by_list) > 1 else by_list[0], dropna=False, sort=False).indices
                parts = [(k if isinstance(k, tuple) else (k,), i) for k, i in groups.items()]
                parts = [(tuple(_plain(v) for v in k), i) for k, i in parts]
            else:
                parts = [((), None)]
            for key, at in parts:
                if key not in known:
                    continue
                model, values = known[key]
                at = slice(None) if at is None else at
                x = plain if plain is not None else matrix(batch, names, model.sv.shape[1])
                got = _apply(model, x[at], flag_far)
                for out, v in zip(outs, got):
                    out[at] = v
                for e, v in zip(extra, values):
                    e[at] = v
                if detail:
                    best = got[2]
                    zones[at] = np.where(
                        np.isnan(best), None,
                        np.where(best < model.far, "far", np.where(best > 1 - model.near, "duplicate", "scored")),
                    )
            cols = [batch.column(c) for c in kept]
            cols += [pa.array(e.tolist(), type=t) for e, t in zip(extra, attach_types)]
            cols.append(pa.array(outs[0], mask=np.isnan(outs[0])))
            if detail:
                cols += [pa.array(outs[1], mask=np.isnan(outs[1])), pa.array(outs[2], mask=np.isnan(outs[2]))]
                cols.append(pa.array(zones.tolist(), type=pa.string()))
            if timed:
                cols.append(pa.array(np.full(n, (time.perf_counter() - clock) / n)))
            made = pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())
            if outside_only:
                made = made.filter(pa.array(np.nan_to_num(outs[0], nan=-1.0) > eps))
            yield made

    return df.mapInArrow(run, schema)


class _Scorer:
    """The scoring part of a model: no inverse matrix."""

    def __init__(self, r):
        self.sv = np.array(r["sv"], dtype=float).reshape(int(r["n_sv"]), int(r["dim"]))
        self.alpha = np.array(r["alpha"], dtype=float)
        self.radius, self.sigma = float(r["radius"]), float(r["sigma"])
        self.near, self.far = float(r["eps_near"]), float(r["eps_far"])


def _plain(v):
    """Key value as Spark's rows hold it."""
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return v.item() if isinstance(v, np.generic) else v


def similarity_columns(features: Sequence[str] | str) -> Column:
    """Array of similarities of a row to the flat ``sv`` array joined to it (JVM-side)."""
    if isinstance(features, str):
        def gap(i):
            own = F.slice("sv", i * F.col("dim") + 1, F.col("dim"))
            return F.aggregate(
                F.zip_with(own, features, lambda s, v: (v.cast("double") - s) * (v.cast("double") - s)),
                F.lit(0.0), lambda a, b: a + b,
            )
    else:
        def gap(i):
            total = F.lit(0.0)
            for j, name in enumerate(features):
                step = F.col(name) - F.get("sv", (i * F.col("dim") + j).cast("int"))
                total = total + step * step
            return total
    width = F.lit(-0.5) / (F.col("sigma") * F.col("sigma"))
    return F.transform(F.sequence(F.lit(0), F.col("n_sv") - 1), lambda i: F.exp(gap(i) * width))


def score_joined(df, models, features, by, attach=(), detail=False, flag_far=False) -> DataFrame:
    """``score`` as a join on the key plus array expressions; rows of a hot key may be split by AQE."""
    fields = ["sv", "alpha", "radius", "sigma", "eps_near", "eps_far", "n_sv", "dim"]
    side = models.select(*by, *attach, *fields)
    names = [features] if isinstance(features, str) else list(features)
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
        if isinstance(features, str):
            whole = whole & (F.size(c) == F.col("dim")) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
        else:
            whole = whole & ~F.isnan(F.col(c))
    out = (
        key_join(df, side, by, "left")
        .withColumn("_sims", F.when(whole & F.col("n_sv").isNotNull(), similarity_columns(features)))
        .withColumns({
            "max_sim": F.array_max("_sims"),
            "raw_score": F.col("radius")
            - F.aggregate(F.zip_with("_sims", "alpha", lambda s, a: s * a), F.lit(0.0), lambda a, b: a + b),
        })
    )
    far, near = F.col("max_sim") < F.col("eps_far"), F.col("max_sim") > 1 - F.col("eps_near")
    forced = near if flag_far else (far | near)
    out = out.withColumns({
        "score": F.when(F.col("max_sim").isNull(), None).when(forced, -1.0).otherwise(F.col("raw_score")),
        "zone": _zone(F.col("max_sim"), F.col("eps_near"), F.col("eps_far")),
    })
    return out.select(*df.columns, *attach, "score", *(_DETAIL if detail else ()))


def uniform_model(vectors: DataFrame, vector: str, order: str, sigma: float, radius: float) -> DataFrame:
    """A model with given support vectors and equal weights, for scoring against fixed references.

    ``vectors`` must be a small table of reference points: they all become one row.
    """
    packed = vectors.agg(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col(vector).cast("array<double>").alias("v")))).alias("all")
    )
    n = F.size("all")
    return packed.select(
        F.flatten(F.transform("all", lambda s: s["v"])).alias("sv"),
        F.transform("all", lambda s: F.lit(1.0) / n).alias("alpha"),
        F.array().cast("array<double>").alias("inverse"),
        F.lit(float(radius)).alias("radius"),
        F.lit(float(sigma)).alias("sigma"),
        F.lit(1e-8).alias("eps_near"),
        F.lit(1e-8).alias("eps_far"),
        n.cast("long").alias("seen"),
        n.alias("n_sv"),
        F.size(F.col("all")[0]["v"]).alias("dim"),
    )


def boundary(models: DataFrame):
    """The single model of a one-row table as a kernel object (driver side)."""
    rows = models.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one model, found {len(rows)}")
    return from_fields(rows[0])
