"""Fitting and updating boundaries on tables of any size.

The boundary depends on the order of the rows, one after the other, which looks
like a single-task job. It is not: a row inside the current boundary changes
nothing. So the rows of a key are numbered and cut into chunks of bounded size;
one task learns one chunk, all remaining rows are then tested in parallel, and
the next chunk to learn is the first one holding a row outside. Chunks in
between are passed over without changing the result, which equals the strictly
sequential pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.types import _parse_datatype_string

from ringfence.functions.kernel import MODEL_FIELDS, Boundary, from_fields, to_fields
from ringfence.operators.rank import ROWS_PER_BUCKET, row_index
from ringfence.operators.score import matrix, score
from ringfence.session import cut, join_small, key_join, new_path

# Feature cells one task may hold at once, and the width assumed for an array column.
CHUNK_CELLS = 6_000_000
ARRAY_WIDTH = 64
COUNTERS = ("processed", "added", "removed")

_BATCH = "array<struct<batch bigint, processed bigint, added bigint, removed bigint, n_sv bigint>>"
_STEP_FIELDS = (
    MODEL_FIELDS
    + ", processed bigint, added bigint, removed bigint, sv_before bigint, fit_seconds double"
    + f", batches {_BATCH}, trace array<double>"
)
_BATCH_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("batch", "processed", "added", "removed", "n_sv")]))
_MODEL_TYPES = {
    "sv": pa.list_(pa.float64()), "alpha": pa.list_(pa.float64()), "inverse": pa.list_(pa.float64()),
    "radius": pa.float64(), "sigma": pa.float64(), "eps_near": pa.float64(), "eps_far": pa.float64(),
    "seen": pa.int64(), "n_sv": pa.int32(), "dim": pa.int32(),
}
_STEP_TYPES = {
    **_MODEL_TYPES, "processed": pa.int64(), "added": pa.int64(), "removed": pa.int64(), "sv_before": pa.int64(),
    "fit_seconds": pa.float64(), "batches": _BATCH_TYPE, "trace": pa.list_(pa.float64()),
}

MODEL_COLUMNS = [f.strip().split()[0] for f in MODEL_FIELDS.split(",")]


def rows_per_task(features: Sequence[str] | str) -> int:
    return CHUNK_CELLS // (ARRAY_WIDTH if isinstance(features, str) else max(1, len(features)))


def _key_fields(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    kinds = {f.name: f for f in df.schema.fields}
    return [T.StructField(k, kinds[k].dataType) for k in by]


def _learn(model: Boundary | None, x: np.ndarray, width, batch_rows, traced, start_idx=0):
    """One task's step: start or continue ``model`` with the rows of one chunk, in order."""
    clock = time.perf_counter()
    whole = np.isfinite(x).all(axis=1) if len(x) else np.zeros(0, bool)
    trace: list | None = [] if traced else None
    counts = {"processed": 0, "added": 0, "removed": 0, "sv_before": model.size if model else 0}
    batches = []
    if len(x) and not whole.all():
        # a row with a missing feature can never be accepted; it only counts as seen
        skipped = int((~whole).sum())
        x = x[whole]
    else:
        skipped = 0
    if model is None:
        if not len(x):
            return None
        model = Boundary.start(x[0], width)
        counts.update(processed=1, added=1)
        todo, first = x[1:], 1
    else:
        todo, first = x, 0
    size = batch_rows or max(1, len(x))
    at = 0
    while at < len(todo) or (first and not batches):
        # the starting row belongs to the first batch
        upto = size - first if at == 0 else size
        part = todo[at : at + upto]
        got = model.learn(part, trace)
        for name in COUNTERS:
            counts[name] += got[name]
        if batch_rows:
            head = first if at == 0 else 0
            batches.append({
                "batch": start_idx // size + len(batches), "processed": got["processed"] + head,
                "added": got["added"] + head, "removed": got["removed"], "n_sv": model.size,
            })
        elif first:
            batches.append(None)
        at += len(part)
        if not len(part):
            break
    model.seen += skipped
    counts["processed"] += skipped
    return model, counts, [b for b in batches if b], trace, time.perf_counter() - clock


def _cell(value, kind) -> pa.Array:
    """One value as a column; numbers of an array stay out of Python's objects, which take four times their room."""
    if isinstance(value, np.ndarray):
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.array(value, pa.float64()))
    return pa.array([value], type=kind)


def _model_of(models: pa.Table) -> Boundary | None:
    """The model in the first row."""
    if not models.num_rows:
        return None
    row = {n: models.column(n)[0] for n in MODEL_COLUMNS}
    lists = {n for n, v in row.items() if isinstance(v, pa.ListScalar) and v.is_valid}
    return from_fields({n: v.values.to_numpy(zero_copy_only=False) if n in lists else v.as_py() for n, v in row.items()})


def _emit(key: tuple, by: Sequence[str], key_types, result) -> pa.Table:
    model, counts, batches, trace, seconds = result
    trace = None if trace is None else np.array(trace, dtype=float)
    row = {**to_fields(model), **counts, "fit_seconds": seconds, "batches": batches, "trace": trace}
    cols = [pa.array([k], type=t) for k, t in zip(key, key_types)]
    cols += [_cell(row[n], t) for n, t in _STEP_TYPES.items()]
    return pa.table(cols, names=[*by, *_STEP_TYPES])


def _empty(by, key_types) -> pa.Table:
    return pa.table([pa.array([], type=t) for t in (*key_types, *_STEP_TYPES.values())], names=[*by, *_STEP_TYPES])


def _plain_key(values):
    return tuple(v.as_py() if hasattr(v, "as_py") else v for v in values)


def _width(rows, sigma):
    return float(rows.column(sigma)[0].as_py()) if isinstance(sigma, str) and rows.num_rows else sigma


def _gathered(batches: Iterator[pa.RecordBatch], features, order, sigma):
    """Feature matrix of a key's rows in order, and the width. Of a batch only its features and its order are held on to."""
    cells, places, width = [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        if width is None:
            width = _width(batch, sigma)
        x = matrix(batch, features)
        # copies: the columns of a batch share its memory
        cells.append(x.copy() if isinstance(features, str) else x)
        places.append(batch.select([c for c, _ in order]).take(pa.array(np.arange(batch.num_rows))))
    if not cells:
        return np.empty((0, 0)), sigma
    if len({x.shape[1] for x in cells}) > 1:
        raise ValueError(f"vectors in '{features}' differ in length or are missing")
    place = pc.sort_indices(pa.Table.from_batches(places), sort_keys=order, null_placement="at_start").to_numpy()
    places.clear()
    x = np.concatenate(cells)
    cells.clear()
    return x[place], width


def _group_step(rows, models, by, features, sigma, batch_rows, traced) -> DataFrame:
    """Learn each key's rows in one task; ``models`` (one row per key) continues, else starts afresh.

    The caller bounds the rows that a key brings.
    """
    schema = T.StructType(_key_fields(rows, by) + _parse_datatype_string(_STEP_FIELDS).fields)
    order = [(c, "ascending") for c in (["_idx"] if "_idx" in rows.columns else _order_of(rows))]
    by = list(by)

    def start_of(table):
        return int(table.column("_idx")[0].as_py()) if "_idx" in table.column_names and table.num_rows else 0

    if models is None:
        def fresh(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _learn(None, *_gathered(batches, features, order, sigma), batch_rows, traced)
            if got is not None:
                yield from _emit(_plain_key(key), by, [k.type for k in key], got).to_batches()

        return rows.groupBy(*by).applyInArrow(fresh, schema)

    def carry_on(key, left, right):
        types = [left.schema.field(k).type for k in by]
        model = _model_of(left)
        table = _sorted(right, order)
        got = _learn(model, matrix(table, features), _width(table, sigma), batch_rows, traced, start_of(table))
        return _empty(by, types) if got is None else _emit(_plain_key(key), by, types, got)

    return models.select(*by, *MODEL_COLUMNS).groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(carry_on, schema)


def fit_legs(
    rows: DataFrame, features, by: Sequence[str], position: str, leg: str, models: DataFrame, sigma, batch_rows: int, trace: bool = True,
) -> DataFrame:
    """What :func:`fit_steps` does for each ``leg`` in turn, all legs of a key in one task: a step per key and leg with rows.

    Every leg begins with the model that the leg before left; ``models`` begin the first. ``batch`` counts from 0 in each leg.
    The caller bounds the rows that a key brings.
    """
    by = list(by)
    names = [features] if isinstance(features, str) else list(features)
    lean = rows.select(*dict.fromkeys([*by, *names, position, leg]))
    fields = _key_fields(lean, by) + _parse_datatype_string(_STEP_FIELDS).fields + [T.StructField(leg, T.LongType())]

    def learn_legs(key, left, right):
        types = [left.schema.field(k).type for k in by]
        model = _model_of(left)
        table = _sorted(right, [(position, "ascending")])
        parts = [_empty(by, types).append_column(leg, pa.array([], pa.int64()))]
        legs = table.column(leg).to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(legs)) + 1).tolist(), len(legs)] if len(legs) else [0]
        for a, b in zip(ends, ends[1:]):
            part = table.slice(a, b - a)
            got = _learn(model, matrix(part, features), _width(part, sigma), batch_rows, trace)
            if got is not None:
                model = got[0]
                parts.append(_emit(_plain_key(key), by, types, got).append_column(leg, pa.array([int(legs[a])], pa.int64())))
        return pa.concat_tables(parts)

    return models.select(*by, *MODEL_COLUMNS).groupBy(*by).cogroup(lean.groupBy(*by)).applyInArrow(learn_legs, T.StructType(fields))


def _order_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == "_head" or c.startswith("_t_")]


def _sorted(table: pa.Table, order) -> pa.Table:
    """In Spark's order: NULL first."""
    return table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))


def _lean(df, by, features, sigma, order_col, ties, seed) -> DataFrame:
    """Only what a fit needs: keys, features, and the order: ``_head``, then the order column and ties by value."""
    names = [features] if isinstance(features, str) else list(features)
    extra = [sigma] if isinstance(sigma, str) else []
    kinds = dict(df.dtypes)

    def place(c):
        # a missing number has no place of its own
        return F.nullif(F.col(c), F.lit(float("nan")).cast(kinds[c])) if kinds[c] in ("float", "double") else F.col(c)

    lean = df.select(
        *[F.col(c) for c in dict.fromkeys([*by, *extra, *names])], F.lit(1).alias("_head"),
        *[place(c).alias(f"_t_{i}") for i, c in enumerate([order_col, *ties])],
    )
    return _central_first(lean, list(by), features) if seed == "central" else lean


def number_rows(df: DataFrame, features, by: Sequence[str], order_col: str, ties: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Keys, features and the place of each row among those of its key, as the fit takes them."""
    lean = _lean(df, list(by), features, 1.0, order_col, ties, "first")
    place = _order_of(lean)
    kept = [c for c in lean.columns if c not in place]
    return row_index(lean, place[0], place[1:], list(by), lean.count(), ROWS_PER_BUCKET, name, None, kept)


def _vector(features):
    if isinstance(features, str):
        return F.transform(features, lambda v: v.cast("double"))
    return F.array(*[F.col(c).cast("double") for c in features])


def _whole(vector):
    """Whether no number of ``vector`` is missing or infinite."""
    return F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _central_first(lean: DataFrame, by: list[str], features) -> DataFrame:
    """``_head`` 0 for the row of each key that is nearest to the mean of its whole rows."""
    rows = lean.select(*by, *[c for c in lean.columns if c.startswith("_t_")], _vector(features).alias("_v")).filter(_whole(F.col("_v")))
    means = rows.select(*by, F.posexplode("_v").alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg("_x").alias("_m"))
    means = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_mean"))
    gaps = F.aggregate(F.zip_with("_v", "_mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    place = [c for c in rows.columns if c.startswith("_t_")]
    nearest = join_small(rows, cut(means, "means"), by).groupBy(*by).agg(F.min(F.struct(gaps.alias("_gap"), *place)).alias("_near"))
    same = F.lit(True)
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col("_near")[c])
    marked = join_small(lean, cut(nearest, "nearest"), by, "left")
    return marked.withColumn("_head", F.when(F.col("_near").isNotNull() & same, 0).otherwise(1)).drop("_near")


def fit_steps(
    df: DataFrame,
    features: Sequence[str] | str,
    by: Sequence[str],
    order_col: str,
    ties: Sequence[str] = (),
    sigma: float | str = 1.0,
    models: DataFrame | None = None,
    seed: str = "first",
    batch_rows: int | None = None,
    trace: bool = False,
    chunk_rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """(models, steps): the sequential fit per key, and what each learned chunk did.

    ``models`` given: continue those (an incremental update); keys without rows
    keep their model. ``sigma`` may name a column that is constant within a key.
    The result equals one pass over each key's rows in (``order_col``, ``ties``)
    order, whatever the number of rows per key. ``chunk_rows`` bounds what one
    task learns (default: ``CHUNK_CELLS`` divided by the number of features).
    """
    chunk_rows = chunk_rows or rows_per_task(features)
    by = list(by)
    ties = list(ties)
    lean = _lean(df, by, features, sigma, order_col, ties, seed if models is None else "first")
    sizes = df.groupBy(*by).count().agg(F.max("count").alias("top"), F.sum("count").alias("rows")).first()
    args = (features, sigma, batch_rows, trace)
    if (sizes["top"] or 0) <= chunk_rows:
        steps = cut(_group_step(lean, models, by, *args).withColumn("chunk", F.lit(0).cast("long")), "step")
        return steps.select(*by, *MODEL_COLUMNS), steps

    # Number the rows of every key and keep them as a table the later scans can prune by chunk.
    if batch_rows:
        chunk_rows = max(batch_rows, chunk_rows // batch_rows * batch_rows)
    # as in one task, vectors of a key have one length, and rows with a missing feature only count as seen
    size = F.size(features) if isinstance(features, str) else F.lit(0)
    uneven = (F.min(size) < F.max(size)) | (F.count(size) < F.count(F.lit(1)))
    met = cut(lean.groupBy(*by).agg(F.count(F.lit(1)).alias("_met"), uneven.alias("_uneven")), "met")
    if not met.filter("_uneven").isEmpty():
        raise ValueError(f"vectors in '{features}' differ in length or are missing")
    place = _order_of(lean)
    kept = [c for c in lean.columns if c not in place]
    numbered = row_index(lean.filter(_whole(_vector(features))), place[0], place[1:], by, sizes["rows"], rows_per_bucket, "_idx", None, kept)
    numbered = cut(numbered.withColumn("_chunk", F.floor(F.col("_idx") / chunk_rows)), "rows")
    last = cut(numbered.groupBy(*by).agg(F.max("_chunk").alias("_last")), "last")
    opening = numbered.filter(F.col("_chunk") == 0).drop("_chunk")
    first = _group_step(opening, models, by, *args).withColumn("chunk", F.lit(0).cast("long"))
    kept, known = new_path(df.sparkSession, "steps"), first.schema
    first.write.mode("error").parquet(kept)

    def at(path):
        return df.sparkSession.read.schema(known).parquet(path)

    current = cut(at(kept).select(*by, *MODEL_COLUMNS, F.lit(1).cast("long").alias("_next")), "current")
    span = 1
    while True:
        # in parallel: the first of the next ``span`` chunks of each key with a row outside its current boundary;
        # the look-ahead doubles while nothing is found, so a learned chunk costs few scanned ones
        active = cut(join_small(current, last, by).filter(F.col("_next") <= F.col("_last")).drop("_last"), "active")
        ends = active.agg(F.min("_next"), F.max("_next")).first()
        if ends[0] is None:
            break
        near = numbered.filter((F.col("_chunk") >= ends[0]) & (F.col("_chunk") < ends[1] + span))
        pending = score(
            near, active, features, by, keep=["_chunk"], attach=["_next"], outside_only=True, outside_eps=0.0,
        ).filter((F.col("_chunk") >= F.col("_next")) & (F.col("_chunk") < F.col("_next") + span))
        upcoming = cut(pending.groupBy(*by).agg(F.min("_chunk").alias("_chunk")), "next")
        passed = join_small(current, upcoming, by, "left_anti").withColumn("_next", F.col("_next") + span)
        if upcoming.isEmpty():
            current, span = cut(passed, "current"), 2 * span
            continue
        part = join_small(numbered, upcoming, [*by, "_chunk"], "left_semi")
        moving = join_small(current, upcoming, by, "left_semi")
        stepped = key_join(_group_step(part.drop("_chunk"), moving, by, *args), upcoming.withColumnRenamed("_chunk", "chunk"), by)
        learned = cut(stepped.select(*known.names), "step")
        learned.write.mode("append").parquet(kept)
        current = cut(passed.unionByName(learned.select(*by, *MODEL_COLUMNS, (F.col("chunk") + 1).alias("_next"))), "current")
        span = 1
    models_out, steps_out = current.drop("_next"), at(kept)
    # rows of chunks that were passed over count as seen too, and rows with a missing feature in the first step
    seen = cut(numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_seen")), "seen")
    steps_out = steps_out.unionByName(_passed_over(steps_out, seen, by, chunk_rows, batch_rows, trace))
    missing = key_join(met, seen, by, "left").select(*by, (F.col("_met") - F.coalesce("_seen", F.lit(0))).alias("_missing"))
    skipped = F.when(F.col("chunk") == 0, F.coalesce("_missing", F.lit(0))).otherwise(0)
    steps_out = key_join(steps_out, missing, by, "left").withColumn("processed", F.col("processed") + skipped).select(*known.names)
    seen = met.select(*by, F.col("_met").alias("_seen"))
    if models is not None:
        seen = key_join(seen, models.select(*by, F.col("seen").alias("_had")), by, "full").select(
            *by, (F.coalesce("_seen", F.lit(0)) + F.coalesce("_had", F.lit(0))).alias("_seen")
        )
    models_out = key_join(models_out, seen, by).withColumn("seen", F.col("_seen")).select(*by, *MODEL_COLUMNS)
    return models_out, steps_out


def _passed_over(steps: DataFrame, seen: DataFrame, by: list[str], chunk_rows: int, batch_rows: int | None, traced: bool) -> DataFrame:
    """Steps of the chunks in which no row was accepted: the model as it stood, nothing added."""
    after = F.lead("chunk").over(Window.partitionBy(*by).orderBy("chunk"))
    gaps = (
        key_join(steps.withColumn("_after", after), seen, by)
        .withColumn("_after", F.coalesce("_after", F.ceil(F.col("_seen") / chunk_rows)))
        .filter(F.col("_after") > F.col("chunk") + 1)
        .withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.col("_after") - 1)))
    )
    start = F.col("chunk") * chunk_rows
    rows = F.least(F.lit(chunk_rows), F.col("_seen") - start).cast("long")
    none = F.lit(0).cast("long")
    if batch_rows:
        first, last = F.floor(start / batch_rows), F.floor((start + rows - 1) / batch_rows)
        batches = F.transform(F.sequence(first, last), lambda b: F.struct(
            b.alias("batch"), F.least(F.lit(batch_rows), F.col("_seen") - b * batch_rows).cast("long").alias("processed"),
            none.alias("added"), none.alias("removed"), F.col("n_sv").cast("long").alias("n_sv"),
        ))
    else:
        batches = F.array()
    kinds = {f.name: f.dataType for f in steps.schema.fields}
    made = {
        "processed": rows, "added": none, "removed": none, "sv_before": F.col("n_sv").cast("long"),
        "fit_seconds": F.lit(0.0), "batches": batches.cast(kinds["batches"]),
        "trace": F.array_repeat("radius", rows.cast("int")) if traced else F.lit(None).cast(kinds["trace"]),
    }
    return gaps.withColumns(made).select(*steps.columns)


def fit_by_key(df, features, by, order_col, ties=(), sigma=1.0, **options) -> DataFrame:
    """One boundary per key: columns of ``by`` plus the model fields."""
    return fit_steps(df, features, by, order_col, ties, sigma, **options)[0]


def fit_one(df, features, order_col, ties=(), sigma=1.0, **options) -> DataFrame:
    """A single boundary over the whole table, equal to the sequential pass."""
    return fit_steps(df.withColumn("_all", F.lit(0)), features, ["_all"], order_col, ties, sigma, **options)[0].drop("_all")


def update_by_key(models, df, features, by, order_col, ties=(), **options) -> DataFrame:
    """Continue stored boundaries with new rows (same frozen scaling)."""
    return fit_steps(df, features, by, order_col, ties, None, models=models, **options)[0]


def update_one(models, df, features, order_col, ties=(), **options) -> DataFrame:
    keyed = models.withColumn("_all", F.lit(0))
    return update_by_key(keyed, df.withColumn("_all", F.lit(0)), features, ["_all"], order_col, ties, **options).drop("_all")


def batch_stats(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per batch: counters and the support vector count after it."""
    return steps.select(*by, F.inline("batches"))


def objective_trace(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Radius term after each whole row that followed a model's first: (key, chunk, seq, radius).

    ``seq`` counts the rows of a key and ``chunk`` is 0, in however many chunks they were learned.
    """
    before = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = steps.filter(F.col("trace").isNotNull()).select(*by, "chunk", F.size("trace").alias("_n"))
    ahead = sizes.select(*by, "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    # only the sizes are put in order; the traces stay where they are
    placed = join_small(steps.select(*by, "chunk", "trace"), cut(ahead, "ahead"), [*by, "chunk"])
    rows = placed.select(*by, F.lit(0).cast("long").alias("chunk"), "_ahead", F.posexplode("trace").alias("_at", "radius"))
    return rows.select(*by, "chunk", (F.col("_ahead") + F.col("_at")).alias("seq"), "radius")
