"""Score-then-adapt per key: every normal event moves the model and the threshold.

State is partitioned by key, so no lock is needed and keys run in parallel. The
events of one micro-batch are ordered by event time inside a key; order across
micro-batches is the order of arrival. The source bounds a micro-batch, so a
backlog is worked off in steps. A single key that outgrows one task
belongs in ``streaming.update``, which tests rows in parallel.

State of a key: its model and counters, written when they change, and a ring of
the last normal events, of which only the places of new events are written.
A stream of models can be mixed in: a row of it replaces the model of its key
while the query runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import _parse_datatype_string

from ringfence.functions.kernel import MODEL_FIELDS, Boundary, fit, from_fields, to_fields
from ringfence.plans.train import Detector
from ringfence.session import by_value, key_join
from ringfence.spec import DatasetSpec

_STATE = MODEL_FIELDS + ", tau double, since_refit bigint, kept bigint"
_STATE_NAMES = [f.strip().split()[0] for f in _STATE.split(",")]
_RESULT = (
    "score double, is_anomaly int, threshold_used double, threshold_after double, "
    "buffer_size int, n_sv int, since_refit int, refitted int"
)
_RESULT_NAMES = [f.strip().split()[0] for f in _RESULT.split(",")]
MODEL_COLUMNS = [f.strip().split()[0] for f in MODEL_FIELDS.split(",")]
#: Column that tells model rows from events.
CONTROL = "is_control"


class Ring:
    """The last ``size`` rows appended, oldest first; row number i has place i % size of a map state.

    New rows wait in memory until :meth:`flush`. ``store`` is None where nothing is stored.
    """

    def __init__(self, size: int, count: int = 0, store=None):
        self.size, self.count, self.store, self.new = max(1, size), count, store, {}

    def __len__(self) -> int:
        return min(self.count, self.size)

    def append(self, row: np.ndarray) -> None:
        self.new[self.count % self.size] = row
        self.count += 1

    def __iter__(self):
        places = [i % self.size for i in range(self.count - len(self), self.count)]
        stored = {}
        if self.store is not None and any(p not in self.new for p in places):
            stored = {k[0]: np.array(v[0], dtype=float) for k, v in self.store.iterator()}
        return iter([self.new[p] if p in self.new else stored[p] for p in places])

    def clear(self) -> None:
        self.count, self.new = 0, {}
        if self.store is not None:
            self.store.clear()

    def flush(self) -> None:
        for place, row in self.new.items():
            self.store.updateValue((place,), (row.tolist(),))
        self.new = {}


@dataclass
class Online:
    """The adapting state of one key and its step for one event."""

    model: Boundary
    tau: float
    buffer: Ring
    since_refit: int
    spec: DatasetSpec
    expand_always: bool = False
    skip_override: bool = False

    def step(self, x: np.ndarray) -> tuple:
        sims = self.model.sims(x)
        s = float(self.model.score(x)[0])
        used, refitted = self.tau, 0
        known = s == s
        anomalous = int(known and s > self.tau + self.spec.margin)
        if known and not anomalous:
            # growing on rows already inside is possible but makes the inverse ill-conditioned
            if self.expand_always or s > 0:
                self.model.accept(x, sims[0])
            self.buffer.append(x)
            if not (self.skip_override and s == -1.0):
                self.tau = (1 - self.spec.ewma) * self.tau + self.spec.ewma * s
            self.since_refit += 1
            if self.since_refit >= self.spec.refit_every and len(self.buffer) > self.spec.min_refit:
                self.refit()
                refitted = 1
        return (s if known else None, anomalous, used, self.tau, len(self.buffer), self.model.size, self.since_refit, refitted)

    def refit(self) -> None:
        """A fresh boundary of the buffer; threshold from its oldest rows."""
        rows = np.vstack(list(self.buffer))
        self.model, _ = fit(rows, self.model.sigma, near=self.model.near, far=self.model.far)
        few = rows[: self.spec.refit_sample]
        self.tau = float(np.quantile(self.model.score(few), self.spec.quantile))
        self.since_refit = 0

    def reload(self, r) -> None:
        """Go on with another model and threshold; buffer and counter start anew."""
        self.model, self.tau, self.since_refit = from_fields(r), float(r["tau"]), 0
        self.buffer.clear()

    def fields(self) -> dict:
        return {**to_fields(self.model), "tau": self.tau, "since_refit": self.since_refit, "kept": self.buffer.count}

    @classmethod
    def restore(cls, r, spec: DatasetSpec, store=None, **options) -> Online:
        return cls(from_fields(r), float(r["tau"]), Ring(spec.buffer_max, int(r["kept"]), store), int(r["since_refit"]), spec, **options)


class _Adapt(StatefulProcessor):
    def __init__(self, keys, kept, features, order, spec, default, options, idle):
        self.keys, self.kept, self.features, self.order = keys, kept, features, order
        self.spec, self.default, self.options, self.idle = spec, default, options, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("online", _STATE)
        self.ring = handle.getMapState("ring", "place int", "row array<double>")

    def _save(self, online: Online) -> None:
        f = online.fields()
        self.state.update(tuple(f[n].tolist() if isinstance(f[n], np.ndarray) else f[n] for n in _STATE_NAMES))
        online.buffer.flush()

    def _load(self) -> Online | None:
        if self.state.exists():
            return Online.restore(dict(zip(_STATE_NAMES, self.state.get())), self.spec, self.ring, **self.options)
        if self.default is not None:
            return Online.restore(self.default, self.spec, self.ring, **self.options)
        return None

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0].to_dict()
        r.update(since_refit=0, kept=0)  # a reloaded model starts with empty buffers
        self._save(Online.restore(r, self.spec, self.ring, **self.options))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a read at a time is taken over; models come before events of the same time
        parts = [p for p in rows if not p.empty]
        if not parts:
            return
        batch = pd.concat(parts, ignore_index=True)
        parts = None
        controlled = CONTROL in batch
        batch = batch.sort_values([*self.order, *([CONTROL] if controlled else [])], ascending=[True] * len(self.order) + [False] * controlled, kind="stable")
        online, changed = self._load(), False
        orders = batch[CONTROL].to_numpy(dtype=bool) if controlled else np.zeros(len(batch), bool)
        x = batch[self.features].to_numpy(dtype=float)
        made, places = [], []
        for i, is_order in enumerate(orders):
            if is_order:
                r = batch.iloc[i]
                fields = {n: r["new_" + n] for n in [*MODEL_COLUMNS, "tau"]}
                if online is None:
                    online = Online.restore({**fields, "since_refit": 0, "kept": 0}, self.spec, self.ring, **self.options)
                online.reload(fields)
                changed = True
            else:
                places.append(i)
                made.append((None, 0, *[None] * (len(_RESULT_NAMES) - 2)) if online is None else online.step(x[i]))
                changed = changed or online is not None
        if changed:
            self._save(online)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if places:
            out = batch[self.kept].iloc[places].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(made, columns=_RESULT_NAMES)], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.ring.clear()
        yield from ()

    def close(self) -> None:
        pass


def control_rows(detector: Detector, keys: Sequence[str], at: dict) -> DataFrame:
    """What a control stream holds: the models and thresholds of a keyed detector, to hold from ``at`` (a value for each order column)."""
    both = key_join(detector.models, detector.taus.select(*keys, "tau"), keys)
    return both.select(*keys, *[F.lit(v).alias(c) for c, v in at.items()], *MODEL_COLUMNS, "tau")


def adapt_stream(
    stream: DataFrame,
    detector: Detector,
    keys: Sequence[str],
    order: Sequence[str],
    keep: Sequence[str] = (),
    expand_always: bool = False,
    skip_override: bool = False,
    control: DataFrame | None = None,
    idle_seconds: float | None = None,
) -> DataFrame:
    """Score events in event-time order per key and adapt on those that are normal.

    A detector with per-key models starts every key from its own (keys without one
    score NULL); a single model is the common start of all keys. ``expand_always``
    learns every normal event, even one inside the boundary. Needs the RocksDB
    state store.

    ``control`` is a stream of :func:`control_rows`: at its place in the order, such a row
    sets model and threshold of its key and empties the buffer, without a restart. The
    vectors of events are prepared with ``detector``, so new models share its scaling.
    ``idle_seconds`` drops the state of a key without events for so long; it then
    starts anew from ``detector``'s single model, or without one. Such a query waits for time to pass: it
    belongs under a repeating trigger, a run over what is there would not end.
    """
    spec, keys, order = detector.spec, list(keys), list(order)
    names = list(spec.features)
    kept = list(dict.fromkeys([*keys, *order, *keep]))
    ready = detector.vectors(stream).select(*dict.fromkeys([*kept, *names]))
    kinds = {f.name: f for f in ready.schema.fields}
    if control is not None:
        own = [F.col(c).cast(kinds[c].dataType).alias(c) for c in dict.fromkeys([*keys, *order])]
        rows = control.select(*own, F.lit(True).alias(CONTROL), *[F.col(c).alias(f"new_{c}") for c in [*MODEL_COLUMNS, "tau"]])
        ready = ready.withColumn(CONTROL, F.lit(False)).unionByName(rows, allowMissingColumns=True)
    options = {"expand_always": expand_always, "skip_override": skip_override}
    default = initial = None
    if detector.keys:
        start = key_join(detector.models, detector.taus.select(*detector.keys, "tau"), detector.keys)
        initial = start.groupBy(*keys)
    else:
        r = detector.models.first().asDict()
        default = {**r, "tau": detector.taus.first()["tau"], "since_refit": 0, "kept": 0}
    out = T.StructType([kinds[c] for c in kept] + _parse_datatype_string(_RESULT).fields)
    with by_value():
        return ready.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=_Adapt(keys, kept, names, order, spec, default, options, None if idle_seconds is None else int(1000 * idle_seconds)),
            outputStructType=out, outputMode="Append", timeMode="None" if idle_seconds is None else "ProcessingTime", initialState=initial,
        )


def status(results: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest threshold, buffer size, support vectors and rows since refit per key."""
    last = F.max_by(F.struct("threshold_after", "buffer_size", "n_sv", "since_refit"), F.struct(*order)).alias("s")
    return results.groupBy(*keys).agg(last).select(
        *keys, F.col("s.threshold_after").alias("threshold"), F.col("s.buffer_size").alias("buffer_size"),
        F.col("s.n_sv").alias("support_vectors"), F.col("s.since_refit").alias("seen_since_refit"),
    )
