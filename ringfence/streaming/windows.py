"""Event-time windows over a stream, with late rows dropped past the watermark; session windows with carried state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import _parse_datatype_string

from ringfence.session import by_value
from ringfence.streaming.sources import event_time


def windowed(
    stream: DataFrame, ts: str, width: str, aggs: Sequence[Column], by: Sequence[str] = (), late: str = "10 minutes", slide: str | None = None
) -> DataFrame:
    """Aggregates per window and key. Rows later than ``late`` behind the newest event are dropped."""
    timed = event_time(stream, ts)
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *by).agg(*aggs)
    return out.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[c for c in out.columns if c != "window"],
    )


_SLOT = (
    "n bigint, qn bigint, mean double, m2 double, bn bigint, bitrate double, stalls bigint, stall bigint, "
    "steps double, opens double, closes double, us array<bigint>, ties array<bigint>, q array<double>"
)
_FEATURES = (
    "window_start timestamp, window_end timestamp, n_samples bigint, quality_mean double, quality_std double, "
    "quality_mad double, bitrate_mean double, stall_ratio double, tsl_end double"
)
_FEATURE_NAMES = [f.split()[0] for f in _FEATURES.split(", ")]


@dataclass
class Slot:
    """What a session's window keeps of a short stretch of time.

    Counts, sums and moments combine as samples come. Successive differences need the samples in order: they are
    held while the stretch can still get some, then become one sum with its first and last value.
    """

    n: int = 0
    qn: int = 0
    mean: float = 0.0
    m2: float = 0.0
    bn: int = 0
    bitrate: float = 0.0
    stalls: int = 0
    stall: int | None = None
    steps: float = 0.0
    opens: float | None = None
    closes: float | None = None
    us: list = field(default_factory=list)
    ties: list = field(default_factory=list)
    q: list = field(default_factory=list)

    def add(self, us: np.ndarray, ties: np.ndarray, q: np.ndarray, bitrate: np.ndarray, stalled: np.ndarray) -> None:
        known = ~pd.isna(q)
        self.n += len(us)
        if known.any():
            new, k = q[known].astype(float), int(known.sum())
            mean, m2 = float(new.mean()), float(((new - new.mean()) ** 2).sum())
            gap, both = mean - self.mean, self.qn + k
            self.m2 += m2 + gap * gap * self.qn * k / both
            self.mean += gap * k / both
            self.qn = both
            self.us += us[known].tolist()
            self.ties += ties[known].ravel().tolist()
            self.q += new.tolist()
        rates = bitrate[~pd.isna(bitrate)].astype(float)
        self.bn += len(rates)
        self.bitrate += float(rates.sum())
        if stalled.any():
            self.stalls += int(stalled.sum())
            self.stall = max(int(us[stalled].max()), self.stall if self.stall is not None else int(us[stalled].max()))

    def close(self) -> None:
        """No sample can come any more: the held ones become their sum of steps and its borders."""
        if self.us:
            ties = np.array(self.ties, dtype=np.int64).reshape(len(self.us), -1)
            q = np.array(self.q)[np.lexsort((*ties.T[::-1], np.array(self.us)))]
            self.steps, self.opens, self.closes = float(np.abs(np.diff(q)).sum()), float(q[0]), float(q[-1])
            self.us, self.ties, self.q = [], [], []


def _features(slots: list[Slot]) -> tuple:
    """n_samples, quality_mean, quality_std, quality_mad, bitrate_mean, stall_ratio of the closed slots of a window, in order."""
    n, qn = sum(s.n for s in slots), sum(s.qn for s in slots)
    mean = sum(s.mean * s.qn for s in slots) / qn if qn else None
    m2 = sum(s.m2 + s.qn * (s.mean - mean) ** 2 for s in slots if s.qn) if qn else 0.0
    some = [s for s in slots if s.qn]
    steps = sum(s.steps for s in some) + sum(abs(b.opens - a.closes) for a, b in zip(some, some[1:]))
    bn = sum(s.bn for s in slots)
    return (
        n, mean, float(np.sqrt(m2 / (qn - 1))) if qn > 1 else None, steps / (qn - 1) if qn > 1 else None,
        sum(s.bitrate for s in slots) / bn if bn else None, sum(s.stalls for s in slots) / n,
    )


class _Session(StatefulProcessor):
    """Windows of one session; each closes when the watermark passes its end and leaves the time of the last stall behind."""

    def __init__(self, session: list[str], width: int, slots: int, forget: int | None):
        self.session, self.width, self.slots, self.forget = session, width, slots, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("slots", "slot bigint", _SLOT)
        self.last = handle.getValueState("last_stall", "us bigint")

    def _end(self, slot: int) -> int:
        """End of the slot's window, in microseconds."""
        return (slot // self.slots + 1) * self.width * self.slots

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ends, latest = set(), None
        for part in rows:  # one read at a time, in any order
            if part.empty:
                continue
            us = part["us"].to_numpy(dtype=np.int64)
            # late rows are dropped by the query already
            part, us = (part[us > now], us[us > now]) if now > 0 else (part, us)
            if not len(us):
                continue
            latest = max(int(us.max()), latest or int(us.max()))
            ties = part[[c for c in part.columns if c.startswith("tie")]].to_numpy(dtype=np.int64)
            columns = [part["q"].to_numpy(), part["b"].to_numpy(), part["s"].to_numpy(dtype=bool)]
            of = us // self.width
            for slot in np.unique(of).tolist():
                own, known = of == slot, (slot,)
                held = Slot(*self.open.getValue(known)) if self.open.containsKey(known) else Slot()
                held.us, held.ties, held.q = list(held.us), list(held.ties), list(held.q)
                held.add(us[own], ties[own], *[c[own] for c in columns])
                if (slot + 1) * self.width <= now:
                    held.close()
                self.open.updateValue(known, tuple(held.__dict__.values()))
                ends.add(self._end(slot))
        for end in ends:
            self.handle.registerTimer(-(-end // 1000))
        if self.forget is not None and latest is not None:
            self.handle.registerTimer(-(-(self._end(latest // self.width) + self.forget) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due: dict[int, list] = {}
        waiting = False
        for (slot,), value in list(self.open.iterator()):
            if self._end(slot) <= now:
                due.setdefault(self._end(slot), []).append((slot, value))
            else:
                waiting = True
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for end in sorted(due):
            slots = []
            for slot, value in sorted(due[end], key=lambda x: x[0]):
                held = Slot(*value)
                held.close()
                slots.append(held)
                self.open.removeKey((slot,))
            stalls = [s.stall for s in slots if s.stall is not None]
            last = max([*stalls, *([last] if last is not None else [])], default=None)
            start = end - self.width * self.slots
            out.append((*key, pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), *_features(slots), None if last is None else (end - last) / 1e6))
        if last is not None and due:
            self.last.update((last,))
        idle = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.forget is not None and not waiting and not due and last is not None and idle - self.forget >= self._end(last // self.width):
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.session, *_FEATURE_NAMES])

    def close(self) -> None:
        pass


def window_features(
    stream: DataFrame, session: Sequence[str], ts: str, quality: str, bitrate: str, stalled: Column, seconds: float = 5.0,
    late: str = "10 seconds", ties: Sequence[str] = (), slots: int = 64, forget: float | None = None,
) -> DataFrame:
    """Features of each session window once the watermark has passed its end, equal to the batch operator's.

    Samples may arrive in any order within ``late``. State per session: sums of the slots of its open windows, samples
    only of slots that can still get some, and the time of its last stall, which counts in every later window
    (``tsl_end``); with ``forget``, that is dropped so many seconds after the session's last window. ``ties`` are whole
    numbers that order samples of one time. Needs the RocksDB state store.
    """
    session = list(session)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    # names of its own: the operator renames columns that begin with an underscore
    keys = [f"key{i}" for i in range(len(session))]
    rows = event_time(stream, ts).select(
        *[F.col(c).alias(k) for c, k in zip(session, keys)], F.col(ts).alias("at"), micros.alias("us"), F.col(quality).cast("double").alias("q"),
        F.col(bitrate).cast("double").alias("b"), F.coalesce(stalled, F.lit(False)).alias("s"), *[F.col(c).cast("long").alias(f"tie{i}") for i, c in enumerate(ties)],
    ).withWatermark("at", late)
    kinds = {f.name: f for f in stream.schema.fields}
    out = T.StructType([kinds[c] for c in session] + _parse_datatype_string(_FEATURES).fields)
    width = int(round(seconds * 1_000_000 / slots))
    with by_value():
        return rows.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=_Session(session, width, slots, None if forget is None else int(forget * 1_000_000)),
            outputStructType=out, outputMode="Append", timeMode="EventTime",
        )
