"""Column builders shared by the batch and the streaming paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def known(c: Column) -> Column:
    """Double with NaN turned into NULL, so that aggregates skip it."""
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound ``c``; NULL and NaN pass through unchanged."""
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(c.isNull() | F.isnan(c), c).otherwise(bounded)


def log1p(c: Column) -> Column:
    """log(1 + c). Spark yields NULL for c <= -1, where NumPy yields NaN or -inf."""
    return F.log1p(c)


def invert(c: Column, top: float | Column) -> Column:
    """``top - c``: large becomes small."""
    return (F.lit(float(top)) if isinstance(top, (int, float)) else top) - c


def flag(score: Column, tau: Column | float, margin: float = 0.0) -> Column:
    """1 when ``score > tau + margin``. A NaN or NULL score is never flagged."""
    limit = (F.lit(tau) if isinstance(tau, (int, float)) else tau) + F.lit(float(margin))
    return F.when(score.isNotNull() & ~F.isnan(score) & (score > limit), 1).otherwise(0)


def ratio(num: Column, den: Column) -> Column:
    """num / den with NULL instead of an error when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def prepared(
    present: Sequence[str],
    clip_cols: Sequence[str] = (),
    log_cols: Sequence[str] = (),
    clip_min: float | None = 0.0,
    clip_max: float | None = None,
    caps: Mapping[str, tuple[float, float]] | None = None,
) -> dict[str, Column]:
    """Clip-then-log expressions for those listed columns that are present."""
    caps = caps or {}
    out: dict[str, Column] = {}
    for name in present:
        if name not in clip_cols and name not in log_cols and name not in caps:
            continue
        c = known(F.col(name))
        if name in caps:
            c = clip(c, *caps[name])
        elif name in clip_cols:
            c = clip(c, clip_min, clip_max)
        if name in log_cols:
            c = log1p(c)
        out[name] = c
    return out
