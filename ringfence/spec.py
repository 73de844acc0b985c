"""Declarative description of a dataset: what to read, prepare, label and fit."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F, types as T


@dataclass(frozen=True)
class AnomalyRule:
    """``target <op> cutoff`` marks a row as anomalous (1); anything else is 0."""

    op: str = "le"
    cutoff: float = 0.0

    def __post_init__(self):
        if self.op not in ("le", "lt"):
            raise ValueError(f"Unknown comparison '{self.op}'. Available: le, lt")

    def column(self, target: str | Column) -> Column:
        """Label as an integer column. NULL and NaN targets compare false, hence 0."""
        value = F.col(target) if isinstance(target, str) else target
        hit = value <= self.cutoff if self.op == "le" else value < self.cutoff
        return F.when(hit, 1).otherwise(0)


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    features: tuple[str, ...]
    target: str | None = None
    description: str = ""
    clip: tuple[str, ...] = ()
    log: tuple[str, ...] = ()
    invert: tuple[str, ...] = ()
    clip_min: float = 0.0
    clip_max: float | None = None
    # Per-column (low, high) caps; they replace clip_min / clip_max for that column.
    caps: dict[str, tuple[float, float]] = field(default_factory=dict)
    rule: AnomalyRule = AnomalyRule()
    quantile: float = 0.95
    sigma_method: str = "median_heuristic"
    sigma: float | None = None
    initial_batch: int = 100
    incremental_batch: int = 50
    checkpoint_every: int = 10
    checkpoints: bool = False
    buffer_max: int = 500
    refit_every: int = 100
    min_refit: int = 50
    refit_sample: int = 200
    ewma: float = 0.1
    margin: float = 0.0

    def schema(self, extra: tuple[str, ...] = ("content", "file")) -> T.StructType:
        """Read schema: features and target as doubles, ``extra`` as strings."""
        numeric = list(dict.fromkeys([*self.features, *([self.target] if self.target else [])]))
        return T.StructType(
            [T.StructField(c, T.DoubleType()) for c in numeric]
            + [T.StructField(c, T.StringType()) for c in extra]
        )

    def with_(self, **changes) -> DatasetSpec:
        return replace(self, **changes)


# The shipped dataset descriptions.
_SPECS = {
    "LIVE_NFLX_II": DatasetSpec(
        name="LIVE_NFLX_II",
        description="Video QoE windows, six quality and stall features",
        features=("vmaf_mean", "vmaf_std", "vmaf_mad", "bitrate_mean", "stall_ratio", "tsl_end"),
        target="QoE_win",
        clip=("bitrate_mean", "stall_ratio", "tsl_end"),
        log=("bitrate_mean", "stall_ratio", "tsl_end"),
        rule=AnomalyRule("le", 0.0),
        quantile=0.90,
        sigma_method="fixed",
        sigma=2.081761,
    ),
    "LIVE_NFLX": DatasetSpec(
        name="LIVE_NFLX",
        description="Video QoE windows, quality features and stall count",
        features=("vmaf_mean", "vmaf_std", "vmaf_mad", "ssim", "stall_count", "tsl_end"),
        target="QoE_win",
        clip=("stall_count", "tsl_end"),
        log=("stall_count", "tsl_end"),
        rule=AnomalyRule("lt", 0.0),
        quantile=0.90,
        sigma_method="fixed",
        sigma=1.5,
    ),
    "LFOVIA_QoE": DatasetSpec(
        name="LFOVIA_QoE",
        description="Continuous QoE scores with streaming and visual quality features",
        features=("TSL", "Nrebuffers", "NIQE", "SSIM"),
        target="score_continuous",
        clip=("TSL", "Nrebuffers"),
        log=("TSL", "Nrebuffers"),
        invert=("TSL", "SSIM"),
        rule=AnomalyRule("lt", 50.0),
        quantile=0.90,
        sigma_method="fixed",
        sigma=1.655873,
    ),
}

# Caps of the older single-dataset preparation.
QOE_CAPS = {
    "bitrate_mean": (0.0, 20000.0),
    "tsl_end": (0.0, 300.0),
    "stall_ratio": (0.0, 1.0),
}


def registered_specs() -> list[str]:
    return list(_SPECS)


def get_spec(name: str) -> DatasetSpec:
    if name not in _SPECS:
        raise ValueError(f"Unknown dataset '{name}'. Available datasets: {', '.join(_SPECS)}")
    return _SPECS[name]


def register_spec(spec: DatasetSpec) -> None:
    """Add or replace a dataset description."""
    _SPECS[spec.name] = spec
