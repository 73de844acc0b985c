"""Incremental one-class anomaly detection on Spark tables and streams."""

from ringfence.spec import AnomalyRule, DatasetSpec, get_spec, registered_specs

__all__ = ["AnomalyRule", "DatasetSpec", "get_spec", "registered_specs"]
