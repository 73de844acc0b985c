"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F


ROW_GROUP_BYTES = 8 << 20


def build_session(app: str = "ringfence", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library relies on.

    Shuffle partitions are left to adaptive execution: a high starting number
    that AQE coalesces, so that the same job fits a laptop and a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return ship(builder.getOrCreate())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, for use inside tasks."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="run-"), "ringfence.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(home):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


@contextmanager
def by_value():
    """Pickle this package's code by value.

    The stateful operator first starts on the driver in a process that does not
    look into shipped archives.
    """
    package = sys.modules["ringfence"]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all tasks run in this process (a local
    master) a new temporary folder is made and set as the checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    made = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; never reused, so retries cannot collide."""
    return f"{shared_dir(spark)}/ringfence-{label}-{uuid.uuid4().hex}"


# Rows a table may have to be sent whole to every executor.
SMALL_ROWS = 200_000


def key_join(df: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on equally named key columns; NULL is a key like any other. The keys come once."""
    keys = [on] if isinstance(on, str) else list(on)
    right = other.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    out = df.join(right, match, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full", "outer"):
        out = out.withColumns({k: F.coalesce(k, f"_right_{k}") for k in keys})
    return out.drop(*[f"_right_{k}" for k in keys])


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a table that is usually small and already written out.

    It is counted, and broadcast only below ``SMALL_ROWS``; the rows of a hot key
    then stay where they are. A larger one is joined by key, where adaptive
    execution splits hot keys. ``on`` names keys, NULL among them, or is a condition.
    """
    small = F.broadcast(small) if small.count() <= SMALL_ROWS else small
    return key_join(df, small, on, how) if isinstance(on, (str, list, tuple)) else df.join(small, on, how)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one result feeds several jobs: the lineage ends at files that
    outlive any executor, and the next scan can prune columns again.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    # small row groups let the next scan split a file over all cores
    df.write.mode("error").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
