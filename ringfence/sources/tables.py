"""Reading and writing tables described by a spec."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ringfence.operators.analysis import stacked
from ringfence.spec import DatasetSpec


def _csv(spark: SparkSession, path: str, schema: T.StructType, strict: bool) -> DataFrame:
    """Columns are found by each file's own header, in any order; surplus ones are ignored.

    ``strict``: a missing number column or a cell that is not of its type is an error; else such a cell is NULL and a
    column that no file has is left out. Text columns (names of sessions and files) may be missing.
    """
    lines = spark.read.text(path, wholetext=False).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    heads = lines.filter("at = 0").groupBy("file").agg(F.first("value").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    parts = []
    for row in sorted(heads, key=lambda r: r["head"]):
        names = next(csv.reader([row["head"]]))
        missing = [f.name for f in schema.fields if f.name not in names and not isinstance(f.dataType, T.StringType)]
        if strict and missing:
            raise ValueError(f"{row['files'][0]} has no column {', '.join(missing)}")
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.option("header", True).schema(text).csv(row["files"])
        cells = {f.name: F.col(f"`{f.name}`") for f in schema.fields if f.name in names}
        parts.append(raw.select(*[(cells[f.name].cast(f.dataType) if strict else cells[f.name].try_cast(f.dataType)).alias(f.name) for f in schema.fields if f.name in names]))
    if not parts:
        return spark.createDataFrame([], schema)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[f.name for f in schema.fields if f.name in out.columns])


def read(
    spark: SparkSession, path: str, schema: T.StructType | DatasetSpec | None = None, fmt: str | None = None, strict: bool = True
) -> DataFrame:
    """A csv, json, parquet or orc table; the format follows the suffix unless given.

    Text formats take the spec's schema, never an inferred one. A missing path is an error; so are, in csv
    files, a missing column and a cell that does not parse, unless ``strict`` is off.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1]
    schema = schema.schema() if isinstance(schema, DatasetSpec) else schema
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"reading {fmt} needs a schema")
    if fmt == "csv":
        return _csv(spark, path, schema, strict)
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on any file system Spark reaches; nothing is listed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_present(spark: SparkSession, paths: Mapping[str, str], schema=None, fmt: str | None = None, strict: bool = True) -> DataFrame | None:
    """Union of the datasets that exist, tagged with their name; None if none does."""
    found = {name: read(spark, p, schema, fmt, strict) for name, p in paths.items() if exists(spark, p)}
    return stacked(found, "dataset") if found else None


def with_lineage(df: DataFrame) -> DataFrame:
    """Add ``file`` (base name of the source file) and ``content`` (without its suffix)."""
    return df.select("*", F.col("_metadata.file_name").alias("file")).withColumn(
        "content", F.regexp_replace("file", r"\.[^.]+$", "")
    )


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)
