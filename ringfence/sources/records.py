"""Metric records as JSON and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ringfence.operators.analysis import comparison_table, rendered, summary_stats
from ringfence.sources.tables import exists, write_csv

METRIC_SCHEMA = T.StructType(
    [T.StructField("dataset", T.StringType()), T.StructField("test_samples", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("threshold", "flag_rate")]
    + [T.StructField("num_sv", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("auc", "ap", "f1", "precision", "recall")]
)


def write_records(records: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON line per record, in a folder per dataset."""
    records.withColumn("_part", F.col("dataset")).write.mode(mode).partitionBy("_part").json(path)


def read_records(spark: SparkSession, path: str, datasets: Sequence[str] | None = None) -> DataFrame:
    """All readable records; a missing dataset or corrupt line yields no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], METRIC_SCHEMA)
    schema = T.StructType(METRIC_SCHEMA.fields + [T.StructField("_corrupt", T.StringType()),
                                                  T.StructField("_part", T.StringType())])
    raw = (
        spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )
    good = raw.filter(F.col("_corrupt").isNull() & F.col("dataset").isNotNull()).drop("_corrupt", "_part")
    return good.filter(F.col("dataset").isin(list(datasets))) if datasets else good


def write_report(records: DataFrame, path: str, mode: str = "error") -> tuple[DataFrame, DataFrame]:
    """Comparison table and its summary, each written as CSV below ``path``."""
    table = comparison_table(records)
    summary = summary_stats(table, ["AUC", "AP", "F1", "Precision", "Recall"])
    write_csv(rendered(table), f"{path}/comparison", mode)
    write_csv(rendered(summary), f"{path}/summary", mode)
    return table, summary
