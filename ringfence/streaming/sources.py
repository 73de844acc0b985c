"""Event sources and run-to-completion helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ringfence.session import new_path


#: What a micro-batch takes at most, unless told otherwise: a backlog is worked off in steps.
FILES_PER_TRIGGER, OFFSETS_PER_TRIGGER = 256, 5_000_000


def file_events(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = FILES_PER_TRIGGER, glob: str | None = None) -> DataFrame:
    """Events from files appearing in a folder. ``files_per_trigger`` bounds a micro-batch (None: no bound)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def kafka_events(spark: SparkSession, servers: str, topic: str, schema: T.StructType, per_trigger: int | None = OFFSETS_PER_TRIGGER, **options) -> DataFrame:
    """JSON events from a topic; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    for name, value in options.items():
        reader = reader.option(name, value)
    raw = reader.load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"), "timestamp").select("e.*", "timestamp")


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks require."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def with_end(stream: DataFrame, ts: str, at: str) -> DataFrame:
    """``stream`` and one row at time ``at`` that is otherwise NULL: it moves the watermark, so that finished input closes its windows.

    ``at`` lies after every event by more than the allowed lateness, and before the year 2262, as far as pandas counts.
    """
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "end")
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    row = [F.lit(at).cast(kinds[c]).alias(c) if c == ts else F.lit(None).cast(kinds[c]).alias(c) for c in stream.columns]
    spark.range(1).select(*row).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def run_available(stream: DataFrame, checkpoint: str | None = None, path: str | None = None, mode: str = "append") -> DataFrame:
    """Process what is there now, then stop; the result as a table.

    In update mode every micro-batch is kept with its ``batch_id``, so that the
    last version of a row can be picked by key.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or path + "-checkpoint")
    schema = stream.schema
    if mode == "update":
        schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])

        def keep(batch: DataFrame, batch_id: int) -> None:
            # a replayed batch overwrites its own folder
            batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/b{batch_id}")

        writer.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    writer.format("parquet").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(schema).parquet(path)
