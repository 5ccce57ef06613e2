"""Running a stream over what has arrived so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.session import scratch_path

# Bounds a micro-batch, and with it what one key can bring into one task at a time.
FILES_PER_TRIGGER = 16


def table_stream(
    spark: SparkSession, folder: str, name: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Stream over the Parquet files of a table; each micro-batch takes a bounded number of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}.parquet*")


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """Session of its own for a stateful query, whose state layout is fixed by its shuffle width."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    return own


def drain(stream: DataFrame, label: str, mode: str = "append") -> str:
    """Process everything available into a Parquet table; returns its path."""
    spark = stream.sparkSession
    out, progress = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress)
    query = writer.trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    return out


def drain_batches(stream: DataFrame, label: str, apply: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available through a batch function (keyed writes, updates)."""
    progress = scratch_path(stream.sparkSession, f"{label}-progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress)
    writer.trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
