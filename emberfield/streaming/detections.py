"""Continuous detection feeds: incremental ingest, daily counts, activity episodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.session import scratch_folder
from emberfield.sources.ingest import PARTITIONS, normalise_types, read_detections


def progress_folder(spark: SparkSession) -> str:
    """Fresh progress location in the shared checkpoint space."""
    return f"{scratch_folder(spark, 'stream')}/progress"


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a zoned timestamp; naive ones are taken as UTC (session zone)."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def run_available(stream: DataFrame, target: str, progress: str, partitions: tuple[str, ...] = ()) -> None:
    """Process everything available now, exactly once per progress location."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", progress)
    if partitions:
        writer = writer.partitionBy(*partitions)
    query = writer.trigger(availableNow=True).start(target)
    query.awaitTermination()


def stream_ingest(raw: DataFrame, target: str, progress: str) -> None:
    """Typed detections appended to the partitioned table; a restart continues where it stopped."""
    run_available(normalise_types(raw), target, progress, PARTITIONS)


def stream_files(spark: SparkSession, root: str, target: str, progress: str, files_a_batch: int = 32) -> None:
    """Raw CSV files of all instrument folders, named, unified and typed as in batch, appended as they arrive.

    Files already taken, by this or an earlier run with the same progress folder, are not taken again.
    """
    run_available(read_detections(spark, root, files_a_batch=files_a_batch), target, progress, PARTITIONS)


def source_days(
    stream: DataFrame, time: str, source: str, value: str, identity: list[str], delay: str = "2 days"
) -> DataFrame:
    """Counts and sums per source and day of a stream; repeats dropped, late rows bounded.

    Appends a day once the watermark passes its end, so state holds open days only.
    """
    once = event_time(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(identity)
    return (
        once.groupBy(F.window(time, "1 day"), F.col(source))
        .agg(F.count(F.lit(1)).alias("detection_count"), F.sum(value).alias("value_sum"))
        .select(F.to_date("window.start").alias("day"), source, "detection_count", "value_sum")
    )


def month_rollup(days: DataFrame, source: str) -> DataFrame:
    """Batch roll-up of closed days to months."""
    return days.groupBy(source, F.trunc("day", "month").alias("month")).agg(
        F.sum("detection_count").alias("detection_count"),
        F.count(F.lit(1)).alias("active_days"),
        F.sum("value_sum").alias("value_sum"),
    )


def activity_episodes(stream: DataFrame, time: str, source: str, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Runs of activity per source split by inactivity, appended once closed."""
    timed = event_time(stream, time).withWatermark(time, delay)
    return (
        timed.groupBy(F.session_window(time, gap), F.col(source))
        .agg(F.count(F.lit(1)).alias("detections"))
        .select(source, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "detections")
    )


def closed_rows(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Run a stream to its end and return what it appended."""
    target = f"{progress_folder(spark)}-out"
    stream = build()
    run_available(stream, target, progress_folder(spark))
    return spark.read.schema(stream.schema).parquet(target)
