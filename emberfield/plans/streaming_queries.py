"""Streaming queries: file-source streams run to their end, compared with batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.plans.audit_queries import TYPED, typed_summary, written_files
from emberfield.plans.registry import query
from emberfield.sources import bindings
from emberfield.streaming import detections as st


def stream(spark, folder, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # naive timestamps are UTC, day windows too
    schema = bindings.table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query("m1_stream_ingest", TYPED, "t_mir")
def m1(spark, folder):
    """Stream raw detections into the partitioned table, then read it back."""
    lineitem = stream(spark, folder, "lineitem")
    det = spark.sql(bindings.DETECTIONS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    raw = det.select(*[F.col(c).cast("string").alias(c) for c in det.columns])
    target = f"{st.progress_folder(spark)}-table"
    st.stream_ingest(raw, target, st.progress_folder(spark))
    return typed_summary(spark.read.parquet(target))


@query("m1_stream_files", TYPED, "t_mir")
def m1_files(spark, folder):
    """Stream raw CSV files in several batches, restart without repeats, then read the table back."""
    root, progress = written_files(spark, folder), st.progress_folder(spark)
    target = f"{progress}-table"
    for _ in range(2):
        st.stream_files(spark, root, target, progress, files_a_batch=16)
    return typed_summary(spark.read.parquet(target))


@query(
    "m2_stream_source_months",
    """
SELECT user_id, DATE_TRUNC('month', day)::DATE AS month, SUM(n) AS detection_count, COUNT(*) AS active_days, SUM(v) AS value_sum
FROM (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n, SUM(value) AS v FROM events GROUP BY ALL)
WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 2 DAY FROM events)
GROUP BY ALL""",
    "value_sum",
)
def m2(spark, folder):
    days = st.closed_rows(
        spark, lambda: st.source_days(stream(spark, folder, "events"), "ts", "user_id", "value", ["event_id"])
    )
    return st.month_rollup(days, "user_id")


@query(
    "m3_stream_activity_episodes",
    """
SELECT user_id, EPOCH_US(MIN(ts)) AS started_us, EPOCH_US(MAX(ts) + INTERVAL 6 HOUR) AS ended_us, COUNT(*) AS detections
FROM (SELECT *, SUM(CASE WHEN ts < before + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
      FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
GROUP BY user_id, run HAVING MAX(ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM events)""",
)
def m3(spark, folder):
    episodes = st.closed_rows(spark, lambda: st.activity_episodes(stream(spark, folder, "events"), "ts", "user_id"))
    return episodes.select(
        "user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "detections"
    )
