"""Session, checkpoint folder and size-checked broadcast helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
CONCURRENT_FITS = 4
"""Independent model fits submitted at once, as a cross-validator does."""

BROADCAST_ROWS = 200_000
"""Largest row count of a narrow lookup table that may be broadcast."""

BROADCAST_BYTES = 16 << 20
"""Largest stored size of one: rows alone say nothing of wide or long columns."""


def build_session(app: str = "emberfield", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session with the settings every job here relies on; cluster settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def use_checkpoint_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """New place in the shared checkpoint space; what is written there goes when the session's file system closes."""
    place = f"{use_checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)  # only what exists can be marked
    system.deleteOnExit(path)
    return place


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a columnar table under the checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but later reads prune columns and carry
    statistics. The table goes when the session's file system closes.
    """
    spark = df.sparkSession
    place = scratch_folder(spark, "settled")
    df.write.mode("append").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a small table once; hint a broadcast only if its counted rows and stored bytes allow.

    Beyond either bound the table comes back unhinted and joins fall back to a
    shuffle, where adaptive execution splits hot keys.
    """
    table = settle(df)
    small = table.count() <= max_rows and stored_bytes(table) <= BROADCAST_BYTES
    return F.broadcast(table) if small else table


def stored_bytes(table: DataFrame) -> int:
    """Size of a table's files, as the optimizer sees it."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate as literals, so no join is planned."""
    row = one_row.first()
    return df.withColumns({n: F.lit(row[n]).cast(t) for n, t in one_row.dtypes})


def in_parallel(spark: SparkSession, tasks: Sequence[Callable[[], T]], width: int = CONCURRENT_FITS) -> list[T]:
    """Run a handful of driver steps, each a chain of distributed jobs, from several threads."""
    if len(tasks) == 1:
        return [tasks[0]()]
    with ThreadPool(min(width, len(tasks))) as pool:
        return pool.map(lambda step: step(), [inheritable_thread_target(spark)(task) for task in tasks])
