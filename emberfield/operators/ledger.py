"""Attempt logs and the cohort built from finished work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.functions.columns import is_true
from emberfield.operators.contracts import join_one_to_one
from emberfield.operators.ordering import percentile_columns, running_totals

FAILURES_TO_STOP = 6


def attempt_ledger(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """Latest state per item: ok beats failed beats pending; a foreign identity is an error."""
    rank = F.when(F.col("status") == "ok", 2).otherwise(1)
    state = attempts.groupBy("item_id").agg(
        F.max_by(F.struct("status", "attempt_id", "attempted_at"), F.struct(rank, "attempted_at", "attempt_id")).alias("s"),
        F.min("chip_id").alias("_low"),
        F.max("chip_id").alias("_high"),
        F.count(F.lit(1)).alias("attempts"),
    )
    joined = items.join(state, "item_id", "left")
    same = F.col("_low").isNull() | ((F.col("_low") == F.col("chip_id")) & (F.col("_high") == F.col("chip_id")))
    checked = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("record identity mismatch")).cast("boolean"))
    return joined.where(checked).select(
        *items.columns,
        F.coalesce("s.status", F.lit("pending")).alias("status"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.col("s.attempt_id").alias("attempt_id"),
    )


def next_batch(ledger: DataFrame, max_new: int, retry_failed: bool = False) -> DataFrame:
    """The first ``max_new`` eligible items in batch order (top-k per task)."""
    open_states = ["pending", "failed"] if retry_failed else ["pending"]
    return ledger.where(F.col("status").isin(open_states)).orderBy("batch_order", "item_id").limit(max_new)


def stop_point(attempts: DataFrame, keys: Sequence[str] = (), failures: int = FAILURES_TO_STOP) -> DataFrame:
    """Where a run of consecutive failures ends the session.

    The running number of successes names each run of failures, which is
    contiguous, so its sixth member is its first place plus five.
    """
    done = (F.col("status") == "ok").cast("bigint")
    keys = list(keys) or ["_run"]
    frame = attempts if keys != ["_run"] else attempts.withColumn("_run", F.lit(0))
    placed = running_totals(
        frame, keys, [F.col("attempted_at"), F.col("attempt_id")], {"place": F.lit(1).cast("bigint"), "successes": done}
    )
    runs = placed.groupBy(*keys, "successes").agg(
        F.count_if(F.col("status") == "failed").alias("_n"),
        F.min(F.when(F.col("status") == "failed", F.col("place"))).alias("_first"),
        F.max("place_group").alias("attempts"),
    )
    return runs.groupBy(*keys).agg(
        F.max("attempts").alias("attempts"),
        F.min(F.when(F.col("_n") >= failures, F.col("_first") + failures - 1)).alias("stop_after"),
        F.max("_n").alias("longest_failure_run"),
    ).drop("_run")


def assemble_cohort(
    sample: DataFrame,
    images: DataFrame,
    quality: DataFrame,
    thermal: DataFrame,
    ranked: Sequence[str],
    min_rows: int = 35,
    min_positives: int = 5,
) -> DataFrame:
    """One-to-one joins of sample, images, quality and thermal features of accepted rows.

    Percentiles are taken over each whole country before the join narrows it.
    """
    whole = percentile_columns(thermal, "country", ranked, "source_id").drop("country")
    good = join_one_to_one(
        join_one_to_one(sample, images, ["source_id"], "left"),
        quality.select("source_id", "status", "review_reflectance_tail"), ["source_id"], "left",
    ).where((F.col("status") == "ok") & ~is_true(F.col("review_reflectance_tail")))
    thin = good.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("is_eog_flare").alias("p")).where(
        (F.col("n") < min_rows) | (F.col("p") < min_positives)
    )
    if not thin.isEmpty():
        raise ValueError("insufficient rows or positives in a country")
    return join_one_to_one(good, whole.join(good.select("source_id"), "source_id", "left_semi"), ["source_id"])
