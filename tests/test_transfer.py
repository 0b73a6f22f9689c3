"""Frozen transfer: every gate refuses, and what passes agrees with DuckDB."""

from __future__ import annotations

import pytest
from compare import SMALL, connect, difference
from pyspark.sql import functions as F

from emberfield.operators import transfer
from emberfield.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"s{i}", "c1", f"b{i % 9}", int(i < 30), f"e{i}" if i < 30 else None) for i in range(100)]
    panel = spark.createDataFrame(rows, "source_id string, country string, block_id string, is_eog_flare int, eog_flare_id string")
    ids = panel.select("source_id")
    seeds = F.explode(F.array(F.lit(1), F.lit(2))).alias("seed")
    base = F.abs(F.xxhash64("source_id", "seed") % 1000) / 1000.0
    compact = ids.select("source_id", seeds).select("source_id", "seed", F.lit(0).alias("model"), base.alias("score"))
    visual = compact.select("source_id", "seed", (1 - F.col("score")).alias("score"), F.lit(True).alias("image_available"))
    references = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 0.1, 1.0, 0.0, 1.0)], "seed int, mean_c double, std_c double, mean_v double, std_v double")
    ledger = ids.withColumn("status", F.lit("ok"))
    quality = ids.withColumn("review_reflectance_tail", F.lit("false"))
    return {"ledger": ledger, "panel": panel, "quality": quality, "compact": compact, "visual": visual, "references": references, "alphas": {1: 0.3, 2: 0.0}}


def state(value, condition):
    return F.when(F.expr(condition), value).otherwise(F.lit("ok"))


def run(tables, **changed):
    return transfer.frozen_transfer(**(tables | changed), repeats=20)


def test_passes(tables):
    done = run(tables)
    assert {r.branch: (r.n, r.n_pos) for r in done.metrics.collect()} == {b: (100, 30) for b in (transfer.BASE, transfer.CANDIDATE)}
    assert done.decision.count() == 2 and done.budgets.count() == 6 and done.bootstrap.first().repeats == 20


def test_failed_and_objected_rows_are_left_out(tables):
    some = run(
        tables, ledger=tables["ledger"].withColumn("status", state("failed", "source_id IN ('s1', 's99')")),
        quality=tables["quality"].withColumn("review_reflectance_tail", state("TRUE", "source_id = 's50'")).where("source_id <> 's51'"),
    )
    left = {r.source_id for r in some.scores.select("source_id").distinct().collect()}
    assert left == {f"s{i}" for i in range(100)} - {"s1", "s99", "s50", "s51"}


@pytest.mark.parametrize(
    ("message", "change"),
    [
        ("pending", lambda t: {"ledger": t["ledger"].withColumn("status", state("pending", "source_id = 's3'"))}),
        ("no ledger row", lambda t: {"ledger": t["ledger"].where("source_id <> 's3'")}),
        ("passed the review", lambda t: {"ledger": t["ledger"].withColumn("status", state("failed", "source_id LIKE 's1%' OR source_id LIKE 's2%'"))}),
        ("passed the review", lambda t: {"quality": t["quality"].withColumn("review_reflectance_tail", F.lit("yes"))}),
        ("too few labels", lambda t: {"panel": t["panel"].withColumn("is_eog_flare", F.when(F.col("source_id") < "s2", 1).otherwise(0))}),
        ("calibration", lambda t: {"references": t["references"].where("seed = 1")}),
        ("frozen seeds of every", lambda t: {"compact": t["compact"].where("NOT (source_id = 's7' AND seed = 2)")}),
    ],
)
def test_refusals(tables, message, change):
    with pytest.raises(ValueError, match=message):
        run(tables, **change(tables))


def test_a_source_twice_in_the_review_is_an_error(tables):
    with pytest.raises(Exception, match="duplicate join key"):
        run(tables, quality=tables["quality"].unionByName(tables["quality"].limit(1)))


@pytest.mark.parametrize("name", ["k13_frozen_transfer", "k13_transfer_metrics", "k13_transfer_bootstrap", "k15_seed_pipeline_policy"])
def test_against_duckdb(spark, name):
    assert difference(QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLES[name]).df()) is None
