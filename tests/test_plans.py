"""Physical plans: pruned scans, pushed filters, no products of tables."""

from __future__ import annotations

import contextlib
import io

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from emberfield.operators import evaluation, grid
from emberfield.plans import geo_queries as geo
from emberfield.plans.catalogue import QUERIES
from emberfield.sources import bindings


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["c4_build_sources", "c7_label_sources", "j2_average_precision", "j5_macro_f1_threshold", "h9_document_site_blocks", "k5_crossfit_fusion"])
def test_no_products(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_needed_columns_only(spark):
    text = plan(grid.origins(bindings.detections(spark, SMALL)))
    schema = [line for line in text.splitlines() if "ReadSchema" in line][0]
    assert "l_extendedprice" not in schema and "l_partkey" in schema


def test_filters_reach_the_scan(spark):
    rows = bindings.table(spark, SMALL, "events").where(F.col("event_type") == "error").select("user_id")
    assert "EqualTo(event_type,error)" in plan(rows)


def test_origin_join_is_broadcast_without_a_shuffle(spark):
    text = plan(geo.located(spark, SMALL))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_python_stays_out_of_the_metrics(spark):
    rows = bindings.predictions(spark, SMALL).withColumn("score", F.col("score_visual"))
    text = plan(evaluation.average_precision(rows, ["country"]))
    assert "Python" not in text and "Pandas" not in text


def test_file_profile_is_read_once_by_its_means(spark):
    """The three weighted means take written files' rows; none profiles the detections again."""
    files = QUERIES["b11_weighted_mean"](spark, SMALL).inputFiles()
    assert files and not any("lineitem" in f for f in files)
