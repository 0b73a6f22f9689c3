"""Scenes judged on their pixels, rules on chip records, and the sweep over cell sizes."""

from __future__ import annotations

import contextlib
import io
from collections import defaultdict

import duckdb
import pytest
from compare import SMALL, connect, difference

from emberfield.operators import grid
from emberfield.operators import raster as rs
from emberfield.plans import geo_queries as geo
from emberfield.plans import raster_queries as rq
from emberfield.plans.catalogue import ORACLES, QUERIES
from emberfield.plans.registry import with_ctes


@pytest.mark.parametrize("name", ["f13_record_constraints", "f14_scenes_from_pixels", "f14_scene_statistics", "c10_grid_sweep", "e6_robust_scale"])
def test_against_duckdb(spark, name):
    assert difference(QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLES[name]).df()) is None


def test_every_rule_is_broken_by_some_chip(spark):
    broken = {r.rule for r in QUERIES["f13_record_constraints"](spark, SMALL).select("rule").distinct().collect()}
    assert broken == set(rq._BROKEN)


def test_every_reason_rejects_some_scene(spark):
    reasons = " ".join(r.reasons for r in QUERIES["f14_scenes_from_pixels"](spark, SMALL).collect())
    for reason in ("cloud/coverage", "invalid scale or offset", "missing band pixels", "suspect reflectance offset"):
        assert reason in reasons


def test_scale_and_offset_of_the_scene_decide(spark):
    """The same integers pass or fail by the offset; pixels of later scenes are not read."""
    scenes = [(1, "a", 1.0, 1e-4, -0.3), (1, "b", 2.0, 1e-4, -0.1), (1, "c", 3.0, 1e-4, 0.0), (2, "a", 1.0, float("nan"), 0.0), (2, "b", 2.0, 1e-4, None)]
    pixels = [(c, s, row, col, 4, *[1500] * 6) for c, s, *_ in scenes for row in range(4) for col in range(4)]
    meta = spark.createDataFrame(scenes, "chip_id int, scene_id string, cloud_cover double, scale double, offset double")
    cells = spark.createDataFrame(pixels, "chip_id int, scene_id string, row int, col int, scl int, " + ", ".join(f"{b} int" for b in rs.BANDS))
    got = {r.chip_id: (r.scene_id, r.reasons) for r in rs.choose_scene(rs.scene_statistics(meta, cells, 4)).collect()}
    assert got[1] == ("b", "a:suspect reflectance offset")
    assert got[2] == (None, "a:invalid scale or offset|b:invalid scale or offset")
    assert rs.scene_statistics(meta, cells, 4, limit=2).count() == 4
    assert rs.scene_statistics(meta, cells.limit(0), 4).where("clear_full = 0").count() == 5


def test_records_with_missing_facts_fail(spark):
    fields = ", ".join(f"{c} string, recorded_{c} string" for c in rs.RECORDED)
    values = ["x"] * (2 * len(rs.RECORDED))
    chips = spark.createDataFrame([("ok", "s2", "s2", [10.0, 0.0, 1.0, 0.0, -10.0, 2.0], *values)], f"status string, collection string, wanted_collection string, transform array<double>, {fields}")
    pixels = spark.createDataFrame([], "chip_id string, scl int, landcover int, clear_mask boolean, landcover_mask boolean")
    assert {r.rule for r in rs.record_constraints(chips, pixels).collect()} == {"land cover mask", "scene class under clear mask"}


def test_sweep_reads_the_detections_once(spark):
    det = geo.detections(spark, SMALL)
    swept = grid.grid_sweep(det, geo.sites(spark, SMALL))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        swept.explain()
    assert "lineitem" not in out.getvalue()


@pytest.mark.parametrize("cells", [(300, 700), (1000,)])
def test_sweep_equals_separate_sizes(spark, cells):
    det, sites = geo.detections(spark, SMALL), geo.sites(spark, SMALL)
    got = defaultdict(set)
    for r in grid.grid_sweep(det, sites, cells).collect():
        got[r.grid_m].add((r.country, r.sources, r.sources_matched, r.eog_recovered))
    for size in cells:
        summary = grid.source_summary(grid.labelled_sources(det, sites, size), sites)
        assert got[size] == {(r.country, r.sources, r.sources_matched, r.eog_recovered) for r in summary.collect()}


@pytest.mark.parametrize("name", ["f14_choose_scene", "f14_scenes_from_pixels", "f14_scene_statistics"])
def test_cloud_cover_on_a_rounding_half(spark, tmp_path, name):
    """Discounts of scene R1 have the exact mean 4.25 % (0.425 %), below which their sum as doubles falls; A1 has 4.3 % (0.43 %) and goes first."""
    finer = [0.007, 0.01, 0.002, 0.01, 0.004, 0.001, 0.002, 0.005, 0.001, 0.004, 0.008, 0.0, 0.0, 0.007, 0.001, 0.0, 0.005, 0.01, 0.008, 0.0]
    digits = 2 if name == "f14_choose_scene" else 3
    half = [0.05, 0.01, 0.05, 0.01, 0.03, 0.04, 0.02, 0.04, 0.04, 0.07, 0.05, 0.03, 0.01, 0.08, 0.06, 0.02, 0.08, 0.07, 0.08, 0.01]
    scenes = [("R", d) for d in half] + [("A", 0.043)] * 20 if digits == 2 else [("R", d) for d in finer] + [("A", 0.0043)] * 20
    rows = [(1, 1, order, flag, 30.0, 30000.0, d, 0.01) for order, (flag, d) in enumerate(scenes)]
    table = spark.createDataFrame(rows, "l_suppkey bigint, l_linenumber int, l_orderkey bigint, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    table.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES[name](spark, str(tmp_path))
    if name == "f14_scene_statistics":
        meta, _ = rq.scene_tables(spark, str(tmp_path))
        assert {r.scene_id: r.cloud_cover for r in meta.collect()} == {"A1": 0.43, "R1": 0.43}
        assert got.count() == 2
    else:
        assert got.first().reasons.split(":")[0] == "A1" and got.first().rejected == 2


def test_bands_round_to_integers_as_in_the_sql(spark, tmp_path):
    """Bands of 112.99999999999999 and 12.5 read 113 and 12; one of 499.6 is 500, which lies above the low limit."""
    rows = [(1, 1, order, "R", q, 30000.0, 0.05, 0.08) for order, q in enumerate([1.13, 0.125, 0.375, 4.996] + [40.0] * 12)]
    table = spark.createDataFrame(rows, "l_suppkey bigint, l_linenumber int, l_orderkey bigint, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    table.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    _, cells = rq.scene_tables(spark, str(tmp_path))
    assert difference(cells.toPandas(), con.execute(with_ctes("SELECT * FROM scene_pixels")).df()) is None
    for name in ("f14_scene_statistics", "f14_scenes_from_pixels"):
        assert difference(QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLES[name]).df()) is None
