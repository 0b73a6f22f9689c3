"""Ingest, grid, labels and features on hand-sized frames."""

from __future__ import annotations

import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.functions import columns as fx
from emberfield.operators import features as ft
from emberfield.operators import grid, raster
from emberfield.operators.components import connected_components
from emberfield.sources import ingest
from emberfield.sources.sites import active_sites

HEAD = "latitude,longitude,{a},scan,track,acq_date,acq_time,satellite,instrument,confidence,version,{b},frp,daynight,type\n"


def write_raw(root, folder, name, a, b, rows):
    target = root / folder
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_text(HEAD.format(a=a, b=b) + "".join(r + "\n" for r in rows))


@pytest.fixture
def raw(tmp_path):
    write_raw(tmp_path, "modis", "modis_2022_Iraq.csv", "brightness", "bright_t31",
              ["30.5,47.25,310.5,1,1,2022-01-02,136,Terra,MODIS,80,61.03,290,12.5,N,2"])
    write_raw(tmp_path, "viirs_snpp", "viirs-snpp_2022_Iraq.csv", "bright_ti4", "bright_ti5",
              ["30.5,47.25,367,0.4,0.4,2022-02-30,0005,N,VIIRS,n,2,295,3.5,D,0"])
    write_raw(tmp_path, "viirs_noaa20", "viirs-jpss1_2023_Libya.csv", "bright_ti4", "bright_ti5",
              ["30.5,17.25,330,0.4,0.4,2023-03-01,2359,1,VIIRS,h,2,295,3.5,D,0"])
    return tmp_path


def test_reads_both_families(spark, raw):
    rows = {r["sensor"]: r for r in ingest.read_detections(spark, str(raw)).collect()}
    assert rows["MODIS"]["acq_time"] == 136 and rows["MODIS"]["t_mir"] == 310.5 and rows["MODIS"]["country"] == "Iraq"
    assert rows["VIIRS_SNPP"]["acq_date"] is None and rows["VIIRS_SNPP"]["acq_time"] == 5
    assert rows["VIIRS_N20"]["year"] == 2023 and rows["VIIRS_N20"]["t_lwir"] == 295.0


def test_sensor_is_that_of_the_folder_read(spark, raw):
    """Not of a folder of that name further up; a row's path is not searched for its parts."""
    write_raw(raw / "modis" / "again", "viirs_snpp", "viirs-snpp_2021_Libya.csv", "bright_ti4", "bright_ti5",
              ["30.5,17.25,330,0.4,0.4,2021-03-01,2359,1,VIIRS,h,2,295,3.5,D,0"])
    got = ingest.read_detections(spark, str(raw / "modis" / "again"), ["viirs_snpp"])
    assert [(r.sensor, r.year, r.country) for r in got.collect()] == [("VIIRS_SNPP", 2021, "Libya")]
    assert "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_unparseable_name_is_an_error(spark, raw):
    write_raw(raw, "modis", "notes.csv", "brightness", "bright_t31", ["1,1,300,1,1,2022-01-01,1,T,M,1,1,290,1,N,0"])
    with pytest.raises(Exception, match="unparseable"):
        ingest.read_detections(spark, str(raw)).collect()


def test_sites_ignore_absent_years(spark):
    wide = spark.createDataFrame(
        [("a", "x", 0.0, 0.0, "ONSHORE", None, None), ("b", "x", 0.0, 0.0, "ONSHORE", 0.0, 2.0), ("c", "x", 0.0, 0.0, "ONSHORE", None, 0.0)],
        "flare_id string, country string, lat double, lon double, location string, y2020 double, y2021 double",
    )
    got = {r["flare_id"]: r["vol"] for r in active_sites(wide, range(2019, 2023)).collect()}
    assert got == {"b": 2.0}


def det(spark, rows):
    return spark.createDataFrame(
        rows,
        "country string, latitude double, longitude double, acq_date date, acq_time int, sensor string, daynight string, "
        "confidence string, t_mir double, t_lwir double, frp double, scan double, track double, year int",
    )


def sample(spark):
    base = dict(sensor="MODIS", daynight="N", confidence="80", t_lwir=300.0, scan=1.0, track=1.0)
    days = [(date(2022, 1, 1), 10.0, 361.0), (date(2022, 1, 1), 30.0, 367.0), (date(2022, 1, 11), 20.0, 360.0)]
    rows = [
        ("x", 10.0, 20.0, d, 1230, base["sensor"], "N", "80", mir, 300.0, frp, 1.0, 2.0, 2022) for d, frp, mir in days
    ]
    return det(spark, rows).withColumn("source_id", F.lit("x_1"))


def test_features_of_one_source(spark):
    row = ft.source_features(sample(spark), (2022,)).first().asDict()
    assert row["n_det"] == 3 and row["n_days"] == 2 and row["span_days"] == 10 and row["duty_cycle"] == 0.2
    assert row["max_gap_days"] == 10 and row["mean_gap_days"] == 10 and row["n_pixels"] == 1
    assert row["frp_med"] == 20 and math.isclose(row["frp_p90"], 28) and math.isclose(row["frp_std"], 10)
    assert math.isclose(row["sat_frac"], 1 / 3) and row["night_frac"] == 1 and row["conf_modis_mean"] == 80
    assert math.isclose(row["lst_mean"], 12.5 + 20 / 15) and row["snpp_modis_ratio"] == 0.25
    assert row["month_entropy"] == 0 and row["month_max_share"] == 1 and math.isclose(row["span_window_frac"], 10 / 364)


def test_single_day_source_nulls(spark):
    row = ft.source_features(sample(spark).limit(1), (2022,)).first().asDict()
    assert row["duty_cycle"] is None and row["frp_std"] == 0 and row["max_gap_days"] == 0


def test_empty_window_is_an_error(spark):
    with pytest.raises(ValueError):
        ft.window_filter(sample(spark), [1999])


def test_nearest_site_ties_and_reach(spark):
    origin = spark.createDataFrame([("x", 0.0, 0.0)], "country string, lat0 double, lon0 double")
    metre = 180 / (math.pi * fx.EARTH_RADIUS_M)
    src = spark.createDataFrame(
        [("s1", "x", 500.0, 500.0), ("s2", "x", 5500.0, 500.0), ("s3", "x", 50500.0, 500.0)], "source_id string, country string, x double, y double"
    )
    sites = spark.createDataFrame(
        [("b", "x", 500 * metre, 700 * metre, "ONSHORE"), ("a", "x", 500 * metre, 300 * metre, "OFFSHORE"),
         ("c", "x", 1500 * metre, 6500 * metre, "OFFSHORE")],
        "flare_id string, country string, lat double, lon double, location string",
    )
    rows = {r["source_id"]: r for r in grid.label_sources(src, sites, origin).collect()}
    assert rows["s1"]["eog_flare_id"] in ("a", "b") and math.isclose(rows["s1"]["eog_dist_m"], 200, abs_tol=1e-6)
    assert rows["s2"]["is_eog_flare"] == 0 and rows["s2"]["eog_flare_id"] is None and rows["s2"]["eog_offshore"]
    assert math.isclose(rows["s2"]["eog_dist_m"], math.hypot(1000, 1000), rel_tol=1e-6)
    assert rows["s3"]["eog_dist_m"] is None and not rows["s3"]["eog_offshore"]


def test_labels_match_brute_force(spark):
    rng = np.random.default_rng(5)
    src = pd.DataFrame({"source_id": [f"s{i}" for i in range(300)], "country": "x", "x": rng.uniform(0, 9e3, 300), "y": rng.uniform(0, 9e3, 300)})
    site = pd.DataFrame({"flare_id": [f"f{i:03d}" for i in range(60)], "country": "x", "sx": rng.uniform(0, 9e3, 60), "sy": rng.uniform(0, 9e3, 60)})
    degree = 180 / (math.pi * fx.EARTH_RADIUS_M)
    sites = spark.createDataFrame(site.assign(lat=site.sy * degree, lon=site.sx * degree, location="ONSHORE")[["flare_id", "country", "lat", "lon", "location"]])
    origin = spark.createDataFrame([("x", 0.0, 0.0)], "country string, lat0 double, lon0 double")
    got = grid.label_sources(spark.createDataFrame(src), sites, origin).toPandas().set_index("source_id")
    for row in src.itertuples():
        d = np.hypot(site.sx - row.x, site.sy - row.y)
        hit = d.min() <= 1000
        assert got.loc[row.source_id, "is_eog_flare"] == int(hit)
        if hit:
            assert got.loc[row.source_id, "eog_flare_id"] == site.flare_id[d.argmin()]


def test_index_masks(spark):
    df = spark.createDataFrame([(0.4, 0.2), (-0.1, 0.5), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(fx.normalized_difference(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], 1 / 3) and got[1:] == [None, None]
    loose = [r[0] for r in df.select(fx.safe_index(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(loose[1], -1.5) and loose[2] is None


def test_true_strings(spark):
    df = spark.createDataFrame([("True",), ("False",), (" yes ",), ("1",), (None,), ("0",)], "v string")
    assert [r[0] for r in df.select(fx.is_true(F.col("v"))).collect()] == [True, False, True, True, False, False]


def chip(spark, size=4, landcover=None):
    values = landcover or [[10] * size] * size
    rows = [
        (1, r, c, 0.1 * c, 0.2, 0.1 * r + 0.05, 0.4, 0.3, 0.2, 4, values[r][c]) for r in range(size) for c in range(size)
    ]
    return spark.createDataFrame(
        rows,
        "chip_id bigint, row int, col int, blue double, green double, red double, nir double, swir16 double, swir22 double, scl int, landcover int",
    )


def test_gradient_equals_numpy(spark):
    layered = rs_layers(spark)
    got = raster.gradient_texture(layered).first()
    red = np.array([[0.1 * r + 0.05 for _ in range(4)] for r in range(4)])
    gy, gx = np.gradient(red)
    assert math.isclose(got["morph_red_gradient_mean"], np.hypot(gx, gy).mean())


def rs_layers(spark):
    return raster.with_layers(raster.median_fill(raster.with_masks(chip(spark), 4)))


def test_unknown_land_cover_is_null(spark):
    got = raster.class_fractions(raster.with_masks(chip(spark, landcover=[[0] * 4] * 4), 4)).first()
    assert got["img_full_wc_10_fraction"] is None


def test_diagonal_components(spark):
    cover = [[50, 0, 0, 10], [0, 50, 0, 10], [0, 0, 0, 10], [50, 0, 0, 10]]
    got = raster.components_8(chip(spark, landcover=cover)).first()
    assert math.isclose(got["morph_largest_built_component_fraction"], 2 / 3)
    assert math.isclose(got["morph_built_components_per_10k"], 2 * 10000 / 7)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5000, 5001)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5001] == 5000


def test_antimeridian_is_an_error(spark):
    df = spark.createDataFrame([(179.9, 0.0, -179.9, 0.1)], "west double, south double, east double, north double")
    with pytest.raises(Exception, match="antimeridian"):
        raster.covering_tiles(df).collect()


def test_utm_zones(spark):
    df = spark.createDataFrame([(33.0, 44.0), (-8.8, 13.2), (10.0, 180.0)], "lat double, lon double")
    assert [r[0] for r in df.select(fx.utm_epsg(F.col("lat"), F.col("lon"))).collect()] == [32638, 32733, 32660]
