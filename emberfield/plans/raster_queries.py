"""Pixel-table queries; chips of 20 × 20 pixels stand for the 200 × 200 ones."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from emberfield.functions.columns import utm_epsg
from emberfield.operators import raster as rs
from emberfield.plans.registry import CTES, query
from emberfield.sources import bindings

SIZE = bindings.CHIP


def nd(a, b):
    return f"CASE WHEN {a} >= 0 AND {b} >= 0 AND {a} + {b} > 1e-6 THEN ({a} - {b}) / ({a} + {b}) END"


def safe(a, b):
    return f"CASE WHEN ABS({a} + {b}) > 1e-6 THEN ({a} - {b}) / ({a} + {b}) END"


CTES["masked"] = (
    "SELECT *, scl IN (4, 5, 6) AS valid, TRUE AS \"full\", row BETWEEN 7.5 AND 12.499 AND col BETWEEN 7.5 AND 12.499 AS center, "
    "SQRT(POW(row - 9.5, 2) + POW(col - 9.5, 2)) * 10 AS radius, "
    + ", ".join(f"{nd(a, b)} AS {n}" for n, (a, b) in rs.INDICES.items())
    + " FROM pixels"
)
CTES["filled"] = (
    "SELECT p.chip_id, p.row, p.col, p.scl, p.landcover, p.valid, p.center, p.radius, "
    + ", ".join(f"CASE WHEN valid THEN p.{b} ELSE COALESCE(m.{b}, 0) END AS {b}" for b in rs.BANDS)
    + " FROM masked p JOIN (SELECT chip_id, "
    + ", ".join(f"MEDIAN({b}) FILTER (valid) AS {b}" for b in rs.BANDS)
    + " FROM masked GROUP BY chip_id) m USING (chip_id)"
)
CTES["layered"] = (
    "SELECT *, " + ", ".join(f"{safe(a, b)} AS {n}" for n, (a, b) in rs.INDICES.items())
    + f", {safe('(swir16 + red)', '(nir + blue)')} AS bsi FROM filled"
)


def masked(spark, folder):
    return rs.with_masks(bindings.pixels(spark, folder), SIZE)


def filled(spark, folder):
    return rs.median_fill(masked(spark, folder))


def layered(spark, folder):
    return rs.with_layers(filled(spark, folder))


@query("f1_normalized_difference", f"SELECT chip_id, row, col, {', '.join(f'{nd(a, b)} AS {n}' for n, (a, b) in rs.INDICES.items())} FROM pixels", "ndvi ndbi mndwi")
def f1(spark, folder):
    return masked(spark, folder).select("chip_id", "row", "col", *rs.INDICES)


@query("f2_safe_index", "SELECT chip_id, row, col, ndvi, ndbi, mndwi, bsi FROM layered", "ndvi ndbi mndwi bsi")
def f2(spark, folder):
    return layered(spark, folder).select("chip_id", "row", "col", "ndvi", "ndbi", "mndwi", "bsi")


SUMMARIES = [
    (f"img_{r}_{n}_{s}", r, n, q) for r in rs.REGIONS for n in (*rs.BANDS, *rs.INDICES) for s, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))
]


@query(
    "f3_region_summaries",
    "SELECT chip_id, " + ", ".join(f'QUANTILE_CONT({n}, {q}) FILTER (valid AND "{r}") AS {c}' for c, r, n, q in SUMMARIES) + " FROM masked GROUP BY chip_id",
    " ".join(c for c, *_ in SUMMARIES),
)
def f3(spark, folder):
    return rs.region_summaries(masked(spark, folder))


def _quality_sql(r):
    tails = {"negative": "0", "below_minus005": "-0.05"}
    parts = [
        f'AVG(CASE WHEN valid THEN 1 ELSE 0 END) FILTER ("{r}") AS {r}_clear_fraction',
        f'AVG(CASE WHEN landcover <> 0 THEN 1 ELSE 0 END) FILTER ("{r}") AS {r}_worldcover_fraction',
    ]
    for n, limit in tails.items():
        count = " + ".join(f"CASE WHEN {b} < {limit} THEN 1 ELSE 0 END" for b in rs.BANDS)
        parts.append(f'AVG(({count}) / 6.0) FILTER ("{r}" AND valid) AS {r}_{n}_fraction')
    parts += [f'AVG(CASE WHEN {n} IS NULL THEN 0 ELSE 1 END) FILTER ("{r}" AND valid) AS {r}_{n}_valid_fraction' for n in rs.INDICES]
    return ", ".join(parts)


QUALITY = [f"{r}_{n}_fraction" for r in rs.REGIONS for n in ("clear", "worldcover", "negative", "below_minus005", *(f"{i}_valid" for i in rs.INDICES))]


@query(
    "f4_region_quality",
    f"SELECT *, full_below_minus005_fraction > 0.005 AS review_reflectance_tail FROM (SELECT chip_id, {_quality_sql('full')}, {_quality_sql('center')} FROM masked GROUP BY chip_id)",
    " ".join(QUALITY),
)
def f4(spark, folder):
    return rs.region_quality(masked(spark, folder))


CLASSES = [f"img_{r}_wc_{k}_fraction" for r in rs.REGIONS for k in rs.LAND_COVER]


@query(
    "f5_class_fractions",
    "SELECT chip_id, "
    + ", ".join(f'AVG(CASE WHEN landcover = {k} THEN 1 ELSE 0 END) FILTER ("{r}" AND landcover <> 0) AS img_{r}_wc_{k}_fraction' for r in rs.REGIONS for k in rs.LAND_COVER)
    + " FROM masked GROUP BY chip_id",
    " ".join(CLASSES),
)
def f5(spark, folder):
    return rs.class_fractions(masked(spark, folder))


@query(
    "f6_nearest_class_distance",
    "SELECT chip_id, MIN(SQRT(POW(row - 9.5, 2) + POW(col - 9.5, 2)) * 10) FILTER (landcover = 50) AS img_nearest_builtup_in_chip_m FROM pixels GROUP BY chip_id",
    "img_nearest_builtup_in_chip_m",
)
def f6(spark, folder):
    return rs.nearest_class_distance(bindings.pixels(spark, folder), SIZE)


RGB = ", ".join(f"LEAST(GREATEST({b}, -0.05), 1.5) AS {b}" for b in ("red", "green", "blue"))


@query("f7_median_fill", f"SELECT chip_id, row, col, {', '.join(rs.BANDS)} FROM filled", " ".join(rs.BANDS))
def f7(spark, folder):
    return filled(spark, folder).select("chip_id", "row", "col", *rs.BANDS)


@query("f7_finite_rgb", f"SELECT chip_id, row, col, {RGB} FROM filled", "red green blue")
def f7_rgb(spark, folder):
    return rs.finite_rgb(filled(spark, folder))


CONTRAST = [f"morph_{c}_{s}" for c in rs.LAYERS for s in ("center_minus_ring", "center_std")]


@query(
    "f8_centre_ring_contrast",
    "SELECT chip_id, "
    + ", ".join(
        f"MEDIAN({c}) FILTER (valid AND radius <= 25) - MEDIAN({c}) FILTER (valid AND radius > 25 AND radius <= 50) AS morph_{c}_center_minus_ring, "
        f"STDDEV_POP({c}) FILTER (valid AND radius <= 25) AS morph_{c}_center_std"
        for c in rs.LAYERS
    )
    + " FROM layered GROUP BY chip_id",
    " ".join(CONTRAST),
)
def f8(spark, folder):
    return rs.centre_ring_contrast(layered(spark, folder))


def _slope_sql(c, line, along):
    w = f"OVER (PARTITION BY chip_id, {line} ORDER BY {along})"
    back = f"CASE WHEN LAG({along}) {w} = {along} - 1 THEN LAG({c}) {w} END"
    ahead = f"CASE WHEN LEAD({along}) {w} = {along} + 1 THEN LEAD({c}) {w} END"
    return f"COALESCE((({ahead}) - ({back})) / 2, ({ahead}) - {c}, {c} - ({back}), 0)"


CTES["steep"] = (
    "SELECT chip_id, valid, radius, "
    + ", ".join(f"SQRT(POW({_slope_sql(c, 'row', 'col')}, 2) + POW({_slope_sql(c, 'col', 'row')}, 2)) AS g_{c}" for c in rs.TEXTURED)
    + " FROM (SELECT * REPLACE (" + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in rs.TEXTURED) + ") FROM layered)"
)
TEXTURE = [f"morph_{c}_gradient_{s}" for c in rs.TEXTURED for s in ("mean", "p90")]


@query(
    "f9_gradient_texture",
    "SELECT chip_id, "
    + ", ".join(f"AVG(g_{c}) FILTER (valid) AS morph_{c}_gradient_mean, QUANTILE_CONT(g_{c}, 0.9) FILTER (valid AND radius <= 25) AS morph_{c}_gradient_p90" for c in rs.TEXTURED)
    + " FROM steep GROUP BY chip_id",
    " ".join(TEXTURE),
)
def f9(spark, folder):
    return rs.gradient_texture(layered(spark, folder))


CTES["built_edges"] = """
SELECT *, CASE WHEN LEAD(col) OVER (PARTITION BY chip_id, row ORDER BY col) = col + 1 THEN CASE WHEN LEAD(b) OVER (PARTITION BY chip_id, row ORDER BY col) <> b THEN 1 ELSE 0 END END AS h,
       CASE WHEN LEAD(row) OVER (PARTITION BY chip_id, col ORDER BY row) = row + 1 THEN CASE WHEN LEAD(b) OVER (PARTITION BY chip_id, col ORDER BY row) <> b THEN 1 ELSE 0 END END AS v
FROM (SELECT *, CASE WHEN landcover = 50 THEN 1 ELSE 0 END AS b FROM masked)
"""
RADII = [f"morph_built_fraction_r{r}" for r in (10, 25, 50, 100)]


@query(
    "f10_builtup_radii",
    "SELECT chip_id, " + ", ".join(f"AVG(b) FILTER (landcover <> 0 AND radius <= {r}) AS morph_built_fraction_r{r}" for r in (10, 25, 50, 100))
    + ", (COALESCE(SUM(h), 0) + COALESCE(SUM(v), 0)) / NULLIF(COUNT(h) + COUNT(v), 0) AS morph_built_edge_density FROM built_edges GROUP BY chip_id",
    " ".join(RADII) + " morph_built_edge_density",
)
def f10(spark, folder):
    return rs.builtup_radii(masked(spark, folder))


@query(
    "f11_components_8",
    """
WITH RECURSIVE built AS (SELECT chip_id, row, col, chip_id * 400 + row * 20 + col AS node FROM pixels WHERE landcover = 50),
links AS (SELECT a.node AS a, b.node AS b FROM built a JOIN built b ON a.chip_id = b.chip_id AND ABS(a.row - b.row) <= 1 AND ABS(a.col - b.col) <= 1),
reach(node, seen) AS (SELECT node, node FROM built UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
roots AS (SELECT node, MIN(seen) AS root FROM reach GROUP BY node),
sizes AS (SELECT node // 400 AS chip_id, root, COUNT(*) AS n FROM roots GROUP BY ALL),
found AS (SELECT chip_id, COUNT(*) AS c, MAX(n) AS m, SUM(n) AS b FROM sizes GROUP BY chip_id)
SELECT k.chip_id, COALESCE(c * 10000.0 / GREATEST(k.n, 1), 0) AS morph_built_components_per_10k, COALESCE(m / b, 0) AS morph_largest_built_component_fraction
FROM (SELECT chip_id, COUNT(*) FILTER (landcover <> 0) AS n FROM pixels GROUP BY chip_id) k LEFT JOIN found USING (chip_id)""",
    "morph_built_components_per_10k morph_largest_built_component_fraction",
)
def f11(spark, folder):
    return rs.components_8(bindings.pixels(spark, folder))


@query(
    "f12_high_index_share",
    """SELECT chip_id, AVG(CASE WHEN ndbi > 0 THEN 1 ELSE 0 END) FILTER (valid AND radius <= 25) AS morph_high_ndbi_center_fraction,
              AVG(CASE WHEN ndvi > 0.4 THEN 1 ELSE 0 END) FILTER (valid AND radius <= 25) AS morph_high_ndvi_center_fraction FROM layered GROUP BY chip_id""",
    "morph_high_ndbi_center_fraction morph_high_ndvi_center_fraction",
)
def f12(spark, folder):
    return rs.high_index_share(layered(spark, folder))


CHIPS = """
SELECT s_suppkey AS chip_id, s_suppkey AS source_id, CASE WHEN s_nationkey = 3 THEN s_suppkey + 1 ELSE s_suppkey END AS recorded_source_id,
       CASE WHEN s_acctbal < 2000 THEN DATE '2021-06-01' ELSE DATE '2023-06-01' END AS scene_date,
       s_nationkey = 7 AS swapped, s_acctbal / 200 AS lat, s_acctbal / 100 AS lon,
       s_acctbal / 200 + CASE WHEN s_nationkey = 9 THEN 0.001 ELSE 0 END AS centre_lat, s_acctbal / 100 AS centre_lon
FROM supplier
"""
CTES["chips"] = CHIPS
CTES["chip_stats"] = (
    "SELECT chip_id, COUNT(*) AS pixels, AVG(CASE WHEN valid THEN 1 ELSE 0 END) AS cf, AVG(CASE WHEN valid THEN 1 ELSE 0 END) FILTER (center) AS cc, "
    "COUNT(*) FILTER (NOT valid) AS breaks, AVG((" + " + ".join(f"CASE WHEN {b} < -0.05 THEN 1 ELSE 0 END" for b in rs.BANDS)
    + ") / 6.0) FILTER (valid) AS tail FROM masked GROUP BY chip_id"
)


def _rules_sql(rules):
    return " UNION ALL ".join(f"SELECT chip_id, '{n}' AS rule FROM chips LEFT JOIN chip_stats USING (chip_id) WHERE {c}" for n, c in rules.items())


@query(
    "f13_chip_constraints",
    _rules_sql(
        {
            "identity": "source_id <> recorded_source_id",
            "date window": "scene_date NOT BETWEEN DATE '2022-01-01' AND DATE '2024-12-31'",
            "shape": "COALESCE(pixels, 0) <> 400",
            "coverage": "COALESCE(LEAST(cf, cc), 0) < 0.8",
            "mask consistency": "COALESCE(breaks, 0) > 0",
            "reflectance tail": "COALESCE(tail, 0) > 0.05",
            "band order": "swapped",
            "centre": "ABS(centre_lat - lat) > 1e-7 OR ABS(centre_lon - lon) > 1e-7",
        }
    ),
)
def f13(spark, folder):
    supplier = bindings.table(spark, folder, "supplier")
    chips = spark.sql(CHIPS.replace("FROM supplier", "FROM {supplier}"), supplier=supplier)
    right = F.array(*[F.lit(b) for b in rs.BANDS])
    chips = chips.withColumn("bands", F.when(F.col("swapped"), F.reverse(right)).otherwise(right)).drop("swapped")
    return rs.chip_constraints(chips, bindings.pixels(spark, folder), ("2022-01-01", "2024-12-31"), SIZE)


SCENES = """
SELECT l_suppkey AS chip_id, CONCAT(l_returnflag, CAST(l_linenumber AS VARCHAR(2))) AS scene_id, ROUND(AVG(l_discount) * 100, 1) AS cloud_cover,
       ROUND(LEAST(AVG(l_tax) * 22, 1), 3) AS clear_full, ROUND(LEAST(AVG(l_quantity) / 28, 1), 3) AS clear_center,
       ROUND(LEAST(AVG(l_tax) * 22, 1), 3) AS finite_full, ROUND(LEAST(AVG(l_extendedprice) / 50000, 1), 3) AS finite_center,
       ROUND(AVG(l_discount) - 0.01, 3) AS tail
FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linenumber
"""
CTES["scenes"] = SCENES


@query(
    "f14_choose_scene",
    """
WITH placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chip_id ORDER BY cloud_cover, scene_id) AS place FROM scenes),
rated AS (SELECT *, CASE WHEN LEAST(clear_full, clear_center) < 0.8 THEN 'cloud/coverage' WHEN LEAST(finite_full, finite_center) < 0.8 THEN 'missing band pixels'
                         WHEN tail > 0.05 THEN 'suspect reflectance offset' END AS reason FROM placed WHERE place <= 8),
best AS (SELECT chip_id, MIN(place) FILTER (reason IS NULL) AS b FROM rated GROUP BY chip_id)
SELECT chip_id, MAX(scene_id) FILTER (place = b) AS scene_id, COUNT(*) FILTER (b IS NULL OR place < b) AS rejected,
       COALESCE(STRING_AGG(scene_id || ':' || reason, '|' ORDER BY place) FILTER (b IS NULL OR place < b), '') AS reasons
FROM rated JOIN best USING (chip_id) GROUP BY chip_id""",
)
def f14(spark, folder):
    return rs.choose_scene(exact_means(spark, folder, SCENES))


def exact_means(spark, folder, text):
    """Rows of a text over line items with means of exact sums: where a mean lies on a rounding half, sums of doubles decide by their order."""
    exact = re.sub(r"AVG\((\w+)\)", r"(SUM(CAST(\1 AS DECIMAL(24, 8))) / NULLIF(COUNT(\1), 0))", text)
    lineitem = bindings.table(spark, folder, "lineitem")
    rows = spark.sql(exact.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    return rows.select(*[F.col(c).cast("double") if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes])


SCENE_SIDE = 4
CTES["scene_meta"] = """
SELECT l_suppkey AS chip_id, CONCAT(l_returnflag, CAST(l_linenumber AS VARCHAR(2))) AS scene_id, ROUND(AVG(l_discount) * 100, 2) AS cloud_cover,
       CASE WHEN l_suppkey % 17 = 0 AND l_linenumber = 2 THEN 0e0 ELSE 0.0001e0 END AS scale,
       CASE WHEN l_suppkey % 5 = 0 AND l_linenumber % 2 = 0 THEN -0.4e0 ELSE -0.1e0 END AS offset_
FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linenumber
"""
CTES["scene_pixels"] = f"""
SELECT l_suppkey AS chip_id, CONCAT(l_returnflag, CAST(l_linenumber AS VARCHAR(2))) AS scene_id,
       CAST(l_orderkey % {SCENE_SIDE} AS INT) AS row, CAST(FLOOR(l_orderkey / {SCENE_SIDE}) % {SCENE_SIDE} AS INT) AS col,
       CASE WHEN MAX(l_quantity) >= 50 AND l_suppkey % 3 = 0 THEN 3 WHEN MAX(l_quantity) > 47 THEN 5 ELSE 4 END AS scl,
       CAST(MAX(l_quantity) * 100 AS INT) AS blue, CAST(MIN(l_quantity) * 100 AS INT) AS green, CAST(MAX(l_tax) * 10000 AS INT) AS red,
       CASE WHEN MIN(l_quantity) < 3 AND l_suppkey % 7 = 0 THEN NULL ELSE CAST(MAX(l_discount) * 50000 AS INT) END AS nir,
       CAST(MAX(l_tax) * 40000 AS INT) AS swir16, CAST(MIN(l_quantity) * 80 AS INT) AS swir22
FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linenumber, l_orderkey % {SCENE_SIDE}, FLOOR(l_orderkey / {SCENE_SIDE}) % {SCENE_SIDE}
"""
_SCALED = {b: f"(CASE WHEN scale > 0 THEN {b} * scale + offset_ END)" for b in rs.BANDS}
CTES["scene_rated"] = f"""
WITH placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chip_id ORDER BY cloud_cover, scene_id) AS place FROM scene_meta),
px AS (
  SELECT chip_id, scene_id, scl IN (4, 5, 6) AS clear, scl IN (4, 5, 6) AND {" AND ".join(f"{v} IS NOT NULL" for v in _SCALED.values())} AS finite,
         row >= {SCENE_SIDE * 3 / 8} AND row < {SCENE_SIDE * 5 / 8} AND col >= {SCENE_SIDE * 3 / 8} AND col < {SCENE_SIDE * 5 / 8} AS centre,
         ({" + ".join(f"CASE WHEN {v} < -0.05 THEN 1 ELSE 0 END" for v in _SCALED.values())}) / 6.0 AS low
  FROM scene_pixels JOIN placed USING (chip_id, scene_id) WHERE place <= 8),
stats AS (
  SELECT chip_id, scene_id, AVG(clear::INT) AS cf, AVG(clear::INT) FILTER (centre) AS cc, AVG(finite::INT) AS ff, AVG(finite::INT) FILTER (centre) AS fc,
         AVG(low) FILTER (finite) AS tail FROM px GROUP BY ALL)
SELECT p.*, COALESCE(cf, 0) AS clear_full, COALESCE(ff, 0) AS finite_full, COALESCE(tail, 0) AS tail,
  CASE WHEN LEAST(COALESCE(cf, 0), COALESCE(cc, 0)) < 0.8 THEN 'cloud/coverage' WHEN NOT (scale > 0) THEN 'invalid scale or offset'
       WHEN LEAST(COALESCE(ff, 0), COALESCE(fc, 0)) < 0.8 THEN 'missing band pixels' WHEN COALESCE(tail, 0) > 0.05 THEN 'suspect reflectance offset' END AS reason
FROM placed p LEFT JOIN stats USING (chip_id, scene_id) WHERE place <= 8"""


def scene_tables(spark, folder):
    # The SQL's casts round a band to the nearest integer; Spark's would cut its digits off.
    rounded = re.sub(r"CAST\((M\w\w\(\w+\) \* \d+) AS INT\)", r"CAST(RINT(\1) AS INT)", CTES["scene_pixels"])
    meta, cells = (exact_means(spark, folder, text) for text in (CTES["scene_meta"], rounded))
    return meta.withColumnRenamed("offset_", "offset"), cells


@query(
    "f14_scenes_from_pixels",
    """
WITH best AS (SELECT chip_id, MIN(place) FILTER (reason IS NULL) AS b FROM scene_rated GROUP BY chip_id)
SELECT chip_id, MAX(scene_id) FILTER (place = b) AS scene_id, COUNT(*) FILTER (b IS NULL OR place < b) AS rejected,
       COALESCE(STRING_AGG(scene_id || ':' || reason, '|' ORDER BY place) FILTER (b IS NULL OR place < b), '') AS reasons
FROM scene_rated JOIN best USING (chip_id) GROUP BY chip_id""",
)
def f14_pixels(spark, folder):
    """The first acceptable scene of every chip, judged on its integer bands under the scene's own scale and offset."""
    return rs.choose_scene(rs.scene_statistics(*scene_tables(spark, folder), SCENE_SIDE))


@query("f14_scene_statistics", "SELECT chip_id, scene_id, clear_full, finite_full, tail FROM scene_rated", "clear_full finite_full tail")
def f14_statistics(spark, folder):
    return rs.scene_statistics(*scene_tables(spark, folder), SCENE_SIDE).select("chip_id", "scene_id", "clear_full", "finite_full", "tail")


CTES["records"] = """
SELECT s_suppkey AS chip_id, CASE WHEN s_nationkey = 1 THEN 'failed' ELSE 'ok' END AS status, 's2' AS wanted_collection,
  CASE WHEN s_nationkey = 2 THEN 's1' ELSE 's2' END AS collection,
  CAST(s_suppkey AS VARCHAR(20)) AS source_id, CAST(CASE WHEN s_nationkey = 3 THEN s_suppkey + 1 ELSE s_suppkey END AS VARCHAR(20)) AS recorded_source_id,
  CONCAT('C', CAST(s_nationkey % 6 AS VARCHAR(2))) AS country, CONCAT('C', CAST(CASE WHEN s_nationkey = 4 THEN 9 ELSE s_nationkey % 6 END AS VARCHAR(2))) AS recorded_country,
  CASE WHEN s_nationkey = 5 THEN NULL ELSE s_suppkey END AS recorded_chip_id,
  'A1' AS scene_id, CASE WHEN s_nationkey = 6 THEN 'A2' ELSE 'A1' END AS recorded_scene_id,
  '2023-06-01' AS scene_time, CASE WHEN s_nationkey = 7 THEN '2023-06-02' ELSE '2023-06-01' END AS recorded_scene_time,
  'EPSG:32639' AS crs, CASE WHEN s_nationkey = 8 THEN 'EPSG:32638' ELSE 'EPSG:32639' END AS recorded_crs,
  CASE WHEN s_nationkey = 9 THEN 20e0 ELSE 10e0 END AS t0, CASE WHEN s_nationkey = 10 THEN 0.5e0 ELSE 0e0 END AS t1, CASE WHEN s_nationkey = 11 THEN 10e0 ELSE -10e0 END AS t4
FROM supplier
"""
_MASKS = """scl IN (4, 5, 6) OR (chip_id % 11 = 0 AND row = 3) AS clear_mask, (landcover <> 0) <> (chip_id % 13 = 0 AND row = 2) AS landcover_mask"""
CTES["record_facts"] = f"""
SELECT chip_id, COUNT(*) FILTER (clear_mask AND scl NOT IN (4, 5, 6)) AS scl_breaks, COUNT(*) FILTER (landcover_mask <> (landcover <> 0)) AS landcover_breaks
FROM (SELECT *, {_MASKS} FROM pixels) GROUP BY chip_id"""
_BROKEN = {
    "status": "status <> 'ok'", "collection": "collection <> wanted_collection", "pixel grid": "t0 <> 10 OR t1 <> 0 OR t4 <> -10",
    "land cover mask": "COALESCE(landcover_breaks, 1) > 0", "scene class under clear mask": "COALESCE(scl_breaks, 1) > 0",
} | {f"{c} identity": f"{c} IS DISTINCT FROM recorded_{c}" for c in rs.RECORDED}


@query(
    "f13_record_constraints",
    " UNION ALL ".join(f"SELECT chip_id, '{n}' AS rule FROM records LEFT JOIN record_facts USING (chip_id) WHERE {c}" for n, c in _BROKEN.items()),
)
def f13_records(spark, folder):
    """Every rule on a chip's record and masks that it breaks; each rule is broken by some chip."""
    supplier = bindings.table(spark, folder, "supplier")
    chips = spark.sql(CTES["records"].replace("FROM supplier", "FROM {supplier}"), supplier=supplier)
    chips = chips.withColumn("transform", F.array("t0", "t1", F.lit(0.0), F.lit(0.0), "t4", F.lit(0.0)))
    masks = bindings.pixels(spark, folder).selectExpr("chip_id", "scl", "landcover", "row", "col", *_MASKS.split(", (l")[:1], "(l" + _MASKS.split(", (l")[1])
    return rs.record_constraints(chips, masks)


FOOTPRINT = "lon - 0.02 AS west, lat - 0.02 AS south, lon + 0.02 AS east, lat + 0.02 AS north"


@query(
    "f15_covering_tiles",
    f"""
SELECT flare_id, CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || LPAD(CAST(ABS(la) AS VARCHAR), 2, '0') || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END || LPAD(CAST(ABS(lo) AS VARCHAR), 3, '0') AS tile
FROM (SELECT flare_id, la, UNNEST(RANGE(CAST(3 * FLOOR(west / 3) AS INT), CAST(3 * FLOOR(east / 3) AS INT) + 1, 3)) AS lo
      FROM (SELECT *, UNNEST(RANGE(CAST(3 * FLOOR(south / 3) AS INT), CAST(3 * FLOOR(north / 3) AS INT) + 1, 3)) AS la FROM (SELECT flare_id, {FOOTPRINT} FROM sites_wide)))""",
)
def f15(spark, folder):
    footprints = bindings.sites_wide(spark, folder).selectExpr("flare_id", *FOOTPRINT.split(", "))
    return rs.covering_tiles(footprints).select("flare_id", "tile")


@query(
    "f16_utm_epsg",
    "SELECT s_suppkey, (CASE WHEN s_acctbal >= 0 THEN 32600 ELSE 32700 END) + LEAST(60, CAST(FLOOR((s_acctbal / 60 + 180) / 6) AS INT) + 1) AS epsg FROM supplier",
)
def f16(spark, folder):
    rows = bindings.table(spark, folder, "supplier")
    return rows.select("s_suppkey", utm_epsg(F.col("s_acctbal"), F.col("s_acctbal") / 60).alias("epsg"))


@query(
    "f17_feature_coverage",
    "SELECT country, is_eog_flare, CASE WHEN score_visual >= 0.1 THEN 'ok' ELSE 'failed' END AS status, COUNT(*) AS n FROM predictions GROUP BY ALL",
)
def f17(spark, folder):
    status = F.when(F.col("score_visual") >= 0.1, "ok").otherwise("failed")
    return rs.feature_coverage(bindings.predictions(spark, folder).withColumn("status", status))
