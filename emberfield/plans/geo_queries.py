"""Source construction and the flagship persistence review."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.functions import columns as fx
from emberfield.operators import grid
from emberfield.operators.ordering import row_numbers
from emberfield.plans.registry import CTES, query
from emberfield.session import lookup
from emberfield.sources import bindings
from emberfield.sources.sites import active_sites

CTES["sites"] = """
SELECT flare_id, country, lat, lon, location,
       CASE WHEN COALESCE(y1996, y1997, y1998, y1999) IS NOT NULL
            THEN COALESCE(y1996, 0) + COALESCE(y1997, 0) + COALESCE(y1998, 0) + COALESCE(y1999, 0) END AS vol
FROM sites_wide WHERE GREATEST(COALESCE(y1996, 0), COALESCE(y1997, 0), COALESCE(y1998, 0), COALESCE(y1999, 0)) > 0
"""
CTES["origins"] = """
SELECT country, ROUND(AVG(latitude), 6) AS lat0, ROUND(AVG(longitude), 6) AS lon0 FROM detections GROUP BY country
"""
CTES["projected"] = """
SELECT d.*, RADIANS(longitude - lon0) * 6371000.0 * COS(RADIANS(lat0)) AS x,
       RADIANS(latitude - lat0) * 6371000.0 AS y
FROM detections d JOIN origins USING (country)
"""
CTES["located"] = """
SELECT *, CONCAT(country, '_', CAST(cell AS VARCHAR)) AS source_id FROM (
  SELECT *, (CAST(FLOOR(x / 1000.0) AS BIGINT) + 2000000) * 4000000 + CAST(FLOOR(y / 1000.0) AS BIGINT) + 2000000 AS cell
  FROM projected)
"""
CTES["sources"] = """
SELECT *, CONCAT(country, '_b', CAST((CAST(FLOOR(x / 10000.0) AS BIGINT) + 100000) * 1000000
                                     + CAST(FLOOR(y / 10000.0) AS BIGINT) + 100000 AS VARCHAR)) AS block_id
FROM (SELECT country, cell, source_id, COUNT(*) AS n_det, AVG(latitude) AS lat, AVG(longitude) AS lon,
             AVG(x) AS x, AVG(y) AS y, MIN(acq_date) AS date_min, MAX(acq_date) AS date_max,
             COUNT(DISTINCT acq_date) AS n_days, DATE_DIFF('day', MIN(acq_date), MAX(acq_date)) AS span_days
      FROM located GROUP BY ALL)
"""
CTES["site_cells"] = """
SELECT flare_id, country, location, sx, sy,
       CAST(FLOOR(sx / 1000.0) AS BIGINT) + dx AS ix, CAST(FLOOR(sy / 1000.0) AS BIGINT) + dy AS iy
FROM (SELECT s.*, RADIANS(lon - lon0) * 6371000.0 * COS(RADIANS(lat0)) AS sx, RADIANS(lat - lat0) * 6371000.0 AS sy
      FROM sites s JOIN origins USING (country)) p,
     (SELECT UNNEST([-1, 0, 1]) AS dx) a, (SELECT UNNEST([-1, 0, 1]) AS dy) b
"""
CTES["nearest_site"] = """
SELECT source_id, d, flare_id, location FROM (
  SELECT s.source_id, SQRT((sx - x) * (sx - x) + (sy - y) * (sy - y)) AS d, c.flare_id, c.location,
         ROW_NUMBER() OVER (PARTITION BY s.source_id ORDER BY SQRT((sx - x) * (sx - x) + (sy - y) * (sy - y)), c.flare_id) AS rn
  FROM sources s JOIN site_cells c ON s.country = c.country
   AND CAST(FLOOR(x / 1000.0) AS BIGINT) = c.ix AND CAST(FLOOR(y / 1000.0) AS BIGINT) = c.iy) WHERE rn = 1
"""
CTES["labelled"] = """
SELECT s.*, d AS eog_dist_m, CASE WHEN d <= 1000 THEN 1 ELSE 0 END AS is_eog_flare,
       CASE WHEN d <= 1000 THEN flare_id END AS eog_flare_id,
       COALESCE(location = 'OFFSHORE', FALSE) AS eog_offshore
FROM sources s LEFT JOIN nearest_site USING (source_id)
"""


def detections(spark, folder):
    return bindings.detections(spark, folder)


def sites(spark, folder, years=bindings.ACTIVE_YEARS):
    return active_sites(bindings.sites_wide(spark, folder), years)


def located(spark, folder):
    det = detections(spark, folder)
    return grid.assign_detections(det, lookup(grid.origins(det)))


def labelled(spark, folder):
    return grid.labelled_sources(detections(spark, folder), sites(spark, folder))


@query(
    "persistence_review",
    """
WITH rated AS (
  SELECT country, source_id, eog_flare_id, is_eog_flare, n_days * (1 - EXP(-span_days / 30.0)) AS persistence
  FROM labelled),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY persistence DESC, source_id) AS rn,
         COUNT(*) OVER (PARTITION BY country) AS n FROM rated)
SELECT country, MAX(n) AS sources, CAST(CEIL(MAX(n) / 5.0) AS BIGINT) AS reviewed,
       COUNT(DISTINCT eog_flare_id) AS labelled_sites,
       COUNT(DISTINCT CASE WHEN rn <= CEIL(n / 5.0) THEN eog_flare_id END) AS sites_in_top_fifth
FROM ranked GROUP BY country""",
)
def persistence_review(spark, folder):
    """Rank grid cells by persistence; labelled sites inside the top 20 %."""
    rated = labelled(spark, folder).select(
        "country",
        "source_id",
        "eog_flare_id",
        (F.col("n_days") * (1 - F.exp(-F.col("span_days") / 30.0))).alias("persistence"),
    )
    ranked = row_numbers(rated, ["country"], [F.col("persistence").desc(), F.col("source_id")])
    cut = F.ceil(F.col("row_group") / 5.0)
    sizes = ranked.groupBy("country").agg(F.max("row_group").alias("sources"), F.max(cut).alias("reviewed"))
    found = ranked.groupBy("country").agg(
        F.count_distinct("eog_flare_id").alias("labelled_sites"),
        F.count_distinct(F.when(F.col("row") <= cut, F.col("eog_flare_id"))).alias("sites_in_top_fifth"),
    )
    return sizes.join(found, "country")


@query(
    "a6_active_sites",
    "SELECT * FROM sites",
    "lat lon vol",
)
def a6(spark, folder):
    return sites(spark, folder)


@query("c1_to_local_m", "SELECT country, latitude, longitude, x, y, COUNT(*) AS n FROM projected GROUP BY ALL", "latitude longitude x y", digits=4)
def c1(spark, folder):
    det = detections(spark, folder)
    return (
        grid.project(det, lookup(grid.origins(det)))
        .groupBy("country", "latitude", "longitude", "x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("c2_grid_id", "SELECT country, cell, COUNT(*) AS n FROM located GROUP BY ALL")
def c2(spark, folder):
    return located(spark, folder).groupBy("country", "cell").agg(F.count(F.lit(1)).alias("n"))


@query("c3_country_origin", "SELECT * FROM origins", "lat0 lon0")
def c3(spark, folder):
    return grid.origins(detections(spark, folder))


SOURCE = "country, source_id, n_det, lat, lon, x, y, date_min, date_max, n_days, span_days"


@query("c4_build_sources", f"SELECT {SOURCE} FROM sources", "lat lon x y", digits=4)
def c4(spark, folder):
    return grid.build_sources(located(spark, folder)).select(*SOURCE.split(", "))


@query("c5_block_id", "SELECT block_id, COUNT(*) AS sources, SUM(n_det) AS n_det FROM sources GROUP BY block_id")
def c5(spark, folder):
    return (
        grid.build_sources(located(spark, folder))
        .groupBy("block_id")
        .agg(F.count(F.lit(1)).alias("sources"), F.sum("n_det").alias("n_det"))
    )


@query("c6_source_id", "SELECT source_id, country, cell FROM sources")
def c6(spark, folder):
    return grid.build_sources(located(spark, folder)).select("source_id", "country", "cell")


@query(
    "c7_label_sources",
    "SELECT source_id, eog_dist_m, is_eog_flare, eog_flare_id, eog_offshore FROM labelled",
    "eog_dist_m",
    digits=4,
)
def c7(spark, folder):
    return labelled(spark, folder).select("source_id", "eog_dist_m", "is_eog_flare", "eog_flare_id", "eog_offshore")


@query(
    "c8_assign_detections",
    "SELECT source_id, acq_date, acq_time, sensor, frp, latitude, longitude FROM located",
    "frp latitude longitude",
)
def c8(spark, folder):
    return located(spark, folder).select("source_id", "acq_date", "acq_time", "sensor", "frp", "latitude", "longitude")


CTES["summary"] = """
SELECT country, SUM(n_det) AS detections, COUNT(*) AS sources, COUNT(*) FILTER (n_det = 1) AS src_1det,
       COUNT(*) FILTER (n_days >= 5) AS src_ge5days, COUNT(*) FILTER (n_days >= 30) AS src_ge30days,
       COUNT(*) FILTER (span_days >= 365) AS src_multiyear, SUM(is_eog_flare) AS sources_matched,
       COUNT(DISTINCT eog_flare_id) AS eog_recovered FROM labelled GROUP BY country
"""


@query(
    "c9_source_summary",
    """
SELECT s.*, COALESCE(t.n, 0) AS eog_sites, ROUND(detections / sources, 1) AS det_per_source,
       ROUND(100.0 * src_1det / sources, 1) AS src_1det_pct,
       ROUND(100.0 * eog_recovered / GREATEST(COALESCE(t.n, 0), 1), 1) AS eog_recall_pct,
       ROUND(100.0 * sources_matched / sources, 3) AS pos_rate_pct
FROM summary s LEFT JOIN (SELECT country, COUNT(*) AS n FROM sites GROUP BY country) t USING (country)""",
    "det_per_source src_1det_pct eog_recall_pct pos_rate_pct",
)
def c9(spark, folder):
    return grid.source_summary(labelled(spark, folder), sites(spark, folder))


def _sweep_sql(size: int) -> str:
    cell = f"CAST(FLOOR(x / {size}.0) AS BIGINT) AS ix, CAST(FLOOR(y / {size}.0) AS BIGINT) AS iy"
    reach_cells = -(-1000 // size)
    reach = list(range(-reach_cells, reach_cells + 1))
    return f"""
SELECT {size} AS grid_m, country, COUNT(*) AS sources, SUM(CASE WHEN d <= 1000 THEN 1 ELSE 0 END) AS sources_matched,
       COUNT(DISTINCT CASE WHEN d <= 1000 THEN flare_id END) AS eog_recovered
FROM (
  SELECT c.country, c.ix, c.iy, MIN(SQRT((sx - x) * (sx - x) + (sy - y) * (sy - y))) AS d,
         MIN({{'d': SQRT((sx - x) * (sx - x) + (sy - y) * (sy - y)), 'f': flare_id}}).f AS flare_id
  FROM (SELECT country, ix, iy, AVG(x) AS x, AVG(y) AS y,
               CAST(FLOOR(AVG(x) / {size}.0) AS BIGINT) AS jx, CAST(FLOOR(AVG(y) / {size}.0) AS BIGINT) AS jy
        FROM (SELECT *, {cell} FROM projected) GROUP BY country, ix, iy) c
  LEFT JOIN (SELECT DISTINCT country, flare_id, sx, sy, CAST(FLOOR(sx / {size}.0) AS BIGINT) + dx AS kx,
                    CAST(FLOOR(sy / {size}.0) AS BIGINT) + dy AS ky
             FROM site_cells, (SELECT UNNEST({reach}) AS dx) a, (SELECT UNNEST({reach}) AS dy) b) s
    ON c.country = s.country AND c.jx = s.kx AND c.jy = s.ky
  GROUP BY c.country, c.ix, c.iy)
GROUP BY country"""


@query(
    "c10_grid_sweep",
    f"""
SELECT w.*, ROUND(100.0 * eog_recovered / GREATEST(COALESCE(t.n, 0), 1), 1) AS eog_recall_pct,
       ROUND(sources_matched / GREATEST(eog_recovered, 1), 3) AS fragments_per_site
FROM ({" UNION ALL ".join(_sweep_sql(size) for size in (500, 1000, 2000))}) w
LEFT JOIN (SELECT country, COUNT(*) AS n FROM sites GROUP BY country) t USING (country)""",
    "eog_recall_pct fragments_per_site",
)
def c10(spark, folder):
    return grid.grid_sweep(detections(spark, folder), sites(spark, folder))
