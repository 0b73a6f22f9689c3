"""Per-source feature queries over the common window."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators import features as ft
from emberfield.operators import grid
from emberfield.plans.geo_queries import detections, sites
from emberfield.plans.registry import CTES, query
from emberfield.session import lookup
from emberfield.sources.bindings import WINDOW_YEARS

CTES["windowed"] = """
SELECT *, MONTH(acq_date) AS month, scan * track AS pix_km2, frp / (scan * track) AS frp_dens, t_mir - t_lwir AS dt_mir_lwir,
       CASE WHEN t_mir >= 367 THEN 1 ELSE 0 END AS sat, CASE WHEN daynight = 'N' THEN 1 ELSE 0 END AS is_night,
       h - 24 * FLOOR(h / 24) AS lst
FROM (SELECT *, FLOOR(acq_time / 100) + (acq_time % 100) / 60.0 + longitude / 15.0 AS h FROM located
      WHERE sensor IN ('MODIS', 'VIIRS_SNPP') AND year IN (1996, 1997, 1998))
"""
CTES["f_intensity"] = (
    "SELECT source_id, "
    + ", ".join(
        f"AVG({c}) AS {c}_mean, MAX({c}) AS {c}_max, COALESCE(STDDEV_SAMP({c}), 0) AS {c}_std, MEDIAN({c}) AS {c}_med"
        for c in ft.INTENSITY
    )
    + """, QUANTILE_CONT(frp, 0.9) AS frp_p90, SUM(frp) AS frp_sum, AVG(pix_km2) AS pix_km2_mean,
       COALESCE(STDDEV_SAMP(frp), 0) / NULLIF(AVG(frp), 0) AS frp_cv FROM windowed GROUP BY source_id"""
)
CTES["f_flags"] = "SELECT source_id, AVG(sat) AS sat_frac, AVG(is_night) AS night_frac FROM windowed GROUP BY source_id"
CTES["f_persistence"] = """
SELECT *, n_days / NULLIF(span_days, 0) AS duty_cycle, n_det / n_days AS det_per_day
FROM (SELECT source_id, COUNT(*) AS n_det, COUNT(DISTINCT acq_date) AS n_days,
             COUNT(DISTINCT DATE_TRUNC('month', acq_date)) AS n_months, COUNT(DISTINCT year) AS n_years,
             DATE_DIFF('day', MIN(acq_date), MAX(acq_date)) AS span_days FROM windowed GROUP BY source_id)
"""
CTES["f_gaps"] = """
SELECT source_id, COALESCE(MAX(gap), 0) AS max_gap_days, COALESCE(AVG(gap), 0) AS mean_gap_days
FROM (SELECT source_id, DATE_DIFF('day', LAG(acq_date) OVER (PARTITION BY source_id ORDER BY acq_date), acq_date) AS gap
      FROM (SELECT DISTINCT source_id, acq_date FROM windowed)) GROUP BY source_id
"""
CTES["f_season"] = """
SELECT source_id, SUM(-p * LN(p)) / LN(12) AS month_entropy, MAX(p) AS month_max_share
FROM (SELECT source_id, month, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY source_id) AS p FROM windowed GROUP BY source_id, month)
GROUP BY source_id
"""
CTES["f_timing"] = """
SELECT source_id, CASE WHEN r <= 1e-12 THEN 0 WHEN a < 0 THEN a + 2 * PI() ELSE a END * 12 / PI() AS lst_mean,
       SQRT(GREATEST(-2 * LN(GREATEST(r, 1e-12)), 0)) * 12 / PI() AS lst_std
FROM (SELECT source_id, ATAN2(AVG(SIN(lst * PI() / 12)), AVG(COS(lst * PI() / 12))) AS a,
             SQRT(POW(AVG(SIN(lst * PI() / 12)), 2) + POW(AVG(COS(lst * PI() / 12)), 2)) AS r FROM windowed GROUP BY source_id)
"""
CTES["f_cross"] = """
SELECT *, (n_snpp + 1) / (n_modis + 1) AS snpp_modis_ratio,
       CASE WHEN n_modis > 0 THEN 1 ELSE 0 END + CASE WHEN n_snpp > 0 THEN 1 ELSE 0 END AS n_sensors
FROM (SELECT source_id, COUNT(*) FILTER (sensor = 'MODIS') AS n_modis, COUNT(*) FILTER (sensor = 'VIIRS_SNPP') AS n_snpp
      FROM windowed GROUP BY source_id)
"""
CTES["f_confidence"] = """
SELECT source_id, AVG(CASE WHEN sensor = 'MODIS' THEN TRY_CAST(confidence AS DOUBLE) END) AS conf_modis_mean,
       AVG(CASE WHEN confidence = 'n' THEN 1 ELSE 0 END) AS conf_viirs_n_frac,
       AVG(CASE WHEN confidence = 'l' THEN 1 ELSE 0 END) AS conf_viirs_l_frac,
       AVG(CASE WHEN confidence = 'h' THEN 1 ELSE 0 END) AS conf_viirs_h_frac FROM windowed GROUP BY source_id
"""
CTES["f_spread"] = """
SELECT source_id, SQRT(POW(COALESCE(STDDEV_SAMP(latitude), 0) * 111320, 2)
       + POW(COALESCE(STDDEV_SAMP(longitude), 0) * 111320 * COS(RADIANS(AVG(latitude))), 2)) AS spread_m,
       COUNT(DISTINCT latitude || ',' || longitude) AS n_pixels FROM windowed GROUP BY source_id
"""
EXPOSURE = """n_det / 3.0 AS det_per_year, n_days / 3.0 AS active_days_per_year, n_months / 3.0 AS active_months_per_year,
       frp_sum / 3.0 AS frp_sum_per_year, n_modis / 3.0 AS modis_per_year, n_snpp / 3.0 AS snpp_per_year,
       span_days / 1095.0 AS span_window_frac"""
CTES["features"] = f"""
SELECT *, {EXPOSURE} FROM f_persistence JOIN f_intensity USING (source_id) JOIN f_flags USING (source_id) JOIN f_gaps USING (source_id)
JOIN f_season USING (source_id) JOIN f_timing USING (source_id) JOIN f_cross USING (source_id)
JOIN f_confidence USING (source_id) JOIN f_spread USING (source_id)
"""
CTES["window_sites"] = """
SELECT flare_id, country, lat, lon, location FROM sites_wide
WHERE GREATEST(COALESCE(y1996, 0), COALESCE(y1997, 0), COALESCE(y1998, 0)) > 0
"""
CTES["window_origins"] = """
SELECT country, ROUND(AVG(latitude), 6) AS lat0, ROUND(AVG(longitude), 6) AS lon0 FROM windowed GROUP BY country
"""
CTES["window_sources"] = """
SELECT c.*, RADIANS(lon - lon0) * 6371000.0 * COS(RADIANS(lat0)) AS x, RADIANS(lat - lat0) * 6371000.0 AS y
FROM (SELECT source_id, country, AVG(latitude) AS lat, AVG(longitude) AS lon FROM windowed GROUP BY ALL) c JOIN window_origins USING (country)
"""
CTES["window_nearest"] = """
SELECT source_id, MIN({'d': d, 'f': flare_id, 'l': location}) AS best FROM (
  SELECT s.source_id, SQRT((sx - x) * (sx - x) + (sy - y) * (sy - y)) AS d, c.flare_id, c.location
  FROM window_sources s JOIN (
    SELECT p.*, CAST(FLOOR(sx / 1000.0) AS BIGINT) + dx AS ix, CAST(FLOOR(sy / 1000.0) AS BIGINT) + dy AS iy
    FROM (SELECT w.*, RADIANS(lon - lon0) * 6371000.0 * COS(RADIANS(lat0)) AS sx, RADIANS(lat - lat0) * 6371000.0 AS sy
          FROM window_sites w JOIN window_origins USING (country)) p,
         (SELECT UNNEST([-1, 0, 1]) AS dx) a, (SELECT UNNEST([-1, 0, 1]) AS dy) b) c
  ON s.country = c.country AND CAST(FLOOR(x / 1000.0) AS BIGINT) = c.ix AND CAST(FLOOR(y / 1000.0) AS BIGINT) = c.iy)
GROUP BY source_id
"""
CTES["window_labels"] = """
SELECT w.source_id, b.block_id, w.country, w.lat, w.lon, CASE WHEN best.d <= 1000 THEN 1 ELSE 0 END AS is_eog_flare,
       CASE WHEN best.d <= 1000 THEN best.f END AS eog_flare_id, best.d AS eog_dist_m,
       COALESCE(best.l = 'OFFSHORE', FALSE) AS eog_offshore
FROM window_sources w LEFT JOIN sources b USING (source_id) LEFT JOIN window_nearest USING (source_id)
"""
CTES["labelled_features"] = "SELECT f.*, w.* EXCLUDE (source_id) FROM features f LEFT JOIN window_labels w USING (source_id)"


def located_window(spark, folder):
    """Located detections of the model sensors in the window; origins use every sensor."""
    det = detections(spark, folder)
    return ft.window_filter(grid.assign_detections(det, lookup(grid.origins(det))), WINDOW_YEARS)


def derived(spark, folder):
    return ft.derive_detection(located_window(spark, folder))


def labelled_window(spark, folder, features=None):
    """Window features (or a subset of them) with window labels."""
    det = detections(spark, folder)
    located = grid.assign_detections(det, lookup(grid.origins(det)))
    window = ft.window_filter(located, WINDOW_YEARS)
    rows = ft.source_features(window, WINDOW_YEARS) if features is None else features(window)
    return ft.attach_labels(rows, window, grid.build_sources(located), sites(spark, folder, WINDOW_YEARS))


def only_ids(window):
    return window.select("source_id").distinct()


@query("d1_window_filter", "SELECT sensor, year, COUNT(*) AS n FROM windowed GROUP BY ALL")
def d1(spark, folder):
    return located_window(spark, folder).groupBy("sensor", "year").agg(F.count(F.lit(1)).alias("n"))


DERIVED = "source_id, acq_date, month, pix_km2, frp_dens, dt_mir_lwir, sat, is_night, lst"


@query("d2_derive_detection", f"SELECT {DERIVED} FROM windowed", "pix_km2 frp_dens dt_mir_lwir lst")
def d2(spark, folder):
    return derived(spark, folder).select(*DERIVED.split(", "))


INTENSITY_COLUMNS = [f"{c}_{s}" for c in ft.INTENSITY for s in ("mean", "max", "std", "med")] + ["frp_p90", "frp_sum", "pix_km2_mean", "frp_cv"]


@query("d3_intensity", "SELECT * FROM f_intensity", " ".join(INTENSITY_COLUMNS))
def d3(spark, folder):
    return ft.intensity(derived(spark, folder))


@query("d4_saturation_night", "SELECT * FROM f_flags", "sat_frac night_frac")
def d4(spark, folder):
    return ft.saturation_night(derived(spark, folder))


@query("d5_persistence", "SELECT * FROM f_persistence", "duty_cycle det_per_day")
def d5(spark, folder):
    return ft.persistence(ft.active_days(located_window(spark, folder)))


@query("d6_gaps", "SELECT * FROM f_gaps", "mean_gap_days")
def d6(spark, folder):
    return ft.gaps(ft.active_days(located_window(spark, folder)))


@query("d7_seasonality", "SELECT * FROM f_season", "month_entropy month_max_share")
def d7(spark, folder):
    return ft.seasonality(ft.active_days(located_window(spark, folder)))


@query("d8_overpass_timing", "SELECT * FROM f_timing", "lst_mean lst_std", digits=5)
def d8(spark, folder):
    return ft.overpass_timing(derived(spark, folder))


@query("d9_cross_sensor", "SELECT * FROM f_cross", "snpp_modis_ratio")
def d9(spark, folder):
    return ft.cross_sensor(located_window(spark, folder))


@query("d10_confidence", "SELECT * FROM f_confidence", "conf_modis_mean conf_viirs_n_frac conf_viirs_l_frac conf_viirs_h_frac")
def d10(spark, folder):
    return ft.confidence(located_window(spark, folder))


@query("d11_spread", "SELECT * FROM f_spread", "spread_m", digits=5)
def d11(spark, folder):
    return ft.spread(located_window(spark, folder))


@query("d12_exposure_normalise", f"SELECT source_id, {EXPOSURE} FROM f_persistence JOIN f_cross USING (source_id) JOIN f_intensity USING (source_id)",
       "det_per_year active_days_per_year active_months_per_year frp_sum_per_year modis_per_year snpp_per_year span_window_frac")
def d12(spark, folder):
    window = located_window(spark, folder)
    power = window.groupBy("source_id").agg(F.sum("frp").alias("frp_sum"))
    rows = ft.persistence(ft.active_days(window)).join(ft.cross_sensor(window), "source_id").join(power, "source_id")
    return ft.exposure_normalise(rows, WINDOW_YEARS).select("source_id", *sorted(ft.NORMALISED))


FINAL = [
    *INTENSITY_COLUMNS, "sat_frac", "night_frac", "n_det", "n_days", "n_months", "n_years", "span_days", "duty_cycle",
    "det_per_day", "max_gap_days", "mean_gap_days", "month_entropy", "month_max_share", "lst_mean", "n_modis", "n_snpp",
    "snpp_modis_ratio", "n_sensors", "conf_modis_mean", "conf_viirs_n_frac", "conf_viirs_l_frac", "conf_viirs_h_frac",
    "spread_m", "n_pixels", *sorted(ft.NORMALISED),
]


@query(
    "d13_finalise",
    "SELECT source_id, " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in FINAL) + " FROM features",
    " ".join(FINAL),
    digits=3,
)
def d13(spark, folder):
    rows = ft.source_features(located_window(spark, folder), WINDOW_YEARS)
    return ft.finalise(rows).select("source_id", *FINAL)


@query("d14_attach_labels", "SELECT * FROM window_labels", "lat lon eog_dist_m", digits=4)
def d14(spark, folder):
    return labelled_window(spark, folder, only_ids)


@query("d14_attach_full_history_labels", "SELECT f.source_id, block_id, country, lat, lon, is_eog_flare, eog_flare_id, eog_dist_m, eog_offshore FROM f_flags f LEFT JOIN labelled USING (source_id)", "lat lon eog_dist_m", digits=4)
def d14_full(spark, folder):
    det = detections(spark, folder)
    origin = lookup(grid.origins(det))
    located = grid.assign_detections(det, origin)
    window = ft.window_filter(located, WINDOW_YEARS)
    sources = grid.label_sources(grid.build_sources(located), sites(spark, folder), origin)
    return ft.attach_labels(only_ids(window), window, sources)


@query(
    "d15_common_window_summary",
    "SELECT country, COUNT(*) AS n, SUM(is_eog_flare) AS n_pos, COUNT(DISTINCT eog_flare_id) AS eog_sites_recovered FROM window_labels GROUP BY country",
)
def d15(spark, folder):
    return ft.common_window_summary(labelled_window(spark, folder, only_ids))


def percentile_sql(columns, frame, nulls_last=False):
    """Average-rank percentiles by country as SQL window expressions."""
    parts = []
    for c in columns:
        top = f"RANK() OVER (PARTITION BY country ORDER BY {c} ASC NULLS LAST)"
        ties = f"COUNT(*) OVER (PARTITION BY country, {c})"
        count = "COUNT(*) OVER (PARTITION BY country)" if nulls_last else f"COUNT({c}) OVER (PARTITION BY country)"
        value = f"({top} + ({ties} - 1) / 2.0) / {count}"
        parts.append(f"{value if nulls_last else f'CASE WHEN {c} IS NOT NULL THEN {value} END'} AS {c}_country_pct")
    return f"SELECT *, {', '.join(parts)} FROM (SELECT * REPLACE ({', '.join(f'ROUND({c}, 9) AS {c}' for c in columns)}) FROM {frame})"


CTES["ranked_features"] = percentile_sql(ft.THERMAL_RANK, "labelled_features")


def rounded_for_ranks(rows, columns):
    """Nine decimals, so the last bit of a sum cannot split a tie."""
    return rows.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in columns})


def ranked_window(spark, folder):
    rows = rounded_for_ranks(labelled_window(spark, folder), ft.THERMAL_RANK)
    return ft.country_percentile(rows, ft.THERMAL_RANK)


PCT = [f"{c}_country_pct" for c in ft.THERMAL_RANK]


@query("d16_country_percentile", f"SELECT source_id, country, {', '.join(PCT)} FROM ranked_features", " ".join(PCT))
def d16(spark, folder):
    return ranked_window(spark, folder).select("source_id", "country", *PCT)


COMPACT = sorted([*ft.THERMAL_RAW, *PCT])


@query("d17_feature_schema", f"SELECT source_id, {', '.join(COMPACT)} FROM ranked_features", " ".join(COMPACT), digits=5)
def d17(spark, folder):
    """Source rows under the compact schema, validated against the frame."""
    rows = ranked_window(spark, folder)
    return rows.select("source_id", *ft.feature_schema(rows, "compact"))


@query(
    "d18_feature_groups",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{name}', {len(columns)}, (SELECT SUM({' + '.join(f'({c} IS NOT NULL)::INT' for c in columns)}) FROM features))"
        for name, columns in ft.group_sets(FINAL + ["lst_std"]).items()
    )
    + ") AS t(feature_set, n_features, known_cells)",
)
def d18(spark, folder):
    """Known cells of every cumulative and leave-one-out feature group."""
    rows = ft.source_features(located_window(spark, folder), WINDOW_YEARS)
    columns = ft.feature_columns(rows)
    known = rows.agg(*[F.count(c).alias(c) for c in columns])
    sets = ft.group_sets(columns)
    return known.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("feature_set"),
                        F.lit(len(cs)).alias("n_features"),
                        sum((F.col(c) for c in cs), F.lit(0)).alias("known_cells"),
                    )
                    for name, cs in sets.items()
                ]
            )
        ).alias("s")
    ).select("s.*")
