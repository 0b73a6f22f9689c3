"""Per-source features over a common observation window."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.functions.columns import METRES_PER_DEGREE, SATURATION_K, null_if_not_finite
from emberfield.operators.grid import label_sources, origins, project
from emberfield.operators.ordering import group_quantiles, percentile_columns
from emberfield.session import lookup, settle

# Sensors every country has, and the named feature lists.
MODEL_SENSORS = ("MODIS", "VIIRS_SNPP")
INTENSITY = ("frp", "frp_dens", "t_mir", "t_lwir", "dt_mir_lwir")
BLOCKED = {
    "lat", "lon", "x", "y", "country", "type", "eog_dist_m", "is_eog_flare", "eog_flare_id",
    "eog_offshore", "block_id", "source_id", "date_min", "date_max",
}
RAW_EXPOSURE = {
    "n_det", "n_days", "n_months", "n_years", "span_days", "frp_sum", "n_modis", "n_snpp", "n_pixels",
}
HARMFUL = {"month_entropy", "month_max_share"}
NORMALISED = {
    "det_per_year", "active_days_per_year", "active_months_per_year", "frp_sum_per_year",
    "modis_per_year", "snpp_per_year", "span_window_frac",
}
THERMAL_RAW = (
    "active_days_per_year", "active_months_per_year", "det_per_day", "det_per_year", "duty_cycle",
    "span_window_frac", "mean_gap_days", "max_gap_days", "modis_per_year", "snpp_per_year",
    "n_sensors", "snpp_modis_ratio", "night_frac", "sat_frac", "lst_mean", "lst_std", "frp_cv",
)
THERMAL_RANK = (
    "frp_mean", "frp_max", "frp_med", "frp_p90", "frp_std",
    "frp_dens_mean", "frp_dens_max", "frp_dens_med", "frp_dens_std",
    "t_mir_mean", "t_mir_max", "t_mir_med", "t_mir_std",
    "t_lwir_mean", "t_lwir_max", "t_lwir_med", "t_lwir_std",
    "dt_mir_lwir_mean", "dt_mir_lwir_max", "dt_mir_lwir_med", "dt_mir_lwir_std", "frp_sum_per_year",
)
IMAGE = (
    *(f"img_center_{band}_median" for band in ("blue", "green", "red", "nir", "swir16", "swir22")),
    *(f"img_center_{index}_{stat}" for index in ("ndvi", "ndbi", "mndwi") for stat in ("p10", "median", "p90")),
    *(f"img_full_{index}_median" for index in ("ndvi", "ndbi", "mndwi")),
    *(f"img_center_wc_{code}_fraction" for code in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)),
    "img_nearest_builtup_in_chip_m",
)
GROUPS = {
    "temporal": (
        "n_days", "n_months", "n_years", "span_days", "duty_cycle", "det_per_day", "max_gap_days",
        "mean_gap_days", "n_det",
    ),
    "intensity": ("frp_", "t_mir", "t_lwir", "dt_mir_lwir", "pix_km2", "sat_frac"),
    "seasonality": ("month_entropy", "month_max_share"),
    "timing": ("lst_", "night_frac"),
    "cross_inst": ("n_modis", "n_snpp", "snpp_modis_ratio", "n_sensors"),
    "confidence": ("conf_",),
    "spatial": ("spread_m", "n_pixels"),
}


def window_filter(det: DataFrame, years: Sequence[int] | None, sensors: Sequence[str] = MODEL_SENSORS) -> DataFrame:
    """Detections of the given sensors and years; an empty result is an error."""
    if years is not None and not list(years):
        raise ValueError("years cannot be empty")
    kept = det.where(F.col("sensor").isin(*sensors))
    if years is not None:
        kept = kept.where(F.col("year").isin(*sorted(set(years))))
    if kept.isEmpty():
        raise ValueError(f"no detections for sensors={sensors}, years={years}")
    return kept


def derive_detection(det: DataFrame) -> DataFrame:
    """Per-detection columns; every one a plain expression in the scan stage."""
    time, pixel = F.col("acq_time").cast("int"), F.col("scan") * F.col("track")
    hour = F.floor(time / 100) + (time % 100) / 60.0 + F.col("longitude") / 15.0
    return det.withColumns(
        {
            "month": F.month("acq_date"),
            "pix_km2": pixel,
            "frp_dens": F.when(pixel != 0, F.col("frp") / pixel),
            "dt_mir_lwir": F.col("t_mir") - F.col("t_lwir"),
            "sat": (F.col("t_mir") >= SATURATION_K).cast("int"),
            "is_night": (F.col("daynight") == "N").cast("int"),
            "lst": F.pmod(hour, F.lit(24.0)),
        }
    )


QUANTILES = {f"{c}_med": (c, 0.5) for c in INTENSITY} | {"frp_p90": ("frp", 0.9)}


def moment_aggregates() -> dict[str, Column]:
    out = {"frp_sum": F.sum("frp"), "pix_km2_mean": F.avg("pix_km2")}
    for c in INTENSITY:
        out[f"{c}_mean"] = F.avg(c)
        out[f"{c}_max"] = F.max(c)
        out[f"{c}_std"] = F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return out


def flag_aggregates() -> dict[str, Column]:
    return {"sat_frac": F.avg("sat"), "night_frac": F.avg("is_night")}


def timing_aggregates() -> dict[str, Column]:
    turn = F.lit(2) * F.pi() / 24
    return {"_sin": F.avg(F.sin(F.col("lst") * turn)), "_cos": F.avg(F.cos(F.col("lst") * turn))}


def sensor_aggregates() -> dict[str, Column]:
    return {
        "n_modis": F.count_if(F.col("sensor") == "MODIS"),
        "n_snpp": F.count_if(F.col("sensor") == "VIIRS_SNPP"),
    }


def confidence_aggregates() -> dict[str, Column]:
    """Numeric mean over MODIS rows; letter shares over all rows of the source."""
    number = F.when(F.col("sensor") == "MODIS", F.col("confidence").try_cast("double"))
    letters = {
        f"conf_viirs_{v}_frac": F.avg(F.when(F.col("confidence") == v, 1).otherwise(0)) for v in ("n", "l", "h")
    }
    return {"conf_modis_mean": F.avg(number)} | letters


def spread_aggregates() -> dict[str, Column]:
    lat = F.coalesce(F.stddev_samp("latitude"), F.lit(0.0)) * METRES_PER_DEGREE
    lon = F.coalesce(F.stddev_samp("longitude"), F.lit(0.0)) * METRES_PER_DEGREE * F.cos(F.radians(F.avg("latitude")))
    return {"spread_m": F.hypot(lat, lon)}


def timing_columns() -> dict[str, Column]:
    """Circular mean and deviation in hours; opposite hours that cancel out give mean 0."""
    turn = F.lit(2) * F.pi() / 24
    length = F.hypot("_sin", "_cos")
    return {
        "lst_mean": F.when(length > 1e-12, F.pmod(F.atan2("_sin", "_cos"), 2 * F.pi()) / turn).otherwise(F.lit(0.0)),
        "lst_std": F.sqrt(F.greatest(-2 * F.ln(F.greatest(length, F.lit(1e-12))), F.lit(0.0))) / turn,
    }


def sensor_columns() -> dict[str, Column]:
    return {
        "snpp_modis_ratio": (F.col("n_snpp") + 1) / (F.col("n_modis") + 1),
        "n_sensors": (F.col("n_modis") > 0).cast("int") + (F.col("n_snpp") > 0).cast("int"),
    }


def power_variation() -> dict[str, Column]:
    return {"frp_cv": F.col("frp_std") / F.nullif(F.col("frp_mean"), F.lit(0.0))}


def by_source(det: DataFrame, *aggregates: dict[str, Column]) -> DataFrame:
    """One map-side combined aggregation of any of the aggregate sets above."""
    return det.groupBy("source_id").agg(*[v.alias(n) for part in aggregates for n, v in part.items()])


def intensity(det: DataFrame) -> DataFrame:
    """Mean, max, std, median of five channels; power percentile, variation and sum.

    The moments count the rows of each source as well, so the quantiles need no pass of their own for that.
    """
    moments = settle(by_source(det, moment_aggregates(), {"_rows": F.count(F.lit(1))}).withColumns(power_variation()))
    medians = group_quantiles(det, ["source_id"], QUANTILES, sizes=moments.select("source_id", F.col("_rows").alias("count")))
    return moments.drop("_rows").join(medians, "source_id")


def saturation_night(det: DataFrame) -> DataFrame:
    return by_source(det, flag_aggregates())


def overpass_timing(det: DataFrame) -> DataFrame:
    return by_source(det, timing_aggregates()).withColumns(timing_columns()).drop("_sin", "_cos")


def cross_sensor(det: DataFrame) -> DataFrame:
    return by_source(det, sensor_aggregates()).withColumns(sensor_columns())


def confidence(det: DataFrame) -> DataFrame:
    return by_source(det, confidence_aggregates())


def distinct_pixels(det: DataFrame) -> DataFrame:
    pixels = det.groupBy("source_id", "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))
    return pixels.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_pixels"))


def spread(det: DataFrame) -> DataFrame:
    """Spatial standard deviation in metres and the number of distinct pixels."""
    return by_source(det, spread_aggregates()).join(distinct_pixels(det), "source_id")


def active_days(det: DataFrame) -> DataFrame:
    """Detections per (source, day): the base of persistence, gaps and seasonality.

    Pre-aggregating by day spreads a hot source and bounds it by the calendar.
    """
    return det.groupBy("source_id", F.col("acq_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def calendar_profile(days: DataFrame) -> DataFrame:
    """Persistence, gaps and month counts in one pass over a source's active days.

    The window holds at most one row per calendar day of the source, and the
    aggregation reuses its partitioning.
    """
    w = Window.partitionBy("source_id").orderBy("day")
    before = F.lag("day").over(w)
    walked = days.select(
        "source_id",
        "day",
        "n",
        F.datediff("day", before).alias("gap"),
        F.when(F.trunc("day", "month") == F.trunc(before, "month"), 0).otherwise(1).alias("new_month"),
        F.when(F.year("day") == F.year(before), 0).otherwise(1).alias("new_year"),
    )
    months = F.array(*[F.sum(F.when(F.month("day") == m, F.col("n")).otherwise(0)) for m in range(1, 13)])
    return walked.groupBy("source_id").agg(
        F.sum("n").alias("n_det"),
        F.count("day").alias("n_days"),
        F.sum("new_month").alias("n_months"),
        F.sum("new_year").alias("n_years"),
        F.datediff(F.max("day"), F.min("day")).alias("span_days"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_days"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap_days"),
        months.alias("_months"),
    )


def persistence_columns() -> dict[str, Column]:
    return {
        "duty_cycle": F.col("n_days") / F.nullif(F.col("span_days"), F.lit(0)),
        "det_per_day": F.col("n_det") / F.col("n_days"),
    }


def seasonality_columns() -> dict[str, Column]:
    """Entropy over calendar months scaled to 1, and the largest month share."""
    shares = F.transform("_months", lambda n: n / F.col("n_det"))
    entropy = F.aggregate(
        shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))
    )
    return {"month_entropy": entropy / F.ln(F.lit(12.0)), "month_max_share": F.array_max(shares)}


def persistence(days: DataFrame) -> DataFrame:
    """Distinct days, year-months and years; span, duty cycle and daily rate."""
    kept = ["source_id", "n_det", "n_days", "n_months", "n_years", "span_days"]
    return calendar_profile(days).select(*kept).withColumns(persistence_columns())


def gaps(days: DataFrame) -> DataFrame:
    """Longest and mean pause between consecutive active days, 0 for a single day."""
    return calendar_profile(days).select("source_id", "max_gap_days", "mean_gap_days")


def seasonality(days: DataFrame) -> DataFrame:
    profile = calendar_profile(days).select("source_id", "n_det", "_months")
    return profile.withColumns(seasonality_columns()).drop("n_det", "_months")


def exposure_normalise(features: DataFrame, years: Sequence[int]) -> DataFrame:
    """Per-year rates and the span as a share of the window."""
    n = float(len(set(years)))
    window = (date(max(years), 12, 31) - date(min(years), 1, 1)).days + 1
    rates = {
        "det_per_year": "n_det", "active_days_per_year": "n_days", "active_months_per_year": "n_months",
        "frp_sum_per_year": "frp_sum", "modis_per_year": "n_modis", "snpp_per_year": "n_snpp",
    }
    return features.withColumns(
        {k: F.col(v) / n for k, v in rates.items()} | {"span_window_frac": F.col("span_days") / max(window - 1.0, 1.0)}
    )


def finalise(features: DataFrame) -> DataFrame:
    """Infinities and NaN become NULL; numbers become single precision."""
    return features.select(
        *[
            F.col(n) if t == "string" else null_if_not_finite(F.col(n)).cast("float").alias(n)
            for n, t in features.dtypes
        ]
    )


def source_features(det: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """All features of detections that already carry a source_id.

    Everything decomposable is one aggregation by source, everything calendar-like
    one pass over active days; only medians and distinct pixels shuffle apart.
    """
    derived = derive_detection(det)
    calendar = settle(calendar_profile(active_days(derived)).withColumns(persistence_columns() | seasonality_columns()))
    sizes = calendar.select("source_id", F.col("n_det").alias("count"))
    summed = by_source(
        derived, moment_aggregates(), flag_aggregates(), timing_aggregates(), sensor_aggregates(),
        confidence_aggregates(), spread_aggregates(),
    ).withColumns(power_variation() | timing_columns() | sensor_columns())
    out = (
        calendar.drop("_months")
        .join(summed.drop("_sin", "_cos"), "source_id")
        .join(group_quantiles(derived, ["source_id"], QUANTILES, sizes=sizes), "source_id")
        .join(distinct_pixels(derived), "source_id")
    )
    return exposure_normalise(out, years) if years is not None else out


def attach_labels(
    features: DataFrame,
    det: DataFrame,
    sources: DataFrame,
    window_sites: DataFrame | None = None,
) -> DataFrame:
    """Join labels: full-history ones, or relabel centroids inside the window.

    With ``window_sites`` the centroid, origin and nearest site come from the
    windowed detections, while the spatial block stays the original one.
    """
    columns = ["source_id", "block_id", "country", "lat", "lon", "is_eog_flare", "eog_flare_id", "eog_dist_m", "eog_offshore"]
    if window_sites is None:
        return features.join(sources.select(*columns), "source_id", "left")
    origin = lookup(origins(det))
    centre = det.groupBy("source_id", "country").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    placed = project(centre, origin, "lat", "lon").join(sources.select("source_id", "block_id"), "source_id", "left")
    relabelled = label_sources(placed, window_sites, origin)
    return features.join(relabelled.select(*columns), "source_id", "left")


def common_window_summary(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("country").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("is_eog_flare").alias("n_pos"),
        F.count_distinct(F.when(F.col("is_eog_flare") == 1, F.col("eog_flare_id"))).alias("eog_sites_recovered"),
    )


def country_percentile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average rank over the non-NULL count inside each country, ties shared."""
    return percentile_columns(df, "country", columns, "source_id")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in BLOCKED]


def robust_columns(df: DataFrame) -> list[str]:
    columns = sorted(set(feature_columns(df)) - RAW_EXPOSURE - HARMFUL)
    missing = NORMALISED - set(columns)
    if missing:
        raise ValueError(f"window-normalised features are missing: {sorted(missing)}")
    return columns


def feature_schema(df: DataFrame, name: str) -> list[str]:
    """Ordered columns of a named schema, checked against the frame and the block list."""
    percent = {f"{c}_country_pct" for c in THERMAL_RANK}
    base = [c for c in robust_columns(df) if not c.endswith("_country_pct")]
    if name in ("raw", "robust"):
        columns = base
    elif name == "ranked":
        columns = sorted((set(base) - set(THERMAL_RANK) - {"pix_km2_mean", "spread_m"}) | percent)
    elif name == "compact":
        columns = sorted((set(base) & set(THERMAL_RAW)) | percent)
    elif name in ("thermal", "early"):
        columns = [*THERMAL_RAW, *(f"{c}_country_pct" for c in THERMAL_RANK), *(IMAGE if name == "early" else ())]
    elif name == "image":
        columns = list(IMAGE)
    else:
        raise ValueError(f"unknown schema {name}")
    absent = set(columns) - set(df.columns)
    if absent:
        raise ValueError(f"columns missing for {name}: {sorted(absent)}")
    if set(columns) & BLOCKED or len(columns) != len(set(columns)):
        raise ValueError(f"invalid {name} schema")
    return columns


def columns_of_groups(columns: Sequence[str], groups: Sequence[str]) -> list[str]:
    return sorted({c for c in columns for g in groups if c.startswith(GROUPS[g])})


def group_sets(columns: Sequence[str]) -> dict[str, list[str]]:
    """Full, cumulative and leave-one-group-out column sets."""
    names = list(GROUPS)
    sets = {"full": list(columns)}
    for i in range(1, len(names) + 1):
        sets["+".join(names[:i])] = columns_of_groups(columns, names[:i])
    for left in names:
        sets[f"without {left}"] = columns_of_groups(columns, [g for g in names if g != left])
    return sets
