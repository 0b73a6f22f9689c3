"""Ingest, typing and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators import audit
from emberfield.plans.registry import CTES, query
from emberfield.session import scratch_folder, settle
from emberfield.sources import ingest
from emberfield.sources.bindings import detections, faulty_detections

FOLDER_SQL = "CASE sensor WHEN 'MODIS' THEN 'modis' WHEN 'VIIRS_SNPP' THEN 'viirs_snpp' ELSE 'viirs_noaa20' END"


def scratch(spark) -> str:
    """New folder in the shared checkpoint space for a table written by a query."""
    return f"{scratch_folder(spark, 'table')}/data"


def raw_files(spark, folder, bands):
    """Detections in a raw family's columns, with instrument folder and file name."""
    mir, lwir = bands
    family = F.col("sensor") == "MODIS" if bands == ingest.MODIS_BANDS else F.col("sensor") != "MODIS"
    raw = detections(spark, folder).where(family).withColumnsRenamed({"t_mir": mir, "t_lwir": lwir})
    names = ingest.raw_schema(bands).fieldNames()
    return raw.select(
        *[
            (F.lpad(F.col(c).cast("string"), 4, "0") if c == "acq_time" else F.col(c)).cast(f.dataType).alias(c)
            for c, f in ((n, ingest.raw_schema(bands)[n]) for n in names)
            if c != "instrument"
        ],
        F.col("sensor").alias("instrument"),
        F.expr(FOLDER_SQL).alias("folder"),
        F.concat_ws("_", F.lower(F.regexp_replace("sensor", "_", "-")), "year", "country").alias("stem"),
    ).select(*names, "folder", F.concat("stem", F.lit(".csv")).alias("file"))


def name_files(spark, place):
    """Turn folders file=<name> with part files into files of that name (a part number goes in front of it)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in system.listStatus(path(place)):
        name = folder.getPath().getName()
        if not folder.isDirectory() or not name.startswith("file="):
            continue
        parts = [p.getPath() for p in system.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-")]
        for i, part in enumerate(parts):
            system.rename(part, path(f"{place}/{i}-{name.removeprefix('file=')}"))
        system.delete(folder.getPath(), True)


TYPED = """
SELECT sensor, country, CAST(year AS INT) AS year, COUNT(*) AS n, SUM(acq_time) AS acq_time,
       ROUND(SUM(CAST(CAST(t_mir AS FLOAT) AS DOUBLE)), 2) AS t_mir, MIN(acq_date) AS first_day, SUM(type) AS type
FROM detections GROUP BY ALL"""


def typed_summary(df):
    return df.groupBy("sensor", "country", F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("acq_time").alias("acq_time"),
        F.round(F.sum(F.col("t_mir").cast("double")), 2).alias("t_mir"),
        F.min("acq_date").alias("first_day"),
        F.sum("type").alias("type"),
    )


def written_files(spark, folder):
    """Raw CSVs in the instrument layout, one name for each prefix, year and country; returns their folder."""
    root = scratch(spark)
    for bands in (ingest.MODIS_BANDS, ingest.VIIRS_BANDS):
        raw = raw_files(spark, folder, bands)
        for name in ["modis"] if bands == ingest.MODIS_BANDS else ["viirs_snpp", "viirs_noaa20"]:
            (
                raw.where(F.col("folder") == name).drop("folder")
                .hint("rebalance", F.col("file"))
                .write.partitionBy("file").option("header", True).csv(f"{root}/{name}")
            )
            name_files(spark, f"{root}/{name}")
    return root


@query("a1_read_detections", TYPED, "t_mir")
def a1(spark, folder):
    """Write raw CSVs, then read them through the typed reader."""
    return typed_summary(ingest.read_detections(spark, written_files(spark, folder)))


@query("a2_unify_sensor_schemas", "SELECT sensor, COUNT(*) AS n, AVG(t_mir) AS t_mir, AVG(t_lwir) AS t_lwir FROM detections GROUP BY sensor", "t_mir t_lwir", digits=3)
def a2(spark, folder):
    families = [ingest.unify_bands(raw_files(spark, folder, b)) for b in (ingest.MODIS_BANDS, ingest.VIIRS_BANDS)]
    return families[0].unionByName(families[1]).groupBy(F.col("instrument").alias("sensor")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("t_mir").cast("double")).alias("t_mir"), F.avg(F.col("t_lwir").cast("double")).alias("t_lwir")
    )


@query("a3_normalise_types", TYPED, "t_mir")
def a3(spark, folder):
    det = detections(spark, folder)
    text = det.select(*[F.col(c).cast("string").alias(c) for c in det.columns])
    return typed_summary(ingest.normalise_types(text))


@query(
    "a4_prune",
    "SELECT country, sensor, year, COUNT(*) AS n, AVG(frp) AS frp FROM detections WHERE country IN ('C1', 'C2') AND sensor <> 'VIIRS_N20' GROUP BY ALL",
    "frp",
)
def a4(spark, folder):
    target = scratch(spark)
    ingest.write_detections(detections(spark, folder), target)
    kept = ingest.load_detections(spark, target, ["C1", "C2"], ["MODIS", "VIIRS_SNPP"], ["country", "sensor", "year", "frp"])
    return kept.groupBy("country", "sensor", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("frp").alias("frp"))


@query("a5_write_detections", "SELECT country, sensor, year, COUNT(*) AS n, SUM(acq_time) AS acq_time FROM detections GROUP BY ALL")
def a5(spark, folder):
    target = scratch(spark)
    ingest.write_detections(ingest.normalise_types(detections(spark, folder)), target)
    back = spark.read.parquet(target)
    return back.groupBy("country", "sensor", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("acq_time").alias("acq_time"))


@query(
    "b1_profile_files",
    """
SELECT country, sensor, year, COUNT(*) AS rows, MIN(acq_date) AS date_min, MAX(acq_date) AS date_max,
       COUNT(*) FILTER (acq_date IS NULL) AS bad_date, 0 AS n_null, COUNT(*) FILTER (frp <= 0) AS frp_nonpos,
       MIN(latitude) AS lat_min, MAX(latitude) AS lat_max, MIN(longitude) AS lon_min, MAX(longitude) AS lon_max,
       MAX(frp) AS frp_max, MAX(t_mir) AS tmir_max, COUNT(*) FILTER (t_mir >= 367) AS tmir_sat,
       ROUND(100.0 * AVG(CASE WHEN daynight = 'N' THEN 1 ELSE 0 END), 2) AS "dn_N_pct",
       COUNT(DISTINCT acq_date) AS n_days, MEDIAN(frp) AS frp_med, MEDIAN(t_mir) AS tmir_med
FROM detections GROUP BY country, sensor, year""",
    'lat_min lat_max lon_min lon_max frp_max tmir_max dn_N_pct frp_med tmir_med',
)
def b1(spark, folder):
    return audit.profile_files(detections(spark, folder))


@query(
    "b2_exact_duplicates",
    """
SELECT country, sensor, year, SUM(n - 1) AS dup_rows
FROM (SELECT *, COUNT(*) AS n FROM (SELECT * REPLACE (0 AS acq_time, 0 AS frp) FROM detections) GROUP BY ALL)
GROUP BY country, sensor, year""",
)
def b2(spark, folder):
    """Duplicates after blanking time and power, which makes line items repeat."""
    blank = {"acq_time": F.lit(0), "frp": F.lit(0)}
    return audit.exact_duplicates(detections(spark, folder).withColumns(blank))


@query(
    "b3_unique_coordinates",
    """
SELECT sensor, SUM(n) AS rows, COUNT(*) AS uniq_coord, ROUND(SUM(n) / COUNT(*), 2) AS reuse
FROM (SELECT country, sensor, year, latitude, longitude, COUNT(*) AS n FROM detections GROUP BY ALL) GROUP BY sensor""",
    "reuse",
)
def b3(spark, folder):
    return audit.unique_coordinates(detections(spark, folder))


@query(
    "b4_value_histogram",
    """
SELECT country, sensor, year, STRING_AGG(confidence || ':' || n, '|' ORDER BY confidence || ':' || n) AS conf_vals,
       ANY_VALUE(sats) AS sats, ANY_VALUE(vers) AS vers
FROM (SELECT country, sensor, year, confidence, COUNT(*) AS n FROM detections GROUP BY ALL)
JOIN (SELECT country, sensor, year, STRING_AGG(DISTINCT satellite, '|' ORDER BY satellite) AS sats,
             STRING_AGG(DISTINCT version, '|' ORDER BY version) AS vers FROM detections GROUP BY ALL)
USING (country, sensor, year) GROUP BY country, sensor, year""",
)
def b4(spark, folder):
    return audit.value_histogram(detections(spark, folder))


@query(
    "b5_type_histogram",
    "SELECT country, sensor, year, COUNT(*) FILTER (type = 0) AS type0, COUNT(*) FILTER (type = 2) AS type2 FROM detections GROUP BY ALL",
)
def b5(spark, folder):
    return audit.type_histogram(detections(spark, folder))


@query(
    "b6_coverage_matrix",
    """
SELECT COALESCE(country, 'All') AS country, SUM(n) FILTER (s = 'MODIS') AS "MODIS", SUM(n) FILTER (s = 'VIIRS_SNPP') AS "VIIRS_SNPP",
       SUM(n) FILTER (s = 'VIIRS_N20') AS "VIIRS_N20", SUM(n) FILTER (s = 'All') AS "All"
FROM (SELECT country, COALESCE(sensor, 'All') AS s, COUNT(*) AS n FROM detections GROUP BY CUBE (country, sensor)) GROUP BY country""",
)
def b6(spark, folder):
    return audit.coverage_wide(detections(spark, folder), tuple(ingest.SENSOR_OF_FOLDER.values()))


@query(
    "b7_coverage_span",
    """
SELECT country, MIN(year) || '-' || MAX(year) || ' (' || COUNT(DISTINCT year) || 'y)' AS years,
       STRING_AGG(DISTINCT sensor, '|' ORDER BY sensor) AS sensors FROM detections GROUP BY country""",
)
def b7(spark, folder):
    return audit.coverage_span(detections(spark, folder))


@query(
    "b8_quality_totals",
    """
SELECT SUM(n) AS rows, COUNT(*) FILTER (acq_date IS NULL) AS bad_date, 0 AS n_null, COUNT(*) FILTER (frp <= 0) AS frp_nonpos,
       SUM(n - 1) AS dup_rows, ROUND(100.0 * SUM(n - 1) / SUM(n), 3) AS dup_pct
FROM (SELECT *, COUNT(*) AS n FROM detections GROUP BY ALL)""",
    "dup_pct",
)
def b8(spark, folder):
    return audit.quality_totals(detections(spark, folder))


@query(
    "b9_share_of_row",
    """
SELECT 'country' AS axis, country AS member, type, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY country), 2) AS pct
FROM detections GROUP BY country, type
UNION ALL
SELECT 'sensor', sensor, type, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY sensor), 2) FROM detections GROUP BY sensor, type""",
    "pct",
)
def b9(spark, folder):
    det = detections(spark, folder)
    parts = [
        audit.share_of_row(det, by).select(F.lit(by).alias("axis"), F.col(by).alias("member"), "type", "pct")
        for by in ("country", "sensor")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "b10_vocabulary_kind",
    """
SELECT sensor, CASE WHEN COUNT(*) > 12 THEN 'NUMERIC' ELSE 'CATEGORICAL' END AS kind, COUNT(*) AS distinct_values,
       SUM(n) AS n,
       COALESCE(STRING_AGG(CASE WHEN v <= 12 THEN confidence || ':' || FORMAT('{:.1f}', 100.0 * n / total) END, '|' ORDER BY confidence), '') AS shares
FROM (SELECT sensor, confidence, COUNT(*) AS n, COUNT(*) OVER (PARTITION BY sensor) AS v,
             SUM(COUNT(*)) OVER (PARTITION BY sensor) AS total FROM detections GROUP BY sensor, confidence)
GROUP BY sensor""",
)
def b10(spark, folder):
    return audit.vocabulary_kind(detections(spark, folder))


CTES["file_profile"] = """
SELECT country, sensor, year, COUNT(*) AS rows, 100.0 * AVG(CASE WHEN t_mir >= 367 THEN 1 ELSE 0 END) AS sat_pct,
       ROUND(100.0 * AVG(CASE WHEN daynight = 'N' THEN 1 ELSE 0 END), 2) AS night_pct, MEDIAN(frp) AS frp_med
FROM detections GROUP BY country, sensor, year
"""


@query(
    "b11_weighted_mean",
    """
SELECT 'saturation' AS measure, sensor AS member, ROUND(SUM(sat_pct * rows) / SUM(rows), 2) AS value FROM file_profile GROUP BY sensor
UNION ALL SELECT 'night', country, ROUND(SUM(night_pct * rows) / SUM(rows), 1) FROM file_profile GROUP BY country
UNION ALL SELECT 'median_frp', sensor, ROUND(SUM(frp_med * rows) / SUM(rows), 2) FROM file_profile GROUP BY sensor""",
    "value",
)
def b11(spark, folder):
    files = audit.profile_files(detections(spark, folder)).select(
        *audit.FILE,
        "rows",
        (100 * F.col("tmir_sat") / F.col("rows")).alias("saturation"),
        F.col("dn_N_pct").alias("night"),
        F.col("frp_med").alias("median_frp"),
    )
    files = settle(files)  # one row a file, read by three means
    parts = [
        audit.weighted_mean(files, by, name, digits).select(F.lit(name).alias("measure"), F.col(by).alias("member"), F.col(name).alias("value"))
        for by, name, digits in (("sensor", "saturation", 2), ("country", "night", 1), ("sensor", "median_frp", 2))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "b12_schema_census",
    """
SELECT CASE WHEN sensor = 'MODIS'
  THEN 'latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_t31,frp,daynight,type'
  ELSE 'latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight,type'
  END AS column_list, COUNT(DISTINCT sensor || country || year) AS files FROM detections GROUP BY 1""",
)
def b12(spark, folder):
    parts = [
        raw_files(spark, folder, bands).select("folder", "file").distinct()
        .withColumn("columns", F.array(*[F.lit(c) for c in ingest.raw_schema(bands).fieldNames()]))
        for bands in (ingest.MODIS_BANDS, ingest.VIIRS_BANDS)
    ]
    return audit.schema_census(parts[0].unionByName(parts[1]))


UNKNOWN = " + ".join(f"CAST({c} IS NULL AS INT)" for c in ("t_mir", "frp", "acq_date", "daynight", "confidence"))


@query(
    "b1_faulty_files",
    f"""
SELECT country, sensor, year, COUNT(*) AS rows, MIN(acq_date) AS date_min, MAX(acq_date) AS date_max,
       COUNT(*) FILTER (acq_date IS NULL) AS bad_date, SUM({UNKNOWN}) AS n_null, COUNT(*) FILTER (frp <= 0) AS frp_nonpos,
       MIN(latitude) AS lat_min, MAX(latitude) AS lat_max, MIN(longitude) AS lon_min, MAX(longitude) AS lon_max,
       MAX(frp) AS frp_max, MAX(t_mir) AS tmir_max, COUNT(*) FILTER (t_mir >= 367) AS tmir_sat,
       ROUND(100.0 * AVG(CASE WHEN daynight = 'N' THEN 1 WHEN daynight IS NOT NULL THEN 0 END), 2) AS "dn_N_pct",
       COUNT(DISTINCT acq_date) AS n_days, MEDIAN(frp) AS frp_med, MEDIAN(t_mir) AS tmir_med
FROM faulty_detections GROUP BY country, sensor, year""",
    'lat_min lat_max lon_min lon_max frp_max tmir_max dn_N_pct frp_med tmir_med',
)
def b1_faulty(spark, folder):
    return audit.profile_files(faulty_detections(spark, folder))


@query(
    "b2_faulty_duplicates",
    "SELECT country, sensor, year, SUM(n - 1) AS dup_rows FROM (SELECT *, COUNT(*) AS n FROM faulty_detections GROUP BY ALL) GROUP BY country, sensor, year",
)
def b2_faulty(spark, folder):
    """Whole rows that repeat, rows with unknown values included."""
    return audit.exact_duplicates(faulty_detections(spark, folder))


@query(
    "b8_faulty_totals",
    f"""
SELECT COUNT(*) AS rows, COUNT(*) FILTER (acq_date IS NULL) AS bad_date, SUM({UNKNOWN}) AS n_null, COUNT(*) FILTER (frp <= 0) AS frp_nonpos,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM faulty_detections)) AS dup_rows,
       ROUND(100.0 * (COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM faulty_detections))) / COUNT(*), 3) AS dup_pct
FROM faulty_detections""",
    "dup_pct",
)
def b8_faulty(spark, folder):
    return audit.quality_totals(faulty_detections(spark, folder))
