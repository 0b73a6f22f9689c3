"""Views of the driver tables in the shapes the operators work on.

The SQL text is shared by Spark and the oracle, so both engines read equal rows.
Fractions carry an exponent: plain ones would be exact decimals, slow in Spark.
Reflectances carry a tiny shift so that their rounding meets no exact half.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_YEARS = (1996, 1997, 1998)
ACTIVE_YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)
HOLDOUT = "C5"
SEEDS = (272, 273, 274)
CHIP = 20
"""Side of a pixel chip built from line items (the reference chips are 200 wide)."""
LAND_COVER = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)

DETECTIONS = """
SELECT CAST(10 + (l_partkey % 40) * 0.05e0 + (l_suppkey % 3) * 0.001e0 AS DOUBLE) AS latitude,
       CAST(40 + (l_partkey % 37) * 0.05e0 + (l_linenumber % 3) * 0.001e0 AS DOUBLE) AS longitude,
       300 + l_quantity * 2 AS t_mir, 290 + l_discount * 100 AS t_lwir,
       l_extendedprice / 1000 AS frp, 1 + l_tax AS scan, 1 + l_discount AS track,
       CAST(l_shipdate AS DATE) AS acq_date,
       CAST((l_orderkey * 37 % 24) * 100 + (l_linenumber * 7 % 60) AS INT) AS acq_time,
       CASE WHEN l_orderkey % 3 = 0 THEN 'N' ELSE 'D' END AS daynight,
       CASE l_linenumber % 3 WHEN 0 THEN 'MODIS' WHEN 1 THEN 'VIIRS_SNPP' ELSE 'VIIRS_N20' END AS sensor,
       CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_quantity * 2 AS INT) AS VARCHAR(3))
            WHEN l_orderkey % 3 = 0 THEN 'l' WHEN l_orderkey % 3 = 1 THEN 'n' ELSE 'h' END AS confidence,
       CASE l_linestatus WHEN 'O' THEN 0 ELSE 2 END AS type,
       CONCAT('sat_', l_returnflag) AS satellite,
       CASE WHEN l_linenumber % 3 = 0 THEN '61.03' ELSE '2.0' END AS version,
       CONCAT('C', CAST(l_partkey % 6 AS VARCHAR(2))) AS country,
       CAST(YEAR(l_shipdate) AS INT) AS year
FROM lineitem
"""

FAULTS = """
WITH faulty AS (
SELECT latitude, longitude, CASE WHEN acq_time BETWEEN 300 AND 399 THEN NULL ELSE t_mir END AS t_mir, t_lwir,
       CASE WHEN acq_time BETWEEN 500 AND 599 THEN -frp WHEN acq_time BETWEEN 700 AND 799 THEN NULL ELSE frp END AS frp,
       scan, track, CASE WHEN acq_time BETWEEN 900 AND 999 THEN NULL ELSE acq_date END AS acq_date, acq_time,
       CASE WHEN acq_time BETWEEN 1300 AND 1359 THEN NULL ELSE daynight END AS daynight, sensor,
       CASE WHEN acq_time BETWEEN 1100 AND 1199 THEN NULL ELSE confidence END AS confidence,
       type, satellite, version, country, year
FROM detections)
SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE acq_time < 200 OR acq_time BETWEEN 900 AND 929
"""
"""All detections with unknown values, dates that do not parse and powers below zero by the hour, some rows twice."""

SITES = """
SELECT CONCAT('s_', CAST(p_partkey AS VARCHAR(20))) AS flare_id,
       CONCAT('C', CAST(p_partkey % 6 AS VARCHAR(2))) AS country,
       CAST(10 + (p_partkey % 40) * 0.05e0 + 0.004e0 + (p_size % 5) * 0.006e0 AS DOUBLE) AS lat,
       CAST(40 + (p_partkey % 37) * 0.05e0 + 0.002e0 AS DOUBLE) AS lon,
       CASE WHEN p_size % 4 = 0 THEN 'OFFSHORE' ELSE 'ONSHORE' END AS location,
       CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS y1996,
       CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS y1997,
       CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0 END AS y1998,
       CASE WHEN p_size % 10 = 5 THEN CAST(p_size AS DOUBLE) END AS y1999
FROM part
"""

PREDICTIONS = """
SELECT CAST(d.doc_id AS VARCHAR(20)) AS source_id, d.lang AS country,
       CONCAT(d.lang, '_', d.source) AS block_id,
       COALESCE(l.quality, 0) AS is_eog_flare,
       CASE WHEN l.quality = 1 THEN CONCAT('s_', CAST(d.doc_id % 200 AS VARCHAR(20))) END AS eog_flare_id,
       ROUND((d.doc_id * 7919 % 100 + 60 * COALESCE(l.quality, 0) + 1) / CAST(162 AS DOUBLE), 3) AS score_compact_tabular,
       ROUND((d.doc_id * 104729 % 100 + 80 * COALESCE(l.quality, 0) + 1) / CAST(182 AS DOUBLE), 3) AS score_visual
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

SEED_COLUMNS = """seed, source_id, country, block_id, is_eog_flare, eog_flare_id,
       ROUND(score_compact_tabular - (seed - 271) * 0.001e0 * (LENGTH(source_id) % 2), 3) AS score_compact_tabular,
       ROUND(score_visual - (seed - 271) * 0.001e0 * (LENGTH(source_id) % 3), 3) AS score_visual,
       ROUND((score_compact_tabular + score_visual) / 2 + 0.03e0 * is_eog_flare
             - (seed - 271) * 0.001e0 + 0.0002e0, 3) AS score_guarded_cv_tabular"""

OUTER = """
SELECT country AS held_out, *, ROUND((score_compact_tabular + score_visual) / 2, 4) AS score_all77_tabular FROM predictions
"""

INNER = """
SELECT o.held_out, source_id, country, block_id, is_eog_flare, eog_flare_id,
       ROUND(score_compact_tabular * (1 - 0.02e0 * (ASCII(o.held_out) % 4) * (LENGTH(source_id) % 2)), 3) AS score_compact_tabular,
       ROUND(score_visual * (1 - 0.2e0 * (ASCII(o.held_out) % 3) * (LENGTH(source_id) % 3)), 3) AS score_visual,
       ROUND((score_compact_tabular + score_visual) / 2 - 0.03e0 * (ASCII(o.held_out) % 2) * (LENGTH(source_id) % 2), 4) AS score_all77_tabular
FROM predictions p JOIN (SELECT DISTINCT country AS held_out FROM predictions) o ON p.country <> o.held_out
"""

PIXELS = """
SELECT chip_id, row, col,
       ROUND(AVG(price) / 100000 + 2.7e-9, 8) AS blue, ROUND(AVG(price) / 90000 + 0.01e0 + 2.7e-9, 8) AS green,
       ROUND(AVG(quantity) / 60 + 2.7e-9, 8) AS red, ROUND(AVG(tax) * 8 + 2.7e-9, 8) AS nir,
       ROUND(AVG(discount) * 8 + 2.7e-9, 8) AS swir16, ROUND(AVG(quantity * tax) / 4 - 0.06e0 + 2.7e-9, 8) AS swir22,
       CASE WHEN MAX(line) % 7 = 0 THEN 3 WHEN MAX(line) % 3 = 0 THEN 5 ELSE 4 END AS scl,
       CASE WHEN SUM(line) % 13 = 0 THEN 0 WHEN SUM(line) % 4 = 0 THEN 50
            WHEN SUM(line) % 4 = 1 THEN 10 WHEN SUM(line) % 4 = 2 THEN 40 ELSE 80 END AS landcover
FROM (SELECT l_suppkey AS chip_id, CAST(l_orderkey % 20 AS INT) AS row,
             CAST(FLOOR(l_orderkey / 20) % 20 AS INT) AS col,
             l_extendedprice AS price, l_quantity AS quantity, l_tax AS tax, l_discount AS discount,
             CAST(l_linenumber AS BIGINT) AS line
      FROM lineitem) cells
GROUP BY chip_id, row, col
"""

ATTEMPTS = """
SELECT user_id AS item_id, event_id AS attempt_id, ts AS attempted_at,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ok' END AS status,
       CONCAT('chip_', CAST(user_id AS VARCHAR(20))) AS chip_id
FROM events WHERE event_type IN ('error', 'purchase')
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _bind(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run binding SQL over frames without leaving views behind."""
    for name in frames:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **frames)


def detections(spark: SparkSession, folder: str) -> DataFrame:
    return _bind(spark, DETECTIONS, lineitem=table(spark, folder, "lineitem"))


def faulty_detections(spark: SparkSession, folder: str) -> DataFrame:
    return _bind(spark, FAULTS, detections=detections(spark, folder))


def sites_wide(spark: SparkSession, folder: str) -> DataFrame:
    return _bind(spark, SITES, part=table(spark, folder, "part"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _bind(
        spark, PREDICTIONS, documents=table(spark, folder, "documents"), labels=table(spark, folder, "labels")
    )


def seed_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every prediction under three seeds with slightly shifted scores."""
    seeds = F.explode(F.array(*[F.lit(s) for s in SEEDS]))
    seeded = predictions(spark, folder).withColumn("seed", seeds)
    return spark.sql(f"SELECT {SEED_COLUMNS} FROM {{seeded}}", seeded=seeded)


def outer_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of every country as its held-out rows."""
    return _bind(spark, OUTER, predictions=predictions(spark, folder))


def inner_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of all other countries for every held-out one, with scores that differ between them."""
    return _bind(spark, INNER, predictions=predictions(spark, folder))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    return _bind(spark, PIXELS, lineitem=table(spark, folder, "lineitem"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return _bind(spark, ATTEMPTS, events=table(spark, folder, "events"))
