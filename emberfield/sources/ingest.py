"""Detection files in and out: declared schemas, typing, partitioned parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Instrument folders, their sensors and the raw column order.
SENSOR_OF_FOLDER = {"modis": "MODIS", "viirs_snpp": "VIIRS_SNPP", "viirs_noaa20": "VIIRS_N20"}
FILE_PATTERN = r"^[a-z0-9-]+_\d{4}_[A-Za-z0-9]+\.csv$"
MODIS_BANDS = ("brightness", "bright_t31")
VIIRS_BANDS = ("bright_ti4", "bright_ti5")

DETECTION_SCHEMA = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("t_mir", T.FloatType()),
        T.StructField("t_lwir", T.FloatType()),
        T.StructField("frp", T.FloatType()),
        T.StructField("scan", T.FloatType()),
        T.StructField("track", T.FloatType()),
        T.StructField("acq_date", T.DateType()),
        T.StructField("acq_time", T.ShortType()),
        T.StructField("satellite", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("daynight", T.StringType()),
        T.StructField("type", T.ByteType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("year", T.ShortType()),
    ]
)
PARTITIONS = ("country", "sensor", "year")


def raw_schema(bands: tuple[str, str]) -> T.StructType:
    """Raw CSV layout; the acquisition time stays text so '0136' keeps its zero."""
    mir, lwir = bands
    types = {"latitude": "double", "longitude": "double", mir: "float", "scan": "float", "track": "float"}
    types |= {c: "string" for c in ("acq_date", "acq_time", "satellite", "instrument", "confidence", "version")}
    types |= {lwir: "float", "frp": "float", "daynight": "string", "type": "float"}
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in types.items()])


def unify_bands(raw: DataFrame) -> DataFrame:
    """Rename either family's channels to t_mir and t_lwir."""
    mir, lwir = MODIS_BANDS if MODIS_BANDS[1] in raw.columns else VIIRS_BANDS
    return raw.withColumnsRenamed({mir: "t_mir", lwir: "t_lwir"})


def normalise_types(df: DataFrame) -> DataFrame:
    """Pad the time, parse dates (invalid becomes NULL), NaN to NULL, narrow casts."""
    prepared = df.withColumns(
        {
            "acq_time": F.lpad(F.col("acq_time").cast("string"), 4, "0"),
            "acq_date": F.coalesce(
                F.col("acq_date").try_cast("date"), F.try_to_date(F.col("acq_date").cast("string"), "yyyy-MM-dd")
            ),
        }
    )
    fields = [f for f in DETECTION_SCHEMA.fields if f.name in df.columns]
    return prepared.select(
        *[
            (
                F.nanvl(F.col(f.name).cast(f.dataType), F.lit(None).cast(f.dataType))
                if isinstance(f.dataType, (T.FloatType, T.DoubleType))
                else F.col(f.name).cast(f.dataType)
            ).alias(f.name)
            for f in fields
        ]
    )


def name_parts(path, folder: str) -> dict:
    """Sensor of an instrument folder, year and country from a file path; a name that does not parse is an error.

    Each row carries its path, so the short name alone is matched and then cut at its underscores.
    """
    name = F.substring_index(path, "/", -1)
    fail = F.raise_error(F.concat(F.lit("unparseable detection file name: "), path)).cast("string")
    parts = {
        "sensor": F.lit(SENSOR_OF_FOLDER[folder]),
        "year": F.substring_index(F.substring_index(name, "_", 2), "_", -1),
        "country": F.substring_index(F.substring_index(name, "_", -1), ".", 1),
    }
    told = {n: F.when(name.rlike(FILE_PATTERN), part).otherwise(fail) for n, part in parts.items()}
    return told | {"year": told["year"].cast("short")}


def read_detections(spark: SparkSession, root: str, folders: Sequence[str] = tuple(SENSOR_OF_FOLDER), files_a_batch: int | None = None) -> DataFrame:
    """All instrument folders under ``root`` in the common typed schema; a stream of them if ``files_a_batch`` is given."""
    parts = []
    for folder in folders:
        bands = MODIS_BANDS if folder == "modis" else VIIRS_BANDS
        reader = spark.readStream.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else spark.read
        raw = (
            reader.schema(raw_schema(bands))
            .option("header", True)
            .option("enforceSchema", False)
            .option("recursiveFileLookup", True)
            .csv(f"{root}/{folder}")
        )
        parts.append(unify_bands(raw).withColumns(name_parts(F.col("_metadata.file_path"), folder)).drop("instrument"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return normalise_types(out)


def write_detections(df: DataFrame, folder: str) -> None:
    """Zstd parquet partitioned for pruning.

    The rebalance sizes the files: small partitions merge, a country holding most
    of the rows is split over many writers.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in PARTITIONS])
        .write.mode("overwrite")
        .partitionBy(*PARTITIONS)
        .option("compression", "zstd")
        .parquet(folder)
    )


def load_detections(
    spark: SparkSession,
    folder: str,
    countries: Sequence[str] = (),
    sensors: Sequence[str] = (),
    columns: Sequence[str] = (),
) -> DataFrame:
    """Read back with partition and column pruning."""
    df = spark.read.parquet(folder)
    if countries:
        df = df.where(F.col("country").isin(*countries))
    if sensors:
        df = df.where(F.col("sensor").isin(*sensors))
    return df.select(*columns) if columns else df


def load_features(spark: SparkSession, folder: str, countries: Sequence[str]) -> DataFrame:
    """Feature rows of several countries from one table partitioned by country."""
    return spark.read.parquet(folder).where(F.col("country").isin(*countries))


def write_report(df: DataFrame, folder: str, fmt: str = "csv") -> None:
    """Metric tables go to CSV, predictions to parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(folder) if fmt == "csv" else writer.parquet(folder)
