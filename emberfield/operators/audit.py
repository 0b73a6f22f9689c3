"""Profiles of detection tables: per-file quality, vocabularies, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.functions.columns import SATURATION_K
from emberfield.operators.ordering import group_quantiles
from emberfield.session import settle

FILE = ("country", "sensor", "year")
VOCABULARY_LIMIT = 12
"""More distinct confidence values than this make a sensor's scale numeric."""


def count_rows() -> Column:
    return F.count(F.lit(1))


def profile_files(det: DataFrame) -> DataFrame:
    """One row per file: sizes, ranges, nulls, medians and flag counts.

    Rows collapse to the days of a file first, so the days are counted without
    expanding rows for a distinct count.
    """
    nulls = sum((F.col(c).isNull().cast("bigint") for c in det.columns), F.lit(0).cast("bigint"))
    spans = [(f, c, f"{n}_{e}") for c, n in (("latitude", "lat"), ("longitude", "lon")) for f, e in ((F.min, "min"), (F.max, "max"))]
    peaks = [*spans, (F.max, "frp", "frp_max"), (F.max, "t_mir", "tmir_max")]
    totals = {
        "rows": F.lit(1).cast("bigint"),
        "n_null": nulls,
        "frp_nonpos": (F.col("frp") <= 0).cast("bigint"),
        "tmir_sat": (F.col("t_mir") >= SATURATION_K).cast("bigint"),
        "_night": (F.col("daynight") == "N").cast("bigint"),
        "_told": F.col("daynight").isNotNull().cast("bigint"),
    }
    days = det.groupBy(*FILE, "acq_date").agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in totals.items()], *[f(c).alias(n) for f, c, n in peaks]
    )
    flat = days.groupBy(*FILE).agg(
        *[F.sum(n).alias(n) for n in totals],
        *[f(n).alias(n) for f, _, n in peaks],
        F.min("acq_date").alias("date_min"),
        F.max("acq_date").alias("date_max"),
        F.sum(F.when(F.col("acq_date").isNull(), F.col("rows")).otherwise(0)).alias("bad_date"),
        F.count("acq_date").alias("n_days"),
    )
    share = F.when(F.col("_told") > 0, F.round(100 * F.col("_night") / F.col("_told"), 2))
    flat = settle(flat.withColumn("dn_N_pct", share).drop("_night", "_told"))
    sizes = flat.select(*FILE, F.col("rows").alias("count"))
    medians = group_quantiles(det, FILE, {"frp_med": ("frp", 0.5), "tmir_med": ("t_mir", 0.5)}, sizes=sizes)
    return flat.join(medians, list(FILE))


def exact_duplicates(det: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row, per file."""
    same = det.groupBy(*det.columns).agg(count_rows().alias("n"))
    return same.groupBy(*FILE).agg(F.sum(F.col("n") - 1).alias("dup_rows"))


def unique_coordinates(det: DataFrame) -> DataFrame:
    """Rows, per-file unique coordinate pairs summed by sensor, and their ratio."""
    spots = det.groupBy(*FILE, "latitude", "longitude").agg(count_rows().alias("n"))
    return (
        spots.groupBy("sensor")
        .agg(F.sum("n").alias("rows"), count_rows().alias("uniq_coord"))
        .withColumn("reuse", F.round(F.col("rows") / F.col("uniq_coord"), 2))
    )


def _joined(values: Column) -> Column:
    return F.array_join(F.array_sort(values), "|")


def value_histogram(det: DataFrame) -> DataFrame:
    """Sorted ``value:count`` text of confidence, plus satellites and versions.

    The lists hold distinct vocabulary entries only, counted beforehand.
    """
    confidence = det.groupBy(*FILE, "confidence").agg(count_rows().alias("n"))
    text = F.concat_ws(":", F.coalesce("confidence", F.lit("<NA>")), F.col("n").cast("string"))
    words = det.groupBy(*FILE).agg(
        _joined(F.collect_set("satellite")).alias("sats"), _joined(F.collect_set("version")).alias("vers")
    )
    return confidence.groupBy(*FILE).agg(_joined(F.collect_list(text)).alias("conf_vals")).join(words, list(FILE))


def type_histogram(det: DataFrame, types: tuple[int, ...] | None = None) -> DataFrame:
    """Count per type code as columns ``type<k>``, 0 where absent."""
    named = det.select(*FILE, F.concat(F.lit("type"), F.col("type").cast("string")).alias("kind"))
    values = [f"type{k}" for k in types] if types else None
    return named.groupBy(*FILE).pivot("kind", values).agg(count_rows()).na.fill(0)


def coverage_matrix(det: DataFrame) -> DataFrame:
    """Rows by country and sensor with 'All' margins."""
    cube = det.cube("country", "sensor").agg(
        count_rows().alias("rows"), F.grouping("country").alias("gc"), F.grouping("sensor").alias("gs")
    )
    return cube.select(
        F.when(F.col("gc") == 1, "All").otherwise(F.col("country")).alias("country"),
        F.when(F.col("gs") == 1, "All").otherwise(F.col("sensor")).alias("sensor"),
        "rows",
    )


def coverage_wide(det: DataFrame, sensors: tuple[str, ...]) -> DataFrame:
    return (
        coverage_matrix(det).groupBy("country").pivot("sensor", [*sensors, "All"]).agg(F.sum("rows")).na.fill(0)
    )


def coverage_span(det: DataFrame) -> DataFrame:
    """Year range text and sorted sensor list per country."""
    files = det.select(*FILE).distinct()
    return files.groupBy("country").agg(
        F.concat(
            F.min("year").cast("string"), F.lit("-"), F.max("year").cast("string"),
            F.lit(" ("), F.size(F.collect_set("year")).cast("string"), F.lit("y)"),
        ).alias("years"),
        _joined(F.collect_set("sensor")).alias("sensors"),
    )


def quality_totals(det: DataFrame) -> DataFrame:
    nulls = sum((F.col(c).isNull().cast("bigint") for c in det.columns), F.lit(0).cast("bigint"))
    repeats = det.groupBy(*det.columns).agg(count_rows().alias("n"))
    return repeats.agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("acq_date").isNull(), F.col("n")).otherwise(0)).alias("bad_date"),
        F.sum(nulls * F.col("n")).alias("n_null"),
        F.sum(F.when(F.col("frp") <= 0, F.col("n")).otherwise(0)).alias("frp_nonpos"),
        F.sum(F.col("n") - 1).alias("dup_rows"),
        F.round(100 * F.sum(F.col("n") - 1) / F.sum("n"), 3).alias("dup_pct"),
    )


def share_of_row(det: DataFrame, by: str) -> DataFrame:
    """Percent of each type code within ``by``."""
    counts = det.groupBy(by, "type").agg(count_rows().alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.select(by, "type", F.round(100 * F.col("n") / total, 2).alias("pct"))


def vocabulary_kind(det: DataFrame) -> DataFrame:
    """Numeric or categorical confidence per sensor; percentages when categorical."""
    counts = det.groupBy("sensor", "confidence").agg(count_rows().alias("n"))
    w = Window.partitionBy("sensor")
    rated = counts.withColumns({"values": F.count("confidence").over(w), "total": F.sum("n").over(w)})
    categorical = F.col("values") <= VOCABULARY_LIMIT
    text = F.concat_ws(":", "confidence", F.format_number(100 * F.col("n") / F.col("total"), 1))
    return rated.groupBy("sensor").agg(
        F.when(F.max("values") > VOCABULARY_LIMIT, "NUMERIC").otherwise("CATEGORICAL").alias("kind"),
        F.max("values").alias("distinct_values"),
        F.max("total").alias("n"),
        _joined(F.collect_list(F.when(categorical, text))).alias("shares"),
    )


def weighted_mean(files: DataFrame, by: str, column: str, digits: int) -> DataFrame:
    """Mean of a per-file statistic weighted by file rows."""
    return files.groupBy(by).agg(
        F.round(F.sum(F.col(column) * F.col("rows")) / F.sum("rows"), digits).alias(column)
    )


def schema_census(columns_of_file: DataFrame) -> DataFrame:
    """Files per distinct column list; input has (file, columns)."""
    return columns_of_file.groupBy(F.concat_ws(",", "columns").alias("column_list")).agg(count_rows().alias("files"))
