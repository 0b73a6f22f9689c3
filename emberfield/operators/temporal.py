"""Monthly sequences per source, temporal descriptors and training-pool sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.functions.columns import SATURATION_K, null_if_not_finite, seeded_order
from emberfield.operators.contracts import forbid_holdout
from emberfield.operators.ordering import exact_quantiles, first_per, melt, percentile_columns, row_numbers
from emberfield.session import lookup, settle

# Channel order of a sequence and the columns that rate hardness.
CONTINUOUS = (
    "log_detection_count", "log_active_days", "log_frp_sum", "log_frp_mean", "mir_mean",
    "mir_lwir_mean", "night_fraction", "saturation_fraction", "modis_fraction",
)
HARDNESS = (
    "active_days_per_year", "active_months_per_year", "det_per_year", "night_frac", "sat_frac",
    "dt_mir_lwir_mean", "frp_mean",
)
META = ("source_id", "country", "block_id", "is_eog_flare", "eog_flare_id")


def monthly_totals(det: DataFrame, first_year: int) -> DataFrame:
    """Per (source, month index): counts, days, sums and means."""
    month = (F.year("acq_date") - first_year) * 12 + F.month("acq_date") - 1
    return (
        det.where(F.col("acq_date").isNotNull())
        .groupBy("source_id", month.alias("month"))
        .agg(
            F.count(F.lit(1)).alias("detection_count"),
            F.count_distinct("acq_date").alias("active_days"),
            F.sum("frp").alias("frp_sum"),
            F.avg("frp").alias("frp_mean"),
            F.avg("t_mir").alias("mir_mean"),
            F.avg(F.col("t_mir") - F.col("t_lwir")).alias("mir_lwir_mean"),
            F.avg((F.upper("daynight") == "N").cast("int")).alias("night_fraction"),
            F.avg((F.col("t_mir") >= SATURATION_K).cast("int")).alias("saturation_fraction"),
            F.avg((F.col("sensor") == "MODIS").cast("int")).alias("modis_fraction"),
        )
    )


def monthly_sequence(det: DataFrame, years: Sequence[int]) -> DataFrame:
    """Dense months per source: log totals, means, presence and the season's sine and cosine.

    The months of a source, at most 12 per year, gather into one map and unfold
    again with the absent ones, so densifying costs no join.
    """
    if sorted(set(years)) != list(range(min(years), max(years) + 1)):
        raise ValueError(f"years with a hole: {sorted(set(years))}")
    months = 12 * len(set(years))
    totals = monthly_totals(det, min(years))

    def level(name: str) -> Column:
        return F.coalesce(null_if_not_finite(F.col(name)), F.lit(0.0))

    logs = ("detection_count", "active_days", "frp_sum", "frp_mean")
    values = [F.log1p(F.greatest(level(c).cast("double"), F.lit(0.0))).alias(f"log_{c}") for c in logs]
    values += [level(c).cast("double").alias(c) for c in CONTINUOUS[4:]]
    packed = totals.select("source_id", "month", F.struct(*values).alias("v"))
    gathered = packed.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("month", "v"))).alias("m"))
    dense = gathered.select("source_id", "m", F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("month"))
    seen = F.try_element_at("m", F.col("month"))
    angle = 2 * F.pi() * (F.col("month") % 12) / 12
    return dense.select(
        "source_id",
        "month",
        *[F.coalesce(seen[c], F.lit(0.0)).alias(c) for c in CONTINUOUS],
        seen.isNotNull().cast("int").alias("presence"),
        F.sin(angle).alias("month_sin"),
        F.cos(angle).alias("month_cos"),
    )


def sequence_arrays(sequence: DataFrame) -> DataFrame:
    """One row per source with its months in order; bounded by the window length."""
    channels = [*CONTINUOUS, "presence", "month_sin", "month_cos"]
    gathered = F.array_sort(F.collect_list(F.struct("month", *channels)))
    return sequence.groupBy("source_id").agg(gathered.alias("months"))


def temporal_descriptors(sequence: DataFrame) -> DataFrame:
    """Totals, active months, count-weighted means and month continuity."""
    w = Window.partitionBy("source_id").orderBy("month")
    count = F.expm1("log_detection_count")
    rows = sequence.withColumns(
        {
            "_n": count,
            "_pair": F.col("presence") * F.coalesce(F.lag("presence").over(w), F.lit(0)),
        }
    )
    weight = F.greatest(F.sum("_n"), F.lit(1.0))
    return rows.groupBy("source_id").agg(
        F.sum("_n").alias("ts_detection_count"),
        F.sum(F.expm1("log_active_days")).alias("ts_active_days"),
        F.sum("presence").alias("ts_active_months"),
        F.sum(F.expm1("log_frp_sum")).alias("ts_frp_sum"),
        *[
            (F.sum(F.col(c) * F.col("_n")) / weight).alias(n)
            for c, n in (
                ("mir_mean", "ts_mir_mean"),
                ("night_fraction", "ts_night_fraction"),
                ("saturation_fraction", "ts_saturation_fraction"),
                ("modis_fraction", "ts_modis_fraction"),
            )
        ],
        (F.sum("_pair") / F.greatest(F.sum("presence") - 1, F.lit(1))).alias("ts_month_continuity"),
    )


def hardness(df: DataFrame, columns: Sequence[str] = HARDNESS) -> DataFrame:
    """Mean within-country percentile of the hardness columns; NULLs rank highest."""
    ranked = percentile_columns(
        df.select("source_id", "country", *[null_if_not_finite(F.col(c)).cast("double").alias(c) for c in columns]),
        "country", columns, "source_id", "_pct", nulls_last=True,
    )
    mean = sum((F.col(f"{c}_pct") for c in columns), F.lit(0.0)) / len(columns)
    return ranked.select("source_id", F.round(mean, 12).alias("hardness"))


def hard_negative_sample(
    df: DataFrame, ratio: int, seed: int, holdout: str, complete: bool = True
) -> tuple[DataFrame, DataFrame]:
    """One source per known site, hard and random unlabelled ones; and a diagnostics row per country.

    Unlabelled sources in a block with any positive are never sampled. Ranks over
    a country are range-partitioned, so no country is ordered in one task. A country
    without known sites or without free unlabelled sources is an error; unless
    ``complete``, it keeps the positives it has and its zeros show in the diagnostics.
    """
    frame = settle(forbid_holdout(df, holdout))
    positives = frame.where(F.col("is_eog_flare") == 1)
    low = [F.coalesce(-F.col(c), F.lit(float("inf"))) for c in ("active_days_per_year", "det_per_year")]
    best = first_per(positives, ["country", "eog_flare_id"], [*low, F.col("source_id")])
    unlabelled = frame.where(F.col("is_eog_flare") == 0)
    blocks = positives.select("country", "block_id").distinct()
    free = settle(unlabelled.join(blocks, ["country", "block_id"], "left_anti"))

    sizes = lookup(
        best.groupBy("country").agg(F.count(F.lit(1)).alias("sites"))
        .join(free.groupBy("country").agg(F.count(F.lit(1)).alias("pool")), "country")
        .withColumn("target", F.least(F.col("pool"), ratio * F.col("sites")))
        .select("country", "target", F.floor((F.col("target") + 1) / 2).alias("hard"))
    )
    if complete:
        short = frame.select("country").distinct().join(sizes, "country", "left_anti").limit(5).collect()
        if short:
            raise ValueError(f"countries without known sites or without free unlabelled sources: {[r.country for r in short]}")
    rated = free.join(hardness(free), "source_id")
    placed = row_numbers(rated, ["country"], [F.col("hardness").desc(), F.col("source_id")], "_r").join(sizes, "country")
    placed = settle(placed.drop("_r_group"))
    hard = placed.where(F.col("_r") <= F.col("hard"))
    rest = placed.where(F.col("_r") > F.col("hard")).withColumn("_order", seeded_order(seed, F.col("source_id")))
    random = row_numbers(rest, ["country"], [F.col("_order"), F.col("source_id")], "_q").where(
        F.col("_q") <= F.col("target") - F.col("hard")
    )
    kept = [*df.columns, "hardness", "sample_role"]
    selected = (
        best.withColumns({"hardness": F.lit(None).cast("double"), "sample_role": F.lit("positive_site")})
        .select(*kept)
        .unionByName(hard.withColumn("sample_role", F.lit("hard_unlabeled")).select(*kept))
        .unionByName(random.withColumn("sample_role", F.lit("random_unlabeled")).select(*kept))
    )
    selected = settle(selected)
    counts = frame.groupBy("country").agg(
        F.count_if(F.col("is_eog_flare") == 1).alias("known_positive_sources"),
        F.count_if(F.col("is_eog_flare") == 0).alias("available_unlabeled_before_block_guard"),
    )
    guarded = free.groupBy("country").agg(F.count(F.lit(1)).alias("available_unlabeled_after_block_guard"))
    roles = selected.groupBy("country").agg(
        F.count_if(F.col("sample_role") == "positive_site").alias("unique_positive_sites"),
        F.count_if(F.col("sample_role") == "hard_unlabeled").alias("selected_hard_unlabeled"),
        F.count_if(F.col("sample_role") == "random_unlabeled").alias("selected_random_unlabeled"),
    )
    diagnostics = (
        counts.join(guarded, "country", "left").na.fill(0).join(roles, "country", "left").na.fill(0)
        .withColumn(
            "positive_block_unlabeled_excluded",
            F.col("available_unlabeled_before_block_guard") - F.col("available_unlabeled_after_block_guard"),
        )
    )
    return selected, diagnostics


def align_population(selected: DataFrame, base: DataFrame, cohort: DataFrame, population: bool) -> DataFrame:
    """Sampled rows plus the rest of the base table, flagged; cohort labels must agree."""
    ids = cohort.select("source_id", F.col("is_eog_flare").alias("_label"))
    picked = selected.select(*META, "sample_role").withColumn("train_selected", F.lit(True))
    rest = base.join(selected.select("source_id"), "source_id", "left_anti").select(*META).withColumns(
        {"sample_role": F.lit("population_only" if population else "cohort_only"), "train_selected": F.lit(False)}
    )
    both = picked.unionByName(rest).join(ids, "source_id", "left")
    agree = F.col("_label").isNull() | (F.col("_label") == F.col("is_eog_flare"))
    checked = F.when(agree, F.lit(True)).otherwise(F.raise_error(F.lit("cohort labels disagree")).cast("boolean"))
    return both.where(checked).withColumns(
        {"is_cohort": F.col("_label").isNotNull(), "population_complete": F.lit(population)}
    ).drop("_label")


def fit_scale(sequence: DataFrame) -> DataFrame:
    """Median and interquartile width per channel over present months.

    A width under 1e-4 falls back to the population deviation, then to 1.
    """
    seen = melt(sequence.where(F.col("presence") == 1), ["source_id"], list(CONTINUOUS)).select("metric", "value")
    quartiles = exact_quantiles(seen, ["metric"], "value", {"q25": 0.25, "center": 0.5, "q75": 0.75})
    deviation = seen.groupBy("metric").agg(F.stddev_pop("value").alias("sd"))
    width = F.col("q75") - F.col("q25")
    fallback = F.when(F.col("sd") >= 1e-4, F.col("sd")).otherwise(F.lit(1.0))
    return quartiles.join(deviation, "metric").select(
        "metric", "center", F.when(width >= 1e-4, width).otherwise(fallback).alias("scale")
    )


def robust_scale(sequence: DataFrame, training: DataFrame) -> DataFrame:
    """Scale every month with statistics of the training sources; absent months 0, clipped at ±8."""
    scales = fit_scale(sequence.join(training.select("source_id"), "source_id", "left_semi"))
    fitted = {row["metric"]: row for row in scales.collect()}  # one row per channel

    def scaled(c: str) -> Column:
        value = (F.col(c) - fitted[c]["center"]) / fitted[c]["scale"]
        return F.when(F.col("presence") == 1, F.greatest(F.least(value, F.lit(8.0)), F.lit(-8.0))).otherwise(F.lit(0.0))

    return sequence.withColumns({c: scaled(c) for c in CONTINUOUS})


def bag_mask(meta: DataFrame, keep: float, seed: int, excluded: Sequence[str] = ()) -> DataFrame:
    """Training rows kept by a bag: all positives, a seeded share of each unlabelled pool."""
    if not 0 < keep <= 1:
        raise ValueError("keep must be in (0, 1]")
    eligible = meta.where("train_selected")
    if excluded:
        eligible = eligible.where(~F.col("country").isin(*excluded))
    positives = eligible.where(F.col("is_eog_flare") == 1)
    pool = eligible.where(F.col("is_eog_flare") == 0).withColumn("_order", seeded_order(seed, F.col("source_id")))
    placed = row_numbers(pool, ["country", "sample_role"], [F.col("_order"), F.col("source_id")], "_r")
    count = F.greatest(F.lit(1), F.bround(F.lit(keep) * F.col("_r_group")).cast("bigint"))
    return positives.unionByName(placed.where(F.col("_r") <= count).select(*meta.columns))


def country_balance_weights(df: DataFrame) -> DataFrame:
    sizes = lookup(df.groupBy("country").agg(F.count(F.lit(1)).alias("_n")))
    return df.join(sizes, "country").withColumn("weight", 1 / F.col("_n")).drop("_n")


def sample_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("country", "sample_role").agg(F.count(F.lit(1)).alias("sources"))
