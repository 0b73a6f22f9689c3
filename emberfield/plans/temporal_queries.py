"""Monthly sequence and training-pool queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators import temporal as tp
from emberfield.plans.feature_queries import labelled_window, located_window, percentile_sql, rounded_for_ranks
from emberfield.plans.registry import CTES, query
from emberfield.session import settle
from emberfield.sources.bindings import HOLDOUT, WINDOW_YEARS

MEANS = tp.CONTINUOUS[4:]
CTES["months"] = """
SELECT source_id, (YEAR(acq_date) - 1996) * 12 + MONTH(acq_date) - 1 AS month, LN(1 + COUNT(*)) AS log_detection_count,
       LN(1 + COUNT(DISTINCT acq_date)) AS log_active_days, LN(1 + GREATEST(SUM(frp), 0)) AS log_frp_sum,
       LN(1 + GREATEST(AVG(frp), 0)) AS log_frp_mean, AVG(t_mir) AS mir_mean, AVG(t_mir - t_lwir) AS mir_lwir_mean,
       AVG(CASE WHEN UPPER(daynight) = 'N' THEN 1 ELSE 0 END) AS night_fraction, AVG(sat) AS saturation_fraction,
       AVG(CASE WHEN sensor = 'MODIS' THEN 1 ELSE 0 END) AS modis_fraction
FROM windowed GROUP BY ALL
"""
CTES["month_grid"] = "SELECT source_id, CAST(UNNEST(RANGE(36)) AS INT) AS month FROM (SELECT DISTINCT source_id FROM windowed)"
CTES["month_sequence"] = (
    "SELECT source_id, month, "
    + ", ".join(f"COALESCE(m.{c}, 0) AS {c}" for c in tp.CONTINUOUS)
    + """, CASE WHEN m.mir_mean IS NULL THEN 0 ELSE 1 END AS presence, SIN(2 * PI() * (month % 12) / 12) AS month_sin,
COS(2 * PI() * (month % 12) / 12) AS month_cos FROM month_grid LEFT JOIN months m USING (source_id, month)"""
)


def sequence(spark, folder):
    return tp.monthly_sequence(located_window(spark, folder), WINDOW_YEARS)


@query("e1_monthly_sequence", "SELECT * FROM month_sequence", " ".join([*tp.CONTINUOUS, "month_sin", "month_cos"]))
def e1(spark, folder):
    return sequence(spark, folder)


@query(
    "e1_sequence_arrays",
    """SELECT source_id, LEN(LIST(presence)) AS months, SUM(presence) AS present, SUM(mir_mean) AS mir FROM month_sequence GROUP BY source_id""",
    "mir",
)
def e1_arrays(spark, folder):
    arrays = tp.sequence_arrays(sequence(spark, folder))
    total = F.aggregate("months", F.lit(0.0), lambda a, m: a + m["mir_mean"])
    seen = F.aggregate("months", F.lit(0), lambda a, m: a + m["presence"])
    return arrays.select("source_id", F.size("months").alias("months"), seen.alias("present"), total.alias("mir"))


TS = "ts_detection_count ts_active_days ts_frp_sum ts_mir_mean ts_night_fraction ts_saturation_fraction ts_modis_fraction ts_month_continuity"


@query(
    "e2_temporal_descriptors",
    """
SELECT source_id, SUM(n) AS ts_detection_count, SUM(EXP(log_active_days) - 1) AS ts_active_days, SUM(presence) AS ts_active_months,
       SUM(EXP(log_frp_sum) - 1) AS ts_frp_sum, SUM(mir_mean * n) / GREATEST(SUM(n), 1) AS ts_mir_mean,
       SUM(night_fraction * n) / GREATEST(SUM(n), 1) AS ts_night_fraction, SUM(saturation_fraction * n) / GREATEST(SUM(n), 1) AS ts_saturation_fraction,
       SUM(modis_fraction * n) / GREATEST(SUM(n), 1) AS ts_modis_fraction, SUM(presence * before) / GREATEST(SUM(presence) - 1, 1) AS ts_month_continuity
FROM (SELECT *, EXP(log_detection_count) - 1 AS n, COALESCE(LAG(presence) OVER (PARTITION BY source_id ORDER BY month), 0) AS before FROM month_sequence)
GROUP BY source_id""",
    TS,
)
def e2(spark, folder):
    return tp.temporal_descriptors(sequence(spark, folder))


CTES["pool"] = (
    "SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, n_days, "
    + ", ".join(f"ROUND({c}, 9) AS {c}" for c in tp.HARDNESS)
    + " FROM labelled_features WHERE country <> 'C5'"
)
CTES["pool_free"] = """
SELECT * FROM pool p WHERE is_eog_flare = 0 AND NOT EXISTS (
  SELECT 1 FROM pool q WHERE q.is_eog_flare = 1 AND q.country = p.country AND q.block_id = p.block_id)
"""


def hardness_sql(frame):
    mean = " + ".join(f"{c}_country_pct" for c in tp.HARDNESS)
    return f"SELECT source_id, country, ROUND(({mean}) / {len(tp.HARDNESS)}, 12) AS hardness FROM ({percentile_sql(tp.HARDNESS, frame, nulls_last=True)})"


CTES["pool_hardness"] = hardness_sql("pool_free")
CTES["pool_best"] = """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, eog_flare_id ORDER BY active_days_per_year DESC NULLS LAST, det_per_year DESC NULLS LAST, source_id) AS rn
FROM pool WHERE is_eog_flare = 1) WHERE rn = 1
"""
CTES["pool_targets"] = """
SELECT country, target, (target + 1) // 2 AS hard FROM (
  SELECT country, LEAST(pool, 2 * sites) AS target FROM (SELECT country, COUNT(*) AS sites FROM pool_best GROUP BY country)
  JOIN (SELECT country, COUNT(*) AS pool FROM pool_free GROUP BY country) USING (country))
"""
CTES["pool_placed"] = """
SELECT f.*, hardness, target, hard, ROW_NUMBER() OVER (PARTITION BY f.country ORDER BY hardness DESC, f.source_id) AS r
FROM pool_free f JOIN pool_hardness h USING (source_id) JOIN pool_targets t ON t.country = f.country
"""
CTES["pool_selected"] = """
SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, NULL AS hardness, 'positive_site' AS sample_role FROM pool_best
UNION ALL SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, hardness, 'hard_unlabeled' FROM pool_placed WHERE r <= hard
UNION ALL SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, hardness, 'random_unlabeled' FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY SHA256('13:' || source_id), source_id) AS q FROM pool_placed WHERE r > hard) WHERE q <= target - hard
"""
CTES["meta"] = """
SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, sample_role, TRUE AS train_selected FROM pool_selected
UNION ALL SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, 'population_only', FALSE FROM pool
WHERE source_id NOT IN (SELECT source_id FROM pool_selected)
"""


def pool(spark, folder):
    """Sampling frame of the training countries, ranks protected from last-bit noise."""
    from emberfield.operators import features as ft

    rows = labelled_window(spark, folder).where(F.col("country") != HOLDOUT)
    columns = ["source_id", "country", "block_id", "is_eog_flare", "eog_flare_id", "n_days", *tp.HARDNESS]
    assert set(tp.HARDNESS) <= set(ft.feature_columns(rows))
    return settle(rounded_for_ranks(rows.select(*columns), tp.HARDNESS))


def sampled(spark, folder):
    """The pool and its sample; as in the SQL, a country that has no free unlabelled sources gives its positives only."""
    frame = pool(spark, folder)
    return frame, tp.hard_negative_sample(frame, 2, 13, HOLDOUT, complete=False)


def aligned(spark, folder):
    frame, (selected, _) = sampled(spark, folder)
    return tp.align_population(selected, frame, frame.where(F.col("n_days") >= 10), population=True)


@query("e3_hardness", hardness_sql("pool"), "hardness")
def e3(spark, folder):
    frame = pool(spark, folder)
    return frame.select("source_id", "country").join(tp.hardness(frame), "source_id")


@query("e4_hard_negative_sample", "SELECT * FROM pool_selected", "hardness")
def e4(spark, folder):
    _, (selected, _) = sampled(spark, folder)
    return selected.select("source_id", "country", "block_id", "is_eog_flare", "eog_flare_id", "hardness", "sample_role")


@query(
    "e4_sampling_diagnostics",
    """
SELECT country, COUNT(*) FILTER (is_eog_flare = 1) AS known_positive_sources, COUNT(*) FILTER (is_eog_flare = 0) AS available_unlabeled_before_block_guard,
       COALESCE(MAX(free), 0) AS available_unlabeled_after_block_guard, COALESCE(MAX(p), 0) AS unique_positive_sites, COALESCE(MAX(h), 0) AS selected_hard_unlabeled,
       COALESCE(MAX(q), 0) AS selected_random_unlabeled, COUNT(*) FILTER (is_eog_flare = 0) - COALESCE(MAX(free), 0) AS positive_block_unlabeled_excluded
FROM pool LEFT JOIN (SELECT country, COUNT(*) AS free FROM pool_free GROUP BY country) USING (country)
LEFT JOIN (SELECT country, COUNT(*) FILTER (sample_role = 'positive_site') AS p, COUNT(*) FILTER (sample_role = 'hard_unlabeled') AS h,
                  COUNT(*) FILTER (sample_role = 'random_unlabeled') AS q FROM pool_selected GROUP BY country) USING (country) GROUP BY country""",
)
def e4_diagnostics(spark, folder):
    _, (_, diagnostics) = sampled(spark, folder)
    return diagnostics


@query("e5_align_population", "SELECT m.*, p.n_days >= 10 AS is_cohort, TRUE AS population_complete FROM meta m JOIN (SELECT source_id, n_days FROM pool) p USING (source_id)")
def e5(spark, folder):
    return aligned(spark, folder)


SCALED = ", ".join(
    f"CASE WHEN presence = 1 THEN GREATEST(LEAST(({c} - {c}_m) / {c}_s, 8), -8) ELSE 0 END AS {c}" for c in tp.CONTINUOUS
)
CTES["channel_scale"] = (
    "SELECT " + ", ".join(
        f"MEDIAN({c}) AS {c}_m, CASE WHEN QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25) >= 1e-4 THEN QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25) "
        f"WHEN STDDEV_POP({c}) >= 1e-4 THEN STDDEV_POP({c}) ELSE 1 END AS {c}_s" for c in tp.CONTINUOUS
    )
    + " FROM month_sequence WHERE presence = 1 AND source_id IN (SELECT source_id FROM windowed GROUP BY source_id HAVING COUNT(*) >= 5)"
)


@query("e6_robust_scale", f"SELECT source_id, month, {SCALED}, presence, month_sin, month_cos FROM month_sequence, channel_scale", " ".join([*tp.CONTINUOUS, "month_sin", "month_cos"]))
def e6(spark, folder):
    window = located_window(spark, folder)
    training = window.groupBy("source_id").count().where(F.col("count") >= 5)
    return tp.robust_scale(settle(tp.monthly_sequence(window, WINDOW_YEARS)), training)


@query(
    "e7_bag_mask",
    """
SELECT source_id, country, sample_role, is_eog_flare FROM meta WHERE train_selected AND is_eog_flare = 1
UNION ALL SELECT source_id, country, sample_role, is_eog_flare FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY country, sample_role ORDER BY SHA256('29:' || source_id), source_id) AS r, COUNT(*) OVER (PARTITION BY country, sample_role) AS n
  FROM meta WHERE train_selected AND is_eog_flare = 0) WHERE r <= GREATEST(1, ROUND_EVEN(0.7 * n, 0))""",
)
def e7(spark, folder):
    return tp.bag_mask(aligned(spark, folder), 0.7, 29).select("source_id", "country", "sample_role", "is_eog_flare")


@query(
    "e8_country_balance_weights",
    "SELECT source_id, country, 1.0 / COUNT(*) OVER (PARTITION BY country) AS weight FROM window_labels",
    "weight",
)
def e8(spark, folder):
    from emberfield.plans.feature_queries import only_ids

    rows = labelled_window(spark, folder, only_ids)
    return tp.country_balance_weights(rows).select("source_id", "country", "weight")


@query("e9_sample_counts", "SELECT country, sample_role, COUNT(*) AS sources FROM pool_selected GROUP BY ALL")
def e9(spark, folder):
    _, (selected, _) = sampled(spark, folder)
    return tp.sample_counts(selected)
