"""Contract queries: fingerprints, joins, rules, panels and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators import contracts
from emberfield.operators import evaluation as ev
from emberfield.plans.evaluation_queries import AP, AUC, BY, scores
from emberfield.plans.feature_queries import labelled_window, only_ids
from emberfield.plans.registry import CTES, query
from emberfield.sources import bindings

PANEL = ["source_id", "country", "is_eog_flare", "eog_flare_id", "block_id"]


def fingerprint_sql(frame, columns, keys=""):
    row = " || CHR(31) || ".join(f"COALESCE(CAST({c} AS VARCHAR), '<NA>')" for c in columns)
    words = ", ".join(f"SUM(CAST('0x' || SUBSTR(d, {1 + 16 * i}, 16) AS UBIGINT)) AS w{i}" for i in range(2))
    text = " || ':' || ".join(["rows", *(f"w{i}" for i in range(2))])
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"SELECT {lead}rows, SHA256({text}) AS fingerprint FROM (SELECT {lead}COUNT(*) AS rows, {words} FROM (SELECT {lead}SHA256({row}) AS d FROM {frame}) {group})"


@query("l1_table_fingerprint", fingerprint_sql("predictions", PANEL, "country"))
def l1(spark, folder):
    return contracts.table_fingerprint(bindings.predictions(spark, folder), PANEL, ["country"])


NUMBERS = ["latitude", "longitude", "t_mir", "t_lwir", "frp", "scan", "track"]
OTHERS = ["acq_date", "acq_time", "daynight", "sensor", "confidence", "type", "country", "year"]
MICRO = 1_000_000
"""Numbers enter a fingerprint as whole millionths: engines print doubles differently."""


@query(
    "l1_detection_fingerprint",
    fingerprint_sql(
        f"(SELECT * REPLACE ({', '.join(f'CAST(ROUND({c} * {MICRO}) AS BIGINT) AS {c}' for c in NUMBERS)}) FROM detections)", NUMBERS + OTHERS, "sensor"
    ),
)
def l1_detections(spark, folder):
    """All columns of all detections."""
    whole = bindings.detections(spark, folder).withColumns({c: F.round(F.col(c) * MICRO).cast("bigint") for c in NUMBERS})
    return contracts.table_fingerprint(whole, NUMBERS + OTHERS, ["sensor"])


@query(
    "l2_join_one_to_one",
    "SELECT source_id, country, score_compact_tabular, score_visual FROM predictions",
    "score_compact_tabular score_visual",
)
def l2(spark, folder):
    rows = bindings.predictions(spark, folder)
    return contracts.join_one_to_one(
        rows.select("source_id", "country", "score_compact_tabular"), rows.select("source_id", "score_visual"), ["source_id"]
    )


@query(
    "l3_require",
    """
SELECT 'null identifier' AS rule, COUNT(*) FILTER (source_id IS NULL OR country IS NULL OR block_id IS NULL) AS rows FROM window_labels
UNION ALL SELECT 'label not binary', COUNT(*) FILTER (is_eog_flare NOT IN (0, 1)) FROM window_labels
UNION ALL SELECT 'positive without site', COUNT(*) FILTER (is_eog_flare = 1 AND eog_flare_id IS NULL) FROM window_labels
UNION ALL SELECT 'coordinates out of bounds', COUNT(*) FILTER (lat < -80 OR lat > 84 OR lon < -180 OR lon >= 180) FROM window_labels
UNION ALL SELECT 'not finite: eog_dist_m', COUNT(*) FILTER (ISINF(eog_dist_m)) FROM window_labels
UNION ALL SELECT 'duplicate source_id', COUNT(*) - COUNT(DISTINCT source_id) FROM window_labels
UNION ALL SELECT 'country with one label', COUNT(*) FROM (SELECT country FROM window_labels GROUP BY country HAVING COUNT(DISTINCT is_eog_flare) <> 2)""",
)
def l3(spark, folder):
    return contracts.violations(labelled_window(spark, folder, only_ids), ["eog_dist_m"], coordinates=True)


@query("l4_forbid_holdout", "SELECT country, COUNT(*) AS n FROM window_labels WHERE country <> 'C5' GROUP BY country")
def l4(spark, folder):
    rows = labelled_window(spark, folder, only_ids).where(F.col("country") != bindings.HOLDOUT)
    return contracts.forbid_holdout(rows, bindings.HOLDOUT).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query("l5_forbid_leakage", "SELECT source_id, score_compact_tabular FROM predictions", "score_compact_tabular")
def l5(spark, folder):
    rows = bindings.predictions(spark, folder)
    columns = ["score_compact_tabular"]
    contracts.forbid_leakage(columns)
    return rows.select("source_id", *columns)


@query(
    "l6_same_lineage",
    f"""
SELECT a.country, a.fingerprint = b.fingerprint AS same
FROM ({fingerprint_sql('predictions', ['source_id', 'is_eog_flare'], 'country')}) a
JOIN ({fingerprint_sql("(SELECT * REPLACE (CASE WHEN country = 'de' AND source_id = '7' THEN 1 - is_eog_flare ELSE is_eog_flare END AS is_eog_flare) FROM predictions)", ['source_id', 'is_eog_flare'], 'country')}) b USING (country)""",
)
def l6(spark, folder):
    """Fingerprints of a table and of the same table with one changed row."""
    rows = bindings.predictions(spark, folder)
    touched = (F.col("country") == "de") & (F.col("source_id") == "7")
    changed = rows.withColumn("is_eog_flare", F.when(touched, 1 - F.col("is_eog_flare")).otherwise(F.col("is_eog_flare")))
    prints = [contracts.table_fingerprint(t, ["source_id", "is_eog_flare"], ["country"]) for t in (rows, changed)]
    return contracts.same_lineage(*prints)


CTES["seed_prints"] = fingerprint_sql("seed_predictions", PANEL, "seed")


@query(
    "l7_panel_complete",
    """
SELECT seed, COUNT(*) AS rows, SUM(is_eog_flare) AS positives,
       COUNT(*) FILTER (score_visual < 0 OR score_visual > 1 OR score_compact_tabular < 0 OR score_compact_tabular > 1) AS bad_scores,
       COUNT(DISTINCT source_id) AS sources,
       (SELECT COUNT(DISTINCT fingerprint) = 1 AND COUNT(*) = 3 FROM seed_prints) AND COUNT(*) = COUNT(DISTINCT source_id)
       AND COUNT(*) FILTER (score_visual < 0 OR score_visual > 1 OR score_compact_tabular < 0 OR score_compact_tabular > 1) = 0 AS passed
FROM seed_predictions GROUP BY seed""",
)
def l7(spark, folder):
    return contracts.panel_complete(bindings.seed_predictions(spark, folder), ["score_visual", "score_compact_tabular"])


@query(
    "l8_reconcile_evidence",
    f"""
WITH fresh AS (SELECT branch, country, {AP} AS ap, {AUC} AS auc FROM country_curve GROUP BY branch, country)
SELECT branch, country, 'pr_auc' AS metric, ap AS computed, ROUND(ap, 6) AS stored, ABS(ap - ROUND(ap, 6)) <= GREATEST(1e-10 * GREATEST(ap, ROUND(ap, 6)), 1e-12) AS matches FROM fresh
UNION ALL
SELECT branch, country, 'roc_auc', auc, ROUND(auc, 15), TRUE FROM fresh""",
    "computed stored",
)
def l8(spark, folder):
    """Recomputed AP and ROC against stored ones; AP is stored with six digits only."""
    fresh = ev.ranking(scores(spark, folder), BY, ["pr_auc", "roc_auc"])
    def long(ap, auc):
        return fresh.select(
            *BY,
            F.explode(F.array(F.struct(F.lit("pr_auc").alias("metric"), ap.alias("value")), F.struct(F.lit("roc_auc").alias("metric"), auc.alias("value")))).alias("m"),
        ).select(*BY, "m.*")
    computed = long(F.col("pr_auc"), F.col("roc_auc"))
    stored = long(F.round("pr_auc", 6), F.round("roc_auc", 15))
    return contracts.reconcile(computed, stored, [*BY, "metric"])


COLUMNS_READ = ["source_id", "country", "block_id", "is_eog_flare", "eog_flare_id", "score_compact_tabular", "score_visual"]


@query(
    "l5_leakage_report",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {str(not c.startswith('score')).upper()} AS leaking, COUNT({c}) AS known FROM predictions" for c in COLUMNS_READ
    ),
)
def l5_report(spark, folder):
    """Every column of the score table: all but the scores leak."""
    return contracts.leakage_report(bindings.predictions(spark, folder))


@query(
    "l8_evidence_faults",
    """
WITH computed AS (
  SELECT branch, country, metric, value FROM country_rank UNPIVOT (value FOR metric IN (pr_auc, roc_auc))),
stored AS (
  SELECT branch, country, metric, CASE WHEN country = 'fr' AND metric = 'pr_auc' THEN value * (1 + 1e-6)
                                       WHEN country = 'es' THEN value * (1 + 1e-12) ELSE value END AS value
  FROM computed WHERE NOT (country = 'de' AND metric = 'roc_auc')
  UNION ALL SELECT branch, 'withdrawn', metric, value FROM computed WHERE country = 'de')
SELECT branch, country, metric, c.value AS computed, s.value AS stored,
       CASE WHEN c.value IS NULL AND s.value IS NULL THEN 'no value' WHEN s.value IS NULL THEN 'not stored'
            WHEN c.value IS NULL THEN 'not computed' ELSE 'differs' END AS reason
FROM computed c FULL JOIN stored s USING (branch, country, metric)
WHERE NOT COALESCE(ABS(c.value - s.value) <= GREATEST(1e-10 * GREATEST(ABS(c.value), ABS(s.value)), 1e-12), FALSE)""",
    "computed stored",
)
def l8_faults(spark, folder):
    """Stored evidence with values off by more and by less than the tolerance, values lost and values of a country that is no more."""
    fresh = ev.ranking(scores(spark, folder), BY, ["pr_auc", "roc_auc"])
    computed = fresh.unpivot(BY, ["pr_auc", "roc_auc"], "metric", "value")
    country, metric = F.col("country"), F.col("metric")
    drifted = (
        F.when((country == "fr") & (metric == "pr_auc"), F.col("value") * (1 + 1e-6))
        .when(country == "es", F.col("value") * (1 + 1e-12))
        .otherwise(F.col("value"))
    )
    kept = computed.where(~((country == "de") & (metric == "roc_auc"))).withColumn("value", drifted)
    withdrawn = computed.where(country == "de").withColumn("country", F.lit("withdrawn"))
    return contracts.evidence_faults(contracts.reconcile(computed, kept.unionByName(withdrawn), [*BY, "metric"]))
