"""Metric, budget and bootstrap queries over the prediction panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators import evaluation as ev
from emberfield.plans.registry import CTES, query
from emberfield.session import lookup
from emberfield.sources import bindings

BRANCHES = ("compact_tabular", "visual")
SEED_BRANCHES = ("compact_tabular", "visual", "guarded_cv_tabular")
THRESHOLD = 0.55
# Repeats of the paired, the block and the confirmation bootstrap.
PAIRED_REPEATS, BLOCK_REPEATS, CONFIRM_REPEATS = 1000, 2000, 5000


def _long_sql(frame, branches):
    kept = "* EXCLUDE (" + ", ".join(f"score_{b}" for b in branches) + ")"
    return " UNION ALL ".join(f"SELECT {kept}, '{b}' AS branch, score_{b} AS score FROM {frame}" for b in branches)


CTES["scores"] = _long_sql("predictions", BRANCHES)
CTES["seed_scores"] = _long_sql("seed_predictions", SEED_BRANCHES)


def curve_sql(keys, frame, weight="1"):
    order = f"OVER (PARTITION BY {keys} ORDER BY score DESC)"
    whole = f"OVER (PARTITION BY {keys})"
    return f"""
SELECT *, SUM(n) {order} AS seen, SUM(pos) {order} AS found, SUM(n) {whole} AS total, SUM(pos) {whole} AS positives
FROM (SELECT {keys}, score, SUM({weight}) AS n, SUM({weight} * is_eog_flare) AS pos FROM {frame} GROUP BY {keys}, score)"""


AP = "SUM(pos * found / seen) / NULLIF(MAX(positives), 0)"
AUC = "SUM(pos * (total - positives - (seen - found) + (n - pos) / 2.0)) / NULLIF(MAX(positives) * (MAX(total) - MAX(positives)), 0)"
CTES["country_curve"] = curve_sql("branch, country", "scores")
CTES["branch_curve"] = curve_sql("branch", "scores")
CTES["seed_curve"] = curve_sql("seed, branch, country", "seed_scores")


def confusion_sql(keys, frame, threshold):
    return f"""
SELECT *, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS recall,
       COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1,
       COALESCE((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
                / NULLIF(SQRT(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc
FROM (SELECT {keys}, COUNT(*) AS n, SUM(is_eog_flare) AS n_pos, ROUND(MAX({threshold}), 4) AS thr,
             AVG(POW(LEAST(GREATEST(score, 0), 1) - is_eog_flare, 2)) AS brier,
             COUNT(*) FILTER (is_eog_flare = 0 AND score < {threshold}) AS tn,
             COUNT(*) FILTER (is_eog_flare = 0 AND score >= {threshold}) AS fp,
             COUNT(*) FILTER (is_eog_flare = 1 AND score < {threshold}) AS fn,
             COUNT(*) FILTER (is_eog_flare = 1 AND score >= {threshold}) AS tp
      FROM {frame} GROUP BY {keys})"""


CTES["country_confusion"] = confusion_sql("branch, country", "scores", THRESHOLD)
CTES["seed_confusion"] = confusion_sql("seed, branch, country", "seed_scores", THRESHOLD)
CTES["country_rank"] = f"SELECT branch, country, {AP} AS pr_auc, {AUC} AS roc_auc FROM country_curve GROUP BY branch, country"
CTES["seed_rank"] = f"SELECT seed, branch, country, {AP} AS pr_auc, {AUC} AS roc_auc FROM seed_curve GROUP BY seed, branch, country"
CTES["seed_metrics"] = "SELECT * FROM seed_confusion JOIN seed_rank USING (seed, branch, country)"
CTES["site_totals"] = "SELECT country, COUNT(DISTINCT eog_flare_id) + 3 AS sites FROM predictions GROUP BY country"
BY = ["branch", "country"]
THR = THRESHOLD
CONFUSION = "thr brier precision recall f1 mcc"


def scores(spark, folder):
    return ev.long_scores(bindings.predictions(spark, folder), BRANCHES)


def seed_scores(spark, folder):
    return ev.long_scores(bindings.seed_predictions(spark, folder), SEED_BRANCHES)


def seed_metrics(spark, folder):
    return ev.full_metrics(seed_scores(spark, folder), ["seed", "branch", "country"], THR)


def site_totals(spark, folder):
    rows = bindings.predictions(spark, folder)
    return rows.groupBy("country").agg((F.count_distinct("eog_flare_id") + 3).alias("sites"))


@query("j1_binary_metrics", "SELECT * FROM country_confusion", CONFUSION)
def j1(spark, folder):
    return ev.binary_metrics(scores(spark, folder), BY, THR)


@query("j2_average_precision", f"SELECT branch, country, {AP} AS pr_auc FROM country_curve GROUP BY branch, country", "pr_auc")
def j2(spark, folder):
    return ev.average_precision(scores(spark, folder), BY)


@query("j3_roc_auc", f"SELECT branch, {AUC} AS roc_auc FROM branch_curve GROUP BY branch", "roc_auc")
def j3(spark, folder):
    return ev.roc_auc(scores(spark, folder), ["branch"])


BEST = """
SELECT {keys}, score AS best_threshold, f1 AS best_f1 FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY f1 DESC, score) AS rn
  FROM (SELECT {keys}, score, ROUND(2.0 * found / (seen + positives), 12) AS f1 FROM {frame})) WHERE rn = 1"""
CTES["branch_best"] = BEST.format(keys="branch", frame="branch_curve")


@query("j4_best_f1_threshold", BEST.format(keys="branch, country", frame="country_curve"), "best_threshold best_f1")
def j4(spark, folder):
    return ev.best_f1_threshold(scores(spark, folder), BY)


GRID = [i / 20 for i in range(1, 20)]


@query(
    "j4_grid_f1_threshold",
    f"""
SELECT branch, t AS best_threshold, f1 AS best_f1 FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY f1 DESC, t) AS rn FROM (
    SELECT branch, t, ROUND(COALESCE(2.0 * SUM(is_eog_flare) FILTER (score >= t) / NULLIF(COUNT(*) FILTER (score >= t) + SUM(is_eog_flare), 0), 0), 12) AS f1
    FROM scores, (SELECT CAST(UNNEST({GRID}) AS DOUBLE) AS t) g GROUP BY branch, t)) WHERE rn = 1""",
    "best_threshold best_f1",
)
def j4_grid(spark, folder):
    return ev.grid_f1_threshold(scores(spark, folder), ["branch"], GRID)


MACRO_F1 = """
SELECT {keys}, t AS threshold, f AS macro_f1 FROM (
  SELECT {keys}, t, f, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY f DESC, t) AS rn FROM (
    SELECT {keys}, t, ROUND(AVG(f1), 12) AS f FROM (
      SELECT {qualified}, c.t, s.country, COALESCE(2.0 * SUM(is_eog_flare) FILTER (score >= c.t)
             / NULLIF(COUNT(*) FILTER (score >= c.t) + SUM(is_eog_flare), 0), 0) AS f1
      FROM {frame} s JOIN (SELECT DISTINCT {keys}, score AS t FROM {frame}) c USING ({keys}) GROUP BY {qualified}, c.t, s.country)
    GROUP BY {keys}, t)) WHERE rn = 1"""
CTES["branch_macro_f1"] = MACRO_F1.format(keys="branch", qualified="branch", frame="scores")


@query("j5_macro_f1_threshold", "SELECT * FROM branch_macro_f1", "threshold macro_f1")
def j5(spark, folder):
    return ev.macro_f1_threshold(scores(spark, folder), ["branch"])


@query(
    "j6_calibration_table",
    """
SELECT branch, bin, COUNT(*) AS n, AVG(score) AS pred, AVG(is_eog_flare) AS obs, ABS(AVG(score) - AVG(is_eog_flare)) AS gap
FROM (SELECT s.branch, s.score, s.is_eog_flare, GREATEST(LEN(LIST_FILTER(edges, lambda e: e < s.score)) - 1, 0) AS bin
      FROM scores s JOIN (SELECT branch, LIST_DISTINCT(QUANTILE_CONT(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edges
                          FROM scores GROUP BY branch) q USING (branch))
GROUP BY branch, bin""",
    "pred obs gap",
)
def j6(spark, folder):
    return ev.calibration_table(scores(spark, folder), ["branch"])


@query(
    "j7_country_metrics",
    """
SELECT c.*, pr_auc, roc_auc, n_pos / n AS prevalence, tp + fp AS predicted_positive, (tp + fp) / n AS prediction_rate,
       CASE WHEN n_pos > 0 THEN pr_auc / (n_pos / n) END AS pr_auc_lift
FROM country_confusion c JOIN country_rank USING (branch, country)""",
    CONFUSION + " pr_auc roc_auc prevalence prediction_rate pr_auc_lift",
)
def j7(spark, folder):
    return ev.country_metrics(scores(spark, folder), BY, THR)


CTES["site_counts"] = f"""
SELECT branch, country, sites AS eog_sites_total, COUNT(DISTINCT eog_flare_id) AS eog_sites_recoverable,
       COUNT(DISTINCT CASE WHEN score >= {THRESHOLD} THEN eog_flare_id END) AS eog_sites_detected
FROM scores JOIN site_totals USING (country) GROUP BY branch, country, sites
"""


@query(
    "j8_site_metrics",
    """SELECT *, eog_sites_detected / GREATEST(eog_sites_recoverable, 1) AS recall_of_recoverable,
              eog_sites_detected / GREATEST(eog_sites_total, 1) AS recall_of_all_active FROM site_counts""",
    "recall_of_recoverable recall_of_all_active",
)
def j8(spark, folder):
    return ev.site_metrics(scores(spark, folder), BY, THR, site_totals(spark, folder))


@query(
    "j9_site_funnel",
    """SELECT *, eog_sites_recoverable / GREATEST(eog_sites_total, 1) AS source_construction_recall,
              eog_sites_detected / GREATEST(eog_sites_recoverable, 1) AS model_recall_of_recoverable,
              eog_sites_detected / GREATEST(eog_sites_total, 1) AS end_to_end_recall_of_all_active FROM site_counts""",
    "source_construction_recall model_recall_of_recoverable end_to_end_recall_of_all_active",
)
def j9(spark, folder):
    return ev.site_funnel(scores(spark, folder), BY, THR, site_totals(spark, folder))


@query("j10_macro_ap", "SELECT branch, AVG(pr_auc) AS macro_ap FROM country_rank GROUP BY branch", "macro_ap")
def j10(spark, folder):
    return ev.macro_ap(scores(spark, folder), ["branch"])


@query(
    "j10_country_ap_deltas",
    """SELECT country, b.pr_auc AS baseline, v.pr_auc AS candidate, v.pr_auc - b.pr_auc AS delta
       FROM country_rank b JOIN country_rank v USING (country) WHERE b.branch = 'compact_tabular' AND v.branch = 'visual'""",
    "baseline candidate delta",
)
def j10_deltas(spark, folder):
    return ev.country_ap_deltas(scores(spark, folder), "compact_tabular", "visual")


@query(
    "j11_branch_summary",
    """SELECT branch, AVG(f1) AS macro_f1, AVG(pr_auc) AS macro_pr_auc, AVG(roc_auc) AS macro_roc_auc, MIN(pr_auc) AS worst_country_pr_auc
       FROM country_confusion JOIN country_rank USING (branch, country) GROUP BY branch""",
    "macro_f1 macro_pr_auc macro_roc_auc worst_country_pr_auc",
)
def j11(spark, folder):
    return ev.branch_summary(ev.full_metrics(scores(spark, folder), BY, THR))


def budget_sql(keys, frame, fractions):
    return f"""
SELECT *, GREATEST(CEIL(ROUND(review_fraction * size, 9)), 1) AS review_count
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY score DESC, source_id) AS rank,
             COUNT(*) OVER (PARTITION BY {keys}) AS size FROM {frame}) r,
     (SELECT CAST(UNNEST({list(fractions)}) AS DOUBLE) AS review_fraction) f"""


CTES["budgeted"] = budget_sql("branch, country", "scores", ev.BUDGETS)
CTES["gated"] = budget_sql("branch, country", "scores", ev.GATES)
CTES["seed_budgeted"] = budget_sql("seed, branch, country", "seed_scores", ev.BUDGETS)
FOUND = "SUM(is_eog_flare) FILTER (rank <= review_count)"
SITES_FOUND = "COUNT(DISTINCT CASE WHEN rank <= review_count THEN eog_flare_id END)"


@query(
    "j12_review_budgets",
    f"""
SELECT branch, country, review_fraction, MAX(review_count) AS review_count, COALESCE({FOUND}, 0) AS positive_found, {SITES_FOUND} AS sites_found,
       COALESCE({FOUND}, 0) / MAX(review_count) AS precision_at_budget, COALESCE({FOUND}, 0) / GREATEST(SUM(is_eog_flare), 1) AS recall_at_budget,
       {SITES_FOUND} / GREATEST(COUNT(DISTINCT eog_flare_id), 1) AS site_recall_at_budget
FROM budgeted GROUP BY branch, country, review_fraction""",
    "review_fraction precision_at_budget recall_at_budget site_recall_at_budget",
)
def j12(spark, folder):
    return ev.review_budgets(scores(spark, folder), BY)


@query(
    "j13_queue_membership",
    "SELECT branch, country, review_fraction, rank, source_id, is_eog_flare, score FROM budgeted WHERE rank <= review_count",
    "review_fraction score",
)
def j13(spark, folder):
    return ev.queue_membership(scores(spark, folder), BY)


@query(
    "j14_gate_metrics",
    f"""
SELECT branch, country, review_fraction AS top_fraction, MAX(review_count) AS candidates,
       COALESCE({FOUND}, 0) / MAX(review_count) AS precision_at_gate, COALESCE({FOUND}, 0) / GREATEST(SUM(is_eog_flare), 1) AS source_recall_at_gate,
       {SITES_FOUND} / GREATEST(COUNT(DISTINCT eog_flare_id), 1) AS site_recall_at_gate
FROM gated GROUP BY branch, country, review_fraction""",
    "top_fraction precision_at_gate source_recall_at_gate site_recall_at_gate",
)
def j14(spark, folder):
    return ev.gate_metrics(scores(spark, folder), BY)


@query(
    "j15_top_n_review",
    f"SELECT source_id, country, is_eog_flare, score FROM scores WHERE branch = 'compact_tabular' ORDER BY score >= {THRESHOLD} DESC, score DESC, source_id LIMIT 100",
    "score",
)
def j15(spark, folder):
    rows = scores(spark, folder).where(F.col("branch") == "compact_tabular")
    return ev.top_n_review(rows, 100, THRESHOLD).select("source_id", "country", "is_eog_flare", "score")


def bootstrap_sql(unit, seed, frame="scores", baseline="compact_tabular", candidate="visual", repeats=PAIRED_REPEATS):
    return f"""
WITH units AS (SELECT country, {unit}, MAX(is_eog_flare) AS stratum FROM {frame} GROUP BY country, {unit}),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, stratum ORDER BY {unit}) - 1 AS slot,
                  COUNT(*) OVER (PARTITION BY country, stratum) AS size FROM units),
drawn AS (SELECT repeat, country, stratum, slot, COUNT(*) AS weight FROM (
  SELECT repeat, country, stratum, CAST('0x' || SUBSTR(MD5('{seed}:' || repeat || ':' || country || ':' || stratum || ':' || slot), 1, 15) AS BIGINT) % size AS slot
  FROM placed, (SELECT UNNEST(RANGE({repeats})) AS repeat) r) GROUP BY ALL),
weighted AS (SELECT d.repeat, d.weight, f.* FROM drawn d JOIN placed p USING (country, stratum, slot)
             JOIN {frame} f ON f.country = p.country AND f.{unit} = p.{unit}),
walked AS ({curve_sql("repeat, country, branch", "weighted", "weight")}),
rated AS (SELECT repeat, country, branch, {AP} AS pr_auc FROM walked GROUP BY repeat, country, branch),
differences AS (SELECT repeat, AVG(v.pr_auc - b.pr_auc) AS difference FROM rated b JOIN rated v USING (repeat, country)
                WHERE b.branch = '{baseline}' AND v.branch = '{candidate}' GROUP BY repeat)
SELECT AVG(difference) AS mean, QUANTILE_CONT(difference, 0.025) AS lower_95, QUANTILE_CONT(difference, 0.975) AS upper_95,
       COUNT(*) AS repeats FROM differences"""


@query("j16_paired_bootstrap", bootstrap_sql("source_id", 42), "mean lower_95 upper_95")
def j16(spark, folder):
    return ev.paired_bootstrap(scores(spark, folder), "compact_tabular", "visual", PAIRED_REPEATS, 42)


@query("j17_block_bootstrap", bootstrap_sql("block_id", 13014, repeats=BLOCK_REPEATS), "mean lower_95 upper_95")
def j17(spark, folder):
    return ev.block_bootstrap(scores(spark, folder), "compact_tabular", "visual", BLOCK_REPEATS, 13014)


CTES["seed_deltas"] = """
SELECT seed, country, b.pr_auc AS b_ap, v.pr_auc AS v_ap, v.pr_auc - b.pr_auc AS delta, v.f1 - b.f1 AS f1_delta
FROM seed_metrics b JOIN seed_metrics v USING (seed, country) WHERE b.branch = 'compact_tabular' AND v.branch = 'guarded_cv_tabular'
"""


@query(
    "j18_seed_summary",
    """SELECT seed, AVG(b_ap) AS compact_macro_pr_auc, AVG(v_ap) AS guarded_macro_pr_auc, AVG(delta) AS macro_pr_auc_gain,
              COUNT(*) FILTER (delta > 0) AS improved_countries, MIN(delta) AS worst_country_pr_auc_delta, AVG(f1_delta) AS macro_f1_gain
       FROM seed_deltas GROUP BY seed""",
    "compact_macro_pr_auc guarded_macro_pr_auc macro_pr_auc_gain worst_country_pr_auc_delta macro_f1_gain",
)
def j18(spark, folder):
    return ev.seed_summary(seed_metrics(spark, folder), "compact_tabular", "guarded_cv_tabular")


@query(
    "j19_country_stability",
    """SELECT country, AVG(delta) AS mean_pr_auc_delta, STDDEV_SAMP(delta) AS std_pr_auc_delta, MIN(delta) AS min_pr_auc_delta,
              MAX(delta) AS max_pr_auc_delta, COUNT(*) FILTER (delta > 0) AS positive_seeds FROM seed_deltas GROUP BY country""",
    "mean_pr_auc_delta std_pr_auc_delta min_pr_auc_delta max_pr_auc_delta",
)
def j19(spark, folder):
    return ev.country_stability(seed_metrics(spark, folder), "compact_tabular", "guarded_cv_tabular")


@query(
    "j20_ablation_table",
    "SELECT c.*, pr_auc, roc_auc FROM ("
    + confusion_sql("branch", "(SELECT * FROM scores JOIN branch_best USING (branch))", "best_threshold")
    + f") c JOIN (SELECT branch, {AP} AS pr_auc, {AUC} AS roc_auc FROM branch_curve GROUP BY branch) USING (branch)",
    CONFUSION + " pr_auc roc_auc",
)
def j20(spark, folder):
    return ev.ablation_table(scores(spark, folder), "branch")
