"""Fusion, selection and acceptance queries over the prediction panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators import evaluation as ev
from emberfield.operators import contracts, fusion, ledger, nested, policy, transfer
from emberfield.plans.evaluation_queries import (
    AP, CONFIRM_REPEATS, PAIRED_REPEATS, SEED_BRANCHES, THR, THRESHOLD, AUC, MACRO_F1, bootstrap_sql, budget_sql, confusion_sql, curve_sql,
    scores, seed_scores, seed_metrics, FOUND, SITES_FOUND, BEST,
)
from emberfield.plans.feature_queries import percentile_sql
from emberfield.plans.registry import CTES, query
from emberfield.session import lookup, settle, with_row
from emberfield.sources import bindings

COMPACT, VISUAL, GUARDED = "score_compact_tabular", "score_visual", "score_guarded_cv_tabular"
BASE, CANDIDATE, SENSITIVE = "compact_tabular", "guarded_cv_tabular", "de"
ALPHA_OF_SEED = {272: 0.3, 273: 0.0, 274: 0.5}


def predictions(spark, folder):
    return bindings.predictions(spark, folder)


def logit_sql(c):
    clipped = f"LEAST(GREATEST({c}, 1e-6), 1 - 1e-6)"
    return f"(LN({clipped}) - LN(1 - {clipped}))"


def calibrate_sql(c, mean, std):
    return f"(1 / (1 + EXP(-(({logit_sql(c)}) - {mean}) / GREATEST({std}, 1e-6))))"


def fuse_sql(c, v, a):
    return f"LEAST(GREATEST({c} + {a} * 4 * {c} * (1 - {c}) * ({v} - {c}), 0), 1)"


CTES["late_scores"] = f"""
SELECT country, is_eog_flare, weight, weight * {COMPACT} + (1 - weight) * {VISUAL} AS score
FROM predictions, (SELECT CAST(UNNEST([0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) AS DOUBLE) AS weight) w
"""
CTES["late_curve"] = curve_sql("weight, country", "late_scores")
CTES["late_weights"] = f"""
SELECT weight, macro_ap, ROW_NUMBER() OVER (ORDER BY macro_ap DESC, weight) = 1 AS selected
FROM (SELECT weight, ROUND(AVG(ap), 12) AS macro_ap FROM (SELECT weight, country, {AP} AS ap FROM late_curve GROUP BY weight, country) GROUP BY weight)
"""


@query("k1_late_fusion_weights", "SELECT * FROM late_weights", "macro_ap")
def k1_weights(spark, folder):
    return fusion.late_fusion_weights(predictions(spark, folder), COMPACT, VISUAL)


@query(
    "k1_late_fusion",
    f"SELECT source_id, weight, weight * {COMPACT} + (1 - weight) * {VISUAL} AS score FROM predictions, (SELECT weight FROM late_weights WHERE selected) w",
    "score",
)
def k1(spark, folder):
    return fusion.late_fusion(predictions(spark, folder), COMPACT, VISUAL).select("source_id", "weight", "score")


CTES["ranked_scores"] = percentile_sql([COMPACT, VISUAL], "predictions").replace("_country_pct", "_rank")
CTES["blended"] = f"SELECT *, ROUND(0.8 * {COMPACT}_rank + 0.2 * {VISUAL}_rank, 12) AS score FROM ranked_scores"


@query("k2_rank_blend", f"SELECT source_id, country, {COMPACT}_rank, {VISUAL}_rank, score FROM blended", f"{COMPACT}_rank {VISUAL}_rank score")
def k2(spark, folder):
    rows = fusion.rank_blend(predictions(spark, folder), COMPACT, VISUAL)
    return rows.select("source_id", "country", f"{COMPACT}_rank", f"{VISUAL}_rank", "score")


@query(
    "k3_calibrate",
    f"SELECT source_id, {calibrate_sql(COMPACT, 'm', 's')} AS calibrated FROM predictions, (SELECT AVG({logit_sql(COMPACT)}) AS m, STDDEV_POP({logit_sql(COMPACT)}) AS s FROM predictions) r",
    "calibrated",
)
def k3(spark, folder):
    from emberfield.functions.columns import calibrate

    rows = predictions(spark, folder)
    return with_row(rows, fusion.logit_statistics(rows, COMPACT)).select("source_id", calibrate(F.col(COMPACT), F.col("mean"), F.col("std")).alias("calibrated"))


@query("k4_residual_fusion", f"SELECT source_id, {fuse_sql(COMPACT, VISUAL, '0.3')} AS fused FROM predictions", "fused")
def k4(spark, folder):
    from emberfield.functions.columns import residual_fusion

    return predictions(spark, folder).select("source_id", residual_fusion(F.col(COMPACT), F.col(VISUAL), F.lit(0.3)).alias("fused"))


CTES["crossfit"] = f"""
SELECT p.*, alpha, {fuse_sql('c', 'v', 'alpha')} AS score FROM (
  SELECT p.*, {calibrate_sql(COMPACT, 'mc', 'sc')} AS c, {calibrate_sql(VISUAL, 'mv', 'sv')} AS v
  FROM predictions p JOIN (
    SELECT h.country, AVG({logit_sql(COMPACT)}) AS mc, STDDEV_POP({logit_sql(COMPACT)}) AS sc,
           AVG({logit_sql(VISUAL)}) AS mv, STDDEV_POP({logit_sql(VISUAL)}) AS sv
    FROM (SELECT DISTINCT country FROM predictions) h JOIN predictions r ON r.country <> h.country GROUP BY h.country) s USING (country)) p,
  (SELECT CAST(UNNEST([0, 0.15, 0.3, 0.5, 0.7]) AS DOUBLE) AS alpha) a
"""


@query("k5_crossfit_fusion", "SELECT source_id, country, alpha, score FROM crossfit", "alpha score")
def k5(spark, folder):
    return fusion.crossfit_fusion(predictions(spark, folder), COMPACT, VISUAL).select("source_id", "country", "alpha", "score")


def guard_sql(frame, name, baseline):
    return f"""
SELECT m.{name}, ROUND(AVG(m.pr_auc), 12) AS macro_ap, ROUND(AVG(m.pr_auc - b.pr_auc), 12) AS gain,
       COUNT(*) FILTER (ROUND(m.pr_auc - b.pr_auc, 12) > 0) AS improved_countries, ROUND(MIN(m.pr_auc - b.pr_auc), 12) AS worst_delta
FROM {frame} m JOIN (SELECT country, pr_auc FROM {frame} WHERE {name} = {baseline}) b USING (country) GROUP BY m.{name}"""


def pick_sql(body, name, order):
    return f"""
SELECT *, {name} = (SELECT {name} FROM rated WHERE eligible ORDER BY {order} LIMIT 1) AS selected FROM rated"""


CTES["alpha_rows"] = f"SELECT country, is_eog_flare, alpha, score FROM crossfit UNION ALL SELECT country, is_eog_flare, -1, {COMPACT} FROM predictions"
CTES["alpha_curve"] = curve_sql("alpha, country", "alpha_rows")
CTES["alpha_ap"] = f"SELECT alpha, country, {AP} AS pr_auc FROM alpha_curve GROUP BY alpha, country"
GUARD = "(gain >= {g} AND improved_countries >= {n} AND worst_delta >= {w})"


@query(
    "k6_choose_alpha",
    f"WITH rated AS (SELECT *, alpha = 0 OR {GUARD.format(g=0.002, n=3, w=-0.03)} AS eligible FROM ({guard_sql('alpha_ap', 'alpha', -1)}) WHERE alpha >= 0)"
    + pick_sql("", "alpha", "macro_ap DESC, alpha"),
    "alpha macro_ap gain worst_delta",
)
def k6(spark, folder):
    return policy.choose_alpha(predictions(spark, folder), COMPACT, VISUAL)


for _seed in bindings.SEEDS:
    CTES[f"seed{_seed}_metrics"] = f"SELECT * FROM seed_metrics WHERE seed = {_seed}"
    CTES[f"seed{_seed}_scores"] = f"SELECT * FROM seed_scores WHERE seed = {_seed}"
    CTES[f"seed{_seed}_f1"] = MACRO_F1.format(keys="branch", qualified="branch", frame=f"seed{_seed}_scores")
    CTES[f"seed{_seed}_pooled_budgeted"] = budget_sql("branch", f"seed{_seed}_scores", ev.BUDGETS)
    CTES[f"seed{_seed}_pooled_curve"] = curve_sql("branch", f"seed{_seed}_scores")

PER_SEED = []
BY_SEED = ["seed"]


def per_seed(name, one, doubles):
    """Register a query with a result for each seed; ``one`` is its SQL over the tables of one seed."""
    parts = [one.replace("one_seed_", f"seed{s}_").replace("pooled_", f"seed{s}_pooled_") for s in bindings.SEEDS]
    PER_SEED.append(name)
    return query(name, " UNION ALL ".join(f"SELECT {s} AS seed, * FROM ({part})" for s, part in zip(bindings.SEEDS, parts, strict=True)), doubles)


def settled_seed_scores(spark, folder):
    return settle(seed_scores(spark, folder))


def settled_seed_metrics(rows):
    return settle(ev.full_metrics(rows, ["seed", *BRANCH_COUNTRY], THR))


BRANCH_COUNTRY = ["branch", "country"]


@per_seed(
    "k7_choose_candidate",
    f"WITH rated AS (SELECT *, branch = '{BASE}' OR {GUARD.format(g=0.005, n=3, w=-0.03)} AS eligible FROM ({guard_sql('one_seed_metrics', 'branch', repr(BASE))}))"
    + pick_sql("", "branch", "macro_ap DESC, branch"),
    "macro_ap gain worst_delta",
)
def k7(spark, folder):
    return policy.choose_candidate(settled_seed_metrics(settled_seed_scores(spark, folder)), BASE, 3, 0.03, BY_SEED)


@per_seed(
    "k8_global_selection",
    f"""WITH rated AS (SELECT g.*, macro_f1, macro_roc_auc, worst_country_pr_auc, g.branch = '{BASE}' OR {GUARD.format(g=0.005, n=4, w=-0.03)} AS eligible
    FROM ({guard_sql('one_seed_metrics', 'branch', repr(BASE))}) g JOIN (SELECT branch, ROUND(AVG(f1), 12) AS macro_f1, AVG(roc_auc) AS macro_roc_auc,
    MIN(pr_auc) AS worst_country_pr_auc FROM one_seed_metrics GROUP BY branch) s USING (branch))"""
    + pick_sql("", "branch", "macro_ap DESC, macro_f1 DESC, branch"),
    "macro_ap gain worst_delta macro_f1 macro_roc_auc worst_country_pr_auc",
)
def k8(spark, folder):
    return policy.global_selection(settled_seed_metrics(settled_seed_scores(spark, folder)), BASE, BY_SEED)


@per_seed(
    "k9_choose_branch",
    f"""WITH rated AS (SELECT g.*, f.macro_f1, ROUND(f.macro_f1 - b.macro_f1, 12) AS macro_f1_delta,
      g.branch = '{BASE}' OR ({GUARD.format(g=0.005, n=3, w=-0.03)} AND ROUND(f.macro_f1 - b.macro_f1, 12) >= -0.015) AS eligible
    FROM ({guard_sql('one_seed_metrics', 'branch', repr(BASE))}) g JOIN one_seed_f1 f USING (branch), (SELECT macro_f1 FROM one_seed_f1 WHERE branch = '{BASE}') b)"""
    + pick_sql("", "branch", "macro_ap DESC, CASE branch WHEN 'compact_tabular' THEN 0 WHEN 'guarded_cv_tabular' THEN 2 ELSE 9 END, branch"),
    "macro_ap gain worst_delta macro_f1 macro_f1_delta",
)
def k9(spark, folder):
    return policy.choose_branch(settled_seed_scores(spark, folder), keys=BY_SEED)


def conditions_sql(observed, rules):
    """Rules are (name, expression, operator, limit) over the one-row query ``observed``."""
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS name, ROUND(CAST({e} AS DOUBLE), 12) AS observed, '{op} {limit:g}' AS rule, COALESCE(ROUND(CAST({e} AS DOUBLE), 12) {op} {limit}, FALSE) AS passed FROM seen"
        for n, e, op, limit in rules
    )
    return f"WITH seen AS ({observed}) {rows}"


def deltas_sql(frame, baseline=BASE, candidate=CANDIDATE):
    return f"""SELECT country, v.pr_auc - b.pr_auc AS delta, v.f1 - b.f1 AS f1 FROM {frame} b JOIN {frame} v USING (country)
WHERE b.branch = '{baseline}' AND v.branch = '{candidate}'"""


OBSERVED = f"""AVG(delta) AS macro_gain, COUNT(*) FILTER (delta > 0) AS improved, MIN(delta) AS worst,
MAX(delta) FILTER (country = '{SENSITIVE}') AS sensitive, AVG(f1) AS macro_f1_delta"""


@per_seed(
    "k10_selection_guard",
    conditions_sql(
        f"SELECT * FROM (SELECT {OBSERVED} FROM ({deltas_sql('one_seed_metrics')})), (SELECT lower_95 FROM ({bootstrap_sql('source_id', 42, 'one_seed_scores', BASE, CANDIDATE)})) b",
        [
            ("macro_ap_gain", "macro_gain", ">=", 0.01),
            ("improved_countries", "improved", ">=", 4),
            ("worst_country_delta", "worst", ">=", -0.02),
            ("sensitive_country_delta", "sensitive", ">=", -0.02),
            ("bootstrap_lower_95", "lower_95", ">=", -0.01),
            ("macro_f1_delta", "macro_f1_delta", ">=", -0.01),
        ],
    ),
    "observed",
)
def k10(spark, folder):
    rows = settled_seed_scores(spark, folder)
    return policy.selection_guard(settled_seed_metrics(rows), rows, BASE, CANDIDATE, SENSITIVE, PAIRED_REPEATS, 42, BY_SEED)


CTES["population_scores"] = f"""
SELECT country, is_eog_flare, 'population' AS branch, {COMPACT} AS score FROM predictions
UNION ALL SELECT country, is_eog_flare, 'rank_blend', score FROM blended
"""
CTES["population_curve"] = curve_sql("branch, country", "population_scores")
CTES["population_metrics"] = f"SELECT branch, country, {AP} AS pr_auc, 0 AS f1 FROM population_curve GROUP BY branch, country"


@query(
    "k11_population_guard",
    conditions_sql(
        f"SELECT AVG(delta) AS gain, COUNT(*) FILTER (delta > 0) AS improved, MIN(delta) AS worst FROM ({deltas_sql('population_metrics', 'population', 'rank_blend')})",
        [("macro_ap_gain", "gain", ">=", 0.005), ("improved_countries", "improved", ">=", 4), ("worst_country_ap_delta", "worst", ">=", -0.03)],
    ),
    "observed",
)
def k11(spark, folder):
    """Blend the population scores with a second table joined one to one, then guard it."""
    from emberfield.operators.contracts import join_one_to_one

    rows = predictions(spark, folder)
    temporal = rows.select("source_id", "country", VISUAL)
    joined = join_one_to_one(rows.drop(VISUAL), temporal, ["source_id", "country"])
    blend = fusion.rank_blend(joined, COMPACT, VISUAL)
    both = rows.select("country", "is_eog_flare", F.lit("population").alias("branch"), F.col(COMPACT).alias("score")).unionByName(
        blend.select("country", "is_eog_flare", F.lit("rank_blend").alias("branch"), "score")
    )
    return policy.population_guard(ev.average_precision(both, ["branch", "country"]))


CTES["ensemble"] = f"""
SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, AVG({COMPACT}) AS {COMPACT}, AVG({VISUAL}) AS {VISUAL}, AVG({GUARDED}) AS {GUARDED}
FROM seed_predictions GROUP BY ALL HAVING COUNT(*) = 3
"""
CTES["ensemble_scores"] = " UNION ALL ".join(
    f"SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, '{b}' AS branch, ROUND(score_{b}, 9) AS score FROM ensemble" for b in SEED_BRANCHES
)
CTES["ensemble_curve"] = curve_sql("branch, country", "ensemble_scores")
CTES["ensemble_metrics"] = (
    f"SELECT c.*, pr_auc, roc_auc FROM ({confusion_sql('branch, country', 'ensemble_scores', THRESHOLD)}) c "
    f"JOIN (SELECT branch, country, {AP} AS pr_auc, {AUC} AS roc_auc FROM ensemble_curve GROUP BY branch, country) USING (branch, country)"
)
CTES["ensemble_budgeted"] = budget_sql("branch, country", "ensemble_scores", ev.BUDGETS)


def ensemble(spark, folder):
    return fusion.ensemble_predictions(bindings.seed_predictions(spark, folder), [COMPACT, VISUAL, GUARDED])


def ensemble_scores(spark, folder):
    return ev.long_scores(ensemble(spark, folder), SEED_BRANCHES).withColumn("score", F.round("score", 9))


def keyed_alpha_sql(key, frame):
    """Tables of the chosen alpha for each value of ``key``: fused scores, their AP and the rated candidates."""
    fused = f"""
SELECT p.*, alpha, {fuse_sql('c', 'v', 'alpha')} AS score FROM (
  SELECT p.*, {calibrate_sql(COMPACT, 'mc', 'sc')} AS c, {calibrate_sql(VISUAL, 'mv', 'sv')} AS v
  FROM {frame} p JOIN (
    SELECT h.{key}, h.country, AVG({logit_sql(COMPACT)}) AS mc, STDDEV_POP({logit_sql(COMPACT)}) AS sc,
           AVG({logit_sql(VISUAL)}) AS mv, STDDEV_POP({logit_sql(VISUAL)}) AS sv
    FROM (SELECT DISTINCT {key}, country FROM {frame}) h JOIN {frame} r ON r.{key} = h.{key} AND r.country <> h.country
    GROUP BY h.{key}, h.country) s USING ({key}, country)) p,
  (SELECT CAST(UNNEST([0, 0.15, 0.3, 0.5, 0.7]) AS DOUBLE) AS alpha) a"""
    rows = f"SELECT {key}, country, is_eog_flare, alpha, score FROM {key}_fused UNION ALL SELECT {key}, country, is_eog_flare, -1, {COMPACT} FROM {frame}"
    CTES[f"{key}_fused"], CTES[f"{key}_alpha_rows"] = fused, rows
    CTES[f"{key}_alpha_curve"] = curve_sql(f"{key}, alpha, country", f"{key}_alpha_rows")
    CTES[f"{key}_alpha_ap"] = f"SELECT {key}, alpha, country, {AP} AS pr_auc FROM {key}_alpha_curve GROUP BY {key}, alpha, country"
    CTES[f"{key}_alphas"] = f"""
SELECT {key}, alpha FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY macro_ap DESC, alpha) AS rn FROM (
    SELECT m.{key}, m.alpha, ROUND(AVG(m.pr_auc), 12) AS macro_ap, ROUND(AVG(m.pr_auc - b.pr_auc), 12) AS gain,
           COUNT(*) FILTER (ROUND(m.pr_auc - b.pr_auc, 12) > 0) AS improved_countries, ROUND(MIN(m.pr_auc - b.pr_auc), 12) AS worst_delta
    FROM {key}_alpha_ap m JOIN (SELECT {key}, country, pr_auc FROM {key}_alpha_ap WHERE alpha = -1) b USING ({key}, country)
    WHERE m.alpha >= 0 GROUP BY m.{key}, m.alpha)
  WHERE alpha = 0 OR {GUARD.format(g=0.002, n=3, w=-0.03)}) WHERE rn = 1"""


keyed_alpha_sql("seed", "seed_predictions")
_BAD = " OR ".join(f"{c} < 0 OR {c} > 1" for c in (COMPACT, VISUAL))
CTES["seed_panel"] = f"""
SELECT seed, COUNT(*) = COUNT(DISTINCT source_id) AND COUNT(*) FILTER ({_BAD}) = 0
  AND (SELECT COUNT(DISTINCT fingerprint) = 1 AND COUNT(*) = 3 FROM seed_prints) AS passed
FROM seed_predictions GROUP BY seed"""


@query(
    "k12_acceptance",
    conditions_sql(
        f"""SELECT * FROM (SELECT {OBSERVED} FROM ({deltas_sql('ensemble_metrics')})),
  (SELECT lower_95 FROM ({bootstrap_sql('block_id', 13014, 'ensemble_scores', BASE, CANDIDATE, CONFIRM_REPEATS)})) b,
  (SELECT AVG(v.recall - b.recall) AS recall_delta, MIN(v.found - b.found) AS lost
   FROM (SELECT branch, country, COALESCE({FOUND}, 0) AS found, COALESCE({FOUND}, 0) / GREATEST(SUM(is_eog_flare), 1) AS recall FROM ensemble_budgeted WHERE review_fraction = 0.2 GROUP BY branch, country) b
   JOIN (SELECT branch, country, COALESCE({FOUND}, 0) AS found, COALESCE({FOUND}, 0) / GREATEST(SUM(is_eog_flare), 1) AS recall FROM ensemble_budgeted WHERE review_fraction = 0.2 GROUP BY branch, country) v
   USING (country) WHERE b.branch = '{BASE}' AND v.branch = '{CANDIDATE}') r,
  (SELECT MIN(g) AS seed_min, MEDIAN(g) AS seed_median FROM (SELECT seed, AVG(delta) AS g FROM seed_deltas GROUP BY seed)) s,
  (SELECT CAST(BOOL_AND(passed) AS INT) AS integrity FROM seed_panel) i, (SELECT COUNT(*) FILTER (alpha > 0) AS alphas FROM seed_alphas) a""",
        [
            ("integrity_valid", "integrity", ">=", 1),
            ("ensemble_macro_pr_auc_gain", "macro_gain", ">=", 0.01),
            ("ensemble_improved_countries", "improved", ">=", 4),
            ("ensemble_worst_country_pr_auc_delta", "worst", ">=", -0.02),
            ("ensemble_sensitive_country_pr_auc_delta", "sensitive", ">=", -0.02),
            ("ensemble_macro_f1_delta", "macro_f1_delta", ">=", -0.01),
            ("bootstrap_lower_95", "lower_95", ">=", -0.01),
            ("macro_recall_at_20_delta", "recall_delta", ">=", -0.02),
            ("worst_positive_count_loss_at_20", "lost", ">=", -1),
            ("all_seed_macro_pr_auc_gains_positive", "seed_min", ">", 0),
            ("median_seed_macro_pr_auc_gain", "seed_median", ">=", 0.01),
            ("nonzero_full_foreign_seed_alphas", "alphas", ">=", 2),
        ],
    ),
    "observed",
)
def k12(spark, folder):
    panel = settle(bindings.seed_predictions(spark, folder))
    rows = settle(ev.long_scores(fusion.ensemble_predictions(panel, [COMPACT, VISUAL, GUARDED]), SEED_BRANCHES).withColumn("score", F.round("score", 9)))
    seeds = ev.seed_summary(settled_seed_metrics(settle(ev.long_scores(panel, SEED_BRANCHES))), BASE, CANDIDATE)
    return policy.acceptance(
        ev.full_metrics(rows, ["branch", "country"], THR),
        ev.review_budgets(rows, ["branch", "country"]),
        seeds,
        ev.block_bootstrap(rows, BASE, CANDIDATE, CONFIRM_REPEATS, 13014),
        policy.choose_alpha(panel, COMPACT, VISUAL, keys=BY_SEED),
        contracts.panel_complete(panel, [COMPACT, VISUAL]),
        BASE,
        CANDIDATE,
        SENSITIVE,
    )


@per_seed(
    "k13_transfer_decision",
    conditions_sql(
        f"""SELECT MAX(ap) FILTER (branch = '{CANDIDATE}') - MAX(ap) FILTER (branch = '{BASE}') AS ap_delta,
  MAX(s) FILTER (branch = '{CANDIDATE}') - MAX(s) FILTER (branch = '{BASE}') AS site_delta
  FROM (SELECT branch, {AP} AS ap FROM pooled_curve GROUP BY branch)
  JOIN (SELECT branch, {SITES_FOUND} AS s FROM pooled_budgeted WHERE review_fraction = 0.2 GROUP BY branch) USING (branch)""",
        [("pr_auc_delta_at_least_minus_0_01", "ap_delta", ">=", -0.01), ("positive_site_loss_at_20_no_more_than_one", "site_delta", ">=", -1)],
    ),
    "observed",
)
def k13(spark, folder):
    rows, own = settled_seed_scores(spark, folder), ["seed", "branch"]
    return policy.transfer_decision(ev.average_precision(rows, own), ev.review_budgets(rows, own), BASE, CANDIDATE, BY_SEED)


CTES["deployable"] = f"SELECT *, {VISUAL} >= 0.1 AS image_available, ({COMPACT} + {VISUAL}) / 2 AS score_all77_tabular FROM predictions"
REFERENCE = f"""SELECT AVG({logit_sql(COMPACT)}) AS mean_c, STDDEV_POP({logit_sql(COMPACT)}) AS std_c,
AVG({logit_sql(VISUAL)}) AS mean_v, STDDEV_POP({logit_sql(VISUAL)}) AS std_v"""


def deployable(spark, folder):
    return predictions(spark, folder).withColumns(
        {"image_available": F.col(VISUAL) >= 0.1, "score_all77_tabular": (F.col(COMPACT) + F.col(VISUAL)) / 2}
    )


@query(
    "k14_deployment_policy",
    f"""
SELECT source_id, 'compact_tabular' AS branch, {COMPACT} AS deployed FROM deployable
UNION ALL SELECT source_id, 'all77_tabular', CASE WHEN whole THEN score_all77_tabular ELSE {COMPACT} END
FROM deployable JOIN (SELECT country, BOOL_AND(image_available) AS whole FROM deployable GROUP BY country) USING (country)
UNION ALL SELECT source_id, 'guarded_cv_tabular', CASE WHEN image_available THEN {fuse_sql('c', 'v', '0.3')} ELSE c END
FROM (SELECT source_id, image_available, {calibrate_sql(COMPACT, 'mean_c', 'std_c')} AS c, {calibrate_sql(VISUAL, 'mean_v', 'std_v')} AS v
      FROM deployable, ({REFERENCE} FROM predictions) r)""",
    "deployed",
)
def k14(spark, folder):
    rows = deployable(spark, folder)
    references = fusion.reference_statistics(rows, COMPACT, VISUAL)
    parts = [
        fusion.deployment_policy(rows, branch, references=references, alpha=0.3).select("source_id", F.lit(branch).alias("branch"), "deployed")
        for branch in policy.COMPLEXITY
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CTES["pipeline_scores"] = f"""
SELECT source_id, AVG(CASE WHEN available THEN {fuse_sql('c', 'v', 'alpha')} ELSE c END) AS score, AVG(compact) AS baseline
FROM (SELECT source_id, seed, compact, {VISUAL} >= 0.1 AS available, CASE seed WHEN 272 THEN 0.3 WHEN 273 THEN 0.0 ELSE 0.5 END AS alpha,
             {calibrate_sql('compact', 'mean_c', 'std_c')} AS c, {calibrate_sql(VISUAL, 'mean_v', 'std_v')} AS v
      FROM (SELECT *, ({COMPACT} + {COMPACT} * 0.9 + {COMPACT} * 0.8) / 3 AS compact FROM seed_predictions)
      JOIN (SELECT seed, {REFERENCE[7:]} FROM seed_predictions GROUP BY seed) r USING (seed))
GROUP BY source_id"""


@query("k15_seed_pipeline_policy", "SELECT * FROM pipeline_scores", "score baseline")
def k15(spark, folder):
    rows = bindings.seed_predictions(spark, folder)
    compact, visual, references = pipeline_inputs(rows)
    fused = fusion.seed_pipeline_policy(compact, visual, ALPHA_OF_SEED, references)
    plain = fusion.seed_pipeline_policy(compact, None, {}, None, guarded=False).withColumnRenamed("score", "baseline")
    return fused.join(plain, "source_id")


def pipeline_inputs(rows):
    """Scores of three models of each seed, image scores, and the saved calibration of each seed."""
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(COMPACT) * w).alias("score")) for m, w in enumerate((1.0, 0.9, 0.8))]))
    compact = rows.select("source_id", "seed", models.alias("m")).select("source_id", "seed", "m.*")
    visual = rows.select("source_id", "seed", F.col(VISUAL).alias("score"), (F.col(VISUAL) >= 0.1).alias("image_available"))
    return compact, visual, fusion.reference_statistics(rows, COMPACT, VISUAL, ["seed"])


CTES["transfer_scores"] = """
SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, 'compact_tabular' AS branch, ROUND(baseline, 9) AS score
FROM predictions JOIN pipeline_scores USING (source_id) WHERE CAST(source_id AS BIGINT) % 10 <> 3 AND CAST(source_id AS BIGINT) % 20 <> 7
UNION ALL SELECT source_id, country, block_id, is_eog_flare, eog_flare_id, 'guarded_cv_tabular', ROUND(score, 9)
FROM predictions JOIN pipeline_scores USING (source_id) WHERE CAST(source_id AS BIGINT) % 10 <> 3 AND CAST(source_id AS BIGINT) % 20 <> 7"""
CTES["transfer_curve"] = curve_sql("branch", "transfer_scores")
CTES["transfer_budgeted"] = budget_sql("branch", "transfer_scores", ev.BUDGETS)


def transferred(spark, folder):
    """The panel with a log of attempts, of which a tenth failed, and reviews, of which a twentieth object."""
    panel = bindings.predictions(spark, folder)
    number = F.col("source_id").cast("bigint")
    items = panel.select(F.col("source_id").alias("item_id"), F.concat(F.lit("chip_"), "source_id").alias("chip_id"))
    tries = panel.select(
        F.col("source_id").alias("item_id"), number.alias("attempt_id"), F.current_date().alias("attempted_at"),
        F.when(number % 10 == 3, "failed").otherwise("ok").alias("status"), F.concat(F.lit("chip_"), "source_id").alias("chip_id"),
    )
    state = ledger.attempt_ledger(items, tries).select(F.col("item_id").alias("source_id"), "status")
    review = panel.select("source_id", (number % 20 == 7).cast("string").alias("review_reflectance_tail"))
    compact, visual, references = pipeline_inputs(settle(bindings.seed_predictions(spark, folder)))
    return transfer.frozen_transfer(state, panel, review, compact, visual, settle(references), ALPHA_OF_SEED, PAIRED_REPEATS)


@query(
    "k13_frozen_transfer",
    conditions_sql(
        f"""SELECT MAX(ap) FILTER (branch = '{CANDIDATE}') - MAX(ap) FILTER (branch = '{BASE}') AS ap_delta,
  MAX(s) FILTER (branch = '{CANDIDATE}') - MAX(s) FILTER (branch = '{BASE}') AS site_delta
  FROM (SELECT branch, {AP} AS ap FROM transfer_curve GROUP BY branch)
  JOIN (SELECT branch, {SITES_FOUND} AS s FROM transfer_budgeted WHERE review_fraction = 0.2 GROUP BY branch) USING (branch)""",
        [("pr_auc_delta_at_least_minus_0_01", "ap_delta", ">=", -0.01), ("positive_site_loss_at_20_no_more_than_one", "site_delta", ">=", -1)],
    ),
    "observed",
)
def k13_transfer(spark, folder):
    """Gates, frozen pipelines, budgets and the decision, from the attempt log on."""
    return transferred(spark, folder).decision


@query(
    "k13_transfer_metrics",
    f"SELECT branch, MAX(total) AS n, MAX(positives) AS n_pos, {AP} AS pr_auc, {AUC} AS roc_auc FROM transfer_curve GROUP BY branch",
    "pr_auc roc_auc",
)
def k13_metrics(spark, folder):
    return transferred(spark, folder).metrics


@query("k13_transfer_bootstrap", bootstrap_sql("block_id", 13014, "transfer_scores", BASE, CANDIDATE, PAIRED_REPEATS), "mean lower_95 upper_95")
def k13_bootstrap(spark, folder):
    return transferred(spark, folder).bootstrap


@query("k16_ensemble_predictions", "SELECT * FROM ensemble", f"{COMPACT} {VISUAL} {GUARDED}")
def k16(spark, folder):
    return ensemble(spark, folder)


CTES["seed_thresholds"] = BEST.format(keys="seed, branch, country", frame="seed_curve")
CTES["median_threshold"] = "SELECT country, branch, MEDIAN(best_threshold) AS threshold FROM seed_thresholds GROUP BY ALL"


@query(
    "k17_median_thresholds",
    confusion_sql("branch, country", "(SELECT * FROM ensemble_scores JOIN median_threshold USING (country, branch))", "threshold"),
    "thr brier precision recall f1 mcc",
)
def k17(spark, folder):
    best = ev.best_f1_threshold(seed_scores(spark, folder), ["seed", "branch", "country"])
    chosen = lookup(policy.median_thresholds(best.withColumnRenamed("best_threshold", "threshold")))
    rows = ensemble_scores(spark, folder).join(chosen, ["country", "branch"])
    return ev.binary_metrics(rows, ["branch", "country"], F.col("threshold"))


@per_seed(
    "k18_variant_selection",
    f"""
WITH rated AS (
  SELECT branch, ROUND(AVG(pr_auc), 12) AS macro_pr_auc, MIN(pr_auc) AS worst_country_pr_auc, MIN(f1) AS worst_country_f1,
         ANY_VALUE(threshold) AS threshold, ANY_VALUE(macro_f1) AS macro_f1, TRUE AS eligible
  FROM (SELECT c.branch, c.country, c.f1, t.threshold, t.macro_f1
        FROM ({confusion_sql('branch, country', '(SELECT * FROM one_seed_scores JOIN one_seed_f1 USING (branch))', 'threshold')}) c JOIN one_seed_f1 t USING (branch))
  JOIN (SELECT branch, country, pr_auc FROM one_seed_metrics) USING (branch, country) GROUP BY branch)
SELECT * EXCLUDE (eligible) FROM ({pick_sql("", "branch", "macro_f1 DESC, macro_pr_auc DESC, branch")})""",
    "macro_pr_auc worst_country_pr_auc worst_country_f1 threshold macro_f1",
)
def k18(spark, folder):
    return policy.variant_selection(settled_seed_scores(spark, folder), keys=BY_SEED)


CTES["inner_predictions"] = bindings.INNER
CTES["outer_predictions"] = bindings.OUTER
keyed_alpha_sql("held_out", "inner_predictions")
CTES["inner_long"] = f"""
SELECT held_out, source_id, country, is_eog_flare, 'compact_tabular' AS branch, {COMPACT} AS score FROM inner_predictions
UNION ALL SELECT held_out, source_id, country, is_eog_flare, 'all77_tabular', score_all77_tabular FROM inner_predictions
UNION ALL SELECT held_out, source_id, country, is_eog_flare, 'guarded_cv_tabular', score FROM held_out_fused JOIN held_out_alphas USING (held_out, alpha)"""
CTES["inner_curve"] = curve_sql("held_out, branch, country", "inner_long")
CTES["inner_ap"] = f"SELECT held_out, branch, country, {AP} AS pr_auc FROM inner_curve GROUP BY held_out, branch, country"
STEP_F1 = """
SELECT {key}, branch, threshold, macro_f1 FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {key}, branch ORDER BY macro_f1 DESC, threshold) AS rn FROM (
    SELECT {key}, branch, score AS threshold, ROUND(SUM(step) OVER (PARTITION BY {key}, branch ORDER BY score DESC) / countries, 12) AS macro_f1
    FROM (SELECT {key}, branch, score, SUM(2.0 * found / (seen + positives) - COALESCE(2.0 * (found - pos) / NULLIF(seen - n + positives, 0), 0)) AS step
          FROM {curve} GROUP BY {key}, branch, score)
    JOIN (SELECT {key}, branch, COUNT(DISTINCT country) AS countries FROM {curve} GROUP BY {key}, branch) USING ({key}, branch))) WHERE rn = 1"""
CTES["inner_f1"] = STEP_F1.format(key="held_out", curve="inner_curve")
CTES["inner_rated"] = f"""
SELECT g.*, f.threshold, f.macro_f1, g.branch = 'compact_tabular'
    OR ({GUARD.format(g=0.005, n=3, w=-0.03)} AND ROUND(f.macro_f1 - b.macro_f1, 12) >= -0.015) AS eligible
FROM (SELECT m.held_out, m.branch, ROUND(AVG(m.pr_auc), 12) AS macro_ap, ROUND(AVG(m.pr_auc - b.pr_auc), 12) AS gain,
        COUNT(*) FILTER (ROUND(m.pr_auc - b.pr_auc, 12) > 0) AS improved_countries, ROUND(MIN(m.pr_auc - b.pr_auc), 12) AS worst_delta
      FROM inner_ap m JOIN (SELECT held_out, country, pr_auc FROM inner_ap WHERE branch = 'compact_tabular') b USING (held_out, country) GROUP BY ALL) g
JOIN inner_f1 f USING (held_out, branch) JOIN (SELECT held_out, macro_f1 FROM inner_f1 WHERE branch = 'compact_tabular') b USING (held_out)"""
RANK = "CASE branch WHEN 'compact_tabular' THEN 0 WHEN 'all77_tabular' THEN 1 WHEN 'guarded_cv_tabular' THEN 2 ELSE 9 END"
CTES["inner_choices"] = f"""
SELECT held_out, branch, macro_ap, eligible, threshold, macro_f1, alpha,
  eligible AND ROW_NUMBER() OVER (PARTITION BY held_out, eligible ORDER BY macro_ap DESC, {RANK}, branch) = 1 AS selected
FROM inner_rated JOIN held_out_alphas USING (held_out)"""


@query("k19_nested_choices", "SELECT * FROM inner_choices", "macro_ap threshold macro_f1 alpha")
def k19_choices(spark, folder):
    """Alpha, branch and thresholds of every held-out country, all from one table of inner scores."""
    return nested.nested_choices(bindings.inner_predictions(spark, folder))


CTES["outer_long"] = f"""
SELECT source_id, country, is_eog_flare, 'compact_tabular' AS branch, {COMPACT} AS score FROM outer_predictions
UNION ALL SELECT source_id, country, is_eog_flare, 'all77_tabular', score_all77_tabular FROM outer_predictions
UNION ALL SELECT source_id, country, is_eog_flare, 'guarded_cv_tabular', {fuse_sql('c', 'v', 'alpha')} FROM (
  SELECT o.*, alpha, {calibrate_sql(COMPACT, 'mean_c', 'std_c')} AS c, {calibrate_sql(VISUAL, 'mean_v', 'std_v')} AS v
  FROM outer_predictions o JOIN held_out_alphas USING (held_out) JOIN (SELECT held_out, {REFERENCE[7:]} FROM inner_predictions GROUP BY held_out) USING (held_out))"""
CTES["outer_judged"] = """
SELECT o.*, threshold FROM outer_long o JOIN inner_choices c ON c.held_out = o.country AND c.branch = o.branch
UNION ALL SELECT o.* REPLACE ('nested_champion' AS branch), threshold
FROM outer_long o JOIN inner_choices c ON c.held_out = o.country AND c.branch = o.branch WHERE selected"""
CTES["outer_curve"] = curve_sql("branch, country", "outer_judged")


@query(
    "k19_nested_selection",
    f"SELECT * FROM ({confusion_sql('branch, country', 'outer_judged', 'threshold')}) JOIN (SELECT branch, country, {AP} AS pr_auc, {AUC} AS roc_auc FROM outer_curve GROUP BY branch, country) USING (branch, country)",
    "thr brier precision recall f1 mcc pr_auc roc_auc",
)
def k19_selection(spark, folder):
    """Metrics of every branch and of the champion in each held-out country, judged by what the others chose."""
    inner = settle(bindings.inner_predictions(spark, folder))
    choices = nested.nested_choices(inner)
    judged = settle(nested.apply_choices(inner, bindings.outer_predictions(spark, folder), choices))
    return ev.full_metrics(judged, BRANCH_COUNTRY, F.col("threshold"))


CTES["variant_choice"] = """
SELECT held_out, branch, threshold FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY held_out ORDER BY macro_f1 DESC, macro_pr_auc DESC, branch) AS rn
  FROM (SELECT held_out, branch, ROUND(AVG(pr_auc), 12) AS macro_pr_auc FROM inner_ap GROUP BY held_out, branch) JOIN inner_f1 USING (held_out, branch)) WHERE rn = 1"""


@query(
    "k19_nested_variants",
    confusion_sql("branch, country", "(SELECT o.*, threshold FROM outer_long o JOIN variant_choice c ON c.held_out = o.country AND c.branch = o.branch)", "threshold"),
    "thr brier precision recall f1 mcc",
)
def k19_variants(spark, folder):
    """Each held-out country under the variant that the other countries chose."""
    inner, outer = settle(bindings.inner_predictions(spark, folder)), bindings.outer_predictions(spark, folder)
    choices = nested.nested_choices(inner)
    long = nested.apply_choices(inner, outer, choices).where(F.col("branch") != nested.CHAMPION).drop("threshold")
    rows = ev.long_scores(inner, ["compact_tabular", "all77_tabular"]).select("held_out", *nested.KEPT, "branch", "score")
    fused = fusion.crossfit_fusion(inner, COMPACT, VISUAL, keys=["held_out"]).join(lookup(choices.select("held_out", "alpha").distinct()), ["held_out", "alpha"])
    rows = settle(rows.unionByName(fused.select("held_out", *nested.KEPT, F.lit("guarded_cv_tabular").alias("branch"), "score")))
    return ev.binary_metrics(nested.nested_variants(rows, long), BRANCH_COUNTRY, F.col("threshold"))
