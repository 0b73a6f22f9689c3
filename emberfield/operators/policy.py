"""Selection and acceptance rules over metric tables.

Metric tables hold one row per (branch, country), so everything after the metric
computation is small; it still stays in DataFrames to keep one lazy plan. Rules take
``keys``, such as a seed or a held-out country: one grouped query decides for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.operators import evaluation as ev
from emberfield.operators.fusion import ALPHAS, crossfit_fusion
from emberfield.session import lookup, settle, with_row

COMPLEXITY = {"compact_tabular": 0, "all77_tabular": 1, "guarded_cv_tabular": 2}
# The limits of the selection and of the acceptance.
SELECTION_LIMITS = {
    "macro_ap_gain": 0.01, "improved_countries": 4, "worst_country_delta": -0.02,
    "sensitive_country_delta": -0.02, "bootstrap_lower_95": -0.01, "macro_f1_delta": -0.01,
}
ACCEPTANCE_LIMITS = {
    "macro_pr_auc_gain": 0.010, "improved_countries": 4, "worst_country_pr_auc_delta": -0.020,
    "sensitive_country_pr_auc_delta": -0.020, "macro_f1_delta": -0.010, "bootstrap_lower_95": -0.010,
    "macro_recall_at_20_delta": -0.020, "seed_macro_pr_auc_gain": 0.0, "median_seed_macro_pr_auc_gain": 0.010,
    "positive_loss_at_20": 1, "nonzero_seed_alphas": 2,
}


def beside(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of a table with one row per key, or of a one-row table, next to ``df``."""
    return df.join(F.broadcast(other), list(keys)) if keys else with_row(df, other)  # a row for each key


def guard_table(metrics: DataFrame, baseline: str, name: str = "branch", keys: Sequence[str] = ()) -> DataFrame:
    """Macro AP, gain, improved countries and worst delta of each candidate.

    Rounded to 12 decimals so that exact ties compare as ties.
    """
    base = metrics.where(F.col(name) == baseline).select(*keys, "country", F.col("pr_auc").alias("_b"))
    delta = F.col("pr_auc") - F.col("_b")
    return (
        metrics.join(base, [*keys, "country"])
        .groupBy(*keys, name)
        .agg(
            F.round(F.avg("pr_auc"), 12).alias("macro_ap"),
            F.round(F.avg(delta), 12).alias("gain"),
            F.count_if(F.round(delta, 12) > 0).alias("improved_countries"),
            F.round(F.min(delta), 12).alias("worst_delta"),
        )
    )


def guarded(gain: float, improved: int, worst: float, free: Column) -> Column:
    """Baseline passes freely; others need the gain, the countries and the worst-case limit."""
    return free | (
        (F.col("gain") >= gain) & (F.col("improved_countries") >= improved) & (F.col("worst_delta") >= worst)
    )


def _select(table: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mark the first eligible row of a small candidate table."""
    rows = settle(table)
    best = rows.where("eligible").groupBy(*keys).agg(F.min_by(F.col(name), F.struct(*order)).alias("_best"))
    return beside(rows, best, keys).withColumn("selected", F.col(name) == F.col("_best")).drop("_best")


def choose_alpha(
    df: DataFrame, compact: str, visual: str, alphas: Sequence[float] = ALPHAS, keys: Sequence[str] = ()
) -> DataFrame:
    """Blend strength on inner scores: highest macro AP among eligible, smaller alpha on ties."""
    kept = [*keys, "country", "is_eog_flare"]
    fused = crossfit_fusion(df, compact, visual, alphas, keys).select(*kept, "alpha", "score")
    plain = df.select(*kept, F.lit(-1.0).alias("alpha"), F.col(compact).alias("score"))
    ap = settle(ev.average_precision(fused.unionByName(plain), [*keys, "alpha", "country"]))
    table = guard_table(ap, -1.0, "alpha", keys).where(F.col("alpha") >= 0)
    rated = table.withColumn("eligible", guarded(0.002, 3, -0.03, F.col("alpha") == 0))
    return _select(rated, [-F.col("macro_ap"), F.col("alpha")], "alpha", keys)


def choose_candidate(
    metrics: DataFrame, baseline: str, improved: int, worst_drop: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Inner candidate choice; the name decides ties."""
    rated = guard_table(metrics, baseline, keys=keys).withColumn(
        "eligible", guarded(0.005, improved, -worst_drop, F.col("branch") == baseline)
    )
    return _select(rated, [-F.col("macro_ap"), F.col("branch")], "branch", keys)


def global_selection(metrics: DataFrame, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """Same guard on outer metrics, four countries and 0.03; macro F1 breaks ties."""
    summary = metrics.groupBy(*keys, "branch").agg(
        F.round(F.avg("f1"), 12).alias("macro_f1"),
        F.avg("roc_auc").alias("macro_roc_auc"),
        F.min("pr_auc").alias("worst_country_pr_auc"),
    )
    rated = guard_table(metrics, baseline, keys=keys).join(summary, [*keys, "branch"]).withColumn(
        "eligible", guarded(0.005, 4, -0.03, F.col("branch") == baseline)
    )
    return _select(rated, [-F.col("macro_ap"), -F.col("macro_f1"), F.col("branch")], "branch", keys)


def choose_branch(df: DataFrame, baseline: str = "compact_tabular", keys: Sequence[str] = ()) -> DataFrame:
    """Branch choice on inner scores with an F1 guard; the simpler branch wins ties."""
    ap = settle(ev.average_precision(df, [*keys, "branch", "country"]))
    f1 = settle(ev.macro_f1_threshold(df, [*keys, "branch"]).select(*keys, "branch", "threshold", "macro_f1"))
    table = guard_table(ap, baseline, keys=keys).join(f1.drop("threshold"), [*keys, "branch"])
    base = f1.where(F.col("branch") == baseline).select(*keys, F.col("macro_f1").alias("_f1"))
    rated = (
        beside(table, base, keys)
        .withColumn("macro_f1_delta", F.round(F.col("macro_f1") - F.col("_f1"), 12))
        .drop("_f1")
        .withColumn(
            "eligible",
            guarded(0.005, 3, -0.03, F.col("branch") == baseline)
            & ((F.col("branch") == baseline) | (F.col("macro_f1_delta") >= -0.015)),
        )
    )
    rank = F.create_map(*[F.lit(x) for pair in COMPLEXITY.items() for x in pair])[F.col("branch")]
    return _select(rated, [-F.col("macro_ap"), F.coalesce(rank, F.lit(9)), F.col("branch")], "branch", keys)


def conditions(
    observed: DataFrame, rules: Sequence[tuple[str, str, str, float]], keys: Sequence[str] = ()
) -> DataFrame:
    """Conditions table (keys, name, observed, rule, passed) of a frame with one row of observations per key."""
    tests = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b}
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.round(F.col(column).cast("double"), 12).alias("observed"),
                F.lit(f"{op} {limit:g}").alias("rule"),
                F.coalesce(tests[op](F.round(F.col(column).cast("double"), 12), F.lit(float(limit))), F.lit(False)).alias("passed"),
            )
            for name, column, op, limit in rules
        ]
    )
    return observed.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def verdict(table: DataFrame) -> DataFrame:
    return table.agg(F.bool_and("passed").alias("passed"))


def country_observations(
    metrics: DataFrame, baseline: str, candidate: str, sensitive: str, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per key of AP and F1 differences across countries."""
    by = [*keys, "country"]
    ap = ev.country_deltas(metrics, by, "pr_auc", baseline, candidate)
    f1 = ev.country_deltas(metrics, by, "f1", baseline, candidate).select(*by, F.col("delta").alias("f1"))
    return ap.join(f1, by).groupBy(*keys).agg(
        F.avg("delta").alias("macro_gain"),
        F.count_if(F.col("delta") > 0).alias("improved"),
        F.min("delta").alias("worst"),
        F.max(F.when(F.col("country") == sensitive, F.col("delta"))).alias("sensitive"),
        F.avg("f1").alias("macro_f1_delta"),
    )


def selection_guard(
    metrics: DataFrame, scores: DataFrame, baseline: str, candidate: str, sensitive: str, repeats: int, seed: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Six conditions, one of them the lower bound of the paired bootstrap."""
    seen = country_observations(metrics, baseline, candidate, sensitive, keys)
    boot = settle(ev.paired_bootstrap(scores, baseline, candidate, repeats, seed, keys)).select(*keys, "lower_95")
    limit = SELECTION_LIMITS
    rules = [
        ("macro_ap_gain", "macro_gain", ">=", limit["macro_ap_gain"]),
        ("improved_countries", "improved", ">=", limit["improved_countries"]),
        ("worst_country_delta", "worst", ">=", limit["worst_country_delta"]),
        ("sensitive_country_delta", "sensitive", ">=", limit["sensitive_country_delta"]),
        ("bootstrap_lower_95", "lower_95", ">=", limit["bootstrap_lower_95"]),
        ("macro_f1_delta", "macro_f1_delta", ">=", limit["macro_f1_delta"]),
    ]
    return conditions(beside(seen, boot, keys), rules, keys)


def population_guard(metrics: DataFrame, baseline: str = "population", candidate: str = "rank_blend") -> DataFrame:
    """AP gain of the fixed rank blend at full prevalence."""
    ap = ev.country_deltas(metrics, ["country"], "pr_auc", baseline, candidate)
    seen = ap.agg(
        F.avg("delta").alias("gain"), F.count_if(F.col("delta") > 0).alias("improved"), F.min("delta").alias("worst")
    )
    return conditions(
        seen,
        [
            ("macro_ap_gain", "gain", ">=", 0.005),
            ("improved_countries", "improved", ">=", 4),
            ("worst_country_ap_delta", "worst", ">=", -0.03),
        ],
    )


def acceptance(
    metrics: DataFrame,
    budgets: DataFrame,
    seeds: DataFrame,
    bootstrap: DataFrame,
    alphas: DataFrame,
    panel: DataFrame,
    baseline: str,
    candidate: str,
    sensitive: str,
) -> DataFrame:
    """Twelve named conditions of the confirmatory decision.

    ``alphas`` are the candidates of ``choose_alpha`` with the chosen one of each seed marked,
    ``panel`` are the rows of ``panel_complete``.
    """
    seen = country_observations(metrics, baseline, candidate, sensitive)
    at20 = budgets.where(F.abs(F.col("review_fraction") - 0.2) < 1e-9)
    recall = ev.country_deltas(at20, ["country"], "recall_at_budget", baseline, candidate)
    found = ev.country_deltas(at20, ["country"], "positive_found", baseline, candidate)
    review = recall.join(found.select("country", F.col("delta").alias("lost")), "country").agg(
        F.avg("delta").alias("recall_delta"), F.min("lost").alias("lost")
    )
    gains = seeds.agg(
        F.min("macro_pr_auc_gain").alias("seed_min"),
        F.percentile("macro_pr_auc_gain", F.lit(0.5)).alias("seed_median"),
    )
    row = seen
    whole = panel.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).cast("int").alias("integrity"))
    moved = alphas.where("selected").agg(F.count_if(F.col("alpha") > 0).alias("alphas"))
    for part in (review, gains, bootstrap.select("lower_95"), whole, moved):
        row = with_row(row, part)
    limit = ACCEPTANCE_LIMITS
    return conditions(
        row,
        [
            ("integrity_valid", "integrity", ">=", 1),
            ("ensemble_macro_pr_auc_gain", "macro_gain", ">=", limit["macro_pr_auc_gain"]),
            ("ensemble_improved_countries", "improved", ">=", limit["improved_countries"]),
            ("ensemble_worst_country_pr_auc_delta", "worst", ">=", limit["worst_country_pr_auc_delta"]),
            ("ensemble_sensitive_country_pr_auc_delta", "sensitive", ">=", limit["sensitive_country_pr_auc_delta"]),
            ("ensemble_macro_f1_delta", "macro_f1_delta", ">=", limit["macro_f1_delta"]),
            ("bootstrap_lower_95", "lower_95", ">=", limit["bootstrap_lower_95"]),
            ("macro_recall_at_20_delta", "recall_delta", ">=", limit["macro_recall_at_20_delta"]),
            ("worst_positive_count_loss_at_20", "lost", ">=", -limit["positive_loss_at_20"]),
            ("all_seed_macro_pr_auc_gains_positive", "seed_min", ">", limit["seed_macro_pr_auc_gain"]),
            ("median_seed_macro_pr_auc_gain", "seed_median", ">=", limit["median_seed_macro_pr_auc_gain"]),
            ("nonzero_full_foreign_seed_alphas", "alphas", ">=", limit["nonzero_seed_alphas"]),
        ],
    )


def transfer_decision(
    ap: DataFrame, budgets: DataFrame, baseline: str, candidate: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Keep the candidate unless AP falls by more than 0.01 or over one site is lost at 20 %."""
    delta = ev.country_deltas(ap, keys, "pr_auc", baseline, candidate).select(*keys, F.col("delta").alias("ap_delta"))
    at20 = budgets.where(F.abs(F.col("review_fraction") - 0.2) < 1e-9)
    sites = ev.country_deltas(at20, keys, "sites_found", baseline, candidate).select(*keys, F.col("delta").alias("site_delta"))
    return conditions(
        beside(delta, sites, keys),
        [
            ("pr_auc_delta_at_least_minus_0_01", "ap_delta", ">=", -0.01),
            ("positive_site_loss_at_20_no_more_than_one", "site_delta", ">=", -1),
        ],
        keys,
    )


def median_thresholds(thresholds: DataFrame) -> DataFrame:
    """Median of the seed thresholds (three per country and branch)."""
    return thresholds.groupBy("country", "branch").agg(
        F.percentile("threshold", F.lit(0.5)).alias("threshold"), F.count(F.lit(1)).alias("seeds")
    )


def variant_selection(
    df: DataFrame, by: Sequence[str] = ("macro_f1", "macro_pr_auc"), keys: Sequence[str] = ()
) -> DataFrame:
    """Score variants (``branch``) at their macro-F1 threshold and pick the best by ``by``."""
    own = [*keys, "branch"]
    chosen = lookup(ev.macro_f1_threshold(df, own))
    tables = ev.country_metrics(df.join(chosen, own), [*own, "country"], F.col("threshold"))
    summary = tables.groupBy(*own).agg(
        F.round(F.avg("pr_auc"), 12).alias("macro_pr_auc"), F.min("pr_auc").alias("worst_country_pr_auc"), F.min("f1").alias("worst_country_f1")
    )
    rated = summary.join(chosen, own).withColumn("eligible", F.lit(True))
    return _select(rated, [*[-F.col(c) for c in by], F.col("branch")], "branch", keys).drop("eligible")
