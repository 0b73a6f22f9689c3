"""Scorer, feature-table and report queries: rules and scaled scores have oracles, fitted models are checked by shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators import evaluation as ev
from emberfield.operators import features as ft
from emberfield.operators import folds, nested, policy
from emberfield.operators import models as md
from emberfield.plans.audit_queries import scratch
from emberfield.plans.evaluation_queries import confusion_sql, scores
from emberfield.plans.feature_queries import labelled_window, located_window
from emberfield.plans.registry import CTES, query
from emberfield.plans.sampling_queries import CTES as _FOLD_TABLES  # noqa: F401  registers fold_blocks first
from emberfield.session import settle, with_row
from emberfield.sources import bindings, ingest

COLUMNS = list(ft.THERMAL_RAW)
WIDTH, VIEWS = 32, 2
PROTOCOL = "grouped-nested"


def panel(spark, folder):
    """Labelled window features, written once: every fit reads them again."""
    return settle(labelled_window(spark, folder))


def split(spark, folder):
    """Training countries and the hold-out country."""
    rows = panel(spark, folder)
    held = F.col("country") == bindings.HOLDOUT
    return rows.where(~held), rows.where(held)


def calendar(spark, folder):
    days = ft.active_days(located_window(spark, folder))
    profile = ft.calendar_profile(days).withColumns(ft.persistence_columns() | ft.seasonality_columns())
    labels = labelled_window(spark, folder, lambda w: w.select("source_id").distinct())
    return labels.join(profile.drop("_months"), "source_id")


CTES["rule_scores"] = """
SELECT source_id, country, is_eog_flare, 'n_days>=' || d || ' & month_entropy>=' || FORMAT('{:.1f}', e) AS branch,
       CASE WHEN n_days >= d AND ROUND(month_entropy, 12) >= e THEN 1.0 ELSE 0.0 END AS score
FROM labelled_features, (SELECT UNNEST([5, 10, 30, 60]) AS d) a, (SELECT CAST(UNNEST([0.0, 0.5, 0.7]) AS DOUBLE) AS e) b
"""


@query("i1_persistence_rule", confusion_sql("branch", "rule_scores", "0.5"), "thr brier precision recall f1 mcc")
def i1(spark, folder):
    return ev.binary_metrics(md.persistence_rule(calendar(spark, folder)), ["branch"], 0.5)


SCALED = ("n_days", "duty_cycle", "n_months", "span_days")


@query(
    "i2_persistence_score",
    " UNION ALL ".join(
        f"SELECT source_id, is_eog_flare, '{c}' AS branch, (COALESCE({c}, 0) - MIN(COALESCE({c}, 0)) OVER ()) / (MAX(COALESCE({c}, 0)) OVER () - MIN(COALESCE({c}, 0)) OVER () + 1e-9) AS score FROM labelled_features"
        for c in SCALED
    ),
    "score",
)
def i2(spark, folder):
    return md.persistence_score(calendar(spark, folder), SCALED).select("source_id", "is_eog_flare", "branch", "score")


@query("i3_isolation_rank")
def i3(spark, folder):
    rows = panel(spark, folder)
    return md.isolation_rank(rows, COLUMNS).select("source_id", "country", "score")


@query("i4_gbt_score")
def i4(spark, folder):
    train, test = split(spark, folder)
    return md.gbt_score(COLUMNS)(train, test)


@query("i4_weighted_gbt_score")
def i4_weighted(spark, folder):
    """Trees weighted by country balance and equal site mass, from training rows only."""
    train, test = split(spark, folder)
    return md.gbt_score(COLUMNS, weight="weight")(settle(folds.sample_weights(train, 0.5, True)), test)


@query("i5_pu_gbt_score")
def i5(spark, folder):
    train, test = split(spark, folder)
    return md.pu_gbt_score(COLUMNS, bags=3)(train, test)


@query("i6_seed_ensemble")
def i6(spark, folder):
    train, test = split(spark, folder)
    return md.seed_ensemble(COLUMNS, 71)(train, test)


def vectors(spark, folder):
    rows = bindings.table(spark, folder, "embeddings")
    return rows.select(
        F.col("vec_id").cast("string").alias("source_id"),
        F.concat(F.lit("C"), (F.col("vec_id") % 6).cast("string")).alias("country"),
        (F.col("label") == 0).cast("int").alias("is_eog_flare"),
        "embedding",
        F.when(F.col("vec_id") % 5 != 0, F.col("embedding")[0].cast("double")).alias("aux_value"),
    )


@query(
    "i7_normalise_views",
    """
SELECT vec_id, pos, x / GREATEST(SQRT(SUM(x * x) OVER (PARTITION BY vec_id, (pos - 1) // 32)), 1e-12) AS value
FROM (SELECT vec_id, UNNEST(RANGE(1, 65)) AS pos, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings)""",
    "value",
)
def i7_views(spark, folder):
    rows = bindings.table(spark, folder, "embeddings")
    parts = F.posexplode(md.normalise_views(F.col("embedding"), WIDTH, VIEWS)).alias("pos", "value")
    return rows.select("vec_id", parts).withColumn("pos", F.col("pos") + 1)


@query("i7_embedding_features")
def i7(spark, folder):
    rows = vectors(spark, folder)
    held = F.col("country") == bindings.HOLDOUT
    out = md.embedding_features(rows.where(~held), rows.where(held), 12, WIDTH, VIEWS)
    return out.select("source_id", "pca")


@query("i8_oof_predict")
def i8(spark, folder):
    """Grouped out-of-fold scores; blocks of one known site stay together."""
    train, _ = split(spark, folder)
    safe = folds.site_safe_blocks(train)
    grouped = folds.grouped_folds(train.join(safe, ["country", "block_id"]), 3, "evaluation_block")
    return md.oof_predict(grouped, "fold", md.logistic_score(COLUMNS), range(3)).select("source_id", "fold", "is_eog_flare", "score")


@query("i9_visual_pu_score")
def i9(spark, folder):
    rows = settle(vectors(spark, folder))
    held = F.col("country") == bindings.HOLDOUT
    return md.visual_pu_score(["aux_value"], 12, width=WIDTH, views=VIEWS)(rows.where(~held), rows.where(held))


@query("i10_frozen_score")
def i10(spark, folder):
    train, test = split(spark, folder)
    place = scratch(spark)
    md.freeze(md.fit_tabular(train, COLUMNS, md.logistic()), place, COLUMNS, 0.5, PROTOCOL, bindings.HOLDOUT)
    model, columns, threshold = md.thaw(spark, place, PROTOCOL, bindings.HOLDOUT)
    return md.frozen_score(model, test, columns, threshold, bindings.HOLDOUT)


SIDES = """
SELECT fold, COUNT(*) AS n_test, (SELECT COUNT(*) FROM folded) - COUNT(*) AS n_train, SUM(is_eog_flare) AS positives_test,
  (SELECT SUM(is_eog_flare) FROM folded) - SUM(is_eog_flare) AS positives_train, 0 AS shared_blocks, 0 AS unsound_scores, 0 AS repeated_sources
FROM (SELECT source_id, block_id, is_eog_flare, fold FROM predictions JOIN fold_blocks USING (block_id)) AS folded GROUP BY fold"""


@query("i8_fold_sides", SIDES.replace("FROM folded", "FROM (SELECT source_id, block_id, is_eog_flare, fold FROM predictions JOIN fold_blocks USING (block_id))"))
def i8_sides(spark, folder):
    """What each fold's fit and score saw: sizes and classes of both sides, blocks on both, scores that are no probability."""
    grouped = settle(folds.grouped_folds(bindings.predictions(spark, folder), 5))
    columns = ["score_compact_tabular", "score_visual"]
    scored = settle(md.oof_predict(grouped, "fold", md.logistic_score(columns), range(5)))
    folds_of = grouped.groupBy("block_id").agg(F.count_distinct("fold").alias("k"))
    own = scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("is_eog_flare").alias("positives_test"),
        F.count_if(~F.col("score").between(0, 1) | F.col("score").isNull()).alias("unsound_scores"),
        (F.count(F.lit(1)) - F.count_distinct("source_id")).alias("repeated_sources"),
    )
    shared = grouped.join(folds_of.where("k > 1"), "block_id").groupBy("fold").agg(F.count_distinct("block_id").alias("shared_blocks"))
    whole = grouped.agg(F.count(F.lit(1)).alias("_n"), F.sum("is_eog_flare").alias("_p"))
    return with_row(own, whole).join(shared, "fold", "left").select(
        "fold", "n_test", (F.col("_n") - F.col("n_test")).alias("n_train"), "positives_test",
        (F.col("_p") - F.col("positives_test")).alias("positives_train"), F.coalesce("shared_blocks", F.lit(0)).alias("shared_blocks"),
        "unsound_scores", "repeated_sources",
    )


@query(
    "i8_pair_sides",
    """
SELECT a.country || '|' || b.country AS excluded, a.n + b.n AS n_scored, t.n - a.n - b.n AS n_trained, t.p - a.p - b.p AS positives_trained, 0 AS seen, 0 AS repeated
FROM (SELECT country, COUNT(*) AS n, SUM(is_eog_flare) AS p FROM predictions GROUP BY country) a
JOIN (SELECT country, COUNT(*) AS n, SUM(is_eog_flare) AS p FROM predictions GROUP BY country) b ON a.country < b.country,
(SELECT COUNT(*) AS n, SUM(is_eog_flare) AS p FROM predictions) t""",
)
def i8_pairs(spark, folder):
    """What the boosted trees of each excluded pair of countries were fitted on and scored."""
    rows = settle(bindings.predictions(spark, folder))
    scorer = md.gbt_score(["score_compact_tabular", "score_visual"])
    met = nested.sides(rows, nested.excluded_scores(rows, {"compact_tabular": scorer}, 2))
    return met.withColumn("excluded", F.array_join("excluded", "|")).select("excluded", "n_scored", "n_trained", "positives_trained", "seen", "repeated")


def nested_branches():
    """Boosted trees on calendar and on all thermal features, and a linear scorer beside them."""
    calendar_columns = [c for c in COLUMNS if c in ("n_days", "n_months", "span_days", "duty_cycle", "month_entropy", "n_det")]
    return {
        "compact_tabular": md.gbt_score(calendar_columns or COLUMNS[:6]), "all77_tabular": md.gbt_score(COLUMNS), "visual": md.logistic_score(COLUMNS),
    }


@query("k19_nested_fits")
def k19_fits(spark, folder):
    """The whole nested protocol: pair-excluded fits, choices without the held-out country, outer fits judged once."""
    train, _ = split(spark, folder)
    _, judged = nested.nested_selection(train, nested_branches())
    return ev.full_metrics(settle(judged), ["branch", "country"], F.col("threshold"))


@query("d18_group_ablation")
def d18_ablation(spark, folder):
    """Boosted trees on every cumulative and leave-one-out feature group, each judged on the hold-out country."""
    train, test = split(spark, folder)
    sets = ft.group_sets(ft.feature_columns(train.drop("is_eog_flare", "eog_flare_id", "block_id")))
    return ev.ablation_table(settle(md.feature_ablation(train, test, sets)), "branch")


@query("i11_feature_importance")
def i11(spark, folder):
    train, _ = split(spark, folder)
    fits = [md.fit_tabular(train, COLUMNS, md.gbt(seed)) for seed in (17, 118, 219)]
    return md.feature_importance(fits, train)


@query("k18_variant_training")
def k18_training(spark, folder):
    """Weighting variants trained out of fold, then selected on macro F1."""
    train, _ = split(spark, folder)
    grouped = settle(folds.grouped_folds(train, 3))
    parts = None
    for name, alpha, balance in (("unweighted", 0.0, False), ("site_balanced", 0.0, True), ("equal_country_site", 1.0, True)):

        def fit_predict(fit, held, alpha=alpha, balance=balance):
            weighted = settle(folds.sample_weights(fit, alpha, balance))
            return md.logistic_score(COLUMNS, "weight")(weighted, held)

        scored = md.oof_predict(grouped, "fold", fit_predict, range(3)).select(
            "source_id", "country", "is_eog_flare", "eog_flare_id", F.lit(name).alias("branch"), "score"
        )
        scored = settle(scored)
        parts = scored if parts is None else parts.unionByName(scored)
    return policy.variant_selection(parts)


@query("k19_nested_loco")
def k19(spark, folder):
    """Metrics of every country judged by a threshold learned without it."""
    train, _ = split(spark, folder)
    scored = md.nested_loco(train, md.logistic_score(COLUMNS))
    return ev.country_metrics(scored, ["country"], F.col("threshold"))


@query("a7_load_features", "SELECT source_id, country, n_days FROM labelled_features WHERE country IN ('C0', 'C3')")
def a7(spark, folder):
    """Write the calendar features partitioned by country, load two countries back."""
    target = scratch(spark)
    rows = calendar(spark, folder).select("source_id", "country", "n_days")
    rows.write.partitionBy("country").parquet(target)
    return ingest.load_features(spark, target, ["C0", "C3"])


@query(
    "a8_write_report",
    "SELECT branch, country, n, tp, fp, fn, tn, f1 FROM country_confusion",
    "f1",
)
def a8(spark, folder):
    """Write a metric table as CSV and read it under its own schema."""
    table = ev.binary_metrics(scores(spark, folder), ["branch", "country"], 0.55).select("branch", "country", "n", "tp", "fp", "fn", "tn", "f1")
    target = scratch(spark)
    ingest.write_report(table, target)
    return spark.read.schema(table.schema).option("header", True).csv(target)
