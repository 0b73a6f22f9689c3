"""Frozen transfer to an untouched country: gates on the ledger and the panel, then scores, metrics and a decision.

Nothing is fitted or chosen here. Each gate looks at the state that the steps before left
and refuses to go on: attempts still pending, a panel row without record, images that fail
the quality review, too little coverage or too few labels, seeds that the frozen
pipelines do not cover. What passes is scored by the frozen seed pipelines, and ranked,
budgeted, bootstrapped and decided by the operators that do so elsewhere.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.functions.columns import is_true
from emberfield.operators import evaluation as ev
from emberfield.operators import fusion, policy
from emberfield.operators.contracts import join_one_to_one
from emberfield.session import settle

# The gates of the protocol.
MIN_COVERAGE, MIN_POSITIVES, MIN_UNLABELLED = 0.8, 20, 40
BASE, CANDIDATE = "compact_tabular", "guarded_cv_tabular"
KEPT = ("source_id", "country", "block_id", "is_eog_flare", "eog_flare_id")


@dataclass
class Transfer:
    """Tables of one transfer; scores are long over ``branch``."""

    scores: DataFrame
    metrics: DataFrame
    budgets: DataFrame
    bootstrap: DataFrame
    decision: DataFrame


def refuse_pending(ledger: DataFrame) -> None:
    """No scoring while an item has neither succeeded nor failed."""
    pending = ledger.where(F.col("status") == "pending").count()
    if pending:
        raise ValueError(f"{pending} items are still pending")


def approved(ledger: DataFrame, panel: DataFrame, quality: DataFrame) -> DataFrame:
    """Rows of the panel whose attempt succeeded and whose image passed the review; refused below the gates.

    ``ledger`` is (source_id, status), ``quality`` (source_id, review_reflectance_tail), one row for each
    source. A panel row without a ledger row is an error; one without a quality row is not approved.
    """
    refuse_pending(ledger)
    states = join_one_to_one(panel, ledger.select("source_id", "status"), ["source_id"], "left")
    reviewed = join_one_to_one(states, quality.select("source_id", "review_reflectance_tail"), ["source_id"], "left")
    reviewed = settle(reviewed)
    known = reviewed.agg(F.count(F.lit(1)).alias("n"), F.count("status").alias("known")).first()
    if known.n != known.known:
        raise ValueError(f"{known.n - known.known} panel rows have no ledger row")
    clean = F.col("review_reflectance_tail").isNotNull() & ~is_true(F.col("review_reflectance_tail"))
    passed = settle(reviewed.where((F.col("status") == "ok") & clean).drop("status", "review_reflectance_tail"))
    label = F.col("is_eog_flare")
    row = passed.agg(F.count(F.lit(1)).alias("n"), F.count_if(label == 1).alias("positives"), F.count_if(label == 0).alias("unlabelled")).first()
    if row.n < MIN_COVERAGE * known.n or not known.n:
        raise ValueError(f"only {row.n} of {known.n} panel rows passed the review")
    if row.positives < MIN_POSITIVES or row.unlabelled < MIN_UNLABELLED:
        raise ValueError("approved rows hold too few labels of a kind")
    return passed


def check_seeds(compact: DataFrame, visual: DataFrame, references: DataFrame, alphas: Mapping[int, float], cohort: DataFrame) -> None:
    """Every approved source has scores of exactly the frozen seeds, and every seed a calibration."""
    seeds = sorted(alphas)
    if sorted(r.seed for r in references.select("seed").limit(len(seeds) + 1).collect()) != seeds:
        raise ValueError("calibration does not cover the frozen seeds")
    for table in (compact, visual):
        own = table.join(cohort.select("source_id"), "source_id", "left_semi").groupBy("source_id")
        each = own.agg(F.array_sort(F.collect_set("seed")).alias("seeds"))  # as many as there are seeds
        whole = each.where(F.col("seeds") == F.array(*map(F.lit, seeds))).count()
        if whole != cohort.count():
            raise ValueError("scores do not cover the frozen seeds of every approved source")


def frozen_transfer(
    ledger: DataFrame,
    panel: DataFrame,
    quality: DataFrame,
    compact: DataFrame,
    visual: DataFrame,
    references: DataFrame,
    alphas: Mapping[int, float],
    repeats: int = 2000,
    seed: int = 13014,
) -> Transfer:
    """All steps behind the gates.

    ``compact`` is (source_id, seed, model, score), ``visual`` (source_id, seed, score, image_available),
    ``references`` the saved calibration of each seed.
    """
    cohort = approved(ledger, panel, quality)
    check_seeds(compact, visual, references, alphas, cohort)
    ours = cohort.select("source_id")
    inside = [t.join(ours, "source_id", "left_semi") for t in (compact, visual)]
    candidate = fusion.seed_pipeline_policy(*inside, dict(alphas), references).withColumnRenamed("score", f"score_{CANDIDATE}")
    base = fusion.seed_pipeline_policy(inside[0], None, {}, None, guarded=False).withColumnRenamed("score", f"score_{BASE}")
    wide = cohort.select(*KEPT).join(base, "source_id").join(candidate, "source_id")
    scores = settle(ev.long_scores(wide, [BASE, CANDIDATE]).withColumn("score", F.round("score", 9)))
    ranked = ev.ranking(scores, ["branch"], ["n", "n_pos", "pr_auc", "roc_auc"])
    metrics, budgets = settle(ranked), settle(ev.review_budgets(scores, ["branch"]))
    return Transfer(
        scores, metrics, budgets, ev.block_bootstrap(scores, BASE, CANDIDATE, repeats, seed),
        policy.transfer_decision(metrics, budgets, BASE, CANDIDATE),
    )
