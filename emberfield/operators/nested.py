"""Selection nested inside leave-one-country-out: models keyed by what they never saw, choices by grouped queries.

Inner scores of a held-out country are its rivals' scores from models that saw neither of
the two. A model without the pair {a, b} gives them for both held-out countries: a's rows
serve b, b's rows serve a. So n countries take n (n - 1) / 2 inner fits, not n (n - 1).

All inner scores lie in one table keyed by ``held_out``. Blend strength, branch, variant and
thresholds are chosen for all held-out countries at once by the rules of ``policy`` with
that key, and reach the outer scores by a join with one row for each country. A held-out country's
own labels are in no row of its key, so they cannot move its choices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.operators import evaluation as ev
from emberfield.operators import fusion, policy
from emberfield.operators.folds import leave_country_out
from emberfield.operators.models import FitPredict
from emberfield.session import in_parallel, lookup, settle

HELD, CHAMPION = "held_out", "nested_champion"
MOST_COUNTRIES = 60
"""Countries above which the pairs are refused: each is a fit submitted by the driver."""

KEPT = ("source_id", "country", "block_id", "is_eog_flare", "eog_flare_id")


def held_out_countries(df: DataFrame) -> list[str]:
    """Countries with positives, the only ones that can be judged."""
    names = sorted(r["country"] for r in leave_country_out(df).select("country").limit(MOST_COUNTRIES + 1).collect())
    if len(names) > MOST_COUNTRIES:
        raise ValueError(f"more than {MOST_COUNTRIES} countries")
    return names


def excluded_scores(df: DataFrame, branches: Mapping[str, FitPredict], size: int, countries: Sequence[str] | None = None) -> DataFrame:
    """(excluded, branch, source_id, score): rows of each excluded set from one model of all other rows.

    ``excluded`` is the sorted array of its ``size`` countries; each set and branch is fitted once.
    """
    frame = settle(df)
    names = list(countries) if countries is not None else held_out_countries(frame)

    def one(branch: str, out: tuple[str, ...]) -> DataFrame:
        inside = F.col("country").isin(*out)
        scored = branches[branch](frame.where(~inside), frame.where(inside))
        return settle(scored.select(F.array(*map(F.lit, out)).alias("excluded"), F.lit(branch).alias("branch"), "source_id", "score"))

    steps = [lambda b=b, out=out: one(b, out) for out in combinations(sorted(names), size) for b in branches]
    if not steps:
        raise ValueError(f"fewer than {size} countries to hold out")
    parts = in_parallel(df.sparkSession, steps)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def inner_scores(df: DataFrame, branches: Mapping[str, FitPredict], countries: Sequence[str] | None = None) -> DataFrame:
    """Rows of every other country for each held-out one, with score_<branch> of models that saw neither."""
    scored = excluded_scores(df, branches, 2, countries)
    rows = df.select(*KEPT).join(scored, "source_id")
    rival = F.when(F.col("country") == F.col("excluded")[0], F.col("excluded")[1]).otherwise(F.col("excluded")[0])
    return _wide(rows.withColumn(HELD, rival), branches)


def outer_scores(df: DataFrame, branches: Mapping[str, FitPredict], countries: Sequence[str] | None = None) -> DataFrame:
    """Rows of every held-out country with score_<branch> of models that never saw it."""
    rows = df.select(*KEPT).join(excluded_scores(df, branches, 1, countries), "source_id")
    return _wide(rows.withColumn(HELD, F.col("country")), branches)


def _wide(rows: DataFrame, branches: Mapping[str, FitPredict]) -> DataFrame:
    each = [F.max(F.when(F.col("branch") == b, F.col("score"))).alias(f"score_{b}") for b in branches]
    return rows.groupBy(HELD, *KEPT).agg(*each)


def sides(df: DataFrame, scored: DataFrame) -> DataFrame:
    """(excluded, n_scored, n_trained, positives_trained, seen, repeated): what the model of each excluded set met.

    ``seen`` counts scored rows of countries outside the set, which its model was fitted on.
    """
    one = scored.select("excluded", "source_id").join(df.select("source_id", "country"), "source_id")
    met = one.groupBy("excluded").agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.count_if(~F.array_contains("excluded", F.col("country"))).alias("seen"),
        (F.count(F.lit(1)) - F.count_distinct("source_id")).alias("repeated"),
    )
    counts = lookup(df.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("is_eog_flare").alias("p")))
    outside = met.select("excluded").join(counts, ~F.array_contains("excluded", F.col("country")))  # a row a country
    trained = outside.groupBy("excluded").agg(F.sum("n").alias("n_trained"), F.sum("p").alias("positives_trained"))
    return met.join(trained, "excluded")


def nested_choices(inner: DataFrame, compact: str = "compact_tabular", visual: str = "visual", rivals: Sequence[str] = ("all77_tabular",)) -> DataFrame:
    """(held_out, alpha, branch, threshold, macro_f1, selected): choices of every held-out country from inner scores alone.

    One row per branch; the guarded branch blends compact and visual scores with the chosen alpha.
    """
    inner = settle(inner)
    c, v = f"score_{compact}", f"score_{visual}"
    alphas = lookup(policy.choose_alpha(inner, c, v, keys=[HELD]).where("selected").select(HELD, F.col("alpha").alias("_alpha")))
    fused = fusion.crossfit_fusion(inner, c, v, keys=[HELD]).join(alphas, HELD).where(F.col("alpha") == F.col("_alpha"))
    rows = ev.long_scores(inner, [compact, *rivals]).select(HELD, *KEPT, "branch", "score")
    rows = settle(rows.unionByName(fused.select(HELD, *KEPT, F.lit("guarded_cv_tabular").alias("branch"), "score")))
    chosen = policy.choose_branch(rows, compact, [HELD]).select(HELD, "branch", "macro_ap", "eligible", "selected")
    limits = ev.macro_f1_threshold(rows, [HELD, "branch"])
    return settle(chosen.join(limits, [HELD, "branch"]).join(alphas.withColumnRenamed("_alpha", "alpha"), HELD))


def apply_choices(
    inner: DataFrame, outer: DataFrame, choices: DataFrame, compact: str = "compact_tabular", visual: str = "visual", rivals: Sequence[str] = ("all77_tabular",)
) -> DataFrame:
    """(held_out, rows, branch, score, threshold) of the outer rows: every branch, and the champion of each country.

    The guarded branch is calibrated on the inner scores of the same held-out country.
    """
    c, v = F.col(f"score_{compact}"), F.col(f"score_{visual}")
    references = fusion.reference_statistics(inner, f"score_{compact}", f"score_{visual}", [HELD])
    alphas = lookup(choices.select(HELD, F.col("alpha").alias("_alpha")).distinct())
    fused = fusion.reference_fusion(outer.join(alphas, HELD), references, c, v, F.col("_alpha"), [HELD])
    rows = ev.long_scores(outer, [compact, *rivals]).select(HELD, *KEPT, "branch", "score")
    rows = rows.unionByName(fused.select(HELD, *KEPT, F.lit("guarded_cv_tabular").alias("branch"), F.col("fused").alias("score")))
    judged = rows.join(lookup(choices.select(HELD, "branch", "threshold", "selected")), [HELD, "branch"])
    champion = judged.where("selected").withColumn("branch", F.lit(CHAMPION))
    return judged.unionByName(champion).drop("selected")


def nested_selection(df: DataFrame, branches: Mapping[str, FitPredict]) -> tuple[DataFrame, DataFrame]:
    """Fit, choose and judge: (choices, judged outer rows). ``branches`` are compact, visual and all-feature scorers."""
    inner, outer = settle(inner_scores(df, branches)), settle(outer_scores(df, branches))
    choices = nested_choices(inner)
    return choices, apply_choices(inner, outer, choices)


def nested_variants(inner: DataFrame, outer: DataFrame, by: Sequence[str] = ("macro_f1", "macro_pr_auc")) -> DataFrame:
    """Outer rows under the weighting variant (``branch``) that the inner rows of the same held-out country chose."""
    chosen = policy.variant_selection(inner, by, [HELD]).where("selected").select(HELD, "branch", "threshold")
    return outer.join(lookup(chosen), [HELD, "branch"])
