"""Blending of score branches: late fusion, rank blends, calibrated residual fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions.columns import calibrate, finite_score, logit, residual_fusion
from emberfield.operators.evaluation import average_precision
from emberfield.operators.ordering import percentile_columns
from emberfield.session import lookup, settle, with_row

# The grids and weights of the compared blends.
ALPHAS = (0.0, 0.15, 0.30, 0.50, 0.70)
LATE_WEIGHTS = tuple(i / 8 for i in range(9))
STRUCTURED_WEIGHT = 0.80
KEPT = ("source_id", "country", "block_id", "is_eog_flare", "eog_flare_id")


def late_fusion_weights(df: DataFrame, first: str, second: str, weights: Sequence[float] = LATE_WEIGHTS) -> DataFrame:
    """Macro AP of w*first + (1-w)*second for each weight; the first best is selected."""
    w = F.col("weight")
    blended = df.withColumn("weight", F.explode(F.array(*[F.lit(float(x)) for x in weights]))).withColumn(
        "score", w * F.col(first) + (1 - w) * F.col(second)
    )
    ap = average_precision(blended.select("country", "is_eog_flare", "weight", "score"), ["weight", "country"])
    table = ap.groupBy("weight").agg(F.round(F.avg("pr_auc"), 12).alias("macro_ap"))
    table = settle(table)
    best = table.agg(F.max(F.struct("macro_ap", (-w).alias("low"))).alias("best")).select((-F.col("best.low")).alias("_best"))
    return with_row(table, best).select("weight", "macro_ap", (w == F.col("_best")).alias("selected"))


def late_fusion(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows scored with the selected weight; the weight comes from one selected table row."""
    chosen = late_fusion_weights(df, first, second).where("selected").select("weight")
    return with_row(df, chosen).withColumn(
        "score", F.col("weight") * F.col(first) + (1 - F.col("weight")) * F.col(second)
    )


def rank_blend(df: DataFrame, structured: str, temporal: str, weight: float = STRUCTURED_WEIGHT) -> DataFrame:
    """Fixed mix of within-country percentiles, rounded so that equal mixes tie."""
    ranked = percentile_columns(df, "country", [structured, temporal], "source_id", "_rank")
    mixed = weight * F.col(f"{structured}_rank") + (1 - weight) * F.col(f"{temporal}_rank")
    return ranked.withColumn("score", F.round(mixed, 12))


def logit_statistics(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of a reference score's logits."""
    value = logit(F.col(column))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def crossfit_statistics(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per country: logit mean and deviation of every *other* country of the same key.

    Totals minus own sums, so the work is one aggregation whatever the number of
    countries.
    """
    sums = []
    for c in columns:
        value = logit(F.col(c))
        sums += [F.sum(value).alias(f"s_{c}"), F.sum(value * value).alias(f"q_{c}")]
    own = lookup(df.groupBy(*keys, "country").agg(F.count(F.lit(1)).alias("n"), *sums))
    total = own.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in own.columns if c not in (*keys, "country")])
    both = own.join(lookup(total), list(keys)) if keys else with_row(own, total)
    n = F.col("t_n") - F.col("n")
    out = {}
    for c in columns:
        mean = (F.col(f"t_s_{c}") - F.col(f"s_{c}")) / n
        out[f"mean_{c}"] = mean
        out[f"std_{c}"] = F.sqrt(F.greatest((F.col(f"t_q_{c}") - F.col(f"q_{c}")) / n - mean * mean, F.lit(0.0)))
    return both.select(*keys, "country", *[v.alias(k) for k, v in out.items()])


def crossfit_fusion(
    df: DataFrame, compact: str, visual: str, alphas: Sequence[float] = ALPHAS, keys: Sequence[str] = ()
) -> DataFrame:
    """Fused score per alpha; each country is calibrated on the other countries only."""
    stats = lookup(crossfit_statistics(df, [compact, visual], keys))
    c = calibrate(F.col(compact), F.col(f"mean_{compact}"), F.col(f"std_{compact}"))
    v = calibrate(F.col(visual), F.col(f"mean_{visual}"), F.col(f"std_{visual}"))
    return (
        df.join(stats, [*keys, "country"])
        .withColumns({"_c": c, "_v": v, "alpha": F.explode(F.array(*[F.lit(float(a)) for a in alphas]))})
        .withColumn("score", finite_score(residual_fusion(F.col("_c"), F.col("_v"), F.col("alpha"))))
        .select(*df.columns, "alpha", "score")
    )


def reference_fusion(
    df: DataFrame, references: DataFrame, compact: Column, visual: Column, alpha: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Fuse with saved reference statistics (mean_c, std_c, mean_v, std_v), one row per key."""
    joined = df.join(lookup(references), list(keys)) if keys else with_row(df, references)
    calibrated = calibrate(compact, F.col("mean_c"), F.col("std_c"))
    image = calibrate(visual, F.col("mean_v"), F.col("std_v"))
    return joined.withColumns({"calibrated": calibrated, "fused": residual_fusion(calibrated, image, alpha)}).drop(
        "mean_c", "std_c", "mean_v", "std_v"
    )


def reference_statistics(df: DataFrame, compact: str, visual: str, keys: Sequence[str] = ()) -> DataFrame:
    c, v = logit(F.col(compact)), logit(F.col(visual))
    return df.groupBy(*keys).agg(
        F.avg(c).alias("mean_c"), F.stddev_pop(c).alias("std_c"), F.avg(v).alias("mean_v"), F.stddev_pop(v).alias("std_v")
    )


def deployment_policy(
    df: DataFrame,
    branch: str,
    compact: str = "score_compact_tabular",
    visual: str = "score_visual",
    all77: str = "score_all77_tabular",
    available: str = "image_available",
    references: DataFrame | None = None,
    alpha: float = 0.0,
) -> DataFrame:
    """Deployed score with the compact fallback where the image is absent.

    The all-feature branch is used only in countries where every row has an
    image; the fused branch falls back to the calibrated compact score.
    """
    if branch == "compact_tabular":
        return df.withColumn("deployed", finite_score(F.col(compact), compact))
    if branch == "all77_tabular":
        whole = lookup(df.groupBy("country").agg(F.bool_and(available).alias("_whole")))
        return df.join(whole, "country").withColumn(
            "deployed", finite_score(F.when(F.col("_whole"), F.col(all77)).otherwise(F.col(compact)), "deployed")
        ).drop("_whole")
    if branch == "guarded_cv_tabular":
        if references is None:
            raise ValueError("no reference statistics given for the fused branch")
        fused = reference_fusion(df, references, F.col(compact), F.col(visual), F.lit(float(alpha)))
        return fused.withColumn(
            "deployed", finite_score(F.when(F.col(available), F.col("fused")).otherwise(F.col("calibrated")), "deployed")
        ).drop("fused", "calibrated")
    raise ValueError(f"unknown deployment branch {branch}")


def seed_pipeline_policy(
    compact: DataFrame, visual: DataFrame | None, alphas: dict[int, float], references: DataFrame | None, guarded: bool = True
) -> DataFrame:
    """Mean over seeds of per-seed pipelines; the baseline is the raw mean of all models.

    ``compact`` is (source_id, seed, model, score), ``visual`` (source_id, seed,
    score, image_available), ``references`` one row of statistics per seed.
    """
    by_seed = compact.groupBy("source_id", "seed").agg(F.avg(finite_score(F.col("score"))).alias("compact"))
    if not guarded:
        return by_seed.groupBy("source_id").agg(F.avg("compact").alias("score"))
    if visual is None or references is None:
        raise ValueError("visual scores and reference statistics of all seeds are needed")
    if any(a not in ALPHAS for a in alphas.values()):
        raise ValueError(f"seed alpha outside the grid {ALPHAS}")
    alpha = F.create_map(*[F.lit(x) for pair in alphas.items() for x in pair])[F.col("seed")]
    rows = by_seed.join(visual.withColumnRenamed("score", "visual"), ["source_id", "seed"])
    fused = reference_fusion(rows, references, F.col("compact"), F.col("visual"), alpha, ["seed"])
    score = finite_score(F.when(F.col("image_available"), F.col("fused")).otherwise(F.col("calibrated")))
    return fused.groupBy("source_id").agg(F.avg(score).alias("score"))


def ensemble_predictions(df: DataFrame, columns: Sequence[str], seeds: int = 3) -> DataFrame:
    """Mean score over seeds; a source missing a seed or a score is an error."""
    complete = (F.count(F.lit(1)) == seeds) & (F.count_distinct("seed") == seeds)
    for c in columns:
        complete = complete & (F.count(c) == seeds)
    out = df.groupBy(*KEPT).agg(complete.alias("_ok"), *[F.avg(c).alias(c) for c in columns])
    checked = F.when(F.col("_ok"), F.lit(True)).otherwise(F.raise_error(F.lit("incomplete seed panel")).cast("boolean"))
    return out.where(checked).drop("_ok")
