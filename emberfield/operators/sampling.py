"""Spatially separated panels, interleaving and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.functions.columns import chip_id, seeded_order
from emberfield.operators.contracts import require
from emberfield.operators.ordering import first_per, row_numbers
from emberfield.session import lookup, settle

LABEL, SITE = "is_eog_flare", "eog_flare_id"


def enriched_panel(
    df: DataFrame, quotas: DataFrame, positive_quota: int, seed: int, complete: bool = True
) -> DataFrame:
    """Per country: one positive per site, then per block, then unlabelled ones in other blocks.

    ``quotas`` is (country, n). Both deduplications are grouped minima over the
    seeded order. A country that cannot fill its quota is an error; unless
    ``complete``, it gives every row it can.
    """
    columns = [*df.columns]
    order = [F.col("_order"), F.col("source_id")]
    frame = settle(df.withColumn("_order", seeded_order(seed, F.col("source_id"))))
    by_site = first_per(frame.where(F.col(LABEL) == 1), ["country", SITE], order)
    by_block = first_per(by_site, ["country", "block_id"], order)
    positive = settle(
        row_numbers(by_block, ["country"], order, "_r").where(F.col("_r") <= positive_quota).drop("_r_group")
    )
    taken = positive.groupBy("country").agg(F.count(F.lit(1)).alias("_p"))
    room = lookup(
        quotas.join(taken, "country", "left").select("country", "n", (F.col("n") - F.coalesce("_p", F.lit(0))).alias("_room"))
    )
    outside = frame.where(F.col(LABEL) == 0).join(
        positive.select("country", "block_id").distinct(), ["country", "block_id"], "left_anti"
    )
    one_each = first_per(outside, ["country", "block_id"], order)
    placed = row_numbers(one_each, ["country"], order, "_r").join(room, "country")
    filler = placed.where(F.col("_r") <= F.col("_room"))
    panel = settle(
        positive.select(*columns, "_order", "_r").unionByName(filler.select(*columns, "_order", "_r"))
    )
    if complete:
        sizes = panel.groupBy("country").agg(F.count(F.lit(1)).alias("_have"))
        short = room.join(sizes, "country", "left").where(F.coalesce("_have", F.lit(0)) != F.col("n"))
        if not short.isEmpty():
            raise ValueError("insufficient distinct blocks for the panel")
    return panel.withColumn("chip_id", chip_id(F.col("country"), F.col("source_id")))


def mixed_panel(
    df: DataFrame, quotas: DataFrame, positive_quota: int, seed: int, complete: bool = True
) -> DataFrame:
    """Enriched panel shuffled again per country; batch_order counts from 0."""
    panel = enriched_panel(df, quotas, positive_quota, seed, complete).drop("_order", "_r")
    mixed = panel.withColumn("_mix", seeded_order(seed + 100, F.col("source_id")))
    placed = row_numbers(mixed, ["country"], [F.col("_mix"), F.col("source_id")], "_r")
    return placed.withColumn("batch_order", F.col("_r") - 1).drop("_mix", "_r", "_r_group")


def interleave(panel: DataFrame) -> DataFrame:
    """One positive, then two unlabelled, in seeded order; leftovers follow.

    Expects ``_r`` (1-based place within label). Sorting the positional key gives
    the final order of a panel whose size is a parameter.
    """
    place = F.col("_r") - 1
    key = F.when(F.col(LABEL) == 1, 3 * place).otherwise(3 * F.floor(place / 2) + 1 + place % 2)
    placed = row_numbers(panel.withColumn("_key", key), ["country"], [F.col("_key"), F.col("source_id")], "_o")
    return placed.withColumn("batch_order", F.col("_o") - 1).drop("_key", "_o", "_o_group", "_r", "_order")


def stable_panel(
    df: DataFrame, country: str, n: int, positive_quota: int, seed: int, complete: bool = True
) -> DataFrame:
    """Frozen, interleaved panel of one country; the same rows on any engine.

    Unless ``complete``, a country all of whose sources are known sites gives those it can.
    """
    if n < 30 or not 1 <= positive_quota < n:
        raise ValueError("need n >= 30 and 1 <= positive_quota < n")
    frame = require_panel(df.where(F.col("country") == country), complete)
    quotas = df.sparkSession.createDataFrame([(country, n)], "country string, n int")
    return interleave(enriched_panel(frame, quotas, positive_quota, seed, complete))


def require_panel(df: DataFrame, both_labels: bool = True) -> DataFrame:
    return require(df, coordinates=True, both_labels=both_labels)


def quota_pilot(
    df: DataFrame, seed: int, positives: int = 8, large: int = 17, small: int = 16, first: int = 4, complete: bool = True
) -> DataFrame:
    """Pilot with ``large`` rows for the first countries in name order, ``small`` for the others."""
    names = df.groupBy("country").agg(F.count(F.lit(1)).alias("_n"))
    placed = row_numbers(names, [], [F.col("country")], "_i")
    quotas = placed.select("country", F.when(F.col("_i") <= first, large).otherwise(small).alias("n"))
    return enriched_panel(df, lookup(quotas), positives, seed, complete).drop("_order", "_r")


def round_robin_batches(panel: DataFrame, size: int) -> DataFrame:
    """Global order by within-country position, then country, cut into batches."""
    placed = row_numbers(panel, [], [F.col("batch_order"), F.col("country"), F.col("source_id")], "_g")
    return placed.withColumns(
        {"position": F.col("_g") - 1, "batch": F.floor((F.col("_g") - 1) / size)}
    ).drop("_g", "_g_group")
