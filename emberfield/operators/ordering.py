"""Distributed ordered computations: running totals, row numbers, ranks, quantiles.

A window ordered inside one country would sort that whole country in a single
task. Here rows are range-partitioned on (keys, order), the slices are written
once so their bounds cannot move, and each slice only needs the totals of the
slices before it. A key holding most of the table is spread over many slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.session import lookup, settle

HOT_GROUP_ROWS = 50_000
"""Groups above this size take the narrowed way to their quantiles."""

BINS_A_FOLD = 64
"""Bins for each e-fold of magnitude when the quantiles of hot groups are narrowed down."""


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums ``name`` and group sums ``name_group``.

    ``order`` must be total within the keys wherever ties matter; keys must not
    be NULL. Data that fits one slice skips the offsets.
    """
    keys = list(keys) or ["_whole"]
    values = {f"_v_{name}": value for name, value in totals.items()}
    base = df.withColumns(values if keys != ["_whole"] else {**values, "_whole": F.lit(0)})
    placed = settle(
        base.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id())
    )
    helpers = ["_slice", "_whole", *values]
    if placed.rdd.getNumPartitions() == 1:
        # Adaptive execution merged everything into one slice of ordinary size.
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        sums = {n: F.sum(f"_v_{n}").over(upto) for n in totals}
        return placed.withColumns(sums | {f"{n}_group": F.sum(f"_v_{n}").over(whole) for n in totals}).drop(*helpers)
    per_slice = placed.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals])
    span = Window.partitionBy(*keys)
    earlier = span.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in totals],
        *[F.sum(f"_t_{n}").over(span).alias(f"{n}_group") for n in totals],
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(offsets, [*keys, "_slice"])
        .withColumns({n: F.sum(f"_v_{n}").over(within) + F.col(f"_b_{n}") for n in totals})
        .drop(*helpers, *[f"_b_{n}" for n in totals])
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row") -> DataFrame:
    """Exact ``row_number`` plus the group size ``<name>_group``."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ascending order, as a map-side combined minimum."""
    columns = df.columns
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")
    )
    return picked.select(*[F.col("_row")[c].alias(c) for c in columns])


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form (keys, metric, value) of numeric columns."""
    return df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("_m"),
    ).select(*keys, "_m.metric", "_m.value")


def value_ranks(df: DataFrame, keys: Sequence[str], nulls_last: bool = False) -> DataFrame:
    """Average-rank percentile of each distinct (keys, value) of a ``value`` column.

    NULL values get no rank, or the highest one with ``nulls_last``, in which case
    the denominator counts every row.
    """
    kept = df if nulls_last else df.where(F.col("value").isNotNull())
    cells = kept.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    ran = running_totals(cells, keys, [F.col("value").asc_nulls_last()], {"_upto": F.col("_n")})
    return ran.select(
        *keys,
        "value",
        ((F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_upto_group")).alias("pct"),
    )


def percentile_columns(
    df: DataFrame,
    group: str,
    columns: Sequence[str],
    identifier: str,
    suffix: str = "_country_pct",
    nulls_last: bool = False,
) -> DataFrame:
    """Within-group average-rank percentiles of several columns, joined back by id.

    The rows are written once: they feed both the ranking and the join back.
    """
    df = settle(df)
    long = melt(df, [identifier, group], columns)
    ranks = value_ranks(long, [group, "metric"], nulls_last)
    same = F.col("l.value").eqNullSafe(F.col("r.value")) if nulls_last else F.col("l.value") == F.col("r.value")
    ranked = (
        long.alias("l")
        .join(
            ranks.alias("r"),
            (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col("l.metric") == F.col("r.metric")) & same,
        )
        .select(f"l.{identifier}", "l.metric", "r.pct")
    )
    wide = ranked.groupBy(identifier).agg(
        *[F.max(F.when(F.col("metric") == c, F.col("pct"))).alias(c + suffix) for c in columns]
    )
    return df.join(wide, identifier, "left")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of groups of any size.

    Weighs the two neighbours as the built-in ``percentile`` does, so both ways agree to
    the last bit and a result cannot move when a group grows.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ran = running_totals(cells, keys, [F.col(value)], {"_upto": F.col("_n")})
    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_upto_group") - 1)
        picks += [
            F.min(F.when(F.col("_upto") > F.floor(position), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(position), F.col(value))).alias(f"_hi_{name}"),
        ]
    found = ran.groupBy(*keys).agg(F.max("_upto_group").alias("_size"), *picks)
    return found.select(
        *keys,
        *[
            _between(F.lit(float(p)) * (F.col("_size") - 1), F.col(f"_lo_{n}"), F.col(f"_hi_{n}")).alias(n)
            for n, p in probabilities.items()
        ],
    )


def _between(position: Column, low: Column, high: Column) -> Column:
    weighed = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
    return F.when(low == high, low).when(F.ceil(position) == F.floor(position), low).otherwise(weighed)


def narrowed_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Quantiles of few, large groups without a cell for each distinct value.

    The first pass counts rows by bins that keep the order of the values, so the bin of each
    quantile is known exactly; the second counts values inside that bin only. Bins are as wide
    as their values' magnitude asks, whatever the range; a bin that holds most of a group
    is ranked over many slices like any other.
    """
    keys = list(keys)
    long = melt(df, keys, sorted({c for c, _ in wanted.values()})).where(F.col("value").isNotNull())
    place = F.rint(F.signum("value") * F.log1p(F.abs("value")) * BINS_A_FOLD)
    bins = long.groupBy(*keys, "metric", place.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    span = Window.partitionBy(*keys, "metric")
    upto = span.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ran = bins.withColumns({"_upto": F.sum("_n").over(upto), "_size": F.sum("_n").over(span)})
    bounds = []
    for name, (column, p) in wanted.items():
        mine, position = F.col("metric") == column, F.lit(float(p)) * (F.col("_size") - 1)
        bounds += [
            F.max(F.when(mine, F.col("_size"))).alias(f"_size_{name}"),
            F.max(F.when(mine & (F.col("_upto") <= F.floor(position)), F.col("_upto"))).alias(f"_below_{name}"),
            F.min(F.when(mine & (F.col("_upto") > F.floor(position)), F.col("_low"))).alias(f"_from_{name}"),
            F.min(F.when(mine & (F.col("_upto") > F.ceil(position)), F.col("_high"))).alias(f"_to_{name}"),
        ]
    cuts = lookup(ran.groupBy(*keys).agg(*bounds))
    values = {n: F.col(c).cast("double") for n, (c, _) in wanted.items()}
    inside = {n: v.between(F.col(f"_from_{n}"), F.col(f"_to_{n}")) for n, v in values.items()}
    cells = (
        df.join(cuts, keys)
        .where(reduce(or_, inside.values()))
        .select(
            *keys,
            F.explode(
                F.array(*[F.struct(F.lit(n).alias("name"), F.when(inside[n], v).alias("value")) for n, v in values.items()])
            ).alias("_m"),
        )
        .where(F.col("_m.value").isNotNull())
        .groupBy(*keys, F.col("_m.name").alias("name"), F.col("_m.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    near = running_totals(cells, [*keys, "name"], [F.col("value")], {"_upto": F.col("_n")}).join(cuts, keys)
    picks = []
    for name, (_, p) in wanted.items():
        position = F.lit(float(p)) * (F.col(f"_size_{name}") - 1)
        reached = F.col("_upto") + F.coalesce(F.col(f"_below_{name}"), F.lit(0))
        mine = F.col("name") == name
        picks += [
            F.max(f"_size_{name}").alias(f"_size_{name}"),
            F.min(F.when(mine & (reached > F.floor(position)), F.col("value"))).alias(f"_lo_{name}"),
            F.min(F.when(mine & (reached > F.ceil(position)), F.col("value"))).alias(f"_hi_{name}"),
        ]
    found = near.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            _between(F.lit(float(p)) * (F.col(f"_size_{n}") - 1), F.col(f"_lo_{n}"), F.col(f"_hi_{n}")).alias(n)
            for n, (_, p) in wanted.items()
        ],
    )


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    hot_rows: int = HOT_GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Quantiles of many groups: built-in ``percentile`` for ordinary ones, narrowed bins for hot ones.

    ``wanted`` maps an output name to (column, probability). Group sizes are
    counted first unless given as ``sizes`` (keys, count); the number of hot groups
    is at most rows / ``hot_rows``. Without ordinary groups no pass is made for them.
    """
    plain = [F.percentile(c, F.lit(float(p))).alias(n) for n, (c, p) in wanted.items()]
    counted = settle(df.groupBy(*keys).count()) if sizes is None else sizes
    hot = settle(counted.where(F.col("count") > hot_rows).select(*keys))
    if hot.isEmpty():
        return df.groupBy(*keys).agg(*plain)
    if counted.where(F.col("count") <= hot_rows).isEmpty():
        return hot.join(narrowed_quantiles(df, keys, wanted), list(keys), "left")
    cold = df.join(hot, list(keys), "left_anti").groupBy(*keys).agg(*plain)
    wide = narrowed_quantiles(df.join(hot, list(keys), "left_semi"), keys, wanted)
    return cold.unionByName(hot.join(wide, list(keys), "left"))
