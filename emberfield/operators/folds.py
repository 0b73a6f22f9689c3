"""Training weights, group-safe folds and sampling bags."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.functions.columns import seeded_order
from emberfield.operators.components import connected_components
from emberfield.operators.ordering import row_numbers
from emberfield.session import lookup, settle, with_row

LABEL, SITE = "is_eog_flare", "eog_flare_id"


def sample_weights(
    df: DataFrame, alpha: float = 0.0, fragment_balance: bool = False, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean-one weights: country balance to the power alpha, equal mass per known site.

    With ``keys`` (a fold column) every weight uses the rows of its own key only.
    """
    keys = list(keys)
    scope = keys or ["_all"]
    frame = df if keys else df.withColumn("_all", F.lit(0))
    counts = frame.groupBy(*scope, "country").agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.groupBy(*scope).agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_c"))
    base = counts.join(totals, scope).select(
        *scope, "country", F.pow(F.col("_n") / (F.col("_c") * F.col("_nc")), F.lit(float(alpha))).alias("weight")
    )
    weighted = frame.join(lookup(base), [*scope, "country"])
    if fragment_balance:
        known = (F.col(LABEL) == 1) & F.col(SITE).isNotNull()
        sites = frame.where(known).groupBy(*scope, "country", SITE).agg(F.count(F.lit(1)).alias("_f"))
        means = lookup(sites.groupBy(*scope, "country").agg(F.avg("_f").alias("_mean")))
        share = sites.join(means, [*scope, "country"]).select(
            *scope, "country", SITE, (F.col("_mean") / F.col("_f")).alias("_share")
        )
        # Rows without a site skip the join, so their NULL key cannot pile up in one task.
        positive = weighted.where(known).join(share, [*scope, "country", SITE])
        positive = positive.withColumn("weight", F.col("weight") * F.col("_share")).drop("_share")
        rest = weighted.where(~F.coalesce(known, F.lit(False)))
        weighted = positive.select(*weighted.columns).unionByName(rest)
    mean = lookup(weighted.groupBy(*scope).agg(F.greatest(F.avg("weight"), F.lit(1e-15)).alias("_m")))
    return weighted.join(mean, scope).withColumn("weight", F.col("weight") / F.col("_m")).drop("_m", "_all")


def country_class_weights(df: DataFrame, cap: float = 5.0) -> DataFrame:
    """Inverse (country, label) counts, mean one, capped, mean one again.

    Both means follow from the counts, so the rows are read once.
    """
    counts = lookup(df.groupBy("country", LABEL).agg(F.count(F.lit(1)).alias("_n")))
    first = counts.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_k"))
    capped = with_row(counts, first).withColumn(
        "_w", F.least(F.col("_rows") / (F.col("_k") * F.col("_n")), F.lit(cap))
    )
    mean = capped.agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    weights = lookup(with_row(capped, mean).select("country", LABEL, (F.col("_w") / F.col("_mean")).alias("weight")))
    return df.join(weights, ["country", LABEL])


def dealt_runs(sizes: Iterable[tuple[int, int]], k: int) -> list[tuple[int, int, int, int]]:
    """(size, fold, first, last): which blocks of each size go to which fold.

    ``sizes`` lists (size, number of blocks), largest size first. Every block goes to the
    lightest fold, the lower number on ties. Blocks of one size are dealt at once: fold f
    takes its next blocks at loads L_f, L_f + size, ..., so the takes below one common load,
    found by bisection, and the first few at it are those of the one-by-one rule.
    """
    loads, runs = [0] * k, []
    for size, blocks in sizes:
        def below(level: int) -> list[int]:
            return [max(0, -((load - level) // size)) for load in loads]

        low, high = min(loads), max(loads) + size * blocks
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(below(middle)) <= blocks else (low, middle - 1)
        takes = below(low)
        left = blocks - sum(takes)
        for f, load in enumerate(loads):
            if left and load <= low and (low - load) % size == 0:
                takes[f] += 1
                left -= 1
        first = 1
        for f, taken in enumerate(takes):
            loads[f] += size * taken
            if taken:
                runs.append((size, f, first, first + taken - 1))
            first += taken
    return runs


def fold_of_blocks(df: DataFrame, k: int, block: str = "block_id") -> DataFrame:
    """(block, fold): largest blocks first, each to the lightest fold.

    Only the histogram of block sizes reaches the driver. Distinct sizes add up to at most
    the number of rows, so there are at most sqrt(2 * rows) of them. Among blocks of one
    size the lower ids go to the lower folds.
    """
    sizes = settle(df.groupBy(block).agg(F.count(F.lit(1)).alias("_n")))
    histogram = sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("_b")).orderBy(F.desc("_n")).collect()
    runs = lookup(
        df.sparkSession.createDataFrame(
            dealt_runs([(row["_n"], row["_b"]) for row in histogram], k),
            "_n bigint, fold int, _first bigint, _last bigint",
        )
    )
    placed = row_numbers(sizes, ["_n"], [F.col(block)], "_r")
    return placed.join(runs, "_n").where(F.col("_r").between(F.col("_first"), F.col("_last"))).select(block, "fold")


def grouped_folds(df: DataFrame, k: int, block: str = "block_id") -> DataFrame:
    """Every row of a block in one fold, sizes balanced."""
    return df.join(fold_of_blocks(df, k, block), block)


def leave_country_out(df: DataFrame) -> DataFrame:
    """Held-out countries with positives; sizes of both sides."""
    counts = lookup(
        df.groupBy("country").agg(F.count(F.lit(1)).alias("n_test"), F.sum(LABEL).alias("positives"))
    )
    total = counts.agg(F.sum("n_test").alias("_all"))
    return (
        with_row(counts, total)
        .where(F.col("positives") > 0)
        .select("country", "n_test", (F.col("_all") - F.col("n_test")).alias("n_train"), "positives")
    )


def country_pairs(df: DataFrame) -> DataFrame:
    """Unordered country pairs with the rows both hold; the country list is the only array."""
    counts = lookup(df.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("p")))
    names = counts.agg(F.array_sort(F.collect_list("country")).alias("c"))
    pairs = names.select("c", F.posexplode("c").alias("i", "country_a")).select(
        "country_a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("country_b")
    )
    members = pairs.withColumn("country", F.explode(F.array("country_a", "country_b")))
    return members.join(counts, "country").groupBy("country_a", "country_b").agg(
        F.sum("n").alias("rows"), F.sum("p").alias("positives")
    )


def persistent_train_filter(train: DataFrame, days: int = 2) -> DataFrame:
    """Training rows seen on at least two days; scoring rows never pass through here."""
    return train.where(F.col("n_days") >= days)


def pu_bags(df: DataFrame, bags: int, ratio: float, seed: int, minimum: int = 0) -> DataFrame:
    """All positives plus ratio × positives unlabelled rows per bag, without replacement."""
    size = df.agg(F.sum(LABEL).alias("_p"), F.count(F.lit(1)).alias("_n")).select(
        F.least(
            F.col("_n") - F.col("_p"), F.greatest(F.lit(minimum), F.ceil(F.lit(float(ratio)) * F.col("_p")))
        ).alias("_take")
    )
    spread = df.withColumn("bag", F.explode(F.array(*[F.lit(b) for b in range(bags)])))
    pool = spread.where(F.col(LABEL) == 0).withColumn(
        "_order", F.sha2(F.concat_ws(":", F.lit(seed) + F.col("bag"), F.col("source_id")), 256)
    )
    placed = with_row(row_numbers(pool, ["bag"], [F.col("_order"), F.col("source_id")], "_r"), size)
    chosen = placed.where(F.col("_r") <= F.col("_take")).select(*df.columns, "bag")
    return spread.where(F.col(LABEL) == 1).unionByName(chosen)


def fold_training_weights(df: DataFrame, folds: int, alpha: float, fragment_balance: bool) -> DataFrame:
    """Weights per (held-out fold, training row): a fold's own rows never enter its weights."""
    held = F.explode(F.array(*[F.lit(f) for f in range(folds)]))
    training = df.withColumn("held_out", held).where(F.col("held_out") != F.col("fold"))
    return sample_weights(training, alpha, fragment_balance, ["held_out"])


def site_safe_blocks(df: DataFrame) -> DataFrame:
    """(country, block_id, evaluation_block): blocks sharing a known site are merged."""
    node = F.concat_ws("|", "country", "block_id")
    linked = df.where((F.col(LABEL) == 1) & F.col(SITE).isNotNull()).select("country", SITE, node.alias("a")).distinct()
    centre = linked.groupBy("country", SITE).agg(F.min("a").alias("b"))
    roots = connected_components(linked.join(centre, ["country", SITE]).select("a", "b"))
    blocks = df.select("country", "block_id").distinct().withColumn("node", node)
    return blocks.join(roots, "node", "left").select(
        "country", "block_id", F.concat(F.lit("siteblock_"), F.coalesce("root", "node")).alias("evaluation_block")
    )
