"""Ranking and classification metrics, review budgets and bootstraps over long scores.

Frames are long: keys such as seed, branch and country, then source_id, block_id,
is_eog_flare, eog_flare_id and score. Metrics first collapse rows to distinct
scores per key; the ordered part then runs on those cells, range-partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions.columns import finite_score, share
from emberfield.operators.ordering import exact_quantiles, row_numbers, running_totals
from emberfield.session import lookup, settle, with_row

LABEL = "is_eog_flare"
SITE = "eog_flare_id"
BUDGETS = (0.1, 0.2, 0.3)
SCORES_AT_ONCE = 256
"""Distinct scores that a bootstrap task spreads over all repeats at once."""

CELLS_AT_ONCE = 1 << 18
"""Score cells, roughly, that meet a block of drawn units in one bootstrap task; a block with more meets them in several."""

DRAWS_AT_ONCE = 1 << 22
"""Draws of a bootstrap that one block of slots counts; a tile of slots makes a quarter of them."""

GATES = (0.001, 0.0025, 0.005, 0.01, 0.02)


def long_scores(df: DataFrame, branches: Sequence[str]) -> DataFrame:
    """score_<branch> columns to (branch, score) rows."""
    kept = [c for c in df.columns if not c.startswith("score_")]
    pairs = [F.struct(F.lit(b).alias("branch"), F.col(f"score_{b}").alias("score")) for b in branches]
    return df.select(*kept, F.explode(F.array(*pairs)).alias("_p")).select(*kept, "_p.branch", "_p.score")


def score_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and positives of every distinct score."""
    one = F.lit(1).cast("bigint")
    df = df.withColumn("score", finite_score(F.col("score")))
    return df.groupBy(*keys, "score").agg(F.sum(one).alias("n"), F.sum(one * F.col(LABEL)).alias("pos"))


def curve(df: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Distinct scores per key with rows and positives at or above each one.

    Columns: score, n, pos, seen, found, seen_group, found_group. With a weight,
    ``df`` holds score cells (n, pos) to be weighted.
    """
    cells = score_cells(df, keys) if weight is None else df.groupBy(*keys, "score").agg(
        F.sum(weight * F.col("n")).alias("n"), F.sum(weight * F.col("pos")).alias("pos")
    )
    return running_totals(cells, keys, [F.col("score").desc()], {"seen": F.col("n"), "found": F.col("pos")})


def _f1(found: Column, seen: Column, positives: Column) -> Column:
    return share(2.0 * found, seen + positives)


def curve_metrics() -> dict[str, Column]:
    """Aggregates over ``curve`` rows of one key."""
    total, positives = F.max("seen_group"), F.max("found_group")
    negatives = total - positives
    ap = F.sum(F.col("pos") * F.col("found") / F.col("seen"))
    below = F.col("seen_group") - F.col("found_group") - (F.col("seen") - F.col("found"))
    wins = F.sum(F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    f1 = F.round(_f1(F.col("found"), F.col("seen"), F.col("found_group")), 12)
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("low")))
    none = positives == 0
    return {
        "n": total,
        "n_pos": positives,
        "pr_auc": F.when(~none, ap / positives),
        "roc_auc": F.when(~none & (negatives > 0), wins / (positives * negatives)),
        "best_threshold": F.when(none, F.max("score") + 1e-9).otherwise(-best["low"]),
        "best_f1": F.when(none, F.lit(0.0)).otherwise(best["f1"]),
    }


def ranking(df: DataFrame, keys: Sequence[str], wanted: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Any of ``curve_metrics`` per key, from one ordered pass."""
    metrics = curve_metrics()
    return _grouped(curve(df, keys, weight), keys, [metrics[m].alias(m) for m in wanted])


def _grouped(df: DataFrame, keys: Sequence[str], aggregates: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates)


def average_precision(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ranking(df, keys, ["pr_auc"])


def roc_auc(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ranking(df, keys, ["roc_auc"])


def best_f1_threshold(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact best threshold, lowest on ties; just above every score without positives."""
    return ranking(df, keys, ["best_threshold", "best_f1"])


def grid_f1_threshold(df: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Best threshold of a fixed grid, first on ties: conditional sums, no ordering."""
    if not grid:
        raise ValueError("grid cannot be empty")
    df = df.withColumn("score", finite_score(F.col("score")))
    above = [(F.col("score") >= t).cast("bigint") for t in grid]
    sums = [F.struct(F.sum(a).alias("seen"), F.sum(a * F.col(LABEL)).alias("found")) for a in above]
    counted = _grouped(df, keys, [F.sum(LABEL).alias("p"), F.array(*sums).alias("s")])
    rated = F.array(
        *[
            F.struct(
                F.round(_f1(F.col("s")[i]["found"], F.col("s")[i]["seen"], F.col("p")), 12).alias("best_f1"),
                F.lit(-i).alias("_i"),
                F.lit(float(t)).alias("best_threshold"),
            )
            for i, t in enumerate(grid)
        ]
    )
    best = F.array_max(rated)
    return counted.select(*keys, best["best_threshold"].alias("best_threshold"), best["best_f1"].alias("best_f1"))


def binary_metrics(df: DataFrame, keys: Sequence[str], threshold: Column | float) -> DataFrame:
    """Confusion counts and the scores derived from them; ``threshold`` is constant per key."""
    df = df.withColumn("score", finite_score(F.col("score")))
    y, hit = F.col(LABEL) == 1, F.col("score") >= F.lit(threshold)
    clipped = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    counts = _grouped(
        df,
        keys,
        [
            F.count(F.lit(1)).alias("n"),
            F.count_if(y).alias("n_pos"),
            F.round(F.max(F.lit(threshold)), 4).alias("thr"),
            F.avg(F.pow(clipped - F.col(LABEL), 2)).alias("brier"),
            F.count_if(~y & ~hit).alias("tn"),
            F.count_if(~y & hit).alias("fp"),
            F.count_if(y & ~hit).alias("fn"),
            F.count_if(y & hit).alias("tp"),
        ],
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns(
        {
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
            "mcc": share(tp * tn - fp * fn, spread),
        }
    )


def full_metrics(df: DataFrame, keys: Sequence[str], threshold: Column | float) -> DataFrame:
    return binary_metrics(df, keys, threshold).join(ranking(df, keys, ["pr_auc", "roc_auc"]), list(keys))


def macro_f1_threshold(df: DataFrame, keys: Sequence[str], country: str = "country") -> DataFrame:
    """One threshold per key maximising the mean country F1, lowest on ties.

    A country's F1 is a step function of the threshold that moves only at its own
    scores. Summing those steps over all countries from the top score down gives
    the macro F1 at every candidate without pairing candidates and countries.
    """
    own = curve(df, [*keys, country])
    after = _f1(F.col("found"), F.col("seen"), F.col("found_group"))
    before = _f1(F.col("found") - F.col("pos"), F.col("seen") - F.col("n"), F.col("found_group"))
    steps = own.groupBy(*keys, "score").agg(F.sum(after - before).alias("step"))
    countries = df.groupBy(*keys).agg(F.count_distinct(country).alias("countries"))
    walked = running_totals(steps, keys, [F.col("score").desc()], {"f1": F.col("step")})
    best = F.max(F.struct(F.col("f1"), (-F.col("score")).alias("low")))
    joined = walked.join(countries, list(keys)) if keys else with_row(walked, countries)
    rated = joined.withColumn("f1", F.round(F.col("f1") / F.col("countries"), 12))
    picked = _grouped(rated, keys, [best.alias("best")])
    return picked.select(*keys, (-F.col("best.low")).alias("threshold"), F.col("best.f1").alias("macro_f1"))


def calibration_table(df: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Quantile bins, right-closed, repeated edges merged; predicted against observed rate."""
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, keys, "score", names)
    edges = lookup(edges.select(*keys, F.array_distinct(F.array(*names)).alias("edges")))
    below = F.size(F.filter("edges", lambda e: e < F.col("score")))
    binned = df.join(edges, list(keys)).withColumn("bin", F.greatest(below - 1, F.lit(0)))
    table = binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("pred"), F.avg(LABEL).alias("obs")
    )
    return table.withColumn("gap", F.abs(F.col("pred") - F.col("obs")))


def country_metrics(df: DataFrame, keys: Sequence[str], threshold: Column | float) -> DataFrame:
    """Full metrics with prevalence, prediction rate and precision lift."""
    return full_metrics(df, keys, threshold).withColumns(
        {
            "prevalence": F.col("n_pos") / F.col("n"),
            "predicted_positive": F.col("tp") + F.col("fp"),
            "prediction_rate": (F.col("tp") + F.col("fp")) / F.col("n"),
            "pr_auc_lift": F.when(F.col("n_pos") > 0, F.col("pr_auc") / (F.col("n_pos") / F.col("n"))),
        }
    )


def site_metrics(df: DataFrame, keys: Sequence[str], threshold: Column | float, totals: DataFrame | None = None) -> DataFrame:
    """Distinct known sites that can be and are detected; ``totals`` is (country, sites)."""
    known = (F.col(LABEL) == 1) & F.col(SITE).isNotNull()
    by_site = (
        df.groupBy(*keys, F.when(known, F.col(SITE)).alias("_site"))
        .agg(F.max((F.col("score") >= F.lit(threshold)).cast("int")).alias("_hit"))
    )
    counted = by_site.groupBy(*keys).agg(
        F.count("_site").alias("eog_sites_recoverable"),
        F.count_if(F.col("_site").isNotNull() & (F.col("_hit") == 1)).alias("eog_sites_detected"),
    )
    if totals is not None:
        counted = counted.join(totals.select("country", F.col("sites").alias("_all")), "country", "left")
    else:
        counted = counted.withColumn("_all", F.lit(None).cast("bigint"))
    return counted.withColumn("eog_sites_total", F.coalesce("_all", "eog_sites_recoverable")).drop("_all").withColumns(
        {
            "recall_of_recoverable": F.col("eog_sites_detected") / F.greatest("eog_sites_recoverable", F.lit(1)),
            "recall_of_all_active": F.col("eog_sites_detected") / F.greatest("eog_sites_total", F.lit(1)),
        }
    )


def site_funnel(df: DataFrame, keys: Sequence[str], threshold: Column | float, totals: DataFrame) -> DataFrame:
    """Construction, model and end-to-end site recall."""
    sites = site_metrics(df, keys, threshold, totals)
    return sites.select(
        *keys,
        "eog_sites_total",
        "eog_sites_recoverable",
        "eog_sites_detected",
        (F.col("eog_sites_recoverable") / F.greatest("eog_sites_total", F.lit(1))).alias("source_construction_recall"),
        F.col("recall_of_recoverable").alias("model_recall_of_recoverable"),
        F.col("recall_of_all_active").alias("end_to_end_recall_of_all_active"),
    )


def macro_ap(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _grouped(average_precision(df, [*keys, "country"]), keys, [F.avg("pr_auc").alias("macro_ap")])


def country_deltas(table: DataFrame, keys: Sequence[str], metric: str, baseline: str, candidate: str) -> DataFrame:
    """candidate − baseline of a metric table with a ``branch`` column."""
    wide = table.groupBy(*keys).agg(
        F.max(F.when(F.col("branch") == baseline, F.col(metric))).alias("baseline"),
        F.max(F.when(F.col("branch") == candidate, F.col(metric))).alias("candidate"),
    )
    return wide.withColumn("delta", F.col("candidate") - F.col("baseline"))


def country_ap_deltas(df: DataFrame, baseline: str, candidate: str, keys: Sequence[str] = ("country",)) -> DataFrame:
    ap = average_precision(df.where(F.col("branch").isin(baseline, candidate)), [*keys, "branch"])
    return country_deltas(ap, keys, "pr_auc", baseline, candidate)


def branch_summary(metrics: DataFrame, keys: Sequence[str] = ("branch",)) -> DataFrame:
    """Macro means and the worst country of a (country, branch) metric table."""
    return metrics.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        F.avg("pr_auc").alias("macro_pr_auc"),
        F.avg("roc_auc").alias("macro_roc_auc"),
        F.min("pr_auc").alias("worst_country_pr_auc"),
    )


def review_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact review rank: score descending, then source_id."""
    return row_numbers(df, keys, [F.col("score").desc(), F.col("source_id")], "rank")


def _budgeted(df: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> tuple[DataFrame, Column]:
    """Ranked rows repeated per budget, with the number of rows each budget reviews."""
    ranked = review_order(df, keys).withColumn("review_fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    count = F.greatest(F.lit(1), F.ceil(F.round(F.col("review_fraction") * F.col("rank_group"), 9)))
    return ranked.withColumn("review_count", count), F.col("rank") <= F.col("review_count")


def review_budgets(df: DataFrame, keys: Sequence[str], fractions: Sequence[float] = BUDGETS) -> DataFrame:
    """Precision and recall of rows and distinct sites inside each review budget."""
    rows, inside = _budgeted(df, keys, fractions)
    by = [*keys, "review_fraction"]
    known = (F.col(LABEL) == 1) & F.col(SITE).isNotNull()
    # Rows collapse to sites before the distinct count, so no row is expanded.
    by_site = rows.groupBy(*by, F.when(known, F.col(SITE)).alias("_site")).agg(
        F.max("review_count").alias("review_count"),
        F.count_if(F.col(LABEL) == 1).alias("_p"),
        F.count_if(inside & (F.col(LABEL) == 1)).alias("_f"),
    )
    found = by_site.groupBy(*by).agg(
        F.max("review_count").alias("review_count"),
        F.sum("_f").alias("positive_found"),
        F.sum("_p").alias("_positives"),
        F.count_if(F.col("_site").isNotNull() & (F.col("_f") > 0)).alias("sites_found"),
        F.count("_site").alias("_sites"),
    )
    return found.withColumns(
        {
            "precision_at_budget": F.col("positive_found") / F.col("review_count"),
            "recall_at_budget": F.col("positive_found") / F.greatest("_positives", F.lit(1)),
            "site_recall_at_budget": F.col("sites_found") / F.greatest("_sites", F.lit(1)),
        }
    ).drop("_positives", "_sites")


def queue_membership(df: DataFrame, keys: Sequence[str], fractions: Sequence[float] = BUDGETS) -> DataFrame:
    rows, inside = _budgeted(df, keys, fractions)
    return rows.where(inside).select(*keys, "review_fraction", "rank", "source_id", LABEL, "score")


def gate_metrics(df: DataFrame, keys: Sequence[str], fractions: Sequence[float] = GATES) -> DataFrame:
    """Population-scale gates: the review budgets at small fractions."""
    return review_budgets(df, keys, fractions).select(
        *keys,
        F.col("review_fraction").alias("top_fraction"),
        F.col("review_count").alias("candidates"),
        F.col("precision_at_budget").alias("precision_at_gate"),
        F.col("recall_at_budget").alias("source_recall_at_gate"),
        F.col("site_recall_at_budget").alias("site_recall_at_gate"),
    )


def top_n_review(df: DataFrame, n: int, threshold: float | None = None) -> DataFrame:
    """The n best rows, flagged ones first when a threshold is given (top-k per task)."""
    order = [F.col("score").desc(), F.col("source_id")]
    if threshold is not None:
        order = [(F.col("score") >= F.lit(threshold)).desc(), *order]
    return df.orderBy(*order).limit(n)


def _tile_draws(country: str, stratum: int, size: int, first: int, last: int, repeats: int, seed: int) -> Iterator[np.ndarray]:
    """Draws in [0, size) of slots first to last in each repeat: 15 hex digits of a portable md5, modulo size."""
    tails = [f":{country}:{stratum}:{slot}".encode() for slot in range(first, last)]
    for repeat in range(repeats):
        head = f"{seed}:{repeat}".encode()
        digests = b"".join([md5(head + tail).digest()[:8] for tail in tails])
        yield (np.frombuffer(digests, ">u8") >> np.uint64(4)).astype("int64") % size


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the narrowest type that holds them, byte by byte of their value, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = values.ravel().astype(kind).view("u1").reshape(-1, kind.itemsize).T.tobytes()
    return np.array([kind.itemsize, values.size], "<u4").tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    width, size = (int(v) for v in np.frombuffer(packed, "<u4", 2))
    planes = np.frombuffer(pa.decompress(packed[8:], width * size, "zstd", asbytes=True), "u1")
    return planes.reshape(width, size).T.copy().view(f"<u{width}").ravel()


POOL = ["country", "stratum", "size"]


def _places(df: DataFrame, unit: str, by: Sequence[str]) -> DataFrame:
    """(keys, country, stratum, unit, slot, size): the place of each unit among those of its country and label stratum."""
    place = [*by, "country", "stratum"]
    units = df.groupBy(*by, "country", unit).agg(F.max(LABEL).alias("stratum"))
    placed = row_numbers(units, place, [F.col(unit)], "slot").select(
        *place, unit, (F.col("slot") - 1).alias("slot"), F.col("slot_group").alias("size")
    )
    return settle(placed)


def _slots_at_once(repeats: int) -> int:
    return max(1, DRAWS_AT_ONCE // repeats)


def _drawn_blocks(placed: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(country, stratum, size, start, packed): how often each repeat draws each slot of a block, slots x repeats.

    A draw depends on country, stratum, slot and size alone, so keys of one size share theirs. Tiles of slots draw for
    all repeats and send sorted draws as packed gaps to blocks of drawn slots of bounded size, which count them.
    """
    block, tile = _slots_at_once(repeats), max(1, DRAWS_AT_ONCE // (4 * repeats))
    spark = placed.sparkSession
    named = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in POOL) + ", start bigint, packed binary"
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(tile).cast("bigint")))
    tiles = placed.select(*POOL).na.drop().distinct().withColumn("first", first)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = row["size"]
                last = min(size, row["first"] + tile)
                slots = np.stack(list(_tile_draws(row["country"], row["stratum"], size, row["first"], last, repeats, seed)))
                codes = np.sort((slots * repeats + np.arange(repeats)[:, None]).ravel())
                starts = np.arange(0, size, block)
                cuts = np.searchsorted(codes, np.append(starts, size) * repeats)
                hit = np.flatnonzero(np.diff(cuts))
                gaps = [_packed(np.diff(codes[cuts[i] : cuts[i + 1]], prepend=starts[i] * repeats)) for i in hit]
                whole = [pa.array([row[c]] * len(hit), batch.schema.field(c).type) for c in POOL]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(starts[hit]), pa.array(gaps, pa.binary())], [*POOL, "start", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if counts is None:
                head = batch.slice(0, 1).select([*POOL, "start"])
                slots = min(block, head.column("size")[0].as_py() - head.column("start")[0].as_py())
                counts = np.zeros(slots * repeats, "u4")
            codes = np.concatenate([np.cumsum(_unpacked(p), dtype="i8") for p in batch.column("packed").to_pylist()])
            counts += np.bincount(codes, minlength=len(counts)).astype("u4")
        if counts is not None:
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array([_packed(counts)], pa.binary())], [*POOL, "start", "packed"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A number of its own: a few small rows stand for much work, so they must not be merged.
    gaps = tiles.repartition(tasks, *POOL, "first").mapInArrow(draw, named)
    return gaps.groupBy(*POOL, "start").applyInArrow(count, named)


def drawn_repeats(df: DataFrame, unit: str, repeats: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(keys, country, unit, drawn): the repeats that draw each unit, within country and label stratum.

    A unit drawn five times in a repeat has that repeat five times in its array, so multiplicities stand for row copies.
    """
    placed = _places(df, unit, by)
    named = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in POOL)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = _unpacked(row["packed"]).reshape(-1, repeats)
                slots = np.flatnonzero(counts.any(1))
                values = np.repeat(np.tile(np.arange(repeats, dtype="i4"), len(slots)), counts[slots].ravel())
                ends = np.append(0, np.cumsum(counts[slots].sum(1, dtype="i8"))).astype("i4")
                whole = [pa.array([row[c]] * len(slots), batch.schema.field(c).type) for c in POOL]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(slots + row["start"]), pa.ListArray.from_arrays(ends, values)], [*POOL, "slot", "drawn"])

    drawn = settle(_drawn_blocks(placed, repeats, seed)).mapInArrow(unpack, f"{named}, slot bigint, drawn array<int>")
    return drawn.join(placed, [*POOL, "slot"]).select(*by, "country", unit, "drawn")


def _weighted(counts: np.ndarray, slot: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rows of drawn counts summed by place (ascending from 0, no gaps) with their weights, some rows at a time."""
    sums = np.zeros((int(place[-1]) + 1, counts.shape[1]), "i8")
    for lo in range(0, len(slot), SCORES_AT_ONCE):
        at = place[lo : lo + SCORES_AT_ONCE]
        heads = np.append(0, np.flatnonzero(np.diff(at)) + 1)
        rows = counts[slot[lo : lo + SCORES_AT_ONCE]] * weight[lo : lo + SCORES_AT_ONCE, None]
        sums[at[heads]] += np.add.reduceat(rows, heads, axis=0)
    return sums


def _score_slices(cells: DataFrame, keys: Sequence[str], repeats: int) -> tuple[DataFrame, DataFrame]:
    """Cells with the block of their slot and a chunk of it, slice and place of their score from the highest down; chunks of each block."""
    ranks = row_numbers(cells.select(*keys, "score").distinct(), keys, [F.col("score").desc()], "_rank")
    above = F.col("_rank") - 1
    ranks = lookup(
        ranks.select(
            *keys, "score", F.floor(above / SCORES_AT_ONCE).cast("int").alias("_slice"), (above % SCORES_AT_ONCE).cast("int").alias("_place")
        )
    )
    start = F.lit(_slots_at_once(repeats)).cast("bigint")
    blocked = cells.withColumn("start", F.col("slot") - F.col("slot") % start)
    chunks = lookup(blocked.groupBy(*POOL, "start").agg(F.ceil(F.count(F.lit(1)) / CELLS_AT_ONCE).cast("int").alias("chunks")))
    spot = F.pmod(F.xxhash64(*keys, "_slice"), F.col("chunks")).cast("int")
    return blocked.join(ranks, [*keys, "score"]).join(chunks, [*POOL, "start"]).withColumn("chunk", spot), chunks


def bootstrap_precision(df: DataFrame, unit: str, repeats: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(repeat, keys, country, branch, pr_auc) over resampled units; no AP where a repeat has no positive.

    Draws never meet rows one by one. A block of units holds its counts, units x repeats, once for all keys and branches;
    its rows sum them by score there, so what moves on are sums for each distinct score and block, packed. Slices of a
    key's scores add the blocks' sums as these come in, and each works out its part of every repeat's AP on top of
    the totals of the slices above it. A hot block or country spans many slices.
    """
    keys = [*by, "country", "branch"]
    placed = _places(df, unit, by)
    cells = settle(score_cells(df, [*keys, unit]).join(placed, [*by, "country", unit]).select(*keys, "stratum", "size", "slot", "score", "n", "pos"))
    sliced, chunks = _score_slices(cells, keys, repeats)
    spot, groups = [*POOL, "start", "chunk"], [*keys, "_slice"]
    each_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    blocks = _drawn_blocks(placed, repeats, seed).join(chunks, [*POOL, "start"]).select(*POOL, "start", "packed", each_chunk)

    def weigh(drawn: pa.Table, part: pa.Table) -> pa.Table:
        kinds = [*[part.schema.field(c) for c in groups], pa.field("places", pa.list_(pa.int32())), pa.field("n", pa.binary()), pa.field("pos", pa.binary())]
        if not (drawn.num_rows and part.num_rows):
            return pa.schema(kinds).empty_table()
        counts = _unpacked(drawn.column("packed")[0].as_py()).reshape(-1, repeats)
        part = part.sort_by([(c, "ascending") for c in (*groups, "_place")]).combine_chunks()
        slot = part.column("slot").to_numpy() - part.column("start")[0].as_py()
        place, n, pos = (part.column(c).to_numpy() for c in ("_place", "n", "pos"))
        codes = [part.column(c).dictionary_encode().combine_chunks().indices.to_numpy() for c in groups]
        edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
        rows = []
        for lo, hi in zip([0, *edges], [*edges, part.num_rows]):
            places, dense = np.unique(place[lo:hi], return_inverse=True)
            sums = {"n": _packed(_weighted(counts, slot[lo:hi], dense, n[lo:hi])), "pos": None}
            if pos[lo:hi].any():
                sums["pos"] = _packed(_weighted(counts, slot[lo:hi], dense, pos[lo:hi]))
            rows.append({c: part.column(c)[int(lo)].as_py() for c in groups} | {"places": places.tolist()} | sums)
        return pa.Table.from_pylist(rows, pa.schema(kinds))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, head = np.zeros((2, SCORES_AT_ONCE, repeats), "i8"), None
        for batch in batches:
            head = batch.slice(0, 1).select(groups) if batch.num_rows else head
            for row in batch.select(["places", "n", "pos"]).to_pylist():
                for total, packed in zip(sums, (row["n"], row["pos"])):
                    if packed is not None:
                        total[row["places"]] += _unpacked(packed).reshape(-1, repeats)
        if head is not None:
            packed = [pa.array([_packed(s)], pa.binary()) for s in sums]
            totals = [pa.array([s.sum(0).astype("f8")]) for s in sums]
            yield pa.RecordBatch.from_arrays([*head.columns, *packed, *totals], [*groups, "cells_n", "cells_pos", "n", "pos"])

    def offsets(part: pa.Table) -> pa.Table:
        part = part.sort_by("_slice")
        out = part.select(groups)
        for name in ("n", "pos"):
            sums = np.stack(part.column(name).to_numpy())
            out = out.append_column(name, pa.array(list(np.cumsum(sums, 0) - sums)))
        return out.append_column("positives", pa.array([sums.sum(0)] * len(sums)))

    def precision(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, pos = (_unpacked(row.column(c)[0].as_py()).reshape(-1, repeats) for c in ("cells_n", "cells_pos"))
                above, hits_above = (np.asarray(row.column(c)[0].as_py()) for c in ("n", "pos"))
                seen, found = np.cumsum(n, 0, dtype="f8") + above, np.cumsum(pos, 0, dtype="f8") + hits_above
                gain = np.divide(pos * found, seen, out=np.zeros_like(seen), where=seen > 0).sum(0)
                out = row.select([*keys, "positives"])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([gain])], [*out.schema.names, "gain"])

    named = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    summed = blocks.groupBy(*spot).cogroup(sliced.groupBy(*spot)).applyInArrow(weigh, f"{named}, _slice int, places array<int>, n binary, pos binary")
    merged = settle(
        summed.groupBy(*groups).applyInArrow(merge, f"{named}, _slice int, cells_n binary, cells_pos binary, n array<double>, pos array<double>")
    )
    starts = merged.select(*groups, "n", "pos").groupBy(*keys).applyInArrow(  # one row for each slice
        offsets, f"{named}, _slice int, n array<double>, pos array<double>, positives array<double>"
    )
    parts = merged.drop("n", "pos").join(lookup(starts), groups).mapInArrow(precision, f"{named}, positives array<double>, gain array<double>")
    each = parts.select(*keys, F.posexplode(F.arrays_zip("gain", "positives")).alias("repeat", "v"))
    rated = each.groupBy("repeat", *keys).agg(F.sum("v.gain").alias("gain"), F.max("v.positives").alias("positives"))
    return rated.select("repeat", *keys, F.when(F.col("positives") > 0, F.col("gain") / F.col("positives")).alias("pr_auc"))


def bootstrap_differences(
    df: DataFrame, unit: str, baseline: str, candidate: str, repeats: int, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """Macro AP difference of two branches per key and repeat. ``df`` is long over both branches."""
    both = settle(df.where(F.col("branch").isin(baseline, candidate)).select(*{*by, "source_id", "country", unit, LABEL, "branch", "score"}))
    ap = bootstrap_precision(both, unit, repeats, seed, by)
    deltas = country_deltas(ap, [*by, "repeat", "country"], "pr_auc", baseline, candidate)
    return deltas.groupBy(*by, "repeat").agg(F.avg("delta").alias("difference"))


def bootstrap_summary(differences: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and 95 % interval over repeats, whose number is a parameter."""
    return differences.groupBy(*by).agg(
        F.avg("difference").alias("mean"),
        F.percentile("difference", F.lit(0.025)).alias("lower_95"),
        F.percentile("difference", F.lit(0.975)).alias("upper_95"),
        F.count(F.lit(1)).alias("repeats"),
    )


def paired_bootstrap(
    df: DataFrame, baseline: str, candidate: str, repeats: int = 1000, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """Rows resampled within country and label."""
    return bootstrap_summary(bootstrap_differences(df, "source_id", baseline, candidate, repeats, seed, by), by)


def block_bootstrap(
    df: DataFrame, baseline: str, candidate: str, repeats: int = 2000, seed: int = 13014, by: Sequence[str] = ()
) -> DataFrame:
    """Spatial blocks resampled, positive and background blocks apart, within country."""
    return bootstrap_summary(bootstrap_differences(df, "block_id", baseline, candidate, repeats, seed, by), by)


def seed_summary(metrics: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Per-seed macro gains of a (seed, country, branch) metric table."""
    deltas = country_deltas(metrics, ["seed", "country"], "pr_auc", baseline, candidate)
    f1 = country_deltas(metrics, ["seed", "country"], "f1", baseline, candidate)
    gains = deltas.groupBy("seed").agg(
        F.avg("baseline").alias("compact_macro_pr_auc"),
        F.avg("candidate").alias("guarded_macro_pr_auc"),
        F.avg("delta").alias("macro_pr_auc_gain"),
        F.count_if(F.col("delta") > 0).alias("improved_countries"),
        F.min("delta").alias("worst_country_pr_auc_delta"),
    )
    return gains.join(f1.groupBy("seed").agg(F.avg("delta").alias("macro_f1_gain")), "seed")


def country_stability(metrics: DataFrame, baseline: str, candidate: str) -> DataFrame:
    deltas = country_deltas(metrics, ["seed", "country"], "pr_auc", baseline, candidate)
    return deltas.groupBy("country").agg(
        F.avg("delta").alias("mean_pr_auc_delta"),
        F.stddev_samp("delta").alias("std_pr_auc_delta"),
        F.min("delta").alias("min_pr_auc_delta"),
        F.max("delta").alias("max_pr_auc_delta"),
        F.count_if(F.col("delta") > 0).alias("positive_seeds"),
    )


def ablation_table(df: DataFrame, key: str) -> DataFrame:
    """Full metrics of every score set at its own best threshold."""
    best = lookup(best_f1_threshold(df, [key]))
    return full_metrics(df.join(best, key), [key], F.col("best_threshold"))
