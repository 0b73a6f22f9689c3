"""Mixing sources to target weights by balanced sampling (the cube method).

Every source has a target; target / size is how often each of its documents is
expected. The whole part is taken for all documents, the fraction becomes an inclusion
probability. The cube method then moves the probabilities of three documents at a time
along the one direction that changes neither the expected number of words nor the
expected number of documents, as far as the first of them becomes 0 or 1; the sign is
drawn so that every probability keeps its mean. At most two documents stay open.

On the cluster a source is dealt by hash into blocks of bounded size, each block runs
its flight alone, and the open documents of many blocks meet in the blocks of the next
round until one block per source is left. Only there a dozen documents, spread over the
sizes, and the last open ones are landed together on the outcome nearest to both
totals. No block depends on partitioning or task order: reruns agree.

Cases: NULL texts have no words, NULL sources are one source (the last in order);
repeated rows are separate units; sources without words get target 0; very long texts are
units of their size; empty tables give no rows. Other columns are carried along, whatever they
are called; given columns named like a made one give way to it.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import numbered
from emberfield.session import settle

BLOCK = 4096
"""Rows of one flight."""

EDGE = 1e-9
"""Probabilities this near to 0 or 1 count as decided."""

LANDING = 12
"""Documents of a source kept for the landing, which tries all outcomes of these and the last open two."""

OWN = ("_size", "_source", "_p", "_block")
MADE = ("source_size", "target", "copies", "taken")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0
) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, NULL last, take the weights in turn. Their targets
    share ``share`` of all sizes; one that would exceed ``most`` times its source's
    size stops there and its excess is shared again. That is the level L with
    sum(min(most * size, weight * L)) = total, found by one small aggregate a round.
    """
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(grouped, [F.col("source").asc_nulls_last()], "_rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = settle(
        ranked.withColumn("_w", F.element_at(turn, (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("_top", F.col("source_size") * F.lit(float(most)))
        .drop("_rank")
    )
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        above = F.col("_w") * F.lit(level) >= F.col("_top")
        top, weight, count = table.agg(
            F.sum(F.when(above, F.col("_top"))), F.sum(F.when(~above, F.col("_w"))), F.count(F.when(above, 1))
        ).first()
        if count == stopped or not weight:
            break
        level, stopped = (total - (top or 0.0)) / weight, count
    return table.select("source", "source_size", F.least(F.col("_top"), F.col("_w") * F.lit(level)).alias("target"))


def fly(sizes: Sequence[float], chances: Sequence[float], draw: random.Random, land: bool) -> list[float]:
    """Probabilities after the flight: all 0 or 1 but for at most two, and none open after landing.

    Before landing, ``LANDING`` documents spread over the sizes stay on the ground; with
    the last open ones they take the outcome that brings both totals nearest.
    """
    p = list(chances)
    wanting = [i for i, x in enumerate(p) if EDGE < x < 1 - EDGE]
    ground = wanting[:: max(1, len(wanting) // LANDING)][-LANDING:] if land else []
    waiting = iter(sorted(set(wanting) - set(ground)))
    open_: list[int] = []
    while True:
        while len(open_) < 3 and (nxt := next(waiting, None)) is not None:
            open_.append(nxt)
        if len(open_) < 3:
            break
        i, j, k = open_
        x, y, z = sizes[i], sizes[j], sizes[k]
        direction = {i: 1.0, j: -1.0} if x == y == z else {i: y - z, j: z - x, k: x - y}
        up = min((1 - p[i] if u > 0 else p[i]) / abs(u) for i, u in direction.items() if u)
        down = min((p[i] if u > 0 else 1 - p[i]) / abs(u) for i, u in direction.items() if u)
        step = up if draw.random() * (up + down) < down else -down
        for i, u in direction.items():
            p[i] += step * u
        open_ = [i for i in open_ if EDGE < p[i] < 1 - EDGE]
    last = open_ + ground
    if land and last:
        size, chance = np.array([sizes[i] for i in last], float), np.array([p[i] for i in last])
        outcomes = (np.arange(1 << len(last))[:, None] >> np.arange(len(last)) & 1).astype(float)
        off = outcomes - chance
        best = outcomes[np.argmin(np.abs(off @ size) + 0.1 * size.mean() * np.abs(off.sum(axis=1)))]
        for i, x in zip(last, best, strict=True):
            p[i] = float(x)
    return [float(round(x)) if x <= EDGE or x >= 1 - EDGE else x for x in p]


def _flight(seed: int, level: int, land: bool, order: list[str]):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_size", "descending"), *[(c, "ascending") for c in order]])
        source, block = group.column("_source")[0].as_py(), group.column("_block")[0].as_py()
        draw = random.Random(f"{seed}/{level}/{source!r}/{block}")
        p = fly(group.column("_size").to_pylist(), group.column("_p").to_pylist(), draw, land)
        return group.set_column(group.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64()))

    return run


def draw_copies(units: DataFrame, seed: int = 0, order: Sequence[str] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """Decide the ``chance`` of every unit; adds ``drawn`` (0 or 1).

    ``units`` are narrow rows with source, size and chance; ``order`` names the columns
    that fix the order among equal sizes and the dealing into blocks.
    """
    spread = F.pmod(F.xxhash64(*order, "size"), F.greatest(F.lit(1), F.ceil(F.col("_n") / block)))
    rest = units.withColumns({"_size": F.col("size").cast("double"), "_source": F.col("source"), "_p": F.col("chance")})
    decided, level = [], 0
    while True:
        counts = settle(rest.groupBy("_source").agg(F.count(F.lit(1)).alias("_n")))
        largest = counts.agg(F.max("_n")).first()[0] or 0
        land = largest <= block
        dealt = (
            rest.alias("r")
            .join(counts.alias("c"), F.col("r._source").eqNullSafe(F.col("c._source")))
            .select("r.*", (spread if not land else F.lit(0)).cast("long").alias("_block"))
        )
        flown = settle(dealt.groupBy("_source", "_block").applyInArrow(_flight(seed, level, land, list(order)), dealt.schema).drop("_block"))
        if land:
            decided.append(flown)
            break
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        decided.append(flown.where(~open_))
        rest, level = flown.where(open_), level + 1
    whole = decided[0]
    for more in decided[1:]:
        whole = whole.unionByName(more)
    return whole.withColumn("drawn", F.col("_p").cast("long")).drop(*OWN)


def mix(
    units: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
    seed: int = 0,
    order: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Adds source_size, target, copies and taken to narrow rows that have source and size."""
    names = {c: f"_given{i}" for i, c in enumerate(units.columns) if c not in ("source", "size", *MADE) or c in order}
    inside = settle(units.select("source", "size", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    targets = source_targets(inside.select("source", "size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chances = (
        inside.alias("u")
        .join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
        .select("u.*", "source_size", "target", rate.alias("_rate"))
        .withColumn("_whole", F.floor(F.col("_rate") + EDGE).cast("long"))
        .withColumn("chance", F.greatest(F.lit(0.0), F.col("_rate") - F.col("_whole")))
    )
    drawn = draw_copies(chances, seed, [names[c] for c in order])
    copied = drawn.withColumn("copies", F.col("_whole") + F.col("drawn")).withColumn("taken", F.col("copies") * F.col("size"))
    kept = [F.col(names.get(c, c)).alias(c) for c in units.columns if c not in MADE or c in order]
    return copied.select(*kept, *[c for c in MADE if c not in order])
