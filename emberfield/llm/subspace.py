"""Embedding near-duplicates by a subspace pigeonhole join, exact for a cosine threshold.

Vectors are scaled to length one, so a cosine of t or more is a squared distance of
2 - 2t or less. A seeded rotation spreads the energy evenly over the dimensions, which are
cut into low-dimensional blocks. Two linked vectors are, in at least one block, no farther
apart than the block's share of the squared distance: its number of dimensions over all.

Each block is range-joined under its budget. Pivots, fitted on a bounded sample, cut the
block's space into cells; a vector is at home in the cell of its nearest pivot and visits
every cell that a ball of the budget's radius can reach (distance to the bisector, and to
the cell's covering ball), as far as the cell comes before its own. A cell's homes and
visitors are dealt in tiles of bounded size. A task that finds a pair within the block's
budget checks that no earlier block has it within its own, so the union of the blocks holds
it once, and settles it by the cosine in double precision. Pairs never leave the task:
it gives the number of links of each vector and a forest that connects the linked ones.

Large groups of near copies are bundled first. Leaders are drawn from the sample where it
is dense; vectors within half the linking angle of their leader are a bundle, all of whose
members link. Members of a bundle and other vectors meet through the leader: the angles
say that all link, that none does, or that the vector has to be compared with the members,
again in tiles. Equal vectors are one vector that counts several times. So the copies of
one vector, or a dense cluster holding a third of the table, make no pairs.

Cases: rows whose label or id is NULL, and vectors that are NULL, zero, of another length
than most, or hold NULL or non-finite components, link with nothing; a row without id has a
NULL component and is not kept; repeated rows are separate vectors with one id, linked with each
other; labels are never compared with each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.operators.components import connected_components
from emberfield.session import lookup, settle

COSINE = 0.93
BLOCK_DIMENSIONS = 8
FIT_ROWS = 10_000
"""Most vectors that pivots and leaders are drawn from."""

LEADERS, DENSE = 512, 8
"""Most leaders of bundles, and the vectors of the sample that a leader stands for at least."""

CELL, MOST_PIVOTS = 1024, 256
TILE = 2048
"""Most homes and most visitors compared at once in a task."""

SLACK = 1e-9
"""Added to every bound, far above rounding errors, so that bounds only ever admit too much."""

STEP = 256
"""Rows compared at once inside a task."""


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def rotation(dimensions: int, seed: int) -> np.ndarray:
    """Orthogonal matrix, the same in every task."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))[0]


def nearest_two(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all pivots, and the nearest pivot, the first on ties."""
    away = np.maximum((points * points).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * points @ pivots.T, 0)
    return away, away.argmin(1)


@dataclass
class Plan:
    """Everything a task needs: rotation, blocks, pivots of each block, leaders of each label."""

    turn: np.ndarray
    cosine: float
    pivots: list[np.ndarray]
    leaders: np.ndarray
    leader_label: np.ndarray

    @property
    def cuts(self) -> list[tuple[int, int]]:
        d = len(self.turn)
        return [(i, min(i + BLOCK_DIMENSIONS, d)) for i in range(0, d, BLOCK_DIMENSIONS)]

    @property
    def angle(self) -> float:
        return float(np.arccos(self.cosine))

    def budgets(self) -> np.ndarray:
        """Squared distance that a linked pair keeps in at least one block."""
        return np.array([(2 - 2 * self.cosine) * (b - a) / len(self.turn) + SLACK for a, b in self.cuts])


def fit_pivots(points: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    draw = np.random.default_rng(seed)
    pivots = points[draw.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest_two(points, pivots)[1]
        sums, sizes = np.zeros_like(pivots), np.bincount(at, minlength=k)
        np.add.at(sums, at, points)
        pivots[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return pivots


def fit_leaders(vectors: np.ndarray, labels: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in dense places of the sample, and their labels.

    Vectors are taken in turn; one that no leader has within half the angle is a candidate,
    and leads if ``DENSE`` vectors of its label lie within it.
    """
    near, found, of = np.cos(angle / 2 - SLACK), [], []
    for label in np.unique(labels):
        rows = vectors[labels == label]
        free = np.ones(len(rows), bool)
        for lo in range(0, len(rows), STEP):
            close = rows[lo : lo + STEP] @ rows.T >= near
            for i in np.flatnonzero(close.sum(1) >= DENSE):
                inside = close[i] & free
                if free[lo + i] and inside.sum() >= DENSE and len(found) < LEADERS:
                    centre = unit(rows[inside].mean(0, keepdims=True))[0]
                    found.append(centre)
                    of.append(label)
                    free &= rows @ centre < near
    return np.array(found).reshape(-1, vectors.shape[1]), np.array(of, np.int64)


def fit(sample: np.ndarray, labels: np.ndarray, rows: int, cosine: float, seed: int = 0) -> Plan:
    """Plan for labels that hold ``rows`` vectors at most, from a sample of unit vectors."""
    turn = rotation(sample.shape[1], seed)
    plan = Plan(turn, cosine, [], *fit_leaders(sample, labels, np.arccos(cosine)))
    turned = sample @ turn
    k = int(min(MOST_PIVOTS, max(1, rows // CELL), len(sample)))
    plan.pivots = [fit_pivots(turned[:, a:b], k, seed + i) for i, (a, b) in enumerate(plan.cuts)]
    return plan


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(label, embedding, cls, first, copies) of the distinct vectors that take part; ``cls`` numbers them."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull())
    good = good.where(finite & F.exists(embedding, lambda x: x != 0))
    rows = good.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("embedding")
    )
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("embedding") == (usual.d if usual else 0))
    classes = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return settle(classes.withColumn("cls", F.monotonically_increasing_id()))


def _bundled(plan: Plan):
    """Function that adds the bundle of each vector (-1: none) and the other bundles it may link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, reach = np.cos(plan.angle / 2 - SLACK), np.cos(min(np.pi, 1.5 * plan.angle + SLACK))
        for batch in batches:
            home, near = np.full(batch.num_rows, -1, np.int64), [[] for _ in range(batch.num_rows)]
            if batch.num_rows and len(plan.leaders):
                close = unit(_matrix(batch.column("embedding"))) @ plan.leaders.T
                close[batch.column("label").to_numpy()[:, None] != plan.leader_label] = -2
                best = close.argmax(1)
                home = np.where(close[np.arange(len(best)), best] >= half, best, -1)
                close[np.arange(len(best)), home] = np.where(home >= 0, -2, close[np.arange(len(best)), home])
                for i, j in zip(*np.nonzero(close >= reach), strict=True):
                    near[i].append(j)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home, pa.int64()), pa.array(near, pa.list_(pa.int64()))], names=[*batch.schema.names, "bundle", "near"]
            )

    return run


def _turned(plan: Plan, vectors: np.ndarray) -> np.ndarray:
    return unit(vectors) @ plan.turn


def _homes(plan: Plan):
    """Function from vectors to (block, cell, distance to its pivot): where each is at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = _turned(plan, _matrix(batch.column("embedding")))
            for block, (a, b) in enumerate(plan.cuts):
                away, at = nearest_two(turned[:, a:b], plan.pivots[block])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label"), pa.array(np.full(len(at), block), pa.int32()), pa.array(at, pa.int32()),
                        pa.array(np.sqrt(away[np.arange(len(at)), at]), pa.float64()),
                    ],
                    names=["label", "block", "cell", "away"],
                )

    return run


def _routes(plan: Plan, radius: np.ndarray):
    """Function from vectors to one row for each block and cell that they are at home in or visit.

    A vector visits only cells that come before its own; pairs of one cell meet there as homes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = _turned(plan, _matrix(batch.column("embedding")))
            for block, ((a, b), budget) in enumerate(zip(plan.cuts, plan.budgets(), strict=True)):
                pivots, reach = plan.pivots[block], np.sqrt(budget) + SLACK
                away, at = nearest_two(turned[:, a:b], pivots)
                own = np.arange(len(at))
                apart = np.sqrt(nearest_two(pivots, pivots)[0]) + 1e-300
                bisector = (away - away[own, at][:, None]) / (2 * apart[at]) <= reach
                covered = np.sqrt(away) <= reach + radius[block] + SLACK
                seen = bisector & covered & (np.arange(len(pivots)) < at[:, None])
                seen[own, at] = True
                row, cell = np.nonzero(seen)
                for lo in range(0, len(row), 8192):
                    r, c = row[lo : lo + 8192], cell[lo : lo + 8192]
                    chosen = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(n).take(chosen) for n in ("label", "cls", "copies", "embedding")),
                            pa.array(np.full(len(r), block), pa.int32()), pa.array(c, pa.int32()), pa.array(c == at[r]),
                        ],
                        names=["label", "cls", "copies", "embedding", "block", "cell", "home"],
                    )

    return run


class Forest:
    """Union-find over rows, the smallest row as root."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join rows pairwise; each round points the higher roots at the lower ones."""
        while len(a):
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
            x, y = self.root[a], self.root[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.array([self.find(i) for i in np.flatnonzero(self.root != np.arange(len(self.root))).tolist()], np.int64)
        return np.flatnonzero(self.root != np.arange(len(self.root))), own


def reaches(cosines: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs reach the threshold; those near it are computed anew from the given vectors, alike in every task."""
    doubt = np.abs(cosines - cosine) < SLACK
    if doubt.any():
        x, y = a[doubt], b[doubt]
        cosines = cosines.copy()
        cosines[doubt] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return cosines >= cosine


def _result(ids: np.ndarray, counts: np.ndarray, forest: Forest) -> pa.Table:
    """Rows (vec, links, other): a vector's links found here, and one vector that it is connected with (NULL: none)."""
    child, root = forest.edges()
    other = np.full(len(ids), -1, np.int64)
    other[child] = root
    used = np.flatnonzero((counts > 0) | (other >= 0))
    to = pa.array(ids[np.maximum(other[used], 0)], pa.int64(), mask=other[used] < 0)
    return pa.table({"vec": pa.array(ids[used], pa.int64()), "links": pa.array(counts[used], pa.int64()), "other": to})


RESULT = "vec long, links long, other long"
def _tile_links(plan: Plan):
    """Links of a tile of homes with its guests: homes of a later tile, visitors, or, for equal numbers, the tile itself."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block, among = key[1].as_py(), key[3].as_py() == key[4].as_py()
        host = rows.column("host").to_numpy()
        tables = [rows.filter(pa.array(host)), rows.filter(pa.array(host if among else ~host))]
        ids, times = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("cls", "copies"))
        if not all(t.num_rows for t in tables):
            return _result(ids[:0], times[:0], Forest(0))
        given = [_matrix(t.column("embedding")) for t in tables]
        left, right = (_turned(plan, m) for m in given)
        n, counts, forest, budgets = len(left), np.zeros(len(ids), np.int64), Forest(len(ids)), plan.budgets()
        norms = [[(m[:, a:b] ** 2).sum(1) for a, b in plan.cuts] for m in (left, right)]
        a, b = plan.cuts[block]
        for lo in range(0, len(right), STEP):
            hi = min(lo + STEP, len(right))
            near = norms[1][block][lo:hi, None] + norms[0][block] - 2 * right[lo:hi, a:b] @ left[:, a:b].T <= budgets[block]
            if among:
                near &= np.arange(n) < np.arange(lo, hi)[:, None]
            i, j = np.nonzero(near)
            i += lo
            for earlier in range(block):
                c, d = plan.cuts[earlier]
                apart = norms[1][earlier][i] + norms[0][earlier][j] - 2 * (right[i, c:d] * left[j, c:d]).sum(1)
                fresh = apart > budgets[earlier]
                i, j = i[fresh], j[fresh]
            true = reaches((right[i] * left[j]).sum(1), given[1][i], given[0][j], plan.cosine)
            i, j = i[true], j[true]
            np.add.at(counts, j, times[n + i])
            np.add.at(counts, i if among else n + i, times[j])
            forest.link(j, i if among else n + i)
        return _result(ids, counts, forest)

    return run


def dealt(rows: DataFrame, keys: list[str], part: str, tile: int) -> DataFrame:
    """``rows`` with a tile number ``part``, so that a tile of a group holds about ``tile`` rows; adds ``_tiles``."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles"))
    return rows.join(sizes, keys).withColumn(part, F.pmod(F.xxhash64("cls"), F.col("_tiles")).cast("int"))


def pigeonhole_links(vectors: DataFrame, plan: Plan, tile: int = TILE) -> DataFrame:
    """(vec, links, other) from all pairs of the given distinct vectors of one label."""
    radius = np.zeros((len(plan.cuts), len(plan.pivots[0])))
    for r in vectors.mapInArrow(_homes(plan), "label long, block int, cell int, away double").groupBy("block", "cell").agg(F.max("away").alias("r")).collect():
        radius[r.block, r.cell] = r.r  # blocks times MOST_PIVOTS rows at most
    columns = "label long, cls long, copies long, embedding array<double>, block int, cell int, home boolean"
    routed, keys = vectors.mapInArrow(_routes(plan, radius), columns), ["label", "block", "cell"]
    tiles = lambda which: F.ceil(F.count_if(which) / tile).cast("int")
    sizes = routed.groupBy(*keys).agg(tiles(F.col("home")).alias("_homes"), tiles(~F.col("home")).alias("_guests"))
    sized = routed.join(lookup(sizes), keys).where("_homes > 0")
    dealt_to = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    place = lambda host, t, g: F.struct(F.lit(host).alias("host"), t.alias("tile"), g.alias("guest"))
    none = F.array().cast("array<struct<host:boolean,tile:int,guest:int>>")
    own = dealt_to("_homes")
    # A tile of homes hosts itself, the later tiles and all tiles of visitors, and is a guest of the earlier ones.
    hosts = F.transform(F.sequence(own, F.col("_homes") + F.col("_guests") - 1), lambda g: place(True, own, g))
    later = F.when(own > 0, F.transform(F.sequence(F.lit(0), own - 1), lambda t: place(False, t, own))).otherwise(none)
    visits = F.transform(F.sequence(F.lit(0), F.col("_homes") - 1), lambda t: place(False, t, F.col("_homes") + dealt_to("_guests")))
    places = F.when(F.col("home"), F.concat(hosts, later)).otherwise(visits)
    spread = sized.withColumn("_p", F.explode(places)).select(*keys, "_p.tile", "_p.guest", "_p.host", "cls", "copies", "embedding")
    return spread.groupBy(*keys, "tile", "guest").applyInArrow(_tile_links(plan), RESULT)


def _bundle_links(plan: Plan):
    """Links of the members of one bundle's tile with a tile of other vectors near it.

    A guest in a bundle of its own takes its links only; the member takes its own as a guest there.
    """

    def run(key: tuple, members: pa.Table, guests: pa.Table) -> pa.Table:
        ids, times = (np.concatenate([t.column(c).to_numpy() for t in (members, guests)]) for c in ("cls", "copies"))
        if not members.num_rows or not guests.num_rows:
            return _result(ids[:0], times[:0], Forest(0))
        given = [_matrix(t.column("embedding")) for t in (members, guests)]
        left, right = map(unit, given)
        single = guests.column("bundle").to_numpy() < 0
        n, counts, forest = len(left), np.zeros(len(ids), np.int64), Forest(len(ids))
        for lo in range(0, len(right), STEP):
            hi = min(lo + STEP, len(right))
            cosines = right[lo:hi] @ left.T
            i, j = np.nonzero(cosines >= plan.cosine - SLACK)
            true = reaches(cosines[i, j], given[1][lo + i], given[0][j], plan.cosine)
            i, j = i[true] + lo, j[true]
            np.add.at(counts, n + i, times[j])
            own = single[i]
            np.add.at(counts, j[own], times[n + i[own]])
            forest.link(j, n + i)
        return _result(ids, counts, forest)

    return run


def bundle_links(members: DataFrame, near: DataFrame, plan: Plan, tile: int = TILE) -> DataFrame:
    """(vec, links, other) of the pairs with a member of a bundle; ``near`` are the vectors close to other bundles.

    Inside a bundle all link. Outside, the angle to the leader settles what it can for a
    whole bundle, and only the rest is compared with the members.
    """

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = np.zeros(batch.num_rows)
            if batch.num_rows:
                cosine = (unit(_matrix(batch.column("embedding"))) * plan.leaders[batch.column("to").to_numpy()]).sum(1)
                to = np.arccos(np.clip(cosine, -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.float64())], names=[*batch.schema.names, "angle"])

    fields = "embedding array<double>, cls long, copies long, bundle long, to long, angle double"
    picked = ["embedding", "cls", "copies", "bundle"]
    own = settle(members.select(*picked, F.col("bundle").alias("to")).mapInArrow(angles, fields))
    outer = near.select(*picked, F.explode("near").alias("to")).mapInArrow(angles, fields)
    bundle = own.groupBy("to").agg(F.max("angle").alias("_r"), F.sum("copies").alias("_n"), F.min("cls").alias("_first"))
    bundle = F.broadcast(settle(bundle))  # LEADERS rows at most
    inside = own.join(bundle, "to").select(
        F.col("cls").alias("vec"), (F.col("_n") - F.col("copies")).alias("links"), F.when(F.col("cls") > F.col("_first"), F.col("_first")).alias("other")
    )
    reached = settle(outer.join(bundle, "to").where(F.col("angle") - F.col("_r") <= plan.angle + SLACK))
    surely = F.col("angle") + F.col("_r") <= plan.angle - SLACK
    whole = reached.where(surely)
    from_whole = whole.select(F.col("cls").alias("vec"), F.col("_n").alias("links"), F.col("_first").alias("other"))
    given = whole.where("bundle < 0").groupBy("to").agg(F.sum("copies").alias("_more"))
    back = own.join(F.broadcast(given), "to").select(F.col("cls").alias("vec"), F.col("_more").alias("links"), F.lit(None).cast("long").alias("other"))
    open_ = reached.where(~surely).select(*picked, "to")
    guests = dealt(open_, ["to"], "guest", tile).withColumnRenamed("_tiles", "_guests")
    hosts = dealt(own.join(F.broadcast(settle(open_.select("to").distinct())), "to"), ["to"], "tile", tile).withColumnRenamed("_tiles", "_hosts")
    counts = settle(
        guests.groupBy("to").agg(F.max("_guests").alias("_guests")).join(hosts.groupBy("to").agg(F.max("_hosts").alias("_hosts")), "to")
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    wanted = [*picked, "to", "tile", "guest"]
    left = hosts.drop("_hosts").join(F.broadcast(counts), "to").withColumn("guest", upto("_guests")).select(wanted)
    right = guests.drop("_guests").join(F.broadcast(counts), "to").withColumn("tile", upto("_hosts")).select(wanted)
    group = ["to", "tile", "guest"]
    compared = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_bundle_links(plan), RESULT)
    return inside.unionByName(from_whole).unionByName(back).unionByName(compared)


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, seed: int = 0, tile: int = TILE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    distinct = usable(vectors, vec_id, embedding, label)
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    names = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    if not largest:
        return names.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    drawn = distinct.orderBy(F.xxhash64("first", F.lit(seed)), "first", "cls").limit(FIT_ROWS).select("label", "embedding").toArrow()
    plan = fit(unit(_matrix(drawn.column("embedding"))), drawn.column("label").to_numpy(), largest, cosine, seed)
    fields = "label long, embedding array<double>, cls long, copies long, bundle long, near array<long>"
    placed = settle(distinct.select("label", "embedding", "cls", "copies").mapInArrow(_bundled(plan), fields))
    found = pigeonhole_links(placed.where("bundle < 0"), plan, tile)
    if len(plan.leaders):
        found = found.unionByName(bundle_links(placed.where("bundle >= 0"), placed.where(F.size("near") > 0), plan, tile))
    return _labelled(names, distinct, settle(found))


def _labelled(names: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    counts = found.groupBy(F.col("vec").alias("cls")).agg(F.sum("links").alias("links"))
    links = found.where(F.col("other").isNotNull()).select(F.col("vec").alias("a"), F.col("other").alias("b"))
    root = connected_components(links).withColumnRenamed("node", "cls")
    rooted = distinct.join(root, "cls", "left").join(counts, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = settle(rooted)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    known = F.col("vec_id").isNotNull()
    return (
        names.join(classes, ["label", "embedding"], "left")
        .withColumn("component_id", F.when(known, F.coalesce("component_id", "vec_id")))
        .withColumn("n_links", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long"))
        .select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )


def near_sql(cosine: float = COSINE, embeddings: str = "embeddings") -> str:
    """The same by comparing all pairs, in DuckDB SQL."""
    return f"""
WITH RECURSIVE able AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings}
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= {cosine}),
reach AS (SELECT vec_id, vec_id AS to_id FROM able UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.to_id),
first AS (SELECT vec_id, MIN(to_id) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, COUNT(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, COALESCE(d.n, 0) AS n_links, COALESCE(f.component_id, e.vec_id) AS component_id,
  COALESCE(f.component_id, e.vec_id) = e.vec_id AS kept
FROM {embeddings} e LEFT JOIN first f USING (vec_id) LEFT JOIN degree d USING (vec_id)"""
