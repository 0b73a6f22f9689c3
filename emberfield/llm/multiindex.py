"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

The two halves of the vectors are quantised separately, K centroids each, which names
K * K cells with only 2K centroids. Every vector is filed under its cell. A query sorts
the centroids of each half by inner product and visits cells in the order of the summed
products, popping pairs from a heap in which a pair enters once its two predecessors have
left, until the visited cells hold enough entries. Those entries are reranked by their
exact inner product.

On the cluster the centroids come from a k-means on at most ``FIT_ROWS`` vectors, drawn by
hash; the same sample measures which share of the entries must be visited for a recall of
``RECALL`` (its neighbours are farther than those in the whole table, so the share is on
the safe side). Consecutive cells are packed into shards of about ``SHARD`` entries, and a
larger cell is split over several. A query goes once to each shard that it visits; a
shard that more than ``SHARD`` queries visit is copied for every such block of queries. So
no task grows with a hot cell, and each leaves at most k results of a query.

Cases: vectors that are NULL, zero, of another length than most, or hold NULL or
non-finite components, and rows without id, take no part; repeated query rows are one
query; repeated rows are separate candidates; tables with up to ``FLOOR`` vectors are
searched whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.session import settle

FIT_ROWS = 20_000
FIT_QUERIES = 200
RECALL = 0.96
SHARD = 4096
FLOOR = 256
"""Entries that a query visits at least; where the measured share asks for more, it has no effect."""

PROBED = 64
"""Queries whose cells one task traverses."""

MOST_CENTROIDS = 1024
ENTRIES_A_CELL = 12
SEARCHED = 256
"""Queries scored at once in a task."""


@dataclass
class Codebook:
    """Centroids of both halves, and the share of all entries that a query has to visit."""

    left: np.ndarray
    right: np.ndarray
    share: float = 1.0

    @property
    def cut(self) -> int:
        return self.left.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return nearest(vectors[:, : self.cut], self.left) * len(self.right) + nearest(vectors[:, self.cut :], self.right)

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """All cells in descending order of the summed inner products."""
        a, b = self.left @ query[: self.cut], self.right @ query[self.cut :]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        sa, sb, ia, ib = (-a[by_a]).tolist(), (-b[by_b]).tolist(), by_a.tolist(), by_b.tolist()
        last, width = [-1] * len(ia), len(ib)  # last column popped in each row
        heap = [(sa[0] + sb[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            last[i] = j
            yield ia[i] * width + ib[j]
            if i + 1 < len(ia) and last[i + 1] == j - 1:
                heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
            if j + 1 < width and (i == 0 or last[i - 1] > j):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Closest centroid of each point, the first on ties."""
    norms = 0.5 * (centroids * centroids).sum(1)
    return np.concatenate(
        [np.argmax(points[i : i + 4096] @ centroids.T - norms, axis=1) for i in range(0, len(points), 4096)] or [np.zeros(0, np.int64)]
    )


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centroids = points[draw.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, points)
        sizes = np.bincount(at, minlength=k)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 0) -> Codebook:
    """Codebook for a table of ``rows`` vectors from a sample; ``k`` neighbours are wanted."""
    centroids = int(min(MOST_CENTROIDS, max(1, (rows / ENTRIES_A_CELL) ** 0.5), len(sample)))
    cut = sample.shape[1] // 2
    book = Codebook(k_means(sample[:, :cut], centroids, seed), k_means(sample[:, cut:], centroids, seed + 1))
    cells = book.cells(sample)
    sizes = np.bincount(cells, minlength=centroids * centroids)
    shares = []
    for i in range(0, len(sample), -(-len(sample) // FIT_QUERIES)):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        wanted = cells[np.argsort(-scores)[: min(k, len(sample) - 1)]]
        order = np.fromiter(book.visit(sample[i]), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        shares.append(np.cumsum(sizes[order])[place[wanted]] / len(sample))
    book.share = float(np.quantile(np.concatenate(shares), RECALL)) if len(sample) > 1 else 1.0
    return book


@dataclass
class Layout:
    """Where the entries of each cell lie: its first shard and how many shards it fills."""

    sizes: np.ndarray
    first: np.ndarray
    shards: np.ndarray


def layout(sizes: np.ndarray) -> Layout:
    shards = np.maximum(1, -(-sizes // SHARD))
    first = np.zeros(len(sizes), np.int64)
    shard, filled = 0, 0
    for cell, (size, wide) in enumerate(zip(sizes.tolist(), shards.tolist(), strict=True)):
        if filled and (wide > 1 or filled + size > SHARD):
            shard, filled = shard + 1, 0
        first[cell] = shard
        if wide > 1:
            shard += wide
        else:
            filled += size
    return Layout(sizes, first, shards)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as one double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(finite & F.exists(embedding, lambda x: x != 0))
    rows = good.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (usual.d if usual else 0))


def _filed(book: Codebook):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = book.cells(_matrix(batch.column("embedding"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["vec_id", "embedding", "cell"])

    return run


def _placed(plan: Layout):
    """Function that adds each entry's shard; a split cell deals its entries by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, spread = batch.column("cell").to_numpy(), batch.column("_h").to_numpy()
            shard = plan.first[cell] + spread % plan.shards[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shard, pa.int64())], names=["vec_id", "embedding", "cell", "shard"])

    return run


def _probes(book: Codebook, plan: Layout, wanted: int):
    """Function from queries to one row for each shard they visit, with the cells visited there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = plan.sizes.tolist()
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_pylist(), _matrix(batch.column("embedding"))
            rows = []
            for i, query in enumerate(vectors):
                visited, reached = [], 0
                for cell in book.visit(query):
                    if reached >= wanted:
                        break
                    if sizes[cell]:
                        visited.append(cell)
                        reached += sizes[cell]
                cells = np.sort(np.array(visited, np.int64))
                wide = plan.shards[cells]
                shard = np.repeat(plan.first[cells], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
                cells = np.repeat(cells, wide)
                edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
                rows += [(i, int(shard[lo]), cells[lo:hi]) for lo, hi in zip(edges, [*edges[1:], len(shard)], strict=True)] if len(shard) else []
                if len(rows) >= 1024 or i + 1 == len(vectors):
                    at = pa.array([r[0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[r[0]] for r in rows], pa.int64()), batch.column("embedding").take(at),
                            pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                        ],
                        names=["query_id", "query", "shard", "cells"],
                    )
                    rows = []

    return run


def _rerank(k: int):
    """Best k entries of one shard for each query of one block, by exact inner product, ties to smaller ids."""

    def run(entries: pa.Table, probes: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if entries.num_rows and probes.num_rows:
            entries = entries.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
            vectors, ids = _matrix(entries.column("embedding")), entries.column("vec_id").to_numpy()
            cell = entries.column("cell").to_numpy()
            for lo in range(0, probes.num_rows, SEARCHED):
                part = probes.slice(lo, SEARCHED)
                queries, names = _matrix(part.column("query")), part.column("query_id").to_pylist()
                by_cell: dict[int, list[int]] = {}
                for i, cells in enumerate(part.column("cells").to_pylist()):
                    for c in cells:
                        by_cell.setdefault(c, []).append(i)
                scores = np.full((len(names), len(ids)), -np.inf)
                for c, rows in by_cell.items():
                    a, b = np.searchsorted(cell, [c, c + 1])
                    if a < b:
                        scores[rows, a:b] = queries[rows] @ vectors[a:b].T
                scores[ids[None, :] == np.array(names)[:, None]] = -np.inf
                kept = min(k, len(ids))
                least = np.partition(scores, len(ids) - kept, axis=1)[:, len(ids) - kept]
                for i, name in enumerate(names):
                    # Products of one vector may differ in the last bits; those near the edge are computed anew, alike.
                    edge = least[i] - 1e-9 * max(1.0, abs(least[i])) if np.isfinite(least[i]) else -np.inf
                    at = np.flatnonzero((scores[i] >= edge) & np.isfinite(scores[i]))
                    exact = (vectors[at] * queries[i]).sum(1)
                    best = np.lexsort((ids[at], -exact))[:k]
                    out += [(name, int(ids[at[j]]), float(exact[j])) for j in best]
        return pa.table(
            {
                "query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()),
                "score": pa.array([r[2] for r in out], pa.float64()),
            }
        )

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 0, floor: int = FLOOR
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` (over ``vec_id``) holds."""
    rows = settle(usable(vectors, vec_id, embedding))
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(FIT_ROWS).select("embedding").toArrow()
    sample = _matrix(drawn.column("embedding")) if drawn.num_rows else np.zeros((1, 2))
    book = fit(sample, total, k, seed)
    filed = settle(rows.mapInArrow(_filed(book), "vec_id long, embedding array<double>, cell long"))
    sizes = np.zeros(len(book.left) * len(book.right), np.int64)  # at most MOST_CENTROIDS squared
    for r in filed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    plan = layout(sizes)
    wanted = min(total, max(floor, k + 1, int(np.ceil(book.share * total))))
    queries = settle(rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    queries = queries.repartition(max(1, -(-queries.count() // PROBED)))  # dealt by count: few bytes make much work
    probes = settle(queries.mapInArrow(_probes(book, plan, wanted), "query_id long, query array<double>, shard long, cells array<long>"))
    blocks = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("blocks"))
    placed = filed.withColumn("_h", F.xxhash64("vec_id")).mapInArrow(
        _placed(plan), "vec_id long, embedding array<double>, cell long, shard long"
    )
    entries = placed.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = probes.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    found = (
        entries.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(_rerank(k), "query_id long, vec_id long, score double")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
