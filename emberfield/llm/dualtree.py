"""Ranked lexical search by a dual-tree: the k best documents of every item, exact.

A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII, with A-Z in
lower case. A document's score for an item sums, over the item's terms, the weight of the
term times its impact in the document; all of it in whole numbers.

One pass over the documents keeps, of each, its length and the impacts' raw counts for terms of
the items; sums over that narrow table give the collection's statistics. The search then
takes documents in batches. The documents of a batch are ordered so that alike ones are
neighbours, and runs of neighbours form the nodes of a tree, each with the maximum of every
term's weighted impact below it; the items form a tree with the maximum of every term's
repeats. The product of two nodes' maxima is no less than any score between
their members. Node pairs are walked from the roots; a pair goes no further once its bound
is below the weakest k-th score of the node's items. Scores that items have reached in a
bounded sample of documents are the first k-th scores, so batches start with
bounds that hold anywhere. Each batch leaves at most k documents of an item, the best of
them all are ranked at the end.

Items are searched in blocks of ``ITEM_BLOCK``, so that no task holds the terms of all of
them however many there are. Scores are sums of whole numbers below 2^53, exact in doubles; a
block whose bound could pass that is added up in 64-bit integers instead.

Cases: NULL texts, of documents or items, have no terms; such items have no result; repeated
documents are ranked one after another; items with one id are ranked apart under that id
only if their texts differ, equal ones are one item; NULL document ids come last; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberfield.llm.common import map_texts
from emberfield.session import settle

K = 10
SEEDS = 4096
"""Documents of the bounded sample whose scores start the search; it decides nothing but how early pairs are dropped."""

ITEM_BLOCK = 256
"""Items searched together."""

BATCH = 2048
"""Documents of one tree."""

LEAF, FAN = 8, 8
"""Documents or items of a lowest node, and children of an upper one."""

EXACT = float(1 << 53)

_TERM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """All terms of a text, with repeats."""
    return text.translate(_TERM).split()


def _counted(place: dict[bytes, int]):
    """Function from texts to (n, at, tf): all terms, and places and counts of the terms in ``place``."""

    def run(texts: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {"n": [], "at": [], "tf": []}
        for text in texts:
            found = terms(text)
            counts = Counter(found)
            mine = sorted((place[t], c) for t, c in counts.items() if t in place)
            out["n"].append(len(found))
            out["at"].append([i for i, _ in mine])
            out["tf"].append([c for _, c in mine])
        return out

    return run


@dataclass
class Items:
    """A block of items: their repeats of each term, and the terms' weights."""

    numbers: list[int]
    repeats: np.ndarray
    weights: np.ndarray


@dataclass
class Corpus:
    """Documents with a term, and all of their terms."""

    documents: int
    length: int


def impacts(tf: np.ndarray, n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Whole-number impact of ``tf`` occurrences in documents of ``n`` terms."""
    m = 25 + (75 * n * corpus.documents) // corpus.length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def levels(leaves: np.ndarray) -> list[np.ndarray]:
    """The rows, and above them the maxima of every node, from the lowest nodes up to one root."""
    out, size = [leaves], LEAF
    while len(out) == 1 or len(out[-1]) > 1:
        starts = np.arange(0, len(out[-1]), size)
        out.append(np.maximum.reduceat(out[-1], starts, axis=0))
        size = FAN
    return out


def children(node: int, depth: int, below: int) -> tuple[int, int]:
    """Range of a node's children at the level below ``depth``, which has ``below`` nodes."""
    wide = LEAF if depth == 1 else FAN
    return node * wide, min(node * wide + wide, below)


def alike_first(dense: np.ndarray, bits: int = 16) -> np.ndarray:
    """Order of documents by the presence of the terms that divide them best."""
    share = (dense > 0).mean(0)
    weight = dense.max(0) * share * (1 - share)
    told = np.argsort(-weight, kind="stable")[:bits]
    return np.lexsort([dense[:, t] > 0 for t in told[::-1]]) if len(told) else np.arange(len(dense))


class Best:
    """The k best (score, document) of each item, and the score that a document has to reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, floors.copy()
        self.rows: list[list[tuple[float, int]]] = [[] for _ in floors]

    def add(self, item: int, scores: np.ndarray, documents: np.ndarray) -> None:
        """``documents`` are places in an order that settles ties, the smaller first."""
        rows = sorted([*self.rows[item], *zip((-scores).tolist(), documents.tolist(), strict=True)])[: self.k]
        self.rows[item] = rows
        if len(rows) == self.k:
            self.floor[item] = max(self.floor[item], -rows[-1][0])


def search_batch(dense: np.ndarray, items: Items, floors: np.ndarray, k: int) -> tuple[Best, int]:
    """Best rows of ``dense`` (weighted impacts, in the order of ids) for each item, and the scores computed for that."""
    order = alike_first(dense)
    ordered = dense[order]
    doc_levels, item_levels = levels(ordered), levels(items.repeats.astype(dense.dtype))
    best, scored = Best(floors, k), 0

    def floor_of(depth: int, node: int) -> float:
        lo, hi = node, node + 1
        for d in range(depth, 0, -1):
            lo, hi = children(lo, d, len(item_levels[d - 1]))[0], children(hi - 1, d, len(item_levels[d - 1]))[1]
        return best.floor[lo:hi].min()

    columns = [[np.flatnonzero(node) for node in level] for level in item_levels]

    def bound(qd: int, q: int, dd: int, nodes: np.ndarray) -> np.ndarray:
        used = columns[qd][q]
        return doc_levels[dd][np.ix_(nodes, used)] @ item_levels[qd][q, used]

    top = (len(item_levels) - 1, 0, len(doc_levels) - 1)
    stack = [(*top, np.array([0]), bound(*top, np.array([0])))]
    while stack:
        qd, q, dd, nodes, bounds = stack.pop()
        nodes = nodes[(bounds >= floor_of(qd, q)) & (bounds > 0)]
        if not len(nodes):
            continue
        if dd and (dd >= qd or not qd):  # the side with more levels left goes down
            wide = LEAF if dd == 1 else FAN
            below = (nodes[:, None] * wide + np.arange(wide)).ravel()
            below = below[below < len(doc_levels[dd - 1])]
            bounds = bound(qd, q, dd - 1, below)
            if qd or dd > 1:
                stack.append((qd, q, dd - 1, below, bounds))
            else:
                scored += len(below)
                hit = (bounds >= best.floor[q]) & (bounds > 0)
                best.add(q, bounds[hit], order[below[hit]])
        else:
            for child in range(*children(q, qd, len(item_levels[qd - 1]))):
                bounds = bound(qd - 1, child, dd, nodes)
                if qd > 1 or dd:
                    stack.append((qd - 1, child, dd, nodes, bounds))
                else:
                    scored += len(nodes)
                    hit = (bounds >= best.floor[child]) & (bounds > 0)
                    best.add(child, bounds[hit], order[nodes[hit]])
    return best, scored


def _searched(items: Items, corpus: Corpus, floors: np.ndarray, k: int, doc_id: str):
    """Function from (id, n, at, tf) rows to the best of each batch for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                batch = batch.take(pc.sort_indices(batch.column(doc_id), null_placement="at_end"))
                dense = weighted_impacts(batch, items, corpus)
                best, _ = search_batch(dense, items, floors, k)
                found = [(n, int(-s), d) for n, rows in zip(items.numbers, best.rows, strict=True) for s, d in rows]
                at = pa.array([d for _, _, d in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _, _ in found], pa.int64()), batch.column(doc_id).take(at), pa.array([s for _, s, _ in found], pa.int64())],
                    names=["item", doc_id, "score"],
                )

    return run


def weighted_impacts(batch: pa.RecordBatch, items: Items, corpus: Corpus) -> np.ndarray:
    """Weighted impacts of a batch's documents, one column for each term of the items.

    As doubles where no score can pass 2^53, as 64-bit integers otherwise.
    """
    at, tf, n = batch.column("at"), batch.column("tf"), batch.column("n").to_numpy()
    sizes = np.diff(at.offsets.to_numpy())
    row, column = np.repeat(np.arange(len(sizes)), sizes), at.flatten().to_numpy()
    values = items.weights[column] * impacts(tf.flatten().to_numpy(), n[row], corpus)
    exact = int(values.max(initial=0)) * int(items.repeats.sum(1).max(initial=0)) < EXACT
    dense = np.zeros((len(sizes), len(items.weights)), np.float64 if exact else np.int64)
    dense[row, column] = values
    return dense


def item_rows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, text): distinct items with a term, numbered."""
    kept = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    return settle(kept.withColumn("item", F.monotonically_increasing_id()))


def search(
    docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", seeds: int = SEEDS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every item."""
    numbered = item_rows(items, item_id, text)
    total = numbered.count()
    blocks = max(1, -(-total // ITEM_BLOCK))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = numbered.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    parts = [_search_block(narrow, ordered.where(F.col("block") == b), k, seeds) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.join(numbered.drop("text"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(docs: DataFrame, block: DataFrame, k: int, seeds: int) -> DataFrame:
    """(item, doc_id, score) of the best of every batch for the items of one block."""
    rows = block.select("item", "text").collect()  # about ITEM_BLOCK rows
    given = [Counter(terms(r.text.encode())) for r in rows]
    place = {t: i for i, t in enumerate(sorted({t for c in given for t in c}))}
    schema = f"item long, doc_id {dict(docs.dtypes)['doc_id']}, score long"
    if not place:
        return docs.sparkSession.createDataFrame([], schema)
    counted, name = map_texts(docs, "text", _counted(place), "n long, at array<int>, tf array<long>", keep_text=False)
    counted = settle(counted.select("doc_id", f"{name}.*").where("n > 0"))
    sums = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    corpus = Corpus(sums.n, sums.l or 1)
    holding = {r["at"]: r["df"] for r in counted.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term
    df = np.array([holding.get(i, 0) for i in range(len(place))], np.float64)
    weights = np.floor(1000 * np.log((2 * corpus.documents + 2) / (2 * df + 1))).astype(np.int64)
    repeats = np.zeros((len(rows), len(place)), np.int64)
    for i, counts in enumerate(given):
        for term, times in counts.items():
            repeats[i, place[term]] = times
    order = alike_first(repeats)
    whole = Items([rows[i].item for i in order], repeats[order], weights)
    with_terms = counted.where(F.size("at") > 0)
    nothing = np.zeros(len(whole.numbers))
    sample = with_terms.orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(seeds).repartition(max(1, -(-seeds // BATCH)))
    first = sample.mapInArrow(_searched(whole, corpus, nothing, k, "doc_id"), schema)
    kth = Window.partitionBy("item").orderBy(F.col("score").desc())
    reached = first.withColumn("_r", F.row_number().over(kth)).where(F.col("_r") == k).select("item", "score").collect()  # a row an item
    known = {r["item"]: r["score"] for r in reached}
    floors = np.array([float(known.get(n, 0)) for n in whole.numbers])
    return with_terms.mapInArrow(_searched(whole, corpus, floors, k, "doc_id"), schema)


def search_sql(k: int = K, documents: str = "documents", items: str = "benchmark") -> str:
    """The same over all pairs with a common term, in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda t: f"UNNEST(REGEXP_EXTRACT_ALL(TRANSLATE({t}, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH doc_terms AS (SELECT doc_id, {words('text')} AS term FROM {documents}),
lengths AS (SELECT doc_id, COUNT(*) AS n FROM doc_terms GROUP BY doc_id),
corpus AS (SELECT COUNT(*) AS n_docs, CAST(SUM(n) AS BIGINT) AS n_terms FROM lengths),
item_terms AS (SELECT item_id, term, COUNT(*) AS times FROM (SELECT item_id, {words('text')} AS term FROM {items}) GROUP BY ALL),
wanted AS (SELECT DISTINCT term FROM item_terms),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM doc_terms SEMI JOIN wanted USING (term) GROUP BY ALL),
weights AS (SELECT term, CAST(FLOOR(1000 * LN((2 * n_docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, n_docs),
impact AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS x
  FROM tf JOIN weights USING (term) JOIN lengths USING (doc_id), corpus),
scores AS (SELECT item_id, doc_id, CAST(SUM(times * x) AS BIGINT) AS score FROM item_terms JOIN impact USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
