"""Near-duplicates by SimHash and a Gray-order hierarchical index.

Fingerprints: the majority of each bit over the XXH64 values of all 3-word shingles of
the lower-cased text. Texts with fingerprints at ``RADIUS`` or fewer differing bits are
linked and the linked components numbered by their smallest document.

Index: equal fingerprints first collapse to one class. The 64 bits are cut into five
strips; two fingerprints within three bits agree on at least two of them, so every class
is sent to the ten groups that its pairs of strips name, and no link can be missed.
Inside a group the fingerprints are sorted by Gray rank, which brings similar ones
together. Runs of neighbours form a node that keeps the bits on which all its members
agree, runs of nodes form an upper node in the same way, and a lower node keeps only the
agreed bits that its upper node lacks. A search walks down from the roots, adds up the
differing bits on the way and drops whole subtrees once the sum passes the radius.

Groups above ``HOT`` members are sent on to four groups each by the strips of their other
bits (three differing bits leave one strip equal), twice if need be, so that no group
grows with the copies of one text. Links inside a group are reduced to one link for each
member before they leave the task; components are found over those.

Cases: NULL and empty texts have fingerprint zero, as texts without words do; NULL ids
count after all others, and a component of NULL ids alone has a NULL id; repeated rows
are copies; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from emberfield.llm.common import map_texts
from emberfield.operators.components import connected_components
from emberfield.session import lookup, settle

RADIUS, SHINGLE, SEED = 3, 3, 42
STRIPS = (13, 13, 13, 13, 12)
"""Widths of the strips of the first routing, from the lowest bit up."""

HOT = 20_000
"""Members of a group above which it is sent on by further strips."""

LEAF = 8
"""Children of a node."""

SEARCHED = 2048
"""Fingerprints searched at once in a task."""


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    windows = zip(*(words[i:] for i in range(shingle)), strict=False)
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, windows), repeat(SEED)), np.uint64, len(words) - shingle + 1)


def fingerprint(text: bytes) -> int:
    """Majority of the bits of all shingle hashes."""
    return majority(shingle_hashes(text))


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """A bit is one if set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def _codes(texts: list[bytes]) -> dict[str, list]:
    return {"code": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}


def with_code(docs: DataFrame, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a struct column holding the fingerprint as a signed long, and its name."""
    return map_texts(docs, text, _codes, "code long", keep_text=keep_text)


# --- index -----------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence where neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_levels(codes: np.ndarray, starts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels from the leaves (the codes) to one root for each group.

    ``codes`` are sorted by (group, Gray rank), ``starts`` are the groups' first rows.
    Each level has value and mask (agreed bits not held above), and the children's range.
    """
    full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
    levels = [{"ones": codes, "zeros": ~codes, "agreed": full}]
    group_starts = starts
    while True:
        below = levels[-1]
        size = len(below["ones"])
        ends = np.append(group_starts[1:], size)
        nodes = -(-(ends - group_starts) // LEAF)
        if (ends - group_starts <= 1).all():
            break
        first = np.repeat(group_starts, nodes) + LEAF * (np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes))
        last = np.append(first[1:], size)
        ones, zeros = np.bitwise_and.reduceat(below["ones"], first), np.bitwise_and.reduceat(below["zeros"], first)
        agreed = ones | zeros
        below["mask"] = below["agreed"] & ~np.repeat(agreed, last - first)
        levels.append({"ones": ones, "zeros": zeros, "agreed": agreed, "first": first, "last": last})
        group_starts = np.cumsum(nodes) - nodes
    levels[-1]["mask"] = levels[-1]["agreed"]
    return levels


def near_pairs(codes: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs i < j of the same group within the radius; rows sorted by (group, Gray rank)."""
    if not len(codes):
        return
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    levels = build_levels(codes, starts)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    for lo in range(0, len(codes), SEARCHED):
        query = np.arange(lo, min(lo + SEARCHED, len(codes)))
        node, off = of[query], np.zeros(len(query), np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            off = off + np.bitwise_count((codes[query] ^ level["ones"][node]) & level["mask"][node])
            near = off <= radius
            query, node, off = query[near], node[near], off[near]
            if depth:
                wide = level["last"][node] - level["first"][node]
                at = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
                query, off, node = np.repeat(query, wide), np.repeat(off, wide), np.repeat(level["first"][node], wide) + at
        yield query[query < node], node[query < node]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole groups, one for each member that is not its cluster's first; rows come sorted by group."""

    def flush(route: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        rank = gray_rank(code)
        order = np.lexsort((rank, route))
        route, code = route[order], code[order]
        root = np.arange(len(code))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in near_pairs(code, route):
            fresh = root[a] != root[b]
            for i, j in zip(a[fresh].tolist(), b[fresh].tolist(), strict=True):
                i, j = find(i), find(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
        top = np.array([find(i) for i in np.flatnonzero(root != np.arange(len(root))).tolist()], np.int64)
        member = np.flatnonzero(root != np.arange(len(root)))
        signed = code.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[member]), pa.array(signed[top])], names=["a", "b"])

    routes, codes, rows = [], [], 0
    for batch in batches:
        routes.append(batch.column("route").to_numpy())
        codes.append(batch.column("code").to_numpy().view(np.uint64))
        rows += batch.num_rows
        if rows < HOT:
            continue
        route, code = np.concatenate(routes), np.concatenate(codes)
        whole = len(route) - int(np.argmax(route[::-1] != route[-1])) if route[0] != route[-1] else 0
        if whole:
            yield flush(route[:whole], code[:whole])
        routes, codes, rows = [route[whole:]], [code[whole:]], len(route) - whole
    if rows:
        yield flush(np.concatenate(routes), np.concatenate(codes))


def _strip_bits(widths: tuple[int, ...]) -> list[int]:
    """Masks of consecutive strips, lowest first."""
    masks, low = [], 0
    for width in widths:
        masks.append((1 << width) - 1 << low)
        low += width
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _narrower(mask: int) -> list[int]:
    """Masks that add to ``mask`` one of four strips of the bits outside it."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    cuts = [round(i * len(free) / 4) for i in range(5)]
    return [mask | sum(free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _routed(classes: DataFrame, masks: list[int]) -> DataFrame:
    """Every class once for each mask, with the bits under it as the group's key."""
    code = F.col("code")
    key = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), code.bitwiseAND(F.lit(_signed(m))).alias("bits"))
    return classes.select("code", F.explode(F.array(*[key(m) for m in masks])).alias("k")).select("code", "k.mask", "k.bits")


def linked_codes(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct codes that connect all codes within the radius of each other."""
    masks = [a | b for a, b in combinations(_strip_bits(STRIPS), 2)]
    routed, ready = _routed(classes, masks), []
    for level in range(3):
        sizes = settle(routed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
        large = sizes.where(F.col("_n") > hot) if level < 2 else sizes.limit(0)
        ready.append(routed.join(sizes.join(large, ["mask", "bits"], "left_anti") if level < 2 else sizes, ["mask", "bits"], "left_semi"))
        seen = [r.mask for r in large.select("mask").distinct().collect()]  # at most 10, then 40 masks
        if not seen:
            break
        again = routed.join(large, ["mask", "bits"], "left_semi")
        parts = []
        for mask in seen:
            parts.append(_routed(again.where(F.col("mask") == mask).select("code"), _narrower(mask % (1 << 64))))
        routed = parts[0]
        for part in parts[1:]:
            routed = routed.unionByName(part)
        routed = routed.distinct()
    whole = ready[0]
    for more in ready[1:]:
        whole = whole.unionByName(more)
    keyed = whole.select(F.xxhash64("mask", "bits").alias("route"), "code")
    return keyed.repartition("route").sortWithinPartitions("route").mapInArrow(_links, "a long, b long").distinct()


def components(coded: DataFrame, code: Column, order: Column) -> DataFrame:
    """(code, first): for every distinct code the smallest ``order`` value of its component."""
    classes = settle(coded.groupBy(code.alias("code")).agg(F.min(order).alias("first")))
    links = settle(linked_codes(classes.select("code")))
    if links.isEmpty():
        return classes
    labels = connected_components(links)
    joined = classes.join(labels.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    joined = settle(joined)
    smallest = joined.groupBy("root").agg(F.min("first").alias("first"))
    return joined.select("code", "root").join(smallest, "root").select("code", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, code, component_id) of every row."""
    coded, name = with_code(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep_text=False)
    coded = settle(coded.select("doc_id", F.col(f"{name}.code").alias("code")))
    found = lookup(components(coded, F.col("code"), F.col("doc_id")))
    return coded.join(found, "code").select("doc_id", "code", F.col("first").alias("component_id"))
