"""Near copies that a SimHash of few bits cannot reach: exact Jaccard similarity of five-word shingles.

Two texts are linked if the sets of their lower-cased five-word shingles (XXH64 values)
have a Jaccard similarity of 0.8 or more; a text of fewer words is one shingle. SimHash
alone cannot carry this rule: at 0.8 two codes of 64 bits differ by about ten bits, and strips
that are complete for so many bits deal all texts into a handful of groups. So the links of the
SimHash index are the first candidates, and bands of minima bring what they cannot reach.

Candidates: equal sets collapse to one class. Classes linked by SimHash come first. ``BANDS`` keys of ``ROWS`` minima each
are made for a class; a pair at similarity s shares none with a chance of
(1 - s^ROWS)^BANDS, 3 in a million at 0.8 and less above. Every class is compared with
the hub of each of its bands, the class that meets most others, which connects groups of near copies in rows as many
as their members. A band that then holds several components is compared across them in tasks: its
members are dealt in tiles of about ``TILE``, each pair of tiles is one task's group, and what leaves it
are links that connect, never pairs. The common shingles are counted by products of
member-shingle matrices, a slice of the shingles at a time. A link is settled by the shingle sets themselves,
read once, for candidates only.

Cases: NULL, empty and wordless texts have the empty set and are copies of one another; a very long text is
read whole; repeated rows are copies, of which one stays; an empty table gives no rows; other columns are
never read, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from emberfield.llm.common import map_texts
from emberfield.llm.simhash import linked_codes, majority, shingle_hashes
from emberfield.llm.subspace import Forest
from emberfield.operators.components import connected_components
from emberfield.session import settle

SHINGLE, SEED = 5, 42
BANDS, ROWS = 32, 5
TILE, SLICE = 256, 8192
"""Members of a band, and shingles, compared at once in a task."""


FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE))


def band_keys(shingles: np.ndarray, step: int = 1 << 11) -> list[int]:
    """One signed key for each band, from the minima of its rows."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), step):
        mixed = (shingles[i : i + step, None] ^ SALTS) * FACTORS
        np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), band) for band, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _signatures(texts: list[bytes]) -> dict[str, list]:
    keys, sizes, bands, codes = [], [], [], []
    for text in texts:
        hashes = shingle_hashes(text, SHINGLE)
        shingles = np.unique(hashes)
        codes.append(majority(hashes))
        keys.append(xxh3_128_digest(shingles.tobytes()))
        sizes.append(len(shingles))
        bands.append(band_keys(shingles) if len(shingles) else [])
    return {"code": np.array(codes, np.uint64).view(np.int64), "key": keys, "size": sizes, "bands": bands}


def _shingles(texts: list[bytes]) -> dict[str, list]:
    return {"shingles": [shingle_set(t).view(np.int64) for t in texts]}


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and (code, key, size, bands) of each: SimHash, shingle set, its size, bands."""
    made, name = map_texts(docs, text, _signatures, "code long, key binary, size int, bands array<long>", keep_text=False)
    return made.select(*[c for c in made.columns if c != name], f"{name}.*")


def shingle_sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, shingles) of the asked ids, written once for all comparisons; ``texts`` is (id, text)."""
    asked = texts.join(ids.distinct().hint("merge"), "id", "left_semi")
    made, name = map_texts(asked, "text", _shingles, "shingles array<long>", keep_text=False)
    return settle(made.select("id", f"{name}.shingles"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets have a Jaccard similarity of 0.8 or more; ``sets`` is (id, shingles).

    With i common of n and m shingles, i / (n + m - i) >= 4 / 5 where 9 i >= 4 (n + m).
    """
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.where(9 * common >= 4 * (F.size("_x") + F.size("_y"))).select("a", "b")


def _alike_in_size(a: str, b: str) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def similar_links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar classes; ``classes`` is (id, size, bands, code), ``texts`` (id, text)."""
    near, member = settle(near_codes(classes)), _shared(classes.select("id", "size", F.explode("bands").alias("band")))
    sets = shingle_sets(member.select("id").unionByName(near.select(F.explode(F.array("a", "b")).alias("id"))), texts)
    to_hub = member.where((F.col("id") != F.col("hub.id")) & _alike_in_size("size", "hub.size"))
    pairs = near.unionByName(to_hub.select(F.col("id").alias("a"), F.col("hub.id").alias("b"))).distinct()
    links = settle(_similar(pairs, sets))
    return links.unionByName(settle(tile_links(_split_bands(member, links), sets)))


def _shared(dealt: DataFrame) -> DataFrame:
    """(band, id, size, hub) of the bands with several members.

    The hub is the member that meets most others over all of its bands: the text that copies
    were made from shares more bands with them than they do with each other.
    """
    counts = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    member = settle(dealt.join(counts.hint("merge"), "band"))
    met = member.groupBy("id").agg(F.sum("_n").alias("_met"))
    hub = F.max(F.struct("_met", (-F.col("id")).alias("_low"), "id", "size"))
    hubs = member.join(met.hint("merge"), "id").groupBy("band").agg(hub.alias("hub"))
    return settle(member.drop("_n").join(hubs.hint("merge"), "band"))


def _split_bands(member: DataFrame, links: DataFrame) -> DataFrame:
    """(band, id, root, tiles) of the members of bands that hold several components."""
    root = connected_components(links).withColumnRenamed("node", "id")
    labelled = settle(member.join(root.hint("merge"), "id", "left").select("band", "id", F.coalesce("root", "id").alias("root")))
    open_ = labelled.groupBy("band").agg(
        F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")
    )
    return settle(labelled.join(open_.where("_lo < _hi").select("band", "tiles").hint("merge"), "band"))


def tile_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of one band and different components, one tile pair to a group."""
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    place = lambda host, t, g: F.struct(F.lit(host).alias("host"), t.alias("tile"), g.alias("guest"))
    hosts = F.transform(F.sequence(own, F.col("tiles") - 1), lambda g: place(True, own, g))
    none = F.array().cast("array<struct<host:boolean,tile:int,guest:int>>")
    guests = F.when(own > 0, F.transform(F.sequence(F.lit(0), own - 1), lambda t: place(False, t, own))).otherwise(none)
    dealt = members.withColumn("_p", F.explode(F.concat(hosts, guests))).select("band", "_p.tile", "_p.guest", "_p.host", "id", "root")
    whole = dealt.join(sets.hint("merge"), "id")
    return whole.groupBy("band", "tile", "guest").applyInArrow(_compared, "a long, b long").distinct()


def _compared(key: tuple, rows: pa.Table) -> pa.Table:
    """Links of a tile with another one of its band, or with itself, that connect what is similar."""
    among, host = key[1].as_py() == key[2].as_py(), rows.column("host").to_numpy()
    sides = [rows.filter(pa.array(host)), rows.filter(pa.array(host if among else ~host))]
    ids, roots = ([t.column(c).to_numpy() for t in sides] for c in ("id", "root"))
    lists = [t.column("shingles").combine_chunks() for t in sides]
    sizes = [np.diff(x.offsets.to_numpy()) for x in lists]
    n, m = map(len, ids)
    forest, whole = Forest(n + m), np.concatenate(ids)
    if n and m:
        flat = [x.flatten().to_numpy() for x in lists]
        row = [np.repeat(np.arange(len(x)), x) for x in sizes]
        shared = np.intersect1d(*flat)
        common = np.zeros((n, m))
        for lo in range(0, len(shared), SLICE):
            part = shared[lo : lo + SLICE]
            dense = []
            for values, at, height in zip(flat, row, (n, m), strict=True):
                column = np.minimum(np.searchsorted(part, values), len(part) - 1)
                there = part[column] == values
                block = np.zeros((height, len(part)), np.float32)
                block[at[there], column[there]] = 1
                dense.append(block)
            common += dense[0] @ dense[1].T
        similar = (9 * common >= 4 * (sizes[0][:, None] + sizes[1])) & (roots[0][:, None] != roots[1])
        a, b = np.nonzero(similar)
        forest.link(a, b if among else n + b)
    child, root = forest.edges()
    return pa.table({"a": pa.array(whole[child], pa.int64()), "b": pa.array(whole[root], pa.int64())})


def near_codes(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that the SimHash index links: each with the first one of its code, and first ones of linked codes."""
    first = settle(classes.groupBy("code").agg(F.min(F.struct("id", "size")).alias("hub")))
    alike = classes.join(first.hint("merge"), "code").where(F.col("id") != F.col("hub.id"))
    same = alike.where(_alike_in_size("size", "hub.size")).select(F.col("id").alias("a"), F.col("hub.id").alias("b"))
    hub = lambda side: first.select(F.col("code").alias(side), F.col("hub").alias(f"_{side}"))
    linked = linked_codes(first.select("code")).join(hub("a").hint("merge"), "a").join(hub("b").hint("merge"), "b")
    near = linked.where(_alike_in_size("_a.size", "_b.size"))
    return same.unionByName(near.select(F.greatest("_a.id", "_b.id").alias("a"), F.least("_a.id", "_b.id").alias("b")))


def components(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(first) of every component; ``classes`` is (id, first, size, bands, code), ``texts`` (id, text).

    ``first`` is the smallest place of a class's rows, ``id`` names the row whose text stands for the class.
    """
    links = settle(similar_links(classes.select("id", "size", "bands", "code"), texts))
    if links.isEmpty():
        return classes.select("first")
    root = connected_components(links).withColumnRenamed("node", "id")
    joined = classes.select("id", "first").join(root.hint("merge"), "id", "left")
    return joined.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first")).select("first")
