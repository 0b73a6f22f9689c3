"""Mixing and sharding against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberfield.llm import mixing, sharding
from emberfield.llm.common import word_count
from emberfield.llm.queries import QUERIES, SHARDS

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, stopped, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in stopped and target[s] > most * sizes[s]}
        if not above:
            return target
        stopped |= above


def test_op1_totals(spark, sf, texts):
    got = QUERIES["op1_mixing"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.size == len(WORDS.findall(texts[r.doc_id])) for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want = plain_targets(sizes)
    taken, rows, chance = Counter(), Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        rows[r.source] += r.copies
        chance[r.source] += r.target / r.source_size
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, rel=0.01)
        assert rows[source] == pytest.approx(chance[source], rel=0.08)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in QUERIES["op1_mixing"](spark, sf).repartition(3).collect()}


def test_targets_stop_and_share_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 1, None: 300, "z": 0}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)
    assert got["a"] == 30 and got["d"] == 3 and got["z"] == 0


def test_flight_keeps_totals_and_means():
    draw = random.Random(5)
    sizes = [draw.randrange(1, 500) for _ in range(300)]
    chances = [draw.random() for _ in sizes]
    after = mixing.fly(sizes, chances, draw, land=False)
    assert sum(0 < p < 1 for p in after) <= 2
    assert sum(after) == pytest.approx(sum(chances))
    assert sum(s * p for s, p in zip(sizes, after)) == pytest.approx(sum(s * p for s, p in zip(sizes, chances)))
    times = [mixing.fly(sizes[:9], chances[:9], random.Random(i), land=False) for i in range(3000)]
    for i in range(9):
        assert sum(t[i] for t in times) / 3000 == pytest.approx(chances[i], abs=0.04)


def test_rounds_of_blocks(spark):
    units = spark.range(500).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 37 + 1).alias("size"), F.lit(0.4).alias("chance")
    )
    got = mixing.draw_copies(units, block=16).collect()
    assert len(got) == 500
    assert sum(r.drawn for r in got) == pytest.approx(200, abs=6)
    assert sum(r.drawn * r.size for r in got) == pytest.approx(0.4 * sum(r.size for r in got), rel=0.02)


def test_mixing_odd_rows(odd, none):
    units = lambda df: df.select("doc_id", "source", "kept", word_count(F.col("text")).alias("size"))
    got = mixing.mix(units(odd)).collect()
    assert len(got) == odd.count() and all(r.taken == r.copies * r.size for r in got)
    assert mixing.mix(units(none)).count() == 0


def test_op2_law(spark, sf, texts):
    got = QUERIES["op2_sharding"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    shards = defaultdict(list)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "rows")
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(SHARDS))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 97, 1024, 3001])
def test_permutation(spark, rows):
    got = [r[0] for r in spark.range(rows).select(sharding.permuted(F.col("id"), rows, 7)).collect()]
    assert sorted(got) == list(range(rows))
    if rows > 90:
        assert sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < 8


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard(odd, 4).collect()
    assert len({(r.shard, r.slot) for r in got}) == odd.count()
    assert sharding.shard(none, 4).count() == 0


def test_shards_do_not_hang_on_partitions(odd):
    assert set(sharding.shard(odd, 4).collect()) == set(sharding.shard(odd.repartition(5), 4).collect())


def test_mixing_keeps_clashing_columns(spark):
    """Columns named like the operator's own pass through or give way; the mix is the same."""
    rows = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), (F.col("id") % 17).alias("size"))
    clashing = rows.withColumns({c: F.col("doc_id") + 1 for c in ("target", "source_size", "_block", "_rate", "_whole", "_p", "chance", "drawn", "_given0", "_n")})
    plain = {r.doc_id: (r.target, r.copies, r.taken) for r in mixing.mix(rows).collect()}
    mixed = mixing.mix(clashing)
    assert set(mixed.columns) == set(clashing.columns) | {"copies", "taken"}
    got = mixed.collect()
    assert {r.doc_id: (r.target, r.copies, r.taken) for r in got} == plain
    assert all(r["_block"] == r["_rate"] == r["chance"] == r.doc_id + 1 for r in got)
