"""One binned vector for all feature sets: bins of the training rows, one fit a set, no feature outside it."""

from __future__ import annotations

import random

import pytest

from emberfield.operators import models as md


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    made = []
    for i in range(400):
        y = int(draw.random() < 0.5)
        made.append((f"s{i}", "c1" if i < 300 else "c2", "b", y, None, draw.random() + y, draw.random(), None if i % 7 == 0 else float(i % 5), None))
    return spark.createDataFrame(made, f"source_id string, country string, block_id string, {md.LABEL} int, eog_flare_id string, good double, noise double, some double, never double")


def test_bins_come_from_training_rows_and_hold_missing_values(rows):
    train, test = rows.where("country = 'c1'"), rows.where("country = 'c2'")
    own, held = md.binned(train, [train, test], ["good", "some"])
    bins = [r.bins.toArray() for r in own.collect()]
    assert max(b[0] for b in bins) <= md.BINS and len({b[0] for b in bins}) > 40
    missing = {b[1] for b, r in zip(bins, own.join(train.select("source_id", "some"), "source_id").collect(), strict=True) if r.some is None}
    assert missing
    assert held.count() == 100


def test_each_set_sees_its_features_only(rows):
    train, test = rows.where("country = 'c1'"), rows.where("country = 'c2'")
    sets = {"good": ["good"], "noise": ["noise"], "all": ["good", "noise", "some", "never"], "empty": ["never"]}
    scored = md.feature_ablation(train, test, sets, rounds=3)
    pairs = {b: [] for b in ("good", "noise", "all")}
    for r in scored.collect():
        pairs[r.branch].append((r.score, r[md.LABEL]))
    assert {b: len(p) for b, p in pairs.items()} == {"good": 100, "noise": 100, "all": 100}

    def area(p):
        wins = [(a > b) + (a == b) / 2 for a, x in p if x for b, y in p if not y]
        return sum(wins) / len(wins)

    assert area(pairs["good"]) > 0.9 and area(pairs["all"]) > 0.9 and area(pairs["noise"]) < 0.7
