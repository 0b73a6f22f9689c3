"""Nested selection: which rows each model meets, how many are fitted, and that held-out labels move nothing."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from compare import SMALL, connect, difference
from pyspark.sql import functions as F

from emberfield.operators import nested
from emberfield.plans.catalogue import ORACLES, QUERIES

COUNTRIES = [f"c{i}" for i in range(6)]


def panel(spark, flipped=None):
    draw = random.Random(5)
    rows = []
    for i in range(240):
        country, y = COUNTRIES[i % 6], int(draw.random() < 0.4)
        x, v = draw.random() + 0.4 * y, draw.random() + 0.7 * y
        label = 1 - y if country == flipped else y
        rows.append((f"s{i}", country, f"b{i % 30}", label, f"e{i}" if label else None, x, v))
    return spark.createDataFrame(rows, "source_id string, country string, block_id string, is_eog_flare int, eog_flare_id string, x double, v double")


def scorer(column, fits):
    """A model of one number, the share of positives it was fitted on."""

    def run(train, test):
        seen = train.agg(F.avg("is_eog_flare"), F.collect_set("country")).first()
        fits.append((column, tuple(sorted(seen[1]))))
        squeezed = 1 / (1 + F.exp(-(F.col(column) * 3 - 2 + F.lit(seen[0]))))
        return test.select("source_id", squeezed.alias("score"))

    return run


def branches(fits):
    return {"compact_tabular": scorer("x", fits), "visual": scorer("v", fits), "all77_tabular": scorer("x", fits)}


def test_a_pair_is_fitted_once(spark):
    fits = []
    df = panel(spark)
    scored = nested.excluded_scores(df, {"compact_tabular": scorer("x", fits)}, 2)
    assert len(fits) == 15
    assert sorted(len(c) for _, c in fits) == [4] * 15
    met = nested.sides(df, scored).collect()
    assert len(met) == 15 and all((r.n_scored, r.n_trained, r.seen, r.repeated) == (80, 160, 0, 0) for r in met)


def test_inner_rows_come_from_models_without_both_countries(spark):
    fits = []
    inner = nested.inner_scores(panel(spark), branches(fits)).collect()
    assert len(inner) == 240 * 5 and len(fits) == 45
    assert Counter((r.held_out, r.country) for r in inner) == {(a, b): 40 for a in COUNTRIES for b in COUNTRIES if a != b}
    assert all(r.score_compact_tabular is not None and r.score_visual is not None for r in inner)


def test_held_out_labels_move_no_choice(spark):
    plain, judged = nested.nested_selection(panel(spark), branches([]))
    flipped, judged_flipped = nested.nested_selection(panel(spark, "c2"), branches([]))
    of = lambda df: sorted(tuple(r) for r in df.where("held_out = 'c2'").collect())
    assert of(plain) == of(flipped) and len(of(plain)) == 3
    assert sorted(tuple(r) for r in plain.collect()) != sorted(tuple(r) for r in flipped.collect())
    scores = lambda df: {(r.source_id, r.branch): (r.score, r.threshold) for r in df.where("held_out = 'c2'").collect()}
    assert scores(judged) == scores(judged_flipped)
    assert {r.branch for r in judged.select("branch").distinct().collect()} == {"compact_tabular", "all77_tabular", "guarded_cv_tabular", nested.CHAMPION}


def test_too_few_countries(spark):
    with pytest.raises(ValueError, match="fewer than 2"):
        nested.inner_scores(panel(spark).where("country = 'c1'"), branches([]))


@pytest.mark.parametrize("name", ["k19_nested_choices", "k19_nested_selection", "k19_nested_variants", "i8_pair_sides"])
def test_against_duckdb(spark, name):
    assert difference(QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLES[name]).df()) is None
