"""Countries that cannot fill a sample: an error of the operators, whole rows of the queries, as their SQL gives."""

from __future__ import annotations

import pytest

from emberfield.operators import sampling, temporal
from emberfield.plans import sampling_queries as sq
from emberfield.plans import temporal_queries as tq

RATED = ", ".join(f"{c} double" for c in temporal.HARDNESS)


@pytest.fixture
def rows(spark):
    """C0 has one known site and one free block, C5 known sites in all of its blocks."""
    data = [("a", "C0", "b0", 1, "s0"), ("b", "C0", "b1", 0, None), ("c", "C5", "b0", 1, "s1"), ("d", "C5", "b1", 1, "s2"), ("e", "C5", "b1", 0, None)]
    return spark.createDataFrame([(*r[:3], 1.0, 2.0, *r[3:]) for r in data], "source_id string, country string, block_id string, lat double, lon double, is_eog_flare int, eog_flare_id string")


def test_panels_keep_countries_below_their_quota(spark, rows, monkeypatch):
    monkeypatch.setattr(sq, "labels", lambda *_: rows)
    placed = {(r.source_id, r.batch_order) for r in sq.g2(spark, "").collect()}
    assert {s for s, _ in placed} == {"c", "d"} and {o for _, o in placed} == {0, 1}
    assert {r.source_id for r in sq.g1(spark, "").collect()} == {"a", "b", "c", "d"}
    assert {r.source_id for r in sq.g4(spark, "").collect()} == {"a", "b", "c", "d"}
    with pytest.raises(ValueError, match="insufficient"):
        sampling.quota_pilot(rows, 42)


def test_sample_keeps_countries_without_free_sources(spark, rows, monkeypatch):
    data = [(r.source_id, {"C5": "C1"}.get(r.country, r.country), r.block_id, r.is_eog_flare, r.eog_flare_id, 20, *[1.0] * len(temporal.HARDNESS)) for r in rows.collect()]
    pool = spark.createDataFrame(data, f"source_id string, country string, block_id string, is_eog_flare int, eog_flare_id string, n_days int, {RATED}")
    monkeypatch.setattr(tq, "pool", lambda *_: pool)
    assert {(r.source_id, r.sample_role) for r in tq.e4(spark, "").collect()} == {("a", "positive_site"), ("b", "hard_unlabeled"), ("c", "positive_site"), ("d", "positive_site")}
    full = {r.country: r for r in tq.e4_diagnostics(spark, "").collect()}
    assert full["C1"].available_unlabeled_after_block_guard == 0 and full["C1"].positive_block_unlabeled_excluded == 1
    assert {(r.source_id, r.sample_role) for r in tq.e5(spark, "").collect()} >= {("e", "population_only"), ("b", "hard_unlabeled")}
    assert {r.source_id for r in tq.e7(spark, "").collect()} == {"a", "b", "c", "d"}
    assert sum(r.sources for r in tq.e9(spark, "").collect()) == 4
    with pytest.raises(ValueError, match="free unlabelled"):
        temporal.hard_negative_sample(pool, 2, 13, "C5")


def test_stable_panel_of_known_sites_alone(spark, rows, monkeypatch):
    """On large part tables every cell of C5 lies near a site; the SQL then gives known sites only."""
    known = rows.where("is_eog_flare = 1")
    monkeypatch.setattr(sq, "labels", lambda *_: known)
    assert {(r.source_id, r.batch_order) for r in sq.g2(spark, "").collect()} == {("c", 0), ("d", 1)}
    with pytest.raises(ValueError, match="one label"):
        sampling.stable_panel(known, "C5", 60, 20, 13013)
