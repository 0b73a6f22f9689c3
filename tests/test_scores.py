"""Metrics, weights, folds, policies and contracts against brute force and invariants."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberfield.operators import contracts, evaluation, folds, fusion, ledger, policy, sampling, temporal


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(11)
    n = 900
    y = (rng.random(n) < 0.2).astype(int)
    country = np.where(rng.random(n) < 0.6, "a", rng.choice(["b", "c", "d"], n))
    score = np.round(np.clip(rng.random(n) * 0.7 + 0.3 * y, 0, 1), 2)
    pdf = pd.DataFrame(
        {
            "source_id": [f"s{i:04d}" for i in range(n)], "country": country,
            "block_id": [f"{c}{i % 37}" for i, c in enumerate(country)], "is_eog_flare": y,
            "eog_flare_id": [f"f{i % 50}" if v else None for i, v in enumerate(y)], "score": score,
        }
    )
    return pdf, spark.createDataFrame(pdf)


def brute_f1(y, s, t):
    hit = s >= t
    tp = (y[hit] == 1).sum()
    return 0.0 if hit.sum() + y.sum() == 0 else 2 * tp / (hit.sum() + y.sum())


def brute_ap(y, s):
    out, last = 0.0, 0.0
    for t in np.unique(s)[::-1]:
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        out, last = out + (recall - last) * y[hit].mean(), recall
    return out


def test_ap_and_auc(scored):
    pdf, df = scored
    got = evaluation.ranking(df, ["country"], ["pr_auc", "roc_auc"]).toPandas().set_index("country")
    for country, part in pdf.groupby("country"):
        y, s = part.is_eog_flare.to_numpy(), part.score.to_numpy()
        pos, neg = s[y == 1], s[y == 0]
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert math.isclose(got.loc[country, "pr_auc"], brute_ap(y, s)) and math.isclose(got.loc[country, "roc_auc"], auc)


def test_exact_threshold(scored):
    pdf, df = scored
    y, s = pdf.is_eog_flare.to_numpy(), pdf.score.to_numpy()
    f = {t: brute_f1(y, s, t) for t in np.unique(s)}
    got = evaluation.best_f1_threshold(df, []).first()
    best = max(f.values())
    assert math.isclose(got["best_f1"], best) and got["best_threshold"] == min(t for t in f if math.isclose(f[t], best))


def test_threshold_without_positives(scored):
    _, df = scored
    got = evaluation.best_f1_threshold(df.withColumn("is_eog_flare", F.lit(0)), []).first()
    assert got["best_f1"] == 0 and got["best_threshold"] > df.agg(F.max("score")).first()[0]


def test_macro_threshold(scored):
    pdf, df = scored
    macro = {
        t: np.mean([brute_f1(p.is_eog_flare.to_numpy(), p.score.to_numpy(), t) for _, p in pdf.groupby("country")])
        for t in np.unique(pdf.score)
    }
    got = evaluation.macro_f1_threshold(df, []).first()
    best = max(macro.values())
    assert math.isclose(got["macro_f1"], best, abs_tol=1e-9)
    assert got["threshold"] == min(t for t in macro if math.isclose(macro[t], best, abs_tol=1e-9))


def test_one_class_has_null_metrics(spark):
    df = spark.createDataFrame([("s", "a", 0, 0.4), ("t", "a", 0, 0.5)], "source_id string, country string, is_eog_flare int, score double")
    got = evaluation.ranking(df, ["country"], ["pr_auc", "roc_auc"]).first()
    assert got["pr_auc"] is None and got["roc_auc"] is None


def test_review_ties_prefer_smaller_ids(spark):
    rows = [(i, "a", "k", 0, None, 0.5) for i in ("s3", "s1", "s2")]
    df = spark.createDataFrame(rows, "source_id string, country string, block_id string, is_eog_flare int, eog_flare_id string, score double")
    got = evaluation.queue_membership(df, ["country"], (0.3,)).collect()
    assert [r["source_id"] for r in got] == ["s1"]


def test_bootstrap_is_repeatable(scored):
    _, df = scored
    both = df.withColumn("branch", F.lit("b")).unionByName(
        df.withColumn("score", F.round(F.col("score") * 0.9 + 0.1 * F.col("is_eog_flare"), 3)).withColumn("branch", F.lit("c"))
    )
    once, twice = (evaluation.block_bootstrap(both, "b", "c", 10, 7).first() for _ in range(2))
    assert once == twice and once["mean"] > 0 and once["lower_95"] <= once["mean"] <= once["upper_95"]


def test_weights_mean_one_and_equal_site_mass(scored):
    _, df = scored
    got = folds.sample_weights(df, 0.0, True).toPandas()
    assert math.isclose(got.weight.mean(), 1)
    mass = got[got.is_eog_flare == 1].groupby(["country", "eog_flare_id"]).weight.sum()
    for _, part in mass.groupby("country"):
        assert np.allclose(part, part.iloc[0])


def test_weights_see_training_rows_only(scored):
    _, df = scored
    fold = df.withColumn("fold", (F.crc32("block_id") % 3).cast("int"))
    changed = fold.withColumn("is_eog_flare", F.when(F.col("fold") == 0, 1 - F.col("is_eog_flare")).otherwise(F.col("is_eog_flare")))
    one, two = (
        folds.fold_training_weights(f, 3, 0.5, True).where("held_out = 0").select("source_id", "weight").toPandas().sort_values("source_id")
        for f in (fold, changed)
    )
    assert np.allclose(one.weight, two.weight)


def test_folds_keep_blocks_together(scored):
    _, df = scored
    got = folds.grouped_folds(df, 4).groupBy("block_id").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0]
    assert got == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=60), st.integers(1, 7))
def test_bulk_dealing_equals_one_by_one(sizes, k):
    loads, want = [0] * k, Counter()
    for size in sorted(sizes, reverse=True):
        fold = loads.index(min(loads))
        loads[fold] += size
        want[size, fold] += 1
    runs = folds.dealt_runs(sorted(Counter(sizes).items(), reverse=True), k)
    assert {(size, fold): last - first + 1 for size, fold, first, last in runs} == dict(want)
    for size, blocks in Counter(sizes).items():
        assert sorted(t for s, _, first, last in runs if s == size for t in range(first, last + 1)) == list(range(1, blocks + 1))


def test_folds_of_no_rows_and_of_one_large_block(spark):
    shape = "block_id string, x int"
    assert folds.grouped_folds(spark.createDataFrame([], shape), 3).count() == 0
    rows = [("big", i) for i in range(50)] + [(f"b{i}", 0) for i in range(7)]
    got = folds.grouped_folds(spark.createDataFrame(rows, shape), 3).groupBy("fold").count().toPandas()
    assert dict(zip(got["fold"], got["count"])) == {0: 50, 1: 4, 2: 3}


def test_linked_blocks_merge_inside_a_country(spark):
    rows = [("p", "b1", 1, "f"), ("p", "b2", 1, "f"), ("p", "b3", 0, None), ("q", "b1", 1, "f"), ("q", "b4", 1, "g")]
    df = spark.createDataFrame(rows, "country string, block_id string, is_eog_flare int, eog_flare_id string")
    got = folds.site_safe_blocks(df).toPandas()
    assert len(got) == 5 and got.evaluation_block.nunique() == 4
    assert got.groupby("evaluation_block").country.nunique().max() == 1


def test_alpha_zero_keeps_country_order(scored):
    pdf, df = scored
    rows = df.withColumnRenamed("score", "c").withColumn("v", F.rand(1))
    got = fusion.crossfit_fusion(rows, "c", "v", (0.0,)).toPandas()
    for _, part in got.groupby("country"):
        by_c = part.sort_values(["c", "source_id"])
        assert (np.diff(by_c.score) >= -1e-12).all()


def test_missing_image_falls_back(spark):
    rows = [("s1", "a", 0.2, 0.9, True), ("s2", "a", 0.2, 0.9, False)]
    df = spark.createDataFrame(rows, "source_id string, country string, score_compact_tabular double, score_visual double, image_available boolean")
    refs = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0)], "mean_c double, std_c double, mean_v double, std_v double")
    got = {r["source_id"]: r["deployed"] for r in fusion.deployment_policy(df, "guarded_cv_tabular", references=refs, alpha=0.5).collect()}
    assert math.isclose(got["s2"], 0.2) and got["s1"] > got["s2"]


def test_incomplete_seed_panel_is_an_error(spark):
    rows = [(s, "x", "a", "k", 0, None, 0.1) for s in (272, 273)]
    df = spark.createDataFrame(rows, "seed int, source_id string, country string, block_id string, is_eog_flare int, eog_flare_id string, score_a double")
    with pytest.raises(Exception, match="incomplete"):
        fusion.ensemble_predictions(df, ["score_a"]).collect()


def test_one_seed_without_gain_fails_acceptance(spark):
    seen = spark.createDataFrame([(0.02, -0.001)], "median double, lowest double")
    table = policy.conditions(seen, [("median", "median", ">=", 0.01), ("every seed", "lowest", ">", 0.0)])
    assert policy.verdict(table).first()["passed"] is False


def test_guard_prefers_the_simpler_branch(spark):
    rows = [(b, c, ap) for b, ap in (("base", 0.5), ("one", 0.6), ("two", 0.6)) for c in "pqrs"]
    metrics = spark.createDataFrame(rows, "branch string, country string, pr_auc double")
    got = policy.choose_candidate(metrics, "base", 3, 0.03).where("selected").collect()
    assert [r["branch"] for r in got] == ["one"]


def test_fingerprint_ignores_order_and_sees_changes(scored):
    _, df = scored
    columns = ["source_id", "is_eog_flare", "eog_flare_id"]
    one = contracts.table_fingerprint(df, columns).first()
    assert contracts.table_fingerprint(df.orderBy(F.rand(2)), columns).first() == one
    changed = df.withColumn("is_eog_flare", F.when(F.col("source_id") == "s0003", 1 - F.col("is_eog_flare")).otherwise(F.col("is_eog_flare")))
    assert contracts.table_fingerprint(changed, columns).first() != one
    assert contracts.table_fingerprint(df.unionByName(df.limit(1)), columns).first() != one


def test_joins_reject_duplicates_and_losses(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    with pytest.raises(Exception, match="duplicate"):
        contracts.join_one_to_one(left, left.unionByName(left.limit(1)).withColumnRenamed("v", "w"), ["k"]).collect()
    with pytest.raises(Exception, match="partner"):
        contracts.join_one_to_one(left, left.limit(1).withColumnRenamed("v", "w"), ["k"]).collect()


def test_holdout_leakage_and_rules(scored):
    _, df = scored
    with pytest.raises(ValueError):
        contracts.forbid_holdout(df, "a")
    with pytest.raises(ValueError):
        contracts.forbid_leakage(["frp_mean", "country"])
    with pytest.raises(ValueError, match="positive without site"):
        contracts.require(df.withColumn("eog_flare_id", F.lit(None).cast("string")))


def population(scored):
    _, df = scored
    noise = F.abs(F.xxhash64("source_id")) % 1000 / 1000.0
    return df.withColumns({c: F.round(F.col("score") + noise, 3) for c in temporal.HARDNESS})


def test_hard_negatives_respect_blocks(scored):
    frame = population(scored).withColumn("block_id", F.concat("country", F.lit("_"), F.col("source_id").substr(1, 4)))
    selected, diagnostics = temporal.hard_negative_sample(frame, 2, 5, "zz")
    rows = selected.toPandas()
    blocks = set(frame.where("is_eog_flare = 1").select("block_id").toPandas().block_id)
    assert not set(rows[rows.sample_role != "positive_site"].block_id) & blocks
    assert rows.source_id.is_unique and rows[rows.sample_role == "positive_site"].groupby("country").eog_flare_id.apply(lambda s: s.is_unique).all()
    again, _ = temporal.hard_negative_sample(frame, 2, 5, "zz")
    assert set(again.toPandas().source_id) == set(rows.source_id)
    assert diagnostics.count() == 4


def test_interleave_one_to_two(spark):
    rows = [(f"p{i}", "a", 1, i + 1) for i in range(2)] + [(f"u{i}", "a", 0, i + 1) for i in range(5)]
    df = spark.createDataFrame(rows, "source_id string, country string, is_eog_flare int, _r int")
    got = sampling.interleave(df).orderBy("batch_order").toPandas()
    assert list(got.source_id) == ["p0", "u0", "u1", "p1", "u2", "u3", "u4"]


def test_ledger_states_and_stop(spark):
    items = spark.createDataFrame([(1, "c1", 0), (2, "c2", 1), (3, "c3", 2)], "item_id bigint, chip_id string, batch_order int")
    log = spark.createDataFrame(
        [(1, 1, 1, "ok", "c1"), (1, 2, 2, "failed", "c1"), (2, 3, 3, "failed", "c2")],
        "item_id bigint, attempt_id bigint, attempted_at bigint, status string, chip_id string",
    )
    got = {r["item_id"]: r["status"] for r in ledger.attempt_ledger(items, log).collect()}
    assert got == {1: "ok", 2: "failed", 3: "pending"}
    assert [r["item_id"] for r in ledger.next_batch(ledger.attempt_ledger(items, log), 5).collect()] == [3]
    with pytest.raises(Exception, match="identity"):
        ledger.attempt_ledger(items, log.withColumn("chip_id", F.lit("c9"))).collect()
    run = spark.createDataFrame([(i, i, "ok" if i == 3 else "failed") for i in range(12)], "attempt_id bigint, attempted_at bigint, status string")
    assert ledger.stop_point(run).first()["stop_after"] == 10


def test_month_with_two_detections(spark):
    from datetime import date

    rows = [("s", date(2022, 1, 3), 10.0, 361.0, 300.0, "N", "MODIS"), ("s", date(2022, 1, 9), 20.0, 367.0, 300.0, "D", "VIIRS_SNPP")]
    df = spark.createDataFrame(rows, "source_id string, acq_date date, frp double, t_mir double, t_lwir double, daynight string, sensor string")
    got = temporal.monthly_sequence(df, (2022, 2023, 2024)).toPandas().set_index("month")
    first = got.loc[0]
    assert len(got) == 36 and first.mir_mean == 364 and first.saturation_fraction == 0.5 and first.modis_fraction == 0.5
    assert first.presence == 1 and got.presence.sum() == 1 and math.isclose(got.loc[3].month_sin, 1)


def test_stream_drops_repeats_and_late_rows(spark, tmp_path):
    from emberfield.streaming import detections as st

    def put(name, rows):
        spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double").coalesce(1).write.parquet(str(tmp_path / name))

    from datetime import datetime

    at = lambda d, h=0: datetime(2024, 1, d, h)
    put("f1", [(1, at(1, 2), 7, 1.0), (1, at(1, 2), 7, 1.0), (2, at(1, 5), 7, 2.0), (3, at(9), 7, 1.0)])
    put("f2", [(4, at(10), 7, 1.0)])
    put("f3", [(5, at(1, 6), 7, 50.0)])
    put("f4", [(6, at(25), 8, 1.0)])
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"

    def build():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
        return st.source_days(source, "ts", "user_id", "value", ["event_id"], "2 days")

    got = {str(r["day"]): (r["detection_count"], r["value_sum"]) for r in st.closed_rows(spark, build).collect()}
    assert got == {"2024-01-01": (2, 3.0), "2024-01-09": (1, 1.0), "2024-01-10": (1, 1.0)}


def test_leakage_report_names_every_column(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 2, None)], "source_id string, `x.y` int, lat double")
    got = {r["column"]: (r["leaking"], r["known"]) for r in contracts.leakage_report(df).collect()}
    assert got == {"source_id": (True, 2), "x.y": (False, 1), "lat": (True, 1)}
    with pytest.raises(ValueError, match="lat"):
        contracts.forbid_leakage(df.columns)


def test_evidence_faults_give_each_reason(spark):
    shape = "key string, value double"
    computed = spark.createDataFrame([("same", 0.5), ("off", 0.5), ("lost", 0.5), ("empty", None)], shape)
    stored = spark.createDataFrame([("same", 0.5 + 1e-13), ("off", 0.5 + 1e-9), ("gone", 0.5), ("empty", None)], shape)
    faults = contracts.evidence_faults(contracts.reconcile(computed, stored, ["key"]))
    assert {r["key"]: r["reason"] for r in faults.collect()} == {
        "off": "differs", "lost": "not stored", "gone": "not computed", "empty": "no value",
    }
