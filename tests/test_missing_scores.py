"""Missing scores are errors or NULL, never numbers; forests and components take what they are given."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberfield.functions import columns as c
from emberfield.operators import evaluation as ev
from emberfield.operators import fusion, models, ordering, raster, temporal
from emberfield.operators.components import connected_components

ROWS = "source_id string, country string, block_id string, is_eog_flare int, score double"


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_expressions_give_null(spark, missing):
    row = spark.createDataFrame([(missing, 0.4)], "a double, b double")
    got = row.select(
        c.calibrate(F.col("a"), F.lit(0.0), F.lit(1.0)), c.residual_fusion(F.col("a"), F.col("b"), F.lit(0.5)),
        c.residual_fusion(F.col("b"), F.col("a"), F.lit(0.5)), c.logit(F.col("a")),
    ).first()
    assert list(got) == [None] * 4


@pytest.mark.parametrize("missing", [None, float("nan")])
@pytest.mark.parametrize(
    "metric",
    [
        lambda df: ev.binary_metrics(df, ["country"], 0.5),
        lambda df: ev.average_precision(df, ["country"]),
        lambda df: ev.roc_auc(df, ["country"]),
        lambda df: ev.best_f1_threshold(df, ["country"]),
        lambda df: ev.macro_f1_threshold(df, []),
        lambda df: ev.grid_f1_threshold(df, ["country"], [0.5]),
    ],
)
def test_metrics_refuse(spark, metric, missing):
    rows = spark.createDataFrame([("a", "C", "x", 1, missing), ("b", "C", "x", 0, 0.3), ("d", "C", "x", 1, 0.9)], ROWS)
    with pytest.raises(Exception, match="missing or NaN score"):
        metric(rows).collect()


def test_fusions_refuse(spark):
    rows = spark.createDataFrame([("a", "C", 0.2, None, True), ("b", "C", 0.6, 0.5, True), ("d", "D", 0.4, 0.7, True)], "source_id string, country string, c double, v double, image boolean")
    with pytest.raises(Exception, match="missing or NaN score"):
        fusion.crossfit_fusion(rows, "c", "v").collect()
    reference = fusion.reference_statistics(rows, "c", "v")
    deploy = lambda df: fusion.deployment_policy(df, "guarded_cv_tabular", "c", "v", available="image", references=reference, alpha=0.5)
    with pytest.raises(Exception, match="missing or NaN score"):
        deploy(rows).collect()
    without = deploy(rows.withColumn("image", F.col("v").isNotNull())).collect()
    assert all(0 < r.deployed < 1 for r in without)
    with pytest.raises(Exception, match="missing or NaN score"):
        fusion.deployment_policy(rows.withColumn("c", F.col("v")), "compact_tabular", "c").collect()


def test_bootstrap_equals_plain_copies(spark):
    """Arrays of repeats against rows copied for each repeat, with ties and several slices."""
    import random

    draw = random.Random(1)
    rows = [(f"s{i}", "CD"[i % 2], f"b{i % 9}", int(draw.random() < 0.3), branch, round(draw.random(), 1)) for i in range(120) for branch in "uv"]
    df = spark.createDataFrame(rows, "source_id string, country string, block_id string, is_eog_flare int, branch string, score double")
    labels = {r[0]: r[3] for r in rows[::2]}
    df = df.withColumn("is_eog_flare", F.element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), F.col("source_id")))
    got = {(r.repeat, r.country, r.branch): r.pr_auc for r in ev.bootstrap_precision(df, "source_id", 7, 3).collect()}
    weights = {(r.country, r.source_id): list(r.drawn) for r in ev.drawn_repeats(df, "source_id", 7, 3).collect()}
    given = [r.asDict() for r in df.collect()]
    for (repeat, country, branch), value in got.items():
        own = [(r["score"], r["is_eog_flare"], weights.get((country, r["source_id"]), []).count(repeat)) for r in given if (r["country"], r["branch"]) == (country, branch)]
        positives = sum(y * w for _, y, w in own)
        total = 0.0
        for score in {s for s, _, w in own if w}:
            seen = sum(w for s, _, w in own if s >= score)
            found = sum(y * w for s, y, w in own if s >= score)
            total += sum(y * w for s, y, w in own if s == score) * found / seen
        assert value == pytest.approx(total / positives)
    assert len(got) == 7 * 2 * 2


def test_quantiles_agree_to_the_last_bit(spark):
    values = [(g, (i * 7919 % 1013) / 7.3) for g in "ab" for i in range(0, 1013 if g == "a" else 40)]
    df = spark.createDataFrame(values, "g string, x double")
    wanted = {"q05": ("x", 0.05), "q37": ("x", 0.37), "med": ("x", 0.5)}
    small = {r.g: tuple(r)[1:] for r in ordering.group_quantiles(df, ["g"], wanted).select("g", *wanted).collect()}
    large = {r.g: tuple(r)[1:] for r in ordering.group_quantiles(df, ["g"], wanted, hot_rows=10).select("g", *wanted).collect()}
    assert small == large


def test_forest_takes_rows_from_anywhere(spark):
    """No prefix of the table, in any order, holds all rows of the sample; all rows count."""
    rows = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("source_id"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"))
    far = spark.createDataFrame([("far", 1e6, 1e6)], rows.schema)
    scored = models.isolation_rank(rows.unionByName(far), ["a", "b"], trees=40).orderBy(F.desc("score")).limit(1).collect()
    assert scored[0].source_id == "far"
    drawn = rows.where(models._fraction(0, F.col("source_id"), "times") < 0.5)
    spots = [r[0] for r in drawn.select(F.substring("source_id", 2, 9).cast("int")).collect()]
    assert abs(len(spots) - 10_000) < 400 and abs(sum(spots) / len(spots) - 10_000) < 300


def test_components_of_text_nodes(spark):
    edges = spark.createDataFrame([("f0", "0a"), ("0a", "9c"), ("x", "y")], "a string, b string")
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {("f0", "0a"), ("9c", "0a"), ("0a", "0a"), ("y", "x"), ("x", "x")}
    pixels = spark.createDataFrame([("00ffe1", i, j, 50 if (i, j) in {(0, 0), (1, 1), (3, 3)} else 10) for i in range(4) for j in range(4)], "chip_id string, row int, col int, landcover int")
    got = raster.components_8(pixels).first()
    assert got.morph_built_components_per_10k == 2 * 10000 / 16
    assert got.morph_largest_built_component_fraction == pytest.approx(2 / 3)


def test_years_with_a_hole(spark):
    det = spark.createDataFrame([], "source_id string")
    with pytest.raises(ValueError, match="hole"):
        temporal.monthly_sequence(det, [2020, 2022])


def test_draws_move_packed_in_bounded_blocks(spark, monkeypatch, capsys):
    """Several tiles and blocks give the plain draws, for every key; rows and repeats are never multiplied out."""
    from hashlib import md5

    monkeypatch.setattr(ev, "DRAWS_AT_ONCE", 60, raising=False)
    rows = [(seed, f"s{i:03d}", "C", 0) for seed in (1, 2) for i in range(40)] + [(1, "p", "C", 1)]
    df = spark.createDataFrame(rows, "seed int, source_id string, country string, is_eog_flare int")
    drawn = ev.drawn_repeats(df, "source_id", 5, 3, ["seed"])
    got = {(r.seed, r.source_id): sorted(r.drawn) for r in drawn.collect()}
    want = {(1, "p"): [0, 1, 2, 3, 4]}
    for repeat in range(5):
        for slot in range(40):
            unit = int(md5(f"3:{repeat}:C:0:{slot}".encode()).hexdigest()[:15], 16) % 40
            for seed in (1, 2):
                want.setdefault((seed, f"s{unit:03d}"), []).append(repeat)
    assert got == want
    drawn.explain()
    assert "collect_list" not in capsys.readouterr().out


def _two_seeds(spark, units):
    """Rows of two seeds, two countries and two branches whose scores repeat; a third of the units are positive."""
    unit = F.col("id")
    seeds = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = spark.range(units).select(
        F.concat(F.lit("s"), F.lpad(unit.cast("string"), 6, "0")).alias("source_id"), F.concat(F.lit("C"), (unit % 2).cast("string")).alias("country"),
        F.concat(F.lit("b"), (unit % 7).cast("string")).alias("block_id"), (unit % 3 == 0).cast("int").alias("is_eog_flare"), seeds.alias("seed"), unit,
    )
    branch = F.explode(F.array(F.lit("u"), F.lit("v")))
    score = F.round((F.col("id") * 7919 + F.length("branch") * F.col("seed")) % 23 / 23 + F.when(F.col("branch") == "u", 0.1 * F.col("is_eog_flare")).otherwise(0.0), 3)
    return rows.withColumn("branch", branch).withColumn("score", score).drop("id")


def test_bootstrap_stores_less_than_its_draws(spark, monkeypatch):
    """Sums by score move on, not an array of repeats for each row of each key: 2,000 units x 500 repeats are a million draws."""
    from emberfield import session

    stored = []

    def settle(df):
        table = session.settle(df)
        stored.append(session.stored_bytes(table))
        return table

    monkeypatch.setattr(ev, "settle", settle)
    got = ev.bootstrap_differences(_two_seeds(spark, 2000), "source_id", "u", "v", 500, 3, ["seed"])
    assert got.count() == 1000
    assert sum(stored) < 500_000


@pytest.mark.parametrize("unit", ["source_id", "block_id"])
def test_bootstrap_in_many_blocks_chunks_and_slices(spark, monkeypatch, unit):
    df = _two_seeds(spark, 120)
    rate = lambda: {(r.seed, r.repeat, r.country, r.branch): r.pr_auc for r in ev.bootstrap_precision(df, unit, 5, 3, ["seed"]).collect()}
    whole = rate()
    for name, value in (("SCORES_AT_ONCE", 4), ("CELLS_AT_ONCE", 10), ("DRAWS_AT_ONCE", 60)):
        monkeypatch.setattr(ev, name, value, raising=False)
    assert rate() == pytest.approx(whole)
    assert len(whole) == 2 * 5 * 2 * 2
