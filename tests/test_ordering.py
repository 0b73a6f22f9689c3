"""Ordered computations against NumPy/pandas, with one key holding most rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from emberfield.operators import ordering
from emberfield.sources import bindings


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(4000) < 0.7, "hot", rng.choice(list("abcdef"), 4000))
    value = np.round(rng.normal(size=4000), 2)
    value[rng.random(4000) < 0.3] = 0.5
    pdf = pd.DataFrame({"id": [f"r{i:05d}" for i in range(4000)], "key": key, "value": value})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_row_numbers_split_a_hot_key(skewed):
    pdf, df = skewed
    got = ordering.row_numbers(df, ["key"], [F.col("value").desc(), F.col("id")]).toPandas()
    want = pdf.sort_values(["value", "id"], ascending=[False, True])
    want["row"] = want.groupby("key").cumcount() + 1
    merged = got.merge(want, on="id")
    assert (merged["row_x"] == merged["row_y"]).all()
    assert (got.groupby("key")["row_group"].first() == pdf.groupby("key").size()).all()


def test_running_totals_without_keys(skewed):
    pdf, df = skewed
    got = ordering.running_totals(df, [], [F.col("id")], {"total": F.col("value")}).orderBy("id").toPandas()
    assert np.allclose(got["total"], pdf.sort_values("id")["value"].cumsum())


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantiles(skewed, p):
    pdf, df = skewed
    got = ordering.exact_quantiles(df, ["key"], "value", {"q": p}).toPandas().set_index("key")["q"].sort_index()
    assert np.allclose(got, pdf.groupby("key")["value"].quantile(p).sort_index())


def test_hot_groups_take_the_other_way(skewed):
    pdf, df = skewed
    wanted = {"med": ("value", 0.5), "p90": ("value", 0.9)}
    got = ordering.group_quantiles(df, ["key"], wanted, hot_rows=500).toPandas().set_index("key").sort_index()
    grouped = pdf.groupby("key")["value"]
    assert np.allclose(got["med"], grouped.median()) and np.allclose(got["p90"], grouped.quantile(0.9))


def cells_ranked(monkeypatch):
    """Rows handed to running totals, call by call."""
    seen, original = [], ordering.running_totals
    monkeypatch.setattr(ordering, "running_totals", lambda df, *rest: seen.append(df.count()) or original(df, *rest))
    return seen


def test_hot_quantiles_rank_few_of_many_distinct_values(spark, monkeypatch):
    """Neither memory nor shuffle holds a cell for each distinct value of a hot group."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"key": np.where(np.arange(20_000) % 4 == 0, "a", "b"), "x": rng.lognormal(1, 2, 20_000), "y": rng.normal(0, 50, 20_000)})
    seen = cells_ranked(monkeypatch)
    wanted = {"med": ("x", 0.5), "q90": ("x", 0.9), "mid": ("y", 0.5)}
    df = spark.createDataFrame(pdf)
    got = ordering.group_quantiles(df, ["key"], wanted, hot_rows=1000).toPandas().set_index("key").sort_index()
    plain = ordering.group_quantiles(df, ["key"], wanted).toPandas().set_index("key").sort_index()
    assert got.equals(plain[got.columns]) and len(seen) == 1 and 0 < seen[0] < 3000


def test_medians_of_faulty_files_rank_few_values(spark, monkeypatch):
    """Unknown and negative powers of large files: the built-in medians, without a cell for each power."""
    faulty = bindings.faulty_detections(spark, SMALL)
    keys, wanted = ["country", "sensor", "year"], {"frp_med": ("frp", 0.5), "tmir_med": ("t_mir", 0.5)}
    seen = cells_ranked(monkeypatch)
    got = ordering.group_quantiles(faulty, keys, wanted, hot_rows=10).toPandas().set_index(keys).sort_index()
    plain = ordering.group_quantiles(faulty, keys, wanted).toPandas().set_index(keys).sort_index()
    assert got.equals(plain[got.columns]) and len(seen) == 1 and 0 < seen[0] < faulty.count() / 4


def test_hot_quantiles_of_odd_values(spark):
    """Narrow ranges, infinities, NaN, zeros of both signs, nulls only, groups of one value."""
    inf, nan = float("inf"), float("nan")
    groups = {
        "narrow": [1e6 + i / 1000 for i in range(101)], "wide": [10.0**e * s for e in range(-300, 300, 7) for s in (1, -1)],
        "infinite": [inf, -inf, 1.0, 2.0, 3.0, inf, -inf, 4.0], "nan": [nan, 1.0, nan, nan, 2.0, nan], "zero": [0.0, -0.0, 0.0, -1.0, -0.0, 1.0],
        "one": [7.5] * 9, "none": [None] * 8, "some": [None, 3.0, None, 1.0, 2.0, None], "small": [1.0, 4.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "key string, x double")
    wanted = {"low": ("x", 0.0), "q3": ("x", 0.3), "med": ("x", 0.5), "q9": ("x", 0.9), "high": ("x", 1.0)}

    def by_key(frame):
        return {r.key: [repr(r[n] + 0.0 if r[n] is not None else None) for n in wanted] for r in frame.collect()}

    plain = by_key(ordering.group_quantiles(df, ["key"], wanted))
    assert by_key(ordering.group_quantiles(df, ["key"], wanted, hot_rows=1)) == plain
    assert by_key(ordering.group_quantiles(df, ["key"], wanted, hot_rows=5)) == plain


def test_ranks_share_ties_and_skip_nulls(spark):
    pdf = pd.DataFrame(
        {"source_id": list("abcdef"), "country": ["x", "x", "y", "y", "y", "x"], "v": [1.0, 2.0, 100.0, 200.0, 200.0, None]}
    )
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = ordering.percentile_columns(df, "country", ["v"], "source_id").toPandas().set_index("source_id")
    want = pdf.groupby("country")["v"].rank(pct=True)
    assert np.allclose(got["v_country_pct"].sort_index(), want, equal_nan=True)
    last = ordering.percentile_columns(df, "country", ["v"], "source_id", nulls_last=True).toPandas().set_index("source_id")
    assert np.allclose(last["v_country_pct"].sort_index(), pdf.groupby("country")["v"].rank(pct=True, na_option="bottom"))


def test_two_countries_on_different_scales(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 1e6), ("d", "y", 2e6)], "source_id string, country string, v double")
    got = ordering.percentile_columns(df, "country", ["v"], "source_id").orderBy("source_id").toPandas()
    assert list(got["v_country_pct"]) == [0.5, 1.0, 0.5, 1.0]


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_results_do_not_depend_on_partitions(spark, skewed, partitions):
    _, df = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = ordering.row_numbers(df.orderBy(F.rand(partitions)), ["key"], [F.col("value"), F.col("id")])
        digest = rows.agg(F.sum(F.xxhash64("id", "row").cast("decimal(38,0)"))).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = ordering.row_numbers(df, ["key"], [F.col("value"), F.col("id")])
    assert digest == want.agg(F.sum(F.xxhash64("id", "row").cast("decimal(38,0)"))).first()[0]


def test_many_slices_equal_one(spark, skewed):
    """With adaptive merging off every slice is kept, so offsets are exercised."""
    pdf, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.row_numbers(df, ["key"], [F.col("value").desc(), F.col("id")]).toPandas()
        med = ordering.exact_quantiles(df, ["key"], "value", {"q": 0.5}).toPandas().set_index("key")["q"].sort_index()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = pdf.sort_values(["value", "id"], ascending=[False, True])
    want["row"] = want.groupby("key").cumcount() + 1
    merged = got.merge(want, on="id")
    assert (merged["row_x"] == merged["row_y"]).all()
    assert np.allclose(med, pdf.groupby("key")["value"].median().sort_index())
