"""A frozen model is refused unless its manifest fits; a stream of files takes each file once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberfield.operators import models as md
from emberfield.session import scratch_folder
from emberfield.sources import ingest
from emberfield.streaming import detections as st

COLUMNS = ["n_days", "frp_mean"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(80).select(
        F.concat(F.lit("s"), "id").alias("source_id"), F.lit("H").alias("country"), F.concat(F.lit("b"), F.col("id") % 7).alias("block_id"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), (F.col("id") % 3 == 0).cast("int").alias("is_eog_flare"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("eog_flare_id"),
        (F.col("id") % 3 + F.col("id") % 5).cast("double").alias("n_days"), (F.col("id") % 11).cast("double").alias("frp_mean"),
    )


@pytest.fixture(scope="module")
def model(table):
    return md.fit_tabular(table, COLUMNS, md.logistic())


def test_round_trip(spark, table, model):
    place = scratch_folder(spark, "frozen")
    md.freeze(model, place, COLUMNS, 0.4, "nested", "H")
    loaded, columns, threshold = md.thaw(spark, place, "nested", "H")
    assert (columns, threshold) == (COLUMNS, 0.4)
    fresh = {r.source_id: r.score for r in md.frozen_score(model, table, COLUMNS, 0.4, "H").collect()}
    assert {r.source_id: r.score for r in md.frozen_score(loaded, table, columns, threshold, "H").collect()} == fresh


@pytest.mark.parametrize(
    "columns, threshold, protocol, holdout, message",
    [
        (COLUMNS, 0.4, "other", "H", "protocol"),
        (COLUMNS, 0.4, "nested", "I", "hold-out"),
        (COLUMNS[:1], 0.4, "nested", "H", "lacks"),
        ([], 0.4, "nested", "H", "empty"),
        (COLUMNS + COLUMNS, 0.4, "nested", "H", "duplicated"),
        (COLUMNS, 1.4, "nested", "H", "threshold"),
    ],
)
def test_refusals(spark, model, columns, threshold, protocol, holdout, message):
    place = scratch_folder(spark, "frozen")
    md.freeze(model, place, columns, threshold, protocol, holdout)
    with pytest.raises(ValueError, match=message):
        md.thaw(spark, place, "nested", "H")


def test_seen_holdout_is_refused(spark, model):
    place = scratch_folder(spark, "frozen")
    md.freeze(model, place, COLUMNS, 0.4, "nested", "H")
    spark.createDataFrame([("nested", COLUMNS, 0.4, "H", True)], md.MANIFEST).write.mode("overwrite").json(f"{place}/manifest")
    with pytest.raises(ValueError, match="hold-out"):
        md.thaw(spark, place, "nested", "H")


def csv(place, folder, name, bands, rows):
    header = ",".join(n for n in ingest.raw_schema(bands).fieldNames())
    (place / folder).mkdir(parents=True, exist_ok=True)
    (place / folder / name).write_text("\n".join([header, *rows]) + "\n")


ROW = "1.5,2.5,330.0,1.0,1.0,2020-01-0{},0136,T,X,n,6.1,290.0,5.0,D,0"


def test_files_stream_in_batches_and_once(spark, tmp_path):
    csv(tmp_path / "in", "modis", "modis_2020_Iraq.csv", ingest.MODIS_BANDS, [ROW.format(1), ROW.format(2)])
    csv(tmp_path / "in", "viirs_snpp", "viirs-snpp_2021_Libya.csv", ingest.VIIRS_BANDS, [ROW.format(3)])
    csv(tmp_path / "in", "viirs_noaa20", "viirs-noaa20_2021_Libya.csv", ingest.VIIRS_BANDS, [ROW.format(4)])
    target, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    st.stream_files(spark, str(tmp_path / "in"), target, progress, files_a_batch=1)
    csv(tmp_path / "in", "modis", "modis_2021_Iraq.csv", ingest.MODIS_BANDS, [ROW.format(5)])
    st.stream_files(spark, str(tmp_path / "in"), target, progress, files_a_batch=1)
    got = spark.read.parquet(target).collect()
    assert sorted(str(r.acq_date)[-1] for r in got) == list("12345")
    assert {(r.country, r.sensor, r.year) for r in got} >= {("Iraq", "MODIS", 2020), ("Libya", "VIIRS_N20", 2021), ("Iraq", "MODIS", 2021)}
    assert all(abs(r.t_mir - 330) < 1e-3 for r in got)


@pytest.mark.parametrize("name", ["modis_2020_Iraq.csv.bak", "modis_2020_Iraq.csv.gz", "modis_20_Iraq.csv"])
def test_other_names_are_refused(spark, tmp_path, name):
    csv(tmp_path / "in", "modis", name, ingest.MODIS_BANDS, [ROW.format(1)])
    with pytest.raises(Exception, match="unparseable|CSV|gzip|FAILED_READ_FILE"):
        ingest.read_detections(spark, str(tmp_path / "in"), ["modis"]).collect()
