"""Detections to grid-cell sources, spatial blocks and nearest-site labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions.columns import GRID_M, LABEL_RADIUS_M, block_id, cell_index, cell_key, local_x, local_y
from emberfield.session import lookup, settle


def origins(det: DataFrame) -> DataFrame:
    """Projection origin per country, rounded so summation order cannot move a cell."""
    return det.groupBy("country").agg(
        F.round(F.avg("latitude"), 6).alias("lat0"), F.round(F.avg("longitude"), 6).alias("lon0")
    )


def project(df: DataFrame, origin: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Add local metres x, y. ``origin`` has one row per country (see ``lookup``)."""
    return (
        df.join(origin, "country")
        .withColumns(
            {
                "x": local_x(F.col(lon), F.col("lat0"), F.col("lon0")),
                "y": local_y(F.col(lat), F.col("lat0")),
            }
        )
        .drop("lat0", "lon0")
    )


def with_cells(df: DataFrame, grid_m=GRID_M) -> DataFrame:
    return df.withColumns({"ix": cell_index(F.col("x"), grid_m), "iy": cell_index(F.col("y"), grid_m)}).withColumn(
        "cell", cell_key(F.col("ix"), F.col("iy"))
    )


def source_id(country: Column, cell: Column) -> Column:
    return F.concat(country, F.lit("_"), cell.cast("string"))


def assign_detections(det: DataFrame, origin: DataFrame, grid_m: float = GRID_M) -> DataFrame:
    """Detections with local metres, cell and source id; narrow apart from the origin join."""
    located = with_cells(project(det, origin), grid_m)
    return located.withColumn("source_id", source_id(F.col("country"), F.col("cell"))).drop("ix", "iy")


def build_sources(located: DataFrame, *extra: str) -> DataFrame:
    """One row per (country, cell): counts, centroid, dates, block."""
    days = located.groupBy(*extra, "country", "cell", "acq_date").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in ("latitude", "longitude", "x", "y")],
    )
    out = days.groupBy(*extra, "country", "cell").agg(
        F.sum("n").alias("n_det"),
        (F.sum("s_latitude") / F.sum("n")).alias("lat"),
        (F.sum("s_longitude") / F.sum("n")).alias("lon"),
        (F.sum("s_x") / F.sum("n")).alias("x"),
        (F.sum("s_y") / F.sum("n")).alias("y"),
        F.min("acq_date").alias("date_min"),
        F.max("acq_date").alias("date_max"),
        F.count("acq_date").alias("n_days"),
    )
    return out.withColumns(
        {
            "span_days": F.datediff("date_max", "date_min"),
            "block_id": block_id(F.col("country"), F.col("x"), F.col("y")),
            "source_id": source_id(F.col("country"), F.col("cell")),
        }
    )


def label_sources(
    src: DataFrame,
    sites: DataFrame,
    origin: DataFrame,
    grid_m=GRID_M,
    radius_m: float = LABEL_RADIUS_M,
) -> DataFrame:
    """Nearest site among those in the cells round each source centroid.

    Every site is copied to the (2k+1)^2 cells it can reach, then joined on the
    cell, so work is linear in sites and never a distance cross join. The
    distance is kept beyond the radius, NULL when no site is near; the offshore
    flag stays set for unlabelled sources with a candidate.
    """
    k = math.ceil(radius_m / grid_m)
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-k, k + 1) for j in range(-k, k + 1)])
    placed = project(sites.select("flare_id", "country", "lat", "lon", "location"), origin, "lat", "lon")
    reachable = (
        with_cells(placed, grid_m)
        .withColumn("step", F.explode(around))
        .select(
            "country",
            (F.col("ix") + F.col("step.dx")).alias("ix"),
            (F.col("iy") + F.col("step.dy")).alias("iy"),
            "flare_id",
            "location",
            F.col("x").alias("sx"),
            F.col("y").alias("sy"),
        )
    )
    cells = src.select(
        "source_id",
        "country",
        "x",
        "y",
        cell_index(F.col("x"), grid_m).alias("ix"),
        cell_index(F.col("y"), grid_m).alias("iy"),
    )
    distance = F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))
    nearest = (
        cells.join(reachable, ["country", "ix", "iy"])
        .groupBy("source_id")
        .agg(F.min(F.struct(distance.alias("d"), "flare_id", "location")).alias("best"))
    )
    joined = src.join(nearest, "source_id", "left")
    hit = F.coalesce(F.col("best.d") <= radius_m, F.lit(False))
    return joined.select(
        *src.columns,
        F.col("best.d").alias("eog_dist_m"),
        hit.cast("int").alias("is_eog_flare"),
        F.when(hit, F.col("best.flare_id")).alias("eog_flare_id"),
        F.coalesce(F.col("best.location") == "OFFSHORE", F.lit(False)).alias("eog_offshore"),
    )


def labelled_sources(det: DataFrame, sites: DataFrame, grid_m: float = GRID_M) -> DataFrame:
    origin = lookup(origins(det))
    return label_sources(build_sources(assign_detections(det, origin, grid_m)), sites, origin, grid_m)


def source_summary(labelled: DataFrame, sites: DataFrame, *extra: str) -> DataFrame:
    """Per-country construction report, site counts included."""
    n = F.count(F.lit(1))
    found = F.count_distinct(F.when(F.col("is_eog_flare") == 1, F.col("eog_flare_id")))
    # The distinct count is its own aggregate: a mixed one would expand every row.
    recovered = labelled.groupBy(*extra, "country").agg(found.alias("eog_recovered"))
    base = labelled.groupBy(*extra, "country").agg(
        F.sum("n_det").alias("detections"),
        n.alias("sources"),
        F.count_if(F.col("n_det") == 1).alias("src_1det"),
        F.count_if(F.col("n_days") >= 5).alias("src_ge5days"),
        F.count_if(F.col("n_days") >= 30).alias("src_ge30days"),
        F.count_if(F.col("span_days") >= 365).alias("src_multiyear"),
        F.sum("is_eog_flare").alias("sources_matched"),
    )
    totals = sites.groupBy("country").agg(n.alias("eog_sites"))
    return (
        base.join(recovered, [*extra, "country"])
        .join(totals, "country", "left")
        .withColumn("eog_sites", F.coalesce("eog_sites", F.lit(0)))
        .withColumns(
            {
                "det_per_source": F.round(F.col("detections") / F.col("sources"), 1),
                "src_1det_pct": F.round(100 * F.col("src_1det") / F.col("sources"), 1),
                "eog_recall_pct": F.round(100 * F.col("eog_recovered") / F.greatest("eog_sites", F.lit(1)), 1),
                "pos_rate_pct": F.round(100 * F.col("sources_matched") / F.col("sources"), 3),
            }
        )
    )


def fine_cells(det: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """(country, fx, fy, n, sx, sy) of a fine grid, and the origins: one scan of the detections.

    Detections collapse to their distinct coordinates with a count; origins and cells follow from those.
    """
    spots = settle(det.groupBy("country", "latitude", "longitude").agg(F.count(F.lit(1)).alias("n")))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6)
    origin = lookup(spots.groupBy("country").agg(mean("latitude").alias("lat0"), mean("longitude").alias("lon0")))
    cells = project(spots, origin).groupBy("country", cell_index(F.col("x"), step).alias("fx"), cell_index(F.col("y"), step).alias("fy"))
    sums = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("sx"), F.sum(F.col("n") * F.col("y")).alias("sy"))
    return settle(sums), origin


def grid_sweep(
    det: DataFrame, sites: DataFrame, cells: tuple[int, ...] = (500, 1000, 2000), radius_m: float = LABEL_RADIUS_M
) -> DataFrame:
    """Recall and fragmentation for several cell sizes.

    Cells of the common divisor hold mergeable sums, which roll up to the cells of every size. The sites
    around are found by one join over (size, cell).
    """
    step = math.gcd(*cells)
    fine, origin = fine_cells(det, step)
    size = F.array(*[F.struct(F.lit(c).alias("grid_m"), F.lit(c // step).alias("k")) for c in cells])
    coarse = lambda c: F.floor(F.col(c) / F.col("g.k"))
    rolled = (
        fine.withColumn("g", F.explode(size))
        .groupBy(F.col("g.grid_m").alias("grid_m"), "country", coarse("fx").alias("cx"), coarse("fy").alias("cy"))
        .agg((F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"))
    )
    index = lambda c: F.floor(F.col(c) / F.col("grid_m")).cast("bigint")
    src = settle(rolled.withColumns({"ix": index("x"), "iy": index("y")}))
    reach = F.array(*[F.struct(F.lit(c).alias("grid_m"), F.lit(math.ceil(radius_m / c)).alias("k")) for c in cells])
    placed = project(sites.select("flare_id", "country", "lat", "lon"), origin, "lat", "lon")
    spread = lambda: F.explode(F.sequence(-F.col("g.k"), F.col("g.k")))
    around = (
        placed.withColumn("g", F.explode(reach)).withColumn("dx", spread()).withColumn("dy", spread())
        .withColumn("grid_m", F.col("g.grid_m"))
        .select("grid_m", "country", (index("x") + F.col("dx")).alias("ix"), (index("y") + F.col("dy")).alias("iy"), "flare_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    )
    own = ["grid_m", "country", "cx", "cy"]
    distance = F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))
    near = src.join(around, ["grid_m", "country", "ix", "iy"]).groupBy(*own).agg(F.min(F.struct(distance.alias("d"), "flare_id")).alias("best"))
    hits = near.where(F.col("best.d") <= radius_m).groupBy("grid_m", "country", F.col("best.flare_id").alias("flare_id")).agg(F.count(F.lit(1)).alias("n"))
    found = hits.groupBy("grid_m", "country").agg(F.sum("n").alias("sources_matched"), F.count(F.lit(1)).alias("eog_recovered"))
    counted = src.groupBy("grid_m", "country").agg(F.count(F.lit(1)).alias("sources"))
    totals = sites.groupBy("country").agg(F.count(F.lit(1)).alias("eog_sites"))
    whole = counted.join(found, ["grid_m", "country"], "left").join(totals, "country", "left").fillna(0, ["sources_matched", "eog_recovered", "eog_sites"])
    return whole.select(
        "grid_m", "country", "sources", "sources_matched", "eog_recovered",
        F.round(100 * F.col("eog_recovered") / F.greatest("eog_sites", F.lit(1)), 1).alias("eog_recall_pct"),
        F.round(F.col("sources_matched") / F.greatest("eog_recovered", F.lit(1)), 3).alias("fragments_per_site"),
    )
