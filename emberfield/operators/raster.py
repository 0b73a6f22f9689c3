"""Chip analytics over a pixel table (chip_id, row, col, six bands, scl, landcover).

A chip holds at most ``size``² pixels, so windows and exact percentiles per chip
are bounded; chips spread over the cluster by chip_id. Radii and the centre
square scale with the chip side, given here for the 200-pixel chips they were
defined on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.functions.columns import normalized_difference, safe_index
from emberfield.operators.components import connected_components

# Band order, clear classes, land-cover codes, chip geometry.
BANDS = ("blue", "green", "red", "nir", "swir16", "swir22")
INDICES = {"ndvi": ("nir", "red"), "ndbi": ("swir16", "nir"), "mndwi": ("green", "swir16")}
CLEAR_CLASSES = (4, 5, 6)
LAND_COVER = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)
BUILT = 50
PIXEL_M = 10
SIDE = 200
MIN_CLEAR, MAX_SCENES = 0.8, 8
LAYERS = (*BANDS, "ndvi", "ndbi", "mndwi", "bsi")
TEXTURED = ("red", "nir", "swir16", "ndvi", "ndbi", "bsi")
REGIONS = ("full", "center")


def with_masks(pixels: DataFrame, size: int = SIDE) -> DataFrame:
    """Validity, centre square, radius and strict indices of every pixel."""
    finite = F.lit(True)
    for band in BANDS:
        finite = finite & F.col(band).isNotNull() & ~F.isnan(band)
    inner = [F.col(c).between(size * 3 / 8, size * 5 / 8 - 1e-9) for c in ("row", "col")]
    middle = (size - 1) / 2
    return pixels.withColumns(
        {
            "valid": F.col("scl").isin(*CLEAR_CLASSES) & finite,
            "full": F.lit(True),
            "center": inner[0] & inner[1],
            "radius": F.sqrt(F.pow(F.col("row") - middle, 2) + F.pow(F.col("col") - middle, 2)) * (SIDE / size),
            **{name: normalized_difference(F.col(a), F.col(b)) for name, (a, b) in INDICES.items()},
        }
    )


def region_summaries(masked: DataFrame) -> DataFrame:
    """p10, median, p90 of bands and indices over valid pixels, full chip and centre.

    Conditional percentiles in one aggregation; no pixel is repeated per region.
    """
    wanted = {
        f"{region}_{name}": F.percentile(
            F.when(F.col("valid") & F.col(region), F.col(name)), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
        )
        for region in REGIONS
        for name in (*BANDS, *INDICES)
    }
    packed = masked.groupBy("chip_id").agg(*[v.alias(k) for k, v in wanted.items()])
    return packed.select(
        "chip_id",
        *[F.col(k)[i].alias(f"img_{k}_{stat}") for k in wanted for i, stat in enumerate(("p10", "median", "p90"))],
    )


def _mean_where(flag: Column, mask: Column) -> Column:
    return F.avg(F.when(mask, F.coalesce(flag, F.lit(False)).cast("int")))


def region_quality(masked: DataFrame) -> DataFrame:
    """Clear, land-cover, negative, strongly negative and index-valid fractions; review flag."""
    out = {}
    for region in REGIONS:
        inside, clear = F.col(region), F.col(region) & F.col("valid")
        negative = sum((F.col(b) < 0).cast("int") for b in BANDS)
        tail = sum((F.col(b) < -0.05).cast("int") for b in BANDS)
        out[f"{region}_clear_fraction"] = _mean_where(F.col("valid"), inside)
        out[f"{region}_worldcover_fraction"] = _mean_where(F.col("landcover") != 0, inside)
        out[f"{region}_negative_fraction"] = F.avg(F.when(clear, negative / len(BANDS)))
        out[f"{region}_below_minus005_fraction"] = F.avg(F.when(clear, tail / len(BANDS)))
        for name in INDICES:
            out[f"{region}_{name}_valid_fraction"] = _mean_where(F.col(name).isNotNull(), clear)
    rated = masked.groupBy("chip_id").agg(*[v.alias(k) for k, v in out.items()])
    return rated.withColumn("review_reflectance_tail", F.coalesce(F.col("full_below_minus005_fraction") > 0.005, F.lit(False)))


def class_fractions(masked: DataFrame, regions: Sequence[str] = REGIONS) -> DataFrame:
    """Land-cover shares over known pixels; NULL where none is known."""
    parts = [
        _mean_where(F.col("landcover") == code, F.col(region) & (F.col("landcover") != 0)).alias(f"img_{region}_wc_{code}_fraction")
        for region in regions
        for code in LAND_COVER
    ]
    return masked.groupBy("chip_id").agg(*parts)


def nearest_class_distance(pixels: DataFrame, size: int = SIDE, code: int = BUILT) -> DataFrame:
    """Metres from the chip centre to the nearest pixel centre of a class, NULL if absent."""
    away = F.hypot(F.col("row") + 0.5 - size / 2, F.col("col") + 0.5 - size / 2) * PIXEL_M
    return pixels.groupBy("chip_id").agg(
        F.min(F.when(F.col("landcover") == code, away)).alias("img_nearest_builtup_in_chip_m")
    )


def median_fill(masked: DataFrame) -> DataFrame:
    """Invalid pixels take the band median of the chip's valid ones, else 0."""
    w = masked.groupBy("chip_id").agg(
        *[F.coalesce(F.percentile(F.when(F.col("valid"), F.col(b)), F.lit(0.5)), F.lit(0.0)).alias(f"_m_{b}") for b in BANDS]
    )
    return (
        masked.join(w, "chip_id")
        .withColumns({b: F.when(F.col("valid"), F.col(b)).otherwise(F.col(f"_m_{b}")) for b in BANDS})
        .drop(*[f"_m_{b}" for b in BANDS])
    )


def finite_rgb(filled: DataFrame) -> DataFrame:
    """Red, green, blue clipped to [-0.05, 1.5]."""
    return filled.select(
        "chip_id", "row", "col",
        *[F.least(F.greatest(F.col(b), F.lit(-0.05)), F.lit(1.5)).alias(b) for b in ("red", "green", "blue")],
    )


def with_layers(filled: DataFrame) -> DataFrame:
    """Lenient indices on filled bands."""
    red, nir, blue = F.col("red"), F.col("nir"), F.col("blue")
    return filled.withColumns(
        {name: safe_index(F.col(a), F.col(b)) for name, (a, b) in INDICES.items()}
        | {"bsi": safe_index(F.col("swir16") + red, nir + blue)}
    )


def near(low: float, high: float) -> Column:
    return F.col("valid") & (F.col("radius") > low) & (F.col("radius") <= high)


def centre_ring_contrast(layered: DataFrame) -> DataFrame:
    """Median inside radius 25 minus median of the ring to 50, and the inner deviation."""
    out = []
    for c in LAYERS:
        inner = F.when(near(-1, 25), F.col(c))
        ring = F.when(near(25, 50), F.col(c))
        out.append((F.percentile(inner, F.lit(0.5)) - F.percentile(ring, F.lit(0.5))).alias(f"morph_{c}_center_minus_ring"))
        out.append(F.stddev_pop(inner).alias(f"morph_{c}_center_std"))
    return layered.groupBy("chip_id").agg(*out)


def _slope(value: Column, line: str, along: str) -> Column:
    """Central difference along one axis, one-sided where a neighbour is missing."""
    w = Window.partitionBy("chip_id", line).orderBy(along)
    here = F.col(along)
    back = F.when(F.lag(along).over(w) == here - 1, F.lag(value).over(w))
    ahead = F.when(F.lead(along).over(w) == here + 1, F.lead(value).over(w))
    return (
        F.when(back.isNotNull() & ahead.isNotNull(), (ahead - back) / 2)
        .when(ahead.isNotNull(), ahead - value)
        .when(back.isNotNull(), value - back)
        .otherwise(F.lit(0.0))
    )


def gradient_texture(layered: DataFrame) -> DataFrame:
    """Mean gradient over the chip and its 90th percentile inside radius 25."""
    flat = layered.withColumns({f"_z_{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in TEXTURED})
    across = flat.withColumns({f"_x_{c}": _slope(F.col(f"_z_{c}"), "row", "col") for c in TEXTURED})
    both = across.withColumns({f"_g_{c}": F.hypot(F.col(f"_x_{c}"), _slope(F.col(f"_z_{c}"), "col", "row")) for c in TEXTURED})
    out = []
    for c in TEXTURED:
        steep = F.col(f"_g_{c}")
        out.append(F.avg(F.when(F.col("valid"), steep)).alias(f"morph_{c}_gradient_mean"))
        out.append(F.percentile(F.when(near(-1, 25), steep), F.lit(0.9)).alias(f"morph_{c}_gradient_p90"))
    return both.groupBy("chip_id").agg(*out)


def builtup_radii(masked: DataFrame) -> DataFrame:
    """Built-up share within four radii and the density of built-up edges."""
    built = (F.col("landcover") == BUILT).cast("int")
    known = F.col("landcover") != 0

    def edge(line: str, along: str) -> Column:
        w = Window.partitionBy("chip_id", line).orderBy(along)
        return F.when(F.lead(along).over(w) == F.col(along) + 1, (F.lead(built).over(w) != built).cast("int"))

    edges = masked.withColumns({"_h": edge("row", "col"), "_v": edge("col", "row")})
    shares = [
        F.avg(F.when(known & (F.col("radius") <= r), built)).alias(f"morph_built_fraction_r{r}") for r in (10, 25, 50, 100)
    ]
    changed = F.coalesce(F.sum("_h"), F.lit(0)) + F.coalesce(F.sum("_v"), F.lit(0))
    pairs = F.count("_h") + F.count("_v")
    return edges.groupBy("chip_id").agg(
        *shares, F.when(pairs > 0, changed / pairs).alias("morph_built_edge_density")
    )


def components_8(pixels: DataFrame, code: int = BUILT) -> DataFrame:
    """8-connected built-up components per 10 000 known pixels and the largest one's share."""
    node = F.struct("chip_id", "row", "col")  # chip ids may be numbers or text
    built = pixels.where(F.col("landcover") == code).select("chip_id", "row", "col", node.alias("node"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    shifted = built.withColumn("s", steps).select(
        "chip_id", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), F.col("node").alias("a")
    )
    edges = shifted.join(built.withColumnRenamed("node", "b"), ["chip_id", "row", "col"]).select("a", "b")
    roots = built.join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = roots.groupBy("chip_id", "root").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.groupBy("chip_id").agg(
        F.count(F.lit(1)).alias("_c"), F.max("n").alias("_max"), F.sum("n").alias("_built")
    )
    known = pixels.groupBy("chip_id").agg(F.count_if(F.col("landcover") != 0).alias("_known"))
    return known.join(found, "chip_id", "left").select(
        "chip_id",
        F.coalesce(F.col("_c") * 10000 / F.greatest("_known", F.lit(1)), F.lit(0.0)).alias("morph_built_components_per_10k"),
        F.coalesce(F.col("_max") / F.col("_built"), F.lit(0.0)).alias("morph_largest_built_component_fraction"),
    )


def high_index_share(layered: DataFrame) -> DataFrame:
    return layered.groupBy("chip_id").agg(
        _mean_where(F.col("ndbi") > 0, near(-1, 25)).alias("morph_high_ndbi_center_fraction"),
        _mean_where(F.col("ndvi") > 0.4, near(-1, 25)).alias("morph_high_ndvi_center_fraction"),
    )


def chip_constraints(chips: DataFrame, pixels: DataFrame, window: tuple[str, str], size: int = SIDE) -> DataFrame:
    """(chip_id, failed rule): identity, dates, coverage, masks, tail, classes, bands, centre.

    ``chips`` carries chip_id, source_id, recorded_source_id, scene_date, bands,
    lat, lon, centre_lat, centre_lon.
    """
    finite = sum(F.col(b).isNotNull().cast("int") for b in BANDS)
    tail = sum((F.col(b) < -0.05).cast("int") for b in BANDS) / len(BANDS)
    clear = F.col("scl").isin(*CLEAR_CLASSES)
    stats = with_masks(pixels, size).withColumn("clear", clear).groupBy("chip_id").agg(
        F.count(F.lit(1)).alias("pixels"),
        _mean_where(F.col("clear"), F.col("full")).alias("clear_full"),
        _mean_where(F.col("clear"), F.col("center")).alias("clear_center"),
        F.count_if(F.when(F.col("clear"), finite != len(BANDS)).otherwise(finite != 0)).alias("mask_breaks"),
        F.avg(F.when(F.col("clear"), tail)).alias("tail"),
        F.count_if((F.col("landcover") != 0) & ~F.col("landcover").isin(*LAND_COVER)).alias("odd_classes"),
    )
    joined = chips.join(stats, "chip_id", "left")
    close = (F.abs(F.col("centre_lat") - F.col("lat")) <= 1e-7) & (F.abs(F.col("centre_lon") - F.col("lon")) <= 1e-7)
    rules = {
        "identity": F.col("source_id") != F.col("recorded_source_id"),
        "date window": ~F.col("scene_date").between(*[F.lit(d).cast("date") for d in window]),
        "shape": F.coalesce("pixels", F.lit(0)) != size * size,
        "coverage": F.coalesce(F.least("clear_full", "clear_center"), F.lit(0.0)) < MIN_CLEAR,
        "mask consistency": F.coalesce("mask_breaks", F.lit(0)) > 0,
        "reflectance tail": F.coalesce("tail", F.lit(0.0)) > 0.05,
        "land cover domain": F.coalesce("odd_classes", F.lit(0)) > 0,
        "band order": F.col("bands") != F.array(*[F.lit(b) for b in BANDS]),
        "centre": ~close,
    }
    failed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    return joined.select("chip_id", F.explode(failed).alias("rule"))


RECORDED = ("source_id", "country", "chip_id", "scene_id", "scene_time", "crs")


def record_constraints(chips: DataFrame, pixels: DataFrame) -> DataFrame:
    """(chip_id, failed rule) of what a chip's record says against the chip: status, identity, grid and masks.

    ``chips`` carries chip_id, status, collection, wanted_collection, transform (six numbers), the columns of
    ``RECORDED`` and each again with the prefix ``recorded_``. ``pixels`` carries chip_id, scl, landcover and the
    stored masks clear_mask and landcover_mask. Facts are one aggregate for each chip, and the rules a small
    table joined to them.
    """
    odd = lambda bad: F.count_if(F.coalesce(bad, F.lit(True)))
    facts = pixels.groupBy("chip_id").agg(
        odd(F.col("landcover_mask") != (F.col("landcover") != 0)).alias("landcover_breaks"),
        odd(F.col("clear_mask") & ~F.col("scl").isin(*CLEAR_CLASSES)).alias("scl_breaks"),
    )
    joined = chips.join(facts, "chip_id", "left")
    same = {f"{c} identity": F.col(c) == F.col(f"recorded_{c}") for c in RECORDED}
    at = F.col("transform")
    square = [F.abs(at[i] - value) <= 1e-8 + 1e-5 * abs(value) for i, value in enumerate((PIXEL_M, 0, None, 0, -PIXEL_M)) if value is not None]
    kept = same | {
        "status": F.col("status") == "ok",
        "collection": F.col("collection") == F.col("wanted_collection"),
        "pixel grid": (F.size("transform") == 6) & square[0] & square[1] & square[2] & square[3],
        "land cover mask": F.col("landcover_breaks") == 0,
        "scene class under clear mask": F.col("scl_breaks") == 0,
    }
    states = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(holds, F.lit(False)).alias("holds")) for name, holds in kept.items()])
    return joined.select("chip_id", F.explode(states).alias("s")).where(~F.col("s.holds")).select("chip_id", "s.rule")


def scene_statistics(scenes: DataFrame, pixels: DataFrame, size: int = SIDE, limit: int = MAX_SCENES) -> DataFrame:
    """Coverage, band coverage and tail of the first ``limit`` scenes of each chip, from integer bands.

    ``scenes`` is (chip_id, scene_id, cloud_cover, scale, offset), ``pixels`` (chip_id, scene_id, row, col, scl,
    bands). The narrow scene table is ranked first, so pixels of later scenes are never scaled. One pass over
    the pixels then gives all fractions.
    """
    w = Window.partitionBy("chip_id").orderBy("cloud_cover", "scene_id")
    first = scenes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("place")
    scaled = apply_scale(pixels.join(first, ["chip_id", "scene_id"]), F.col("scale"), F.col("offset"))
    finite = F.lit(True)
    for band in BANDS:
        finite = finite & F.col(band).isNotNull() & ~F.isnan(band)
    clear = F.col("scl").isin(*CLEAR_CLASSES)
    inner = [F.col(c).between(size * 3 / 8, size * 5 / 8 - 1e-9) for c in ("row", "col")]
    low = sum((F.col(b) < -0.05).cast("int") for b in BANDS) / len(BANDS)
    rows = scaled.withColumns({"_clear": clear, "_finite": clear & finite, "_centre": inner[0] & inner[1], "_low": low})
    stats = rows.groupBy("chip_id", "scene_id").agg(
        _mean_where(F.col("_clear"), F.lit(True)).alias("clear_full"),
        _mean_where(F.col("_clear"), F.col("_centre")).alias("clear_center"),
        _mean_where(F.col("_finite"), F.lit(True)).alias("finite_full"),
        _mean_where(F.col("_finite"), F.col("_centre")).alias("finite_center"),
        F.avg(F.when(F.col("_finite"), F.col("_low"))).alias("tail"),
    )
    fractions = ("clear_full", "clear_center", "finite_full", "finite_center", "tail")
    return first.join(stats, ["chip_id", "scene_id"], "left").fillna(0.0, fractions)


def choose_scene(scenes: DataFrame, limit: int = MAX_SCENES) -> DataFrame:
    """Least cloudy acceptable scene per chip among the first ``limit``; rejects with reasons.

    ``scenes`` has chip_id, scene_id, cloud_cover, clear_full, clear_center,
    finite_full, finite_center, tail; with scale and offset, these are judged too.
    Ranking stops at ``limit`` per chip before the shuffle.
    """
    w = Window.partitionBy("chip_id").orderBy("cloud_cover", "scene_id")
    first = scenes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    reason = (
        F.when(F.least("clear_full", "clear_center") < MIN_CLEAR, "cloud/coverage")
        .when(~_sound_scale() if {"scale", "offset"} <= set(scenes.columns) else F.lit(False), "invalid scale or offset")
        .when(F.least("finite_full", "finite_center") < MIN_CLEAR, "missing band pixels")
        .when(F.col("tail") > 0.05, "suspect reflectance offset")
    )
    rated = first.withColumn("reason", reason)
    best = F.min(F.when(F.col("reason").isNull(), F.struct("place", "scene_id")))
    tried = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("place", "scene_id", "reason"))))
    grouped = rated.groupBy("chip_id").agg(best.alias("best"), tried.alias("tried"))
    before = F.filter("tried", lambda t: F.col("best").isNull() | (t["place"] < F.col("best.place")))
    return grouped.select(
        "chip_id",
        F.col("best.scene_id").alias("scene_id"),
        F.size(before).alias("rejected"),
        F.array_join(F.transform(before, lambda t: F.concat_ws(":", t["scene_id"], t["reason"])), "|").alias("reasons"),
    )


def _sound_scale() -> Column:
    known = [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in ("scale", "offset")]
    return known[0] & known[1] & (F.col("scale") > 0)


def apply_scale(pixels: DataFrame, scale: float | Column, offset: float | Column, bands: Sequence[str] = BANDS) -> DataFrame:
    """Integer band values to reflectance; a column scale that is not positive gives NULL."""
    if isinstance(scale, Column):
        return pixels.withColumns({b: F.when(scale > 0, F.col(b) * scale + offset) for b in bands})
    if not scale > 0:
        raise ValueError("scale must be positive")
    return pixels.withColumns({b: F.col(b) * scale + offset for b in bands})


def covering_tiles(footprints: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """3° tile keys that a footprint (west, south, east, north) touches; antimeridian is an error.

    A footprint spans at most one degree, so at most four tiles.
    """
    west, south, east, north = (F.col(c) for c in ("west", "south", "east", "north"))
    wrapped = (east - west > 1) | (east < west)
    checked = F.when(wrapped, F.raise_error(F.lit("unsupported antimeridian footprint")).cast("boolean")).otherwise(F.lit(True))

    def steps(low: Column, high: Column) -> Column:
        return F.explode(F.sequence((3 * F.floor(low / 3)).cast("int"), (3 * F.floor(high / 3)).cast("int"), F.lit(3)))

    tiles = footprints.where(checked).withColumn("_lat", steps(south, north)).withColumn("_lon", steps(west, east))
    key = F.concat(
        F.when(F.col("_lat") >= 0, "N").otherwise("S"), F.lpad(F.abs("_lat").cast("string"), 2, "0"),
        F.when(F.col("_lon") >= 0, "E").otherwise("W"), F.lpad(F.abs("_lon").cast("string"), 3, "0"),
    )
    keyed = tiles.withColumn("tile", key).drop("_lat", "_lon")
    return keyed if catalogue is None else keyed.join(catalogue.select("tile"), "tile", "left_semi")


def feature_coverage(cohort: DataFrame, keys: Sequence[str] = ("country", "is_eog_flare", "status")) -> DataFrame:
    return cohort.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
