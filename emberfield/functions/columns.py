"""Column expressions: geometry, reflectance indices, calibration, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid and the physics thresholds.
EARTH_RADIUS_M = 6_371_000.0
GRID_M = 1000
BLOCK_M = 10_000
LABEL_RADIUS_M = 1000
SATURATION_K = 367.0
METRES_PER_DEGREE = 111_320.0


def local_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    return F.radians(lon - lon0) * F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat0))


def local_y(lat: Column, lat0: Column) -> Column:
    return F.radians(lat - lat0) * F.lit(EARTH_RADIUS_M)


def cell_index(metres: Column, cell_m) -> Column:
    cell = cell_m if isinstance(cell_m, Column) else F.lit(float(cell_m))
    return F.floor(metres / cell).cast("bigint")


def cell_key(ix: Column, iy: Column) -> Column:
    """Single bigint key of a grid cell."""
    return (ix + F.lit(2_000_000)) * F.lit(4_000_000) + (iy + F.lit(2_000_000))


def block_id(country: Column, x: Column, y: Column, block_m: int = BLOCK_M) -> Column:
    bx, by = cell_index(x, block_m), cell_index(y, block_m)
    return F.concat(country, F.lit("_b"), ((bx + 100_000) * 1_000_000 + by + 100_000).cast("string"))


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6) + 1).cast("int")
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def normalized_difference(a: Column, b: Column) -> Column:
    """(a-b)/(a+b) for non-negative operands with a sum above 1e-6, else NULL."""
    return F.when((a >= 0) & (b >= 0) & (a + b > 1e-6), (a - b) / (a + b))


def safe_index(a: Column, b: Column) -> Column:
    """(a-b)/(a+b) wherever the sum is not near zero; negative operands allowed."""
    return F.when(F.abs(a + b) > 1e-6, (a - b) / (a + b))


def is_score(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def finite_score(value: Column, name: str = "score") -> Column:
    """The value itself; a missing or NaN score is an error, not a number."""
    return F.when(is_score(value), value).otherwise(F.raise_error(F.lit(f"missing or NaN score: {name}")).cast("double"))


def logit(score: Column) -> Column:
    """NULL for a missing score: least and greatest would turn it into a bound."""
    clipped = F.least(F.greatest(score, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.when(is_score(score), F.ln(clipped) - F.log1p(-clipped))


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def calibrate(score: Column, mean: Column, std: Column) -> Column:
    """Logit, z-score against reference statistics, back through the sigmoid."""
    return sigmoid((logit(score) - mean) / F.when(std.isNotNull(), F.greatest(std, F.lit(1e-6))))


def residual_fusion(compact: Column, visual: Column, alpha: Column) -> Column:
    """Move an uncertain compact score towards the visual one; NULL if either is missing."""
    moved = compact + alpha * 4 * compact * (1 - compact) * (visual - compact)
    return F.when(is_score(moved), F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)))


def seeded_order(seed, identifier: Column) -> Column:
    """Engine-portable pseudo-random order key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), identifier.cast("string")), 256)


def chip_id(country: Column, source_id: Column) -> Column:
    return F.substring(F.sha2(F.concat(country, F.lit(":"), source_id), 256), 1, 20)


def is_true(value: Column) -> Column:
    """Booleans read from text: true/1/yes count, 'False' and NULL do not."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def null_if_not_finite(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), value)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
