"""Known-site inventory: wide yearly volumes to active sites."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INFO = ["country", "lat", "lon", "location"]


def active_sites(wide: DataFrame, years: Iterable[int], prefix: str = "y") -> DataFrame:
    """Sites with a positive volume in any of ``years``; ``vol`` is NULL if every year is.

    Years without a column are ignored.
    """
    present = [f"{prefix}{year}" for year in years if f"{prefix}{year}" in wide.columns]
    if not present:
        raise ValueError("none of the years is a column of the inventory")
    volumes = [F.col(c) for c in present]
    known = F.coalesce(*volumes)
    total = sum((F.coalesce(v, F.lit(0.0)) for v in volumes), F.lit(0.0))
    active = F.greatest(*[F.coalesce(v, F.lit(0.0)) for v in volumes]) > 0
    return wide.where(active).select("flare_id", *INFO, F.when(known.isNotNull(), total).alias("vol"))
