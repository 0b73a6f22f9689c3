"""Named queries with their oracle SQL.

A query is a function (spark, folder) -> DataFrame. Its oracle is DuckDB SQL over
the driver tables; common table expressions it mentions by name are added in
front. Doubles are rounded on both sides before comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.sources import bindings

Query = Callable[[SparkSession, str], DataFrame]
SHIFT = 0.000000271828
"""Added before rounding so that exact decimal halves, common in means of decimal
data, do not sit on a rounding edge where the last bit of a sum decides."""

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLAIN: dict[str, str] = {}
"""Oracles as written, without their tables, and the columns each rounds."""
DOUBLES: dict[str, str] = {}

CTES: dict[str, str] = {
    "detections": bindings.DETECTIONS,
    "faulty_detections": bindings.FAULTS,
    "sites_wide": bindings.SITES,
    "predictions": bindings.PREDICTIONS,
    "seed_predictions": f"SELECT {bindings.SEED_COLUMNS} FROM (SELECT *, UNNEST([272, 273, 274]) AS seed FROM predictions)",
    "pixels": bindings.PIXELS,
    "attempts": bindings.ATTEMPTS,
}

MATERIALIZED = {"month_sequence", "channel_scale"}
"""Tables that a planner must not repeat for each row that uses them."""


def _mentioned(text: str, seen: list[str]) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", text))
    for name in CTES:
        if name in words and name not in seen:
            _mentioned(CTES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_ctes(body: str) -> str:
    names = _mentioned(body, [])
    if not names:
        return body
    once = {n: " MATERIALIZED" if n in MATERIALIZED else "" for n in names}
    return "WITH " + ",\n".join(f"{n} AS{once[n]} ({CTES[n].strip()})" for n in names) + "\n" + body


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[
            (F.round(F.col(f"`{n}`").cast("double") + F.lit(SHIFT), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def query(name: str, oracle: str | None = None, doubles: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Register a query; ``doubles`` names the oracle columns to round."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _rounded(function(spark, folder), digits)

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if oracle:
            rounds = ", ".join(f"ROUND(CAST({c} AS DOUBLE) + {SHIFT:.12f}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            PLAIN[name], DOUBLES[name] = oracle.strip(), doubles
            pick = f"* REPLACE ({rounds})" if rounds else "*"
            ORACLES[name] = with_ctes(f"SELECT {pick} FROM (\n{oracle.strip()}\n) AS answer")
        return function

    return register
