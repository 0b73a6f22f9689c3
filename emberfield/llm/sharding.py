"""Sharding by a Feistel permutation over global row numbers. DataFrame functions only.

Rows are numbered 0 .. N-1 in id order and each number is sent through a keyed
permutation of 0 .. N-1; shard and slot follow from the permuted number by division,
so shard sizes differ by at most one row, slots have no gaps, and anyone who knows N
and the seed can compute where row number n lies, or which row lies in (shard, slot).

The permutation is a Feistel network on pairs (left, right) with left < a, right < b,
a = ceil(sqrt N), b = ceil(N / a). It permutes 0 .. ab-1, which overshoots N by fewer
than a numbers; a number that lands there is sent through again (cycle walking). The
numbers on such a walk differ, so ab - N more passes always suffice.

Cases: NULL ids come first and are ordered by size and checksum; repeated rows get
different slots; a NULL text has no bytes and checksum 0; an empty table gives no rows;
columns of ``docs`` other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import numbered

PRIME = (1 << 31) - 1
"""Round values stay below it, so that products fit in 63 bits in any engine."""

ROUNDS = 6
"""Even, so that the halves end where they began."""

ROW_OVERHEAD = 8
"""Bytes counted for a row besides its text."""


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4]) % PRIME for i in range(ROUNDS)]


def halves(rows: int) -> tuple[int, int]:
    """Sizes a, b of the two halves: ab >= rows > ab - a."""
    a = math.isqrt(max(rows, 1) - 1) + 1
    return a, -(-max(rows, 1) // a)


def _pass(number: Column, a: int, b: int, keys: list[int]) -> Column:
    """One pass of the network over 0 .. ab-1."""

    def step(state: Column, key: Column) -> Column:
        y = (state["right"] + key["k"]) % F.lit(PRIME)
        mixed = y * y % F.lit(PRIME) * y % F.lit(PRIME)
        return F.struct(state["right"].alias("left"), ((state["left"] + mixed) % key["m"]).alias("right"))

    big = lambda v: F.lit(v).cast("long")
    rounds = F.array(*[F.struct(big(k).alias("k"), big((a, b)[i % 2]).alias("m")) for i, k in enumerate(keys)])
    start = F.struct(((number - number % big(b)) / big(b)).cast("long").alias("left"), (number % big(b)).alias("right"))
    return F.aggregate(rounds, start, step, lambda s: s["left"] * big(b) + s["right"])


def permuted(number: Column, rows: int, seed: int = 0) -> Column:
    """Keyed permutation of 0 .. rows-1."""
    (a, b), keys = halves(rows), round_keys(seed)
    once, beyond = _pass(number, a, b, keys), a * b - rows
    if not beyond:
        return once
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(beyond)), once, lambda x, _: F.when(x < rows, x).otherwise(_pass(x, a, b, keys))
    )
    return F.when(once < rows, once).otherwise(walk)


def shard(docs: DataFrame, shards: int, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number, shard, slot) of every row.

    Only the id, size and checksum are shuffled. The order is decided by them, never by
    partitioning, so any rerun and any cluster gives the same shards.
    """
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id),
        (F.octet_length(bytes_) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    )
    total = docs.count()
    ranked = numbered(rows, [F.col(doc_id).asc_nulls_first(), F.col("size"), F.col("text_crc32")], "row_number")
    placed = ranked.withColumn("_at", permuted(F.col("row_number").cast("long"), total, seed))
    return placed.select(
        doc_id, "size", "text_crc32", F.col("row_number").cast("long").alias("row_number"),
        (F.col("_at") % shards).cast("int").alias("shard"),
        ((F.col("_at") - F.col("_at") % shards) / shards).cast("long").alias("slot"),
    )


def shard_sql(shards: int, seed: int = 0, documents: str = "documents") -> str:
    """The same shards in DuckDB SQL; the checksum folds the table of CRC-32 over the bytes."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    crc = f"""XOR(LIST_REDUCE(LIST_PREPEND(4294967295::BIGINT, LIST_TRANSFORM(REGEXP_EXTRACT_ALL(HEX(t), '..'), lambda x: CAST('0x' || x AS BIGINT))),
        lambda c, v: XOR(({table}::BIGINT[])[1 + (XOR(c, v) & 255)], c >> 8)), 4294967295::BIGINT)"""
    steps = "SELECT *, x // b AS l0, x % b AS r0 FROM {src}"
    for i, key in enumerate(round_keys(seed)):
        y = f"((r{i} + {key}) % {PRIME})"
        steps = f"SELECT *, r{i} AS l{i + 1}, (l{i} + {y} * {y} % {PRIME} * {y} % {PRIME}) % {'ab'[i % 2]} AS r{i + 1} FROM ({steps})"
    return f"""
WITH RECURSIVE sized AS (SELECT doc_id, COALESCE(text, '') AS t FROM {documents}),
summed AS (SELECT doc_id, CAST(STRLEN(t) + {ROW_OVERHEAD} AS BIGINT) AS size, {crc} AS text_crc32 FROM sized),
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM summed),
shape AS (SELECT n, a, CAST(CEIL(n / a) AS BIGINT) AS b FROM (SELECT n, CAST(CEIL(SQRT(n)) AS BIGINT) AS a FROM (SELECT COUNT(*) AS n FROM {documents}))),
walk AS (
  SELECT row_number, row_number AS x, 0 AS step FROM ranked
  UNION ALL
  SELECT row_number, l{ROUNDS} * b + r{ROUNDS}, step + 1
  FROM ({steps.format(src="walk, shape")}) WHERE step = 0 OR x >= n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, row_number
FROM ranked JOIN walk USING (row_number), shape WHERE step > 0 AND x < n"""
