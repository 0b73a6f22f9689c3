"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from emberfield.session import settle

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of anything but the six ASCII white space characters."""

CHUNK_BYTES = 1 << 20
"""Text handled at once inside a task; keeps numpy working sets small whatever the Arrow batch holds."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine; every worker has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_count(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits of a whole text, so that (id, key) names a document even where ids repeat or are NULL."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def batches_by_size(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` holding about ``limit`` bytes each; a longer text is alone in its range."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def map_texts(
    df: DataFrame,
    text: str,
    function: Callable[[list[bytes]], dict[str, list]],
    fields: str,
    limit: int = CHUNK_BYTES,
    keep_text: bool = True,
) -> tuple[DataFrame, str]:
    """``df`` with one more struct column, made from the UTF-8 bytes of whole texts in Arrow batches.

    ``function`` gets texts of about ``limit`` bytes in all (NULL: empty) and returns a value per
    text for each of ``fields`` (DDL). Returns the column's name too; as it is a fresh
    one, no column of ``df`` can clash with what the operator makes. Without ``keep_text``
    the text itself is left out, and crosses to Python once instead of twice.
    """
    made, raw = StructType.fromDDL(fields), free_name(df, "_bytes")
    name = free_name(df, "_made")
    kinds = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(raw).to_pylist()
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != raw]
            for lo, hi in batches_by_size(texts, limit):
                values = function(texts[lo:hi])
                added = pa.StructArray.from_arrays([pa.array(values[f.name], type=f.type) for f in kinds], fields=list(kinds))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for _, c in kept), added], names=[*(n for n, _ in kept), name])

    given = df.withColumn(raw, F.coalesce(F.col(text), F.lit("")).cast("binary"))
    if not keep_text:
        given = given.drop(text)
    fields_kept = [f for f in df.schema.fields if keep_text or f.name != text]
    return given.mapInArrow(run, StructType([*fields_kept, StructField(name, made)])), name


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add gapless global row numbers ``name`` from 0 in the given order, never sorting the table in one task.

    Rows are range-partitioned by the order and written once, so that the slices
    cannot move; the number is the slice's offset plus the rank in the slice. The
    only single-task step sees one row per slice.
    """
    placed = settle(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_slice").orderBy(*order)
    return (
        placed.join(F.broadcast(starts), "_slice")  # one row per shuffle partition
        .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_slice", "_start")
    )
