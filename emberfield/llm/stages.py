"""Stages of the corpus pipeline: documents in, documents out; the last one gives the encodings.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and keeps all of its
columns, whatever they are called. Rows are told apart by a number written with them once,
so NULL and repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm import linespread, mixing, neardup, pairbpe, quality
from emberfield.llm.common import free_name, table, vocabulary, word_count
from emberfield.session import settle


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are labelled as content for the most part."""
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged, name = quality.judge(docs, field)
    return judged.where(F.col(f"{name}.kept")).select(*_columns(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites carry; each such line stays in its first document.

    A document left without a word goes. ``n_chars``, where there is one, follows the text.
    """
    cleaned, name = linespread.remove_boilerplate(docs)
    left = cleaned.where(~F.col(f"{name}.emptied"))
    if "n_chars" in docs.columns:
        length = F.when(F.col(f"{name}.n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return left.select(*_columns(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies.

    Candidates come from the SimHash index and from bands; what links is a Jaccard similarity of 0.8 or
    more of the five-word shingles.
    """
    row = free_name(docs, "_row")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = neardup.signed(numbered.select(F.col(row).alias("row"), "doc_id", "text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row"))
    kept = [F.min_by(c, order).alias(c) for c in ("size", "bands", "code")]
    classes = settle(narrow.groupBy("key").agg(F.min(order).alias("first"), *kept).withColumn("id", F.col("first.row")).drop("key"))
    first = neardup.components(classes, numbered.select(F.col(row).alias("id"), "text")).select(F.col("first.row").alias(row))
    return numbered.join(first.hint("merge"), row, "left_semi").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the source targets takes them: not at all, once or more."""
    row = free_name(docs, "_row")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    units = numbered.select(F.col(row).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(units, order=("doc_id", "row")).where("copies > 0")
    copies = free_name(docs, "_copies")
    taken = mixed.select(F.col("row").alias(row), F.sequence(F.lit(1).cast("long"), F.col("copies")).alias(copies))
    # The copies of all documents are as long as the table: a join by row number at any size.
    return numbered.join(taken.hint("merge"), row).withColumn(copies, F.explode(copies)).select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256) of every document."""
    encoded, name = pairbpe.encode_digests(docs.select("doc_id", "source", "text"), vocabulary("byte_bpe_50k.json"), keep_text=False)
    return encoded.select("doc_id", "source", f"{name}.*")


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", keep_one_of_each),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]
