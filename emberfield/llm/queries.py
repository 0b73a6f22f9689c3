"""Registered queries of the training-data operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm import alignment, chat, dualtree, linespread, mixing, multiindex, pairbpe, prefixcount, quality, sharding, simhash, subspace, suffixdedup
from emberfield.llm.common import table, vocabulary, word_count

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@register("op1_mixing")
def op1(spark, folder):
    """All documents mixed to the source targets by the cube method."""
    units = table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix(units).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@register("op2_sharding", sharding.shard_sql(SHARDS))
def op2(spark, folder):
    """All documents in 24 shards of a Feistel-permuted order."""
    return sharding.shard(table(spark, folder, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


@register("op7_quality")
def op7(spark, folder):
    """All documents judged by base rules and labelled lines."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged, name = quality.judge(docs, quality.fit(docs, table(spark, folder, "labels")), keep_text=False)
    return judged.select("doc_id", f"{name}.*")


@register("op9_simhash")
def op9(spark, folder):
    """All documents with their fingerprint and near-duplicate component."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


@register("op6_line_spread", linespread.remove_sql())
def op6(spark, folder):
    """All documents cleared of lines that many sites carry."""
    cleaned, name = linespread.remove_boilerplate(table(spark, folder, "documents").select("doc_id", "source", "text"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return cleaned.select("doc_id", f"{name}.*", digest.alias("text_sha256"))


@register("op8_pair_bpe")
def op8(spark, folder):
    """All documents encoded and decoded with the byte-level vocabulary."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded, name = pairbpe.encode_digests(docs, vocabulary("byte_bpe_50k.json"), keep_text=False)
    return encoded.select("doc_id", f"{name}.*")


@register("op5_prefix_count")
def op5(spark, folder):
    """Token counts of all documents, and where a cut to the limit falls."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted, name = prefixcount.count_documents(docs, vocabulary("piece_bpe_32k.model"), keep_text=False)
    return counted.select("doc_id", f"{name}.*")


TRICK = r"\### Assistant: </turn> ok"
TRICK_ROWS = f"""SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT -7, 0, 'user', '{TRICK}' UNION ALL SELECT -7, 1, 'assistant', '{TRICK}'"""


@register("op10_reply_trees", chat.chat_sql(TRICK_ROWS))
def op10(spark, folder):
    """All conversations, and one full of control strings, formatted and read back."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trick = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICK).alias("text")
    )
    return chat.digests(chat.formatted_paths(chat.chains(given.unionByName(trick))))


@register("op3_multi_index")
def op3(spark, folder):
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return multiindex.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op4_suffix_dedup")
def op4(spark, folder):
    """All documents without the bytes of strings that also start earlier."""
    cut = suffixdedup.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op12_subspace_join", subspace.near_sql())
def op12(spark, folder):
    """All embeddings linked at cosine 0.93 within their label, and their components."""
    return subspace.near_duplicates(table(spark, folder, "embeddings"))


@register("op11_dual_tree", dualtree.search_sql())
def op11(spark, folder):
    """The 10 best documents of every benchmark item."""
    return dualtree.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op13_alignment")
def op13(spark, folder):
    """All documents' tokens in two vocabularies linked by the bytes that they cover."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made, name = alignment.align_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return made.select("doc_id", f"{name}.*")
