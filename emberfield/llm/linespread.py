"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate.

One HyperLogLog sketch of sites per line hash, merged by ordinary aggregation, bounds how
many sites carry each line without gathering them. Lines whose estimate is clearly below
the threshold stay, lines clearly above are boilerplate, and only the lines in between
are counted exactly. "Clearly" is four standard errors of the sketch, plus one site.

A boilerplate line is removed from every text but one: the first document, by id, that
has it, so copies of one text on many sites leave one whole text behind. Documents in
which no word is left are marked as emptied.

Cases: lines with fewer than ``MIN_WORDS`` words are never removed; a NULL site counts as
one site; NULL texts stay NULL and empty ones empty; a very long text is cut whole, its hashes gathered as one
array; NULL ids come after all others; rows with the same id and
text are one document with the same result; empty tables give no rows; other columns stay,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import WORD, free_name, text_key, word_count
from emberfield.session import lookup, settle

SITES = 10
"""Sites from which on a line is boilerplate."""

MIN_WORDS = 3
SKETCH_BITS = 12
ERRORS = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)


def line_hash(line: Column) -> Column:
    """128 bits of a line as two longs, seen as one struct."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2"))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def eligible(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD)) >= MIN_WORDS


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(line, n_sites, exact) of the lines on at least ``sites`` sites.

    ``lines`` are rows (line, site); n_sites is exact near the threshold, an estimate beyond.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("site").cast("string")), F.lit("n"))
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, F.lit(SKETCH_BITS))).alias("n_sites"))
    likely = settle(sketched.where(F.col("n_sites") * (1 + ERRORS) + 1 >= sites))
    near = likely.where(F.col("n_sites") * (1 - ERRORS) - 1 < sites)
    sure = likely.where(F.col("n_sites") * (1 - ERRORS) - 1 >= sites).select("line", "n_sites", F.lit(False).alias("exact"))
    pairs = lines.select("line", site.alias("site")).join(lookup(near.select("line")), "line", "left_semi").distinct()
    counted = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n_sites"))
    return sure.unionByName(counted.where(F.col("n_sites") >= sites).withColumn("exact", F.lit(True)))


def remove_boilerplate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES
) -> tuple[DataFrame, str]:
    """``docs`` with cleaned text, and the name of a struct (n_lines, n_removed, emptied) added to them.

    Two passes over the texts: one makes line hashes, the other cuts the lines. Only the
    hashes of boilerplate lines, gathered for each document, meet the texts again.
    """
    key, made, found_id, found_key, gone, left = (free_name(docs, n) for n in ("_text_key", "_lines", "_found_id", "_found_key", "_cut_lines", "_kept_lines"))
    keyed = docs.withColumn(key, text_key(F.col(text)))
    listed = F.array_distinct(F.transform(F.filter(text_lines(F.col(text)), eligible), line_hash))
    lines = keyed.select(F.col(doc_id).alias("id"), F.col(key).alias("key"), F.col(site).alias("site"), F.explode(listed).alias("line"))
    common = lookup(boilerplate(lines, sites).select("line"))
    found = settle(lines.select("id", "key", "line").join(common, "line"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    first = lookup(found.groupBy("line").agg(F.min(place).alias("first")))
    spared = found.join(first, "line").where(place != F.col("first"))
    cut = spared.groupBy("id", "key").agg(F.collect_set("line").alias("cut"))
    joined = keyed.join(
        cut.select(F.col("id").alias(found_id), F.col("key").alias(found_key), F.col("cut").alias(gone)),
        F.col(doc_id).eqNullSafe(F.col(found_id)) & (F.col(key) == F.col(found_key)),
        "left",
    )
    whole = text_lines(F.col(text))
    kept = F.filter(whole, lambda s: ~(eligible(s) & F.array_contains(F.col(gone), line_hash(s))))
    touched = F.col(gone).isNotNull()
    cleaned = joined.withColumn(left, F.when(touched, kept))
    after = F.when(touched, F.array_join(left, "\n")).otherwise(F.col(text))
    removed = F.when(touched, F.size(whole) - F.size(left)).otherwise(0)
    return (
        cleaned.withColumn(
            made,
            F.struct(
                F.coalesce(F.size(whole), F.lit(0)).cast("long").alias("n_lines"),
                removed.cast("long").alias("n_removed"),
                (touched & (word_count(after) == 0)).alias("emptied"),
            ),
        )
        .withColumn(text, after)
        .select(*[f"`{c}`" for c in docs.columns], made),
        made,
    )


def remove_sql(sites: int = SITES, documents: str = "documents") -> str:
    """The same with exact counts, in DuckDB SQL."""
    return rf"""
WITH parts AS (SELECT doc_id, source, text, UNNEST(STRING_SPLIT(text, CHR(10))) AS line, UNNEST(RANGE(LEN(STRING_SPLIT(text, CHR(10))))) AS i FROM {documents}),
able AS (SELECT *, LEN(REGEXP_EXTRACT_ALL(line, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS} AS able FROM parts),
common AS (SELECT line, MIN(doc_id) AS first FROM able WHERE able GROUP BY line HAVING COUNT(DISTINCT COALESCE('s' || source, 'n')) >= {sites}),
marked AS (SELECT a.*, c.line IS NOT NULL AND a.able AND c.first <> a.doc_id AS cut FROM able a LEFT JOIN common c USING (line)),
per AS (SELECT doc_id, COUNT(*) AS n_lines, CAST(SUM(cut::INT) AS BIGINT) AS n_removed, STRING_AGG(line, CHR(10) ORDER BY i) FILTER (NOT cut) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_removed, 0) AS n_removed,
  COALESCE(n_removed, 0) > 0 AND NOT REGEXP_MATCHES(COALESCE(kept, ''), '[^\x20\x09-\x0D]') AS emptied,
  SHA256(CASE WHEN COALESCE(n_removed, 0) = 0 THEN COALESCE(text, '') ELSE COALESCE(kept, '') END) AS text_sha256
FROM {documents} LEFT JOIN per USING (doc_id)"""
