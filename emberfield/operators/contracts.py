"""Data contracts: fingerprints, safe joins, row rules, panel and evidence checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.operators.features import BLOCKED
from emberfield.session import with_row


def canonical_row(columns: Sequence[str]) -> Column:
    """Row digest; NULL reads '<NA>'."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns]), 256)


def table_fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free digest of a table, per key if given.

    The first 128 bits of the row digests are summed as two 64-bit words, so
    partial sums combine on the map side and no task holds a list of rows. Words
    are added as decimals with room for 10^18 rows. Duplicated rows change the
    digest.
    """
    digest = df.select(*keys, canonical_row(columns).alias("_d"))
    words = [F.conv(F.substring("_d", 1 + 16 * i, 16), 16, 10).cast("decimal(28,0)") for i in range(2)]
    sums = digest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)]
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_w{i}"), F.lit(0)).cast("string") for i in range(2)])
    return sums.select(*keys, "rows", F.sha2(text, 256).alias("fingerprint"))


def _fail_if_any(bad: DataFrame, message: str) -> None:
    if not bad.isEmpty():
        raise ValueError(message)


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that fails on duplicate keys on either side or on rows left without a partner.

    The checks ride on the join: both sides are aggregated by the join key first,
    which is the partitioning the join needs, so no extra pass collects anything.
    """
    names = [c for c in left.columns if c not in on]
    others = [c for c in right.columns if c not in on]
    one = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_nl"), *[F.first(c).alias(c) for c in names])
    two = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_nr"), *[F.first(c).alias(c) for c in others])
    joined = one.join(two, list(on), "full" if how == "inner" else "left")
    twice = (F.col("_nl") > 1) | (F.coalesce("_nr", F.lit(0)) > 1)
    lost = F.col("_nl").isNull() | (F.col("_nr").isNull() if how == "inner" else F.lit(False))
    checked = (
        F.when(twice, F.raise_error(F.lit("duplicate join key")).cast("boolean"))
        .when(lost, F.raise_error(F.lit("row without a partner")).cast("boolean"))
        .otherwise(F.lit(True))
    )
    return joined.where(checked).select(*on, *names, *others)


def violations(
    df: DataFrame, features: Sequence[str] = (), coordinates: bool = False, both_labels: bool = True
) -> DataFrame:
    """Rows per broken rule: ids, labels, site of a positive, bounds, finite features.

    ``both_labels`` asks every country for known and unlabelled sources.
    """
    label = F.col("is_eog_flare")
    rules = {
        "null identifier": F.col("source_id").isNull() | F.col("country").isNull() | F.col("block_id").isNull(),
        "label not binary": label.isNull() | ~label.isin(0, 1),
        "positive without site": (label == 1) & F.col("eog_flare_id").isNull(),
    }
    if coordinates:
        rules["coordinates out of bounds"] = ~F.coalesce(
            F.col("lat").between(-80, 84) & (F.col("lon") >= -180) & (F.col("lon") < 180), F.lit(False)
        )
    for c in features:
        number = F.col(c).cast("double")
        rules[f"not finite: {c}"] = F.isnan(number) | (F.abs(number) == float("inf"))
    counted = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    flat = counted.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("rows")) for n in rules])).alias("r")
    ).select("r.*")
    repeated = df.groupBy("source_id").count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows")
    ).select(F.lit("duplicate source_id").alias("rule"), "rows")
    if not both_labels:
        return flat.unionByName(repeated)
    one_sided = df.groupBy("country").agg(F.count_distinct("is_eog_flare").alias("k")).agg(
        F.count_if(F.col("k") != 2).alias("rows")
    ).select(F.lit("country with one label").alias("rule"), "rows")
    return flat.unionByName(repeated).unionByName(one_sided)


def require(
    df: DataFrame, features: Sequence[str] = (), coordinates: bool = False, both_labels: bool = True
) -> DataFrame:
    broken = violations(df, features, coordinates, both_labels).where(F.col("rows") > 0)
    names = [row["rule"] for row in broken.select("rule").collect()]  # at most one row per rule
    if names:
        raise ValueError(f"rules broken: {sorted(names)}")
    return df


def forbid_holdout(df: DataFrame, holdout: str) -> DataFrame:
    """Fail if the hold-out country reaches a training boundary."""
    _fail_if_any(df.where(F.col("country") == holdout), f"{holdout} is forbidden here")
    return df


def forbid_leakage(columns: Iterable[str], blocked: Iterable[str] = BLOCKED) -> None:
    leaked = set(columns) & set(blocked)
    if leaked:
        raise ValueError(f"leaking columns: {sorted(leaked)}")


def leakage_report(df: DataFrame, blocked: Iterable[str] = BLOCKED) -> DataFrame:
    """(column, leaking, known): every column of a table, whether it may not train, and its known values."""
    known = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    banned = set(blocked)
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(c in banned).alias("leaking"), F.col(f"`{c}`").alias("known"))
        for c in df.columns
    ]
    return known.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def same_lineage(first: DataFrame, second: DataFrame, key: str = "country") -> DataFrame:
    """Per key: are the fingerprints of two manifests present and equal."""
    joined = first.select(key, F.col("fingerprint").alias("a")).join(
        second.select(key, F.col("fingerprint").alias("b")), key, "full"
    )
    return joined.select(key, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def panel_complete(df: DataFrame, scores: Sequence[str], seeds: int = 3) -> DataFrame:
    """Per seed: rows, sources, countries, positives, bad scores and equality of the panel."""
    panel = ["source_id", "country", "is_eog_flare", "eog_flare_id", "block_id"]
    bad = F.lit(False)
    for c in scores:
        bad = bad | F.coalesce((F.col(c) < 0) | (F.col(c) > 1) | F.isnan(c), F.lit(True))
    per_seed = df.groupBy("seed").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_eog_flare").alias("positives"),
        F.count_if(bad).alias("bad_scores"),
    )
    distinct = df.groupBy("seed").agg(F.count_distinct("source_id").alias("sources"))
    prints = table_fingerprint(df, panel, ["seed"]).select("seed", "fingerprint")
    reference = prints.agg(F.min("fingerprint").alias("_a"), F.max("fingerprint").alias("_b"), F.count(F.lit(1)).alias("_n"))
    same = (F.col("_a") == F.col("_b")) & (F.col("_n") == seeds)
    return (
        with_row(per_seed.join(distinct, "seed"), reference)
        .withColumn("passed", same & (F.col("rows") == F.col("sources")) & (F.col("bad_scores") == 0))
        .drop("_a", "_b", "_n")
    )


def reconcile(computed: DataFrame, stored: DataFrame, keys: Sequence[str], relative: float = 1e-10) -> DataFrame:
    """Full outer comparison of recomputed and stored values; one row per key."""
    joined = computed.withColumnRenamed("value", "computed").join(
        stored.withColumnRenamed("value", "stored"), list(keys), "full"
    )
    gap = F.abs(F.col("computed") - F.col("stored"))
    limit = F.greatest(relative * F.greatest(F.abs("computed"), F.abs("stored")), F.lit(1e-12))
    return joined.withColumn("matches", F.coalesce(gap <= limit, F.lit(False)))


def evidence_faults(reconciled: DataFrame) -> DataFrame:
    """Keys whose evidence fails, with the reason; both sides without a value fail as well."""
    computed, stored = F.col("computed"), F.col("stored")
    reason = (
        F.when(computed.isNull() & stored.isNull(), "no value")
        .when(stored.isNull(), "not stored")
        .when(computed.isNull(), "not computed")
        .otherwise("differs")
    )
    return reconciled.where(~F.col("matches")).withColumn("reason", reason).drop("matches")
