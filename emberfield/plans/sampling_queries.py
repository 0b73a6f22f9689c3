"""Panel, ledger, weight and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.functions.columns import is_true
from emberfield.operators import features as ft
from emberfield.operators import folds, ledger, sampling
from emberfield.operators.features import by_source, derive_detection, moment_aggregates
from emberfield.plans.feature_queries import labelled_window, only_ids, percentile_sql, rounded_for_ranks
from emberfield.plans.registry import CTES, query
from emberfield.session import settle
from emberfield.sources import bindings

ROWS = "source_id, country, block_id, lat, lon, is_eog_flare, eog_flare_id"


def labels(spark, folder):
    return settle(labelled_window(spark, folder, only_ids).select(*ROWS.split(", ")))


def panel_sql(seed, quota, positives, countries="TRUE"):
    """Panel rows with their place; ``quota`` is a SQL expression over country."""
    return f"""
SELECT *, SUBSTR(SHA256(country || ':' || source_id), 1, 20) AS chip_id FROM (
  WITH base AS (SELECT *, SHA256('{seed}:' || source_id) AS o FROM window_labels WHERE {countries}),
  sites1 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, eog_flare_id ORDER BY o, source_id) AS k FROM base WHERE is_eog_flare = 1) WHERE k = 1),
  blocks1 AS (SELECT * EXCLUDE (k2) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, block_id ORDER BY o, source_id) AS k2 FROM sites1) WHERE k2 = 1),
  chosen AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY o, source_id) AS r FROM blocks1) WHERE r <= {positives}),
  room AS (SELECT country, {quota} - COALESCE(p, 0) AS room FROM (SELECT DISTINCT country FROM base) LEFT JOIN (SELECT country, COUNT(*) AS p FROM chosen GROUP BY country) USING (country)),
  outside AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, block_id ORDER BY o, source_id) AS k FROM base b
     WHERE is_eog_flare = 0 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.country = b.country AND c.block_id = b.block_id)) WHERE k = 1),
  filler AS (SELECT o2.* FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY o, source_id) AS r FROM outside) o2 JOIN room USING (country) WHERE r <= room)
  SELECT {ROWS}, o, r FROM chosen UNION ALL SELECT {ROWS}, o, r FROM filler)"""


MIXED = "(SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY SHA256('142:' || source_id), source_id) - 1 AS batch_order FROM panel_rows)"
CTES["panel_rows"] = panel_sql(42, "40", 12)
CTES["panel_mixed"] = f"SELECT {ROWS}, chip_id, batch_order FROM {MIXED}"


def quotas(spark, rows, n):
    return rows.groupBy("country").agg(F.lit(n).alias("n"))


def mixed(spark, folder):
    rows = labels(spark, folder)
    return sampling.mixed_panel(rows, quotas(spark, rows, 40), 12, 42, complete=False)  # as in the SQL: every row a country has


@query("g1_enriched_panel", "SELECT * FROM panel_mixed", "lat lon")
def g1(spark, folder):
    return mixed(spark, folder)


CTES["stable_rows"] = panel_sql(13013, "60", 20, "country = 'C5'")
CTES["stable_keyed"] = "SELECT *, CASE WHEN is_eog_flare = 1 THEN 3 * (r - 1) ELSE 3 * ((r - 1) // 2) + 1 + (r - 1) % 2 END AS k FROM stable_rows"
STABLE = f"SELECT {ROWS}, chip_id, ROW_NUMBER() OVER (PARTITION BY country ORDER BY k, source_id) - 1 AS batch_order FROM stable_keyed"


@query("g2_stable_panel", STABLE, "lat lon")
def g2(spark, folder):
    return sampling.stable_panel(labels(spark, folder), bindings.HOLDOUT, 60, 20, 13013, complete=False)


CTES["interleaved"] = """
SELECT source_id, country, is_eog_flare, ROW_NUMBER() OVER (PARTITION BY country ORDER BY k, source_id) - 1 AS batch_order
FROM (SELECT *, CASE WHEN is_eog_flare = 1 THEN 3 * (r - 1) ELSE 3 * ((r - 1) // 2) + 1 + (r - 1) % 2 END AS k
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, is_eog_flare ORDER BY SHA256('7:' || source_id), source_id) AS r FROM predictions))
"""


@query("g3_interleave", "SELECT * FROM interleaved")
def g3(spark, folder):
    """Interleave every prediction of a country, one positive to two unlabelled."""
    from emberfield.functions.columns import seeded_order
    from emberfield.operators.ordering import row_numbers

    rows = bindings.predictions(spark, folder).withColumn("_order", seeded_order(7, F.col("source_id")))
    placed = row_numbers(rows, ["country", "is_eog_flare"], [F.col("_order"), F.col("source_id")], "_r").drop("_r_group")
    return sampling.interleave(placed).select("source_id", "country", "is_eog_flare", "batch_order")


CTES["pilot"] = panel_sql(42, "CASE WHEN country IN ('C0', 'C1', 'C2', 'C3') THEN 17 ELSE 16 END", 8)


@query("g4_quota_pilot", f"SELECT {ROWS}, chip_id FROM pilot", "lat lon")
def g4(spark, folder):
    return sampling.quota_pilot(labels(spark, folder), 42, complete=False)


@query(
    "g5_round_robin_batches",
    """SELECT source_id, country, batch_order, g - 1 AS position, (g - 1) // 25 AS batch
       FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY batch_order, country, source_id) AS g FROM interleaved)""",
)
def g5(spark, folder):
    return sampling.round_robin_batches(g3(spark, folder), 25).select("source_id", "country", "batch_order", "position", "batch")


CTES["items"] = "SELECT c_custkey AS item_id, 'chip_' || c_custkey AS chip_id, c_nationkey AS batch_order FROM customer"
CTES["ledger"] = """
SELECT i.*, COALESCE(a.status, 'pending') AS status, COALESCE(n, 0) AS attempts, attempt_id FROM items i LEFT JOIN (
  SELECT item_id, status, attempt_id, COUNT(*) OVER (PARTITION BY item_id) AS n,
         ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY status = 'ok' DESC, attempted_at DESC, attempt_id DESC) AS rn FROM attempts) a
ON a.item_id = i.item_id AND rn = 1
"""


def items(spark, folder):
    """One work item per customer; only some were ever attempted."""
    name = F.concat(F.lit("chip_"), F.col("c_custkey").cast("string"))
    return bindings.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("item_id"), name.alias("chip_id"), F.col("c_nationkey").alias("batch_order")
    )


@query("g6_attempt_ledger", "SELECT * FROM ledger")
def g6(spark, folder):
    return ledger.attempt_ledger(items(spark, folder), bindings.attempts(spark, folder))


@query("g7_next_batch", "SELECT item_id, batch_order, status FROM ledger WHERE status <> 'ok' ORDER BY batch_order, item_id LIMIT 50")
def g7(spark, folder):
    """The next fifty open items, failed ones retried."""
    states = ledger.attempt_ledger(items(spark, folder), bindings.attempts(spark, folder))
    return ledger.next_batch(states, 50, retry_failed=True).select("item_id", "batch_order", "status")


@query(
    "g7_stop_point",
    """
SELECT MAX(total) AS attempts, MIN(CASE WHEN n >= 6 THEN first + 5 END) AS stop_after, MAX(n) AS longest_failure_run FROM (
  SELECT s, COUNT(*) FILTER (status = 'failed') AS n, MIN(place) FILTER (status = 'failed') AS first, MAX(total) AS total FROM (
    SELECT *, ROW_NUMBER() OVER (ORDER BY attempted_at, attempt_id) AS place, COUNT(*) OVER () AS total,
           SUM(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (ORDER BY attempted_at, attempt_id ROWS UNBOUNDED PRECEDING) AS s FROM attempts) GROUP BY s)""",
)
def g7_stop(spark, folder):
    return ledger.stop_point(bindings.attempts(spark, folder))


CTES["moments"] = "SELECT source_id, ROUND(frp_mean, 9) AS frp_mean, ROUND(t_mir_mean, 9) AS t_mir_mean, ROUND(pix_km2_mean, 9) AS pix_km2_mean, n_det FROM features"
CTES["moment_ranks"] = percentile_sql(["frp_mean", "t_mir_mean"], "(SELECT m.*, country FROM moments m JOIN window_labels USING (source_id))")
REVIEW = "CASE n_det % 4 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'False' WHEN 2 THEN '0' END"


@query(
    "g8_assemble_cohort",
    f"""
SELECT w.source_id, w.country, w.is_eog_flare, r.pix_km2_mean AS img_value, r.frp_mean_country_pct, r.t_mir_mean_country_pct
FROM window_labels w JOIN moment_ranks r USING (source_id)
WHERE r.n_det >= 2 AND COALESCE(LOWER(TRIM({REVIEW.replace('n_det', 'r.n_det')})) NOT IN ('true', '1', 'yes'), TRUE)""",
    "img_value frp_mean_country_pct t_mir_mean_country_pct",
)
def g8(spark, folder):
    """Cohort of sources with at least two detections that are not marked for review."""
    rows = labelled_window(
        spark, folder, lambda w: by_source(derive_detection(w), moment_aggregates(), {"n_det": F.count(F.lit(1))})
    )
    rows = settle(rounded_for_ranks(rows, ["frp_mean", "t_mir_mean", "pix_km2_mean"]))
    quality = rows.select(
        "source_id",
        F.when(F.col("n_det") >= 2, "ok").otherwise("failed").alias("status"),
        F.expr(REVIEW).alias("review_reflectance_tail"),
    )
    cohort = ledger.assemble_cohort(
        rows.select("source_id", "country", "is_eog_flare"),
        rows.select("source_id", F.col("pix_km2_mean").alias("img_value")),
        quality,
        rows.select("source_id", "country", "frp_mean", "t_mir_mean"),
        ["frp_mean", "t_mir_mean"],
        min_rows=5,
        min_positives=1,
    )
    return cohort.select("source_id", "country", "is_eog_flare", "img_value", "frp_mean_country_pct", "t_mir_mean_country_pct")


FLAG = "CASE doc_id % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' yes ' WHEN 2 THEN 'False' WHEN 3 THEN '1' WHEN 4 THEN 'no' END"


@query("g9_review_mask", f"SELECT doc_id, COALESCE(LOWER(TRIM({FLAG})) IN ('true', '1', 'yes'), FALSE) AS review FROM documents")
def g9(spark, folder):
    return bindings.table(spark, folder, "documents").select("doc_id", is_true(F.expr(FLAG)).alias("review"))


CTES["base_weights"] = """
SELECT source_id, country, POW(COUNT(*) OVER () / ((SELECT COUNT(DISTINCT country) FROM predictions) * COUNT(*) OVER (PARTITION BY country)), 0.5) AS w, is_eog_flare, eog_flare_id FROM predictions
"""
CTES["site_shares"] = """
SELECT country, eog_flare_id, AVG(f) OVER (PARTITION BY country) / f AS share
FROM (SELECT country, eog_flare_id, COUNT(*) AS f FROM predictions WHERE is_eog_flare = 1 GROUP BY ALL)
"""


@query(
    "h1_sample_weights",
    """SELECT source_id, w * COALESCE(share, 1) / AVG(w * COALESCE(share, 1)) OVER () AS weight
       FROM base_weights b LEFT JOIN site_shares s ON b.country = s.country AND b.eog_flare_id = s.eog_flare_id AND is_eog_flare = 1""",
    "weight",
)
def h1(spark, folder):
    return folds.sample_weights(bindings.predictions(spark, folder), 0.5, True).select("source_id", "weight")


@query(
    "h2_country_class_weights",
    """SELECT source_id, c / AVG(c) OVER () AS weight FROM (
         SELECT source_id, LEAST(raw / AVG(raw) OVER (), 5) AS c FROM (SELECT source_id, 1.0 / COUNT(*) OVER (PARTITION BY country, is_eog_flare) AS raw FROM predictions))""",
    "weight",
)
def h2(spark, folder):
    return folds.country_class_weights(bindings.predictions(spark, folder)).select("source_id", "weight")


LIGHTEST = ", ".join(f"loads[{i}] + CASE WHEN LIST_POSITION(loads, LIST_MIN(loads)) = {i} THEN n ELSE 0 END" for i in range(1, 6))
CTES["fold_blocks"] = f"""
WITH RECURSIVE ranked AS (
  SELECT block_id, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, block_id) AS r FROM predictions GROUP BY block_id),
dealt(r, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([0, 0, 0, 0, 0] AS BIGINT[])
  UNION ALL
  SELECT ranked.r, CAST(LIST_POSITION(loads, LIST_MIN(loads)) - 1 AS BIGINT), [{LIGHTEST}]
  FROM dealt JOIN ranked ON ranked.r = dealt.r + 1),
taken AS (SELECT n, fold, COUNT(*) AS c FROM dealt JOIN ranked USING (r) GROUP BY n, fold),
runs AS (SELECT n, fold, c, SUM(c) OVER (PARTITION BY n ORDER BY fold) AS last FROM taken),
placed AS (SELECT block_id, n, ROW_NUMBER() OVER (PARTITION BY n ORDER BY block_id) AS t FROM ranked)
SELECT block_id, fold FROM placed JOIN runs ON placed.n = runs.n AND t > last - c AND t <= last
"""


@query("h3_grouped_folds", "SELECT source_id, block_id, fold FROM predictions JOIN fold_blocks USING (block_id)")
def h3(spark, folder):
    return folds.grouped_folds(bindings.predictions(spark, folder), 5).select("source_id", "block_id", "fold")


@query(
    "h4_leave_country_out",
    "SELECT country, COUNT(*) AS n_test, (SELECT COUNT(*) FROM predictions) - COUNT(*) AS n_train, SUM(is_eog_flare) AS positives FROM predictions GROUP BY country HAVING SUM(is_eog_flare) > 0",
)
def h4(spark, folder):
    return folds.leave_country_out(bindings.predictions(spark, folder))


@query(
    "h5_country_pairs",
    """WITH c AS (SELECT country, COUNT(*) AS n, SUM(is_eog_flare) AS p FROM predictions GROUP BY country)
       SELECT a.country AS country_a, b.country AS country_b, a.n + b.n AS rows, a.p + b.p AS positives FROM c a JOIN c b ON a.country < b.country""",
)
def h5(spark, folder):
    return folds.country_pairs(bindings.predictions(spark, folder))


@query("h6_persistent_train_filter", "SELECT source_id, n_days FROM f_persistence WHERE n_days >= 2")
def h6(spark, folder):
    from emberfield.plans.feature_queries import located_window

    return folds.persistent_train_filter(ft.persistence(ft.active_days(located_window(spark, folder)))).select("source_id", "n_days")


@query(
    "h7_pu_bags",
    """
SELECT source_id, is_eog_flare, bag FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY bag, is_eog_flare ORDER BY SHA256((17 + bag) || ':' || source_id), source_id) AS r
  FROM predictions, (SELECT UNNEST([0, 1, 2]) AS bag) b)
WHERE is_eog_flare = 1 OR r <= (SELECT LEAST(COUNT(*) - SUM(is_eog_flare), CEIL(1.5 * SUM(is_eog_flare))) FROM predictions)""",
)
def h7(spark, folder):
    return folds.pu_bags(bindings.predictions(spark, folder), 3, 1.5, 17).select("source_id", "is_eog_flare", "bag")


@query(
    "h8_fold_training_weights",
    """
WITH train AS (SELECT h.held_out, p.* FROM (SELECT * FROM predictions JOIN fold_blocks USING (block_id)) p, (SELECT UNNEST([0, 1, 2, 3, 4]) AS held_out) h WHERE p.fold <> h.held_out),
counted AS (SELECT *, COUNT(*) OVER (PARTITION BY held_out) AS n, COUNT(*) OVER (PARTITION BY held_out, country) AS nc FROM train),
based AS (SELECT c.*, n / (k * nc) AS w FROM counted c JOIN (SELECT held_out, COUNT(DISTINCT country) AS k FROM train GROUP BY held_out) USING (held_out)),
shares AS (SELECT held_out, country, eog_flare_id, AVG(f) OVER (PARTITION BY held_out, country) / f AS share
           FROM (SELECT held_out, country, eog_flare_id, COUNT(*) AS f FROM train WHERE is_eog_flare = 1 GROUP BY ALL))
SELECT b.held_out, b.source_id, w * COALESCE(share, 1) / AVG(w * COALESCE(share, 1)) OVER (PARTITION BY b.held_out) AS weight
FROM based b LEFT JOIN shares s ON b.held_out = s.held_out AND b.country = s.country AND b.eog_flare_id = s.eog_flare_id AND b.is_eog_flare = 1""",
    "weight",
)
def h8(spark, folder):
    rows = folds.grouped_folds(bindings.predictions(spark, folder), 5)
    return folds.fold_training_weights(rows, 5, 1.0, True).select("held_out", "source_id", "weight")


@query(
    "h9_site_safe_blocks",
    """
WITH RECURSIVE nodes AS (SELECT DISTINCT country, block_id, country || '|' || block_id AS node FROM window_labels),
links AS (SELECT DISTINCT a.node AS a, b.node AS b FROM
  (SELECT DISTINCT country, eog_flare_id, country || '|' || block_id AS node FROM window_labels WHERE is_eog_flare = 1) a
  JOIN (SELECT DISTINCT country, eog_flare_id, country || '|' || block_id AS node FROM window_labels WHERE is_eog_flare = 1) b USING (country, eog_flare_id)),
reach(node, seen) AS (SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a)
SELECT country, block_id, 'siteblock_' || MIN(seen) AS evaluation_block FROM nodes JOIN reach USING (node) GROUP BY country, block_id""",
)
def h9(spark, folder):
    return folds.site_safe_blocks(labels(spark, folder))


@query(
    "h9_document_site_blocks",
    """
WITH RECURSIVE nodes AS (SELECT DISTINCT country, block_id, country || '|' || block_id AS node FROM predictions),
links AS (SELECT DISTINCT a.node AS a, b.node AS b FROM
  (SELECT DISTINCT country, eog_flare_id, country || '|' || block_id AS node FROM predictions WHERE is_eog_flare = 1) a
  JOIN (SELECT DISTINCT country, eog_flare_id, country || '|' || block_id AS node FROM predictions WHERE is_eog_flare = 1) b USING (country, eog_flare_id)),
reach(node, seen) AS (SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a)
SELECT country, block_id, 'siteblock_' || MIN(seen) AS evaluation_block FROM nodes JOIN reach USING (node) GROUP BY country, block_id""",
)
def h9_documents(spark, folder):
    """The same merge on prediction blocks, whose sites link many blocks."""
    return folds.site_safe_blocks(bindings.predictions(spark, folder))
