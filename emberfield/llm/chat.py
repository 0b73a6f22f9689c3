r"""Chat formatting of reply trees.

Replies name their parent. Every root-to-leaf path of a tree is one conversation; paths
are ranked by score, and the best ``branches`` of each tree are formatted.

Paths come from iterative self-joins on (tree, node). First each join doubles a table of
ancestors: from 1, 2, 4 ... replies up it makes the one twice as far. Then, from the
farthest table down, each join adds to the (leaf, reply) pairs known so far the replies
that lie one more table length above. So a reply chain of any depth takes a logarithm of
joins, and all joins are on single replies: a huge tree spreads over all tasks. Only the
turns of one path meet in one row, its formatted conversation.

Template: ``### role: text </turn>`` and a line end for each turn. Inside a text a backslash, ``###``
and ``</turn>`` get a backslash in front (and in a role a colon too), so the template's
marks never occur in a text and unescaping gives it back exactly. The loss mask marks the
escaped texts of assistant turns as (start, length) in code points.

Cases: NULL texts and roles are empty strings; a reply whose parent is missing is a root;
replies in a cycle belong to no path and are left out; repeated replies (same tree and
node) are told apart by a number, and their children follow the first of them; an empty
table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.session import settle

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?) </turn>\n", re.S)
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)", re.S)


def escape(text: Column) -> Column:
    for mark in ("\\", "###", "</turn>"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def chains(rows: DataFrame) -> DataFrame:
    """Replies of plain conversations (conv_id, turn, role, text): each turn answers the one before it."""
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = rows.withColumn("node", F.row_number().over(place).cast("long"))
    return numbered.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def _identified(replies: DataFrame) -> DataFrame:
    """Replies with one text key ``id`` and ``up``, the key of an existing parent or NULL."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    key = lambda node: F.concat_ws("/", part("tree"), part(node))
    same = Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    again = F.row_number().over(same)
    named = replies.withColumn("_again", again).withColumn(
        "id", F.concat(key("node"), F.when(F.col("_again") > 1, F.concat(F.lit("#"), "_again")).otherwise(F.lit("")))
    )
    named = settle(named.withColumn("_parent", F.when(F.col("parent").isNotNull(), key("parent"))).drop("_again"))
    there = named.select(F.col("id").alias("up"))
    return named.join(there, F.col("_parent") == F.col("up"), "left").drop("_parent")


def paths(replies: DataFrame) -> DataFrame:
    """(leaf, id, above): for every leaf the replies on its path, ``above`` replies up."""
    nodes = settle(_identified(replies).select("id", "up"))
    parents = nodes.where("up IS NOT NULL")
    tables = [settle(parents.select(F.col("id").alias("low"), F.col("up").alias("high")))]
    reach = 1
    most = nodes.count()
    while not tables[-1].isEmpty() and reach <= most:
        last = tables[-1]
        further = last.alias("a").join(last.alias("b"), F.col("a.high") == F.col("b.low")).select("a.low", "b.high")
        tables.append(settle(further))
        reach *= 2
    leaves = nodes.join(parents.select(F.col("up").alias("id")).distinct(), "id", "left_anti")
    pairs = leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("above"))
    for step in range(len(tables) - 1, -1, -1):
        up = tables[step]
        higher = pairs.join(up, F.col("id") == F.col("low")).select("leaf", F.col("high").alias("id"), (F.col("above") + (1 << step)).alias("above"))
        pairs = settle(pairs.unionByName(higher))
    return pairs


def formatted_paths(replies: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, branch, score, n_turns, formatted, loss) of the best ``branches`` paths of each tree (all by default).

    A path's score is the mean of its replies' scores; ties go to the smaller leaf.
    ``loss`` lists the (start, length) of the assistant texts in ``formatted``.
    """
    named = _identified(replies.select("tree", "node", "parent", "role", "text", "score"))
    steps = paths(replies).join(named.select("id", "tree", "role", "text", "score"), "id")
    scored = steps.groupBy("leaf", "tree").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("path_score"))
    if branches is None:
        chosen = steps
    else:
        best = Window.partitionBy("tree").orderBy(F.col("path_score").desc(), "leaf")
        top = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= branches).select("leaf")
        chosen = steps.join(top, "leaf", "left_semi")
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(":"), F.lit("\\:"))
    body = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(BETWEEN))
    turn = F.struct(
        (-F.col("above")).alias("at"),
        F.concat(head, body, F.lit(CLOSE)).alias("line"),
        F.length(head).cast("long").alias("skip"),
        F.when(F.col("role") == LOSS_ROLE, F.length(body)).cast("long").alias("loss"),
    )
    gathered = chosen.groupBy("leaf", "tree").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score")
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    spans = F.aggregate(
        "turns",
        start,
        lambda s, t: F.struct(
            (s["at"] + F.length(t["line"])).cast("long").alias("at"),
            F.when(
                t["loss"].isNotNull(),
                F.concat(s["spans"], F.array(F.struct((s["at"] + t["skip"]).alias("start"), t["loss"].alias("length")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return gathered.select(
        "tree", "leaf", "score", F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("turns", lambda t: t["line"])).alias("formatted"), spans.alias("loss"),
    )


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2]), *m.span(2)) for m in TURN.finditer(formatted)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns = read_back(formatted)
            learnt = "".join(unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in loss)
            rows.append((
                len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode()).hexdigest(),
                len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted),
            ))
        columns = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns, their digest, the text under the loss mask and its digest."""
    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted", "loss").mapInArrow(
        _digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def chat_sql(conversations: str, role: str = LOSS_ROLE) -> str:
    """The same for plain conversations in DuckDB SQL."""
    esc = lambda x: f"REPLACE(REPLACE(REPLACE({x}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"
    order = "ORDER BY turn NULLS LAST, role0 NULLS FIRST, text0 NULLS FIRST"
    fixed = len(OPEN + BETWEEN + CLOSE)
    return f"""
SELECT conv_id, COUNT(*) AS n_turns,
  SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' {order})) AS turns_sha256,
  CAST(COALESCE(SUM(LENGTH(text)) FILTER (role = '{role}'), 0) AS BIGINT) AS loss_chars,
  SHA256(COALESCE(STRING_AGG(text, '' {order}) FILTER (role = '{role}'), '')) AS loss_sha256,
  CAST(SUM({fixed} + LENGTH(REPLACE({esc('role')}, ':', '\\:')) + LENGTH({esc('text')})) AS BIGINT) AS formatted_chars
FROM (SELECT conv_id, turn, role AS role0, text AS text0, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM ({conversations}))
GROUP BY conv_id"""
