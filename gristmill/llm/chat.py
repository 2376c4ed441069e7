"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees. Self-joins double the reach of every message's ancestor
pointer and of the score gathered on the way, until all pointers have reached
their roots; leaves are then ranked by the score of their root-to-leaf path
(ties: the smaller node id), and the chosen leaf's path is enumerated by going
back through the same pointers, one self-join for each power of two. The number
of joins is the logarithm of the deepest tree; no step makes more rows than
there are messages.

A path is written as turns ``### role: text</turn>\\n``. Inside roles and texts
``\\``, ``#`` and ``<`` become ``\\b``, ``\\h`` and ``\\l`` (and ``:`` in a role
``\\c``), so no text can hold a control string and unescaping gives it back.
``loss_spans`` marks what counts for the loss, in code points within each turn.

Edge cases: null text and null role are empty; a parent id that is not in its
tree makes its message a root; several roots in one tree count as separate
paths, the best of which is chosen; messages whose ancestors run into a cycle have
no root and are on no path; of rows with the same tree and node the one with the
least parent and score counts; extra columns are ignored; turns that tie are
ordered by role and text, repeated rows are repeated turns. A formatted conversation is one value,
so it must fit in a task; nothing else is gathered by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch

_PAIRS = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column, role: bool = False) -> Column:
    for a, b in (*_PAIRS, *([(":", "\\c")] if role else [])):
        c = _replace(c, a, b)
    return c


def unescape(c: Column, role: bool = False) -> Column:
    for a, b in reversed((*_PAIRS, *([(":", "\\c")] if role else []))):
        c = _replace(c, b, a)
    return c


def best_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """Rows (tree, leaf, rank, back, node): the ``keep`` best root-to-leaf paths of each tree.

    ``nodes`` has tree, node, parent, score; ``back`` is the distance from the leaf.
    """
    scratch = Scratch(nodes.sparkSession)
    nodes = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", F.col("score").cast("double").alias("score"))).alias("m")).select("tree", "node", "m.parent", "m.score")
    p = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    known = nodes.join(p, (nodes.tree == F.col("_t")) & (nodes.parent == F.col("_n")), "left")
    jump = scratch.keep(known.select("tree", "node", F.col("_n").alias("up"), "score"), "jump0")
    jumps = [jump]
    most = jump.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # a pointer that is still on its way after as many steps as the largest tree has messages runs in a cycle
    while 1 << (len(jumps) - 1) < most and not jump.filter("up is not null").isEmpty():
        # only messages that have not reached their root are joined again
        far = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("score").alias("_s"))
        live = jump.filter("up is not null")
        live = live.join(far, (live.tree == F.col("_t")) & (live.up == F.col("_n"))).select("tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_s")).alias("score"))
        jump = scratch.keep(live.unionByName(jump.filter("up is null")), "jump")
        jumps.append(jump)
    inner = jumps[0].filter("up is not null").select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    leaves = jump.filter("up is null").join(inner, (jump.tree == F.col("_t")) & (jump.node == F.col("_n")), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "node"))
    path = leaves.withColumn("rank", rank).filter(F.col("rank") <= keep)
    path = path.select("tree", F.col("node").alias("leaf"), "rank", F.lit(0).cast("long").alias("back"), "node")
    for k in reversed(range(len(jumps) - 1)):
        up = jumps[k].filter("up is not null").select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        higher = path.join(up, (path.tree == F.col("_t")) & (path.node == F.col("_n")))
        path = scratch.keep(path.unionByName(higher.select("tree", "leaf", "rank", (F.col("back") + (1 << k)).alias("back"), F.col("up").alias("node"))), "path")
    return path


def format_paths(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, formatted, loss_spans) from rows (tree, leaf, at, role, text) ordered by ``at``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit("### "), escape(role, role=True), F.lit(": ")), escape(text)
    one = F.struct("at", F.concat(head, body, F.lit("</turn>\n")).alias("turn"), (role == learn).alias("learnt"), F.length(head).alias("start"), F.length(body).alias("length"))
    made = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(one)).alias("t"))
    spans = F.filter(F.transform("t", lambda x, i: F.struct(i.alias("turn"), x.learnt.alias("learnt"), x.start.alias("start"), x.length.alias("length"))), lambda x: x.learnt)
    return made.select("tree", "leaf", F.array_join(F.col("t.turn"), "").alias("formatted"), F.transform(spans, lambda x: F.struct(x.turn.alias("turn"), x.start.alias("start"), x.length.alias("length"))).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learnt texts as read from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.filter(F.split("formatted", "</turn>\n"), lambda x: x != "")
    turn = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(5)), ": ", 1), role=True).alias("role"), unescape(F.substr(p, F.instr(p, ": ") + 2)).alias("text")))
    learnt = F.transform("loss_spans", lambda s: unescape(F.substr(F.get(F.col("_p"), s.turn), s.start + 1, s.length)))
    return formatted.withColumn("_p", pieces).withColumn("turns", turn).withColumn("learnt", learnt).drop("_p")


def op6(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(more)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(F.coalesce(F.col("conv_id"), F.lit(-(1 << 63))).alias("tree"), "role", "text", F.row_number().over(order).cast("long").alias("node"))
    rows = Scratch(spark).keep(rows, "nodes")
    nodes = rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), (F.coalesce("role", F.lit("")) == "assistant").cast("double").alias("score"))
    path = best_paths(nodes).select(F.col("tree").alias("_t"), "leaf", "back", F.col("node").alias("_n"))
    turns = rows.join(path, (rows.tree == F.col("_t")) & (rows.node == F.col("_n"))).select("tree", "leaf", (-F.col("back")).alias("at"), "role", "text")
    made = read_back(format_paths(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("learnt", "")
    # the formatted string is built once and read by every digest
    return made.select(F.when(F.col("tree") != -(1 << 63), F.col("tree")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_TEXT, _ROLE = "coalesce(text, '')", "coalesce(role, '')"
_ESCAPED = "replace(replace(replace({}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, {_ROLE} AS role, {_TEXT} AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok', 'user', '\\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\\### Assistant: </turn> ok', 'assistant', '\\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST), '')) AS loss_sha256,
  CAST(sum(4 + length(replace({_ESCAPED.format('role')}, ':', '\\c')) + 2 + length({_ESCAPED.format('text')}) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
