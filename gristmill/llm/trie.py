"""Prefix trie of conversations by smallest-member ownership.

Each distinct sequence of first turns (role, text) of a conversation is a node; all
conversations that begin with it are its members, and the smallest owns it. A
conversation that owns a node owns every deeper node of its path, so what it owns is
a suffix, told by one depth. Tokens saved below a node are the tokens of its
members' turns less those of owned turns, and a leaf is owned once, so one group-by
of the rows (conversation, depth) by prefix sums both, whatever the shape below.

Prefixes are told apart by their depth and 128 bits: two exclusive-or sums of hashes
of (depth, role, text), which windows run up along a conversation. Windows span
blocks of turns, and block totals, one row each, carry the sums across, so a
conversation with a large part of all rows is no single task. Owners come from an
aggregation by prefix (minimum, before the shuffle) and go back to rows by
conversation; a prefix that most conversations share is never a group of rows.
Only a parent's owner is joined by prefix, for the topmost node that a
conversation owns; Spark can split that join, and children of the root skip it.

The list of a node's ending conversations is hashed as a stream of packed ids in
order: a SHA-256 is sequential by nature, so one task reads the packs of a node,
a row for each 1,000 ids or fewer, and holds one batch of them.

Edge cases: null role and text are empty; turns are ordered by turn (null first),
role and text, repeated rows are repeated turns; a block of turns is told by the
turn number, so turns that tie stand in one block; rows without conv_id are left out;
a conversation whose every turn is shared or cut stays a member of the root; an
empty table gives no rows; very long texts are hashed where they are read and shuffled
once, to order turns of one number; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation that one window spans.
BLOCK = 4096
#: Ids that one row of an end list holds.
PACK = 1000
NODE = ["depth", "a", "b"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def blockwise(rows: DataFrame, block: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running values within their conversation, the row itself included.

    ``block`` must not fall along ``order``; ``sums`` has the kind (sum or xor) and
    the column of each value.
    """
    rows = rows.withColumn("_block", block)
    by = W.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({name: _AGG[kind](c).over(by) for name, (kind, c) in sums.items()})
    totals = rows.groupBy("conv_id", "_block").agg(*[_AGG[kind](c).alias(name) for name, (kind, c) in sums.items()])
    before = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select("conv_id", "_block", *[_AGG[kind](name).over(before).alias(f"_{name}") for name, (kind, _) in sums.items()])
    first = next(iter(sums))
    ahead = ahead.filter(F.col(f"_{first}").isNotNull()).withColumnsRenamed({"conv_id": "_conv", "_block": "_part"})
    joined = local.join(ahead, (F.col("conv_id") == F.col("_conv")) & (F.col("_block") == F.col("_part")), "left")
    carried = {name: (F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0))) if kind == "sum" else F.col(name).bitwiseXOR(F.coalesce(F.col(f"_{name}"), F.lit(0))) for name, (kind, _) in sums.items()}
    return joined.withColumns(carried).select(*rows.columns, *sums).drop("_block")


_AGG = {"sum": F.sum, "xor": F.bit_xor}


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, ha, hb, tokens) of every rebuilt turn, and (conv_id, n) of every conversation with its length.

    A conversation c begins with the first h turns of c - c % 20, h = crc32(decimal c) % 4.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = [F.xxhash64(F.lit(salt), role, text).alias(name) for salt, name in ((1, "ha"), (2, "hb"))]
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", *told, F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))
    block = F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(1 << 62)))
    turns = blockwise(turns, block, [F.col("turn").asc_nulls_first(), "role", "text"], {"i": ("sum", F.lit(1))}).select("conv_id", "i", "ha", "hb", "tokens")
    turns = Scratch(conversations.sparkSession).keep(turns, "turns")
    c = F.col("conv_id")
    each = turns.groupBy("conv_id").agg(F.max("i").alias("own")).select("conv_id", "own", (c - c % 20).alias("base"), F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)).alias("h"))
    lengths = each.select(F.col("conv_id").alias("_base"), F.col("own").alias("there"))
    each = each.join(lengths, each.base == F.col("_base"), "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    each = each.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    head = turns.filter("i <= 3").withColumnRenamed("conv_id", "_c")
    lent = each.join(head, (F.col("base") == F.col("_c")) & (F.col("i") <= F.col("lent"))).select("conv_id", F.col("i").alias("depth"), "ha", "hb", "tokens")
    about = each.select(F.col("conv_id").alias("_c"), "h", "lent")
    own = turns.join(about, turns.conv_id == F.col("_c")).filter("i > h").select("conv_id", (F.col("i") - F.col("h") + F.col("lent")).alias("depth"), "ha", "hb", "tokens")
    return lent.unionByName(own), each.select("conv_id", "n")


def paths(turns: DataFrame, each: DataFrame) -> DataFrame:
    """(conv_id, n, depth, a, b, pa, pb, upto): every node on every path with its parent's key; ``upto`` counts the tokens down to it."""
    keyed = turns.select("conv_id", "depth", "tokens", *[F.xxhash64(F.lit(s), "depth", h).alias(h) for s, h in ((3, "ha"), (4, "hb"))])
    run = blockwise(keyed, F.expr(f"depth div {BLOCK}"), ["depth"], {"upto": ("sum", F.col("tokens")), "a": ("xor", F.col("ha")), "b": ("xor", F.col("hb"))})
    length = each.withColumnRenamed("conv_id", "_c")
    run = run.join(length, run.conv_id == F.col("_c")).select("conv_id", "n", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "upto", "tokens")
    zero = F.lit(0).cast("long")
    root = each.select("conv_id", "n", *[zero.alias(x) for x in ("depth", "a", "b", "pa", "pb", "upto", "tokens")])
    return run.unionByName(root)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, a, b, digest) of the ids in ends (depth, a, b, conv_id), ascending and joined by commas."""

    def packed(batches):
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                part = b.slice(at, PACK).to_pydict()
                lists: dict = {}
                for *key, c in zip(*(part[k] for k in [*NODE, "conv_id"]), strict=True):
                    lists.setdefault(tuple(key), []).append(c)
                yield pa.RecordBatch.from_pylist([dict(zip(NODE, k, strict=True)) | {"first": v[0], "ids": ",".join(map(str, v))} for k, v in lists.items()], schema=pack)

    def hashed(batches):
        key, sha, done = None, None, []
        for b in batches:
            for *k, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
            yield rows(done)
            done = []
        if key:
            yield rows([(*key, sha.hexdigest())])

    def rows(done):
        return pa.RecordBatch.from_pylist([dict(zip([*NODE, "digest"], r, strict=True)) for r in done], schema=digest)

    longs = [(k, pa.int64()) for k in NODE]
    pack, digest = pa.schema([*longs, ("first", pa.int64()), ("ids", pa.string())]), pa.schema([*longs, ("digest", pa.string())])
    # ranges of ids keep the packs of a node apart and in order
    parts = ends.repartitionByRange("conv_id").sortWithinPartitions("conv_id").select(*NODE, "conv_id").mapInArrow(packed, "depth long, a long, b long, first long, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, a long, b long, digest string")


def nodes(conversations: DataFrame) -> DataFrame:
    """One row a node: NODE, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(conversations.sparkSession)
    turns, each = rebuilt(conversations)
    path = scratch.keep(paths(turns, scratch.keep(each, "each")), "paths")
    top = path.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("n").alias("deepest"), F.min(F.col("upto") - F.col("tokens")).alias("above"))
    # the topmost owned node tells the suffix; the deepest owned one is the conversation's last
    owned = top.groupBy("owner").agg(F.min(F.struct("depth", "above")).alias("from"), F.max(F.struct("depth", "deepest")).alias("last"))
    owned = owned.select(F.col("owner").alias("_o"), F.col("from.depth").alias("start"), F.col("from.above").alias("shared"), (F.col("last.depth") == F.col("last.deepest")).cast("long").alias("leaf"))
    total = path.groupBy("conv_id").agg(F.max("upto").alias("total")).select(F.col("conv_id").alias("_t"), "total")
    marks = total.join(owned, F.col("_t") == F.col("_o"), "left").select(
        "_t", F.coalesce("start", F.lit((1 << 62))).alias("start"), F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    rows = path.join(scratch.keep(marks, "marks"), path.conv_id == F.col("_t"))
    above = F.col("upto") - F.col("tokens")
    found = rows.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", "start")).alias("m"),
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
        F.count("*").alias("n_convs"),
        F.sum(((F.col("n") > F.col("depth")) & (F.col("start") <= F.col("depth") + 1)).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("shared") - above, F.lit(0))).alias("saved_tokens"),
        F.sum((F.col("n") == F.col("depth")).cast("long")).alias("n_ends"),
        F.max(F.when(F.col("n") == F.col("depth"), F.col("conv_id"))).alias("end"),
    )
    found = scratch.keep(found.select("*", F.col("m.conv_id").alias("conv_id"), F.col("m.start").alias("start")).drop("m"), "nodes")
    root = found.filter("depth = 0").agg(F.min("conv_id")).first()[0]
    # the topmost node that a conversation owns hangs below another's
    hung = found.filter("start = depth and depth > 1").select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    parents = found.select(*NODE, F.col("conv_id").alias("parent"))
    hung = hung.join(parents, NODE).select(F.col("conv_id").alias("_h"), "parent")
    out = found.join(hung, (found.conv_id == F.col("_h")) & (F.col("start") == F.col("depth")), "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == 1, F.lit(root)).when(F.col("start") < F.col("depth"), F.col("conv_id")).otherwise(F.col("parent"))
    many = found.filter("n_ends > 1").select(*[F.col(k).alias(f"_{k}") for k in NODE])
    last = path.filter("n = depth")
    last = last.join(many, [last[k] == F.col(f"_{k}") for k in NODE], "left_semi").select(*NODE, "conv_id")
    digest = end_hashes(last).withColumnsRenamed({k: f"_{k}" for k in NODE})
    out = out.withColumn("parent_conv_id", parent.cast("long")).join(digest, [out[k] == F.col(f"_{k}") for k in NODE], "left")
    ends = F.when(F.col("n_ends") == 0, F.lit(_NO_ENDS)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.col("digest"))
    return out.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(0)).alias("n_leaves"), "saved_tokens", ends.alias("ends_sha256"))


def op13(conversations: DataFrame) -> DataFrame:
    return nodes(conversations).drop("a", "b")


_CRC = """list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END))"""
ORACLE = f"""
WITH crc AS (SELECT {_CRC} AS tab),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda p, q: xor(p >> 8, tab[(xor(p, q) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc),
u AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
v AS (SELECT conv_id, row_number() OVER w AS depth, list({{'r': role, 't': text}}) OVER w AS node, text,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
n AS (SELECT conv_id, count(i) AS n FROM c LEFT JOIN u USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, n, depth, node, tokens FROM v JOIN n USING (conv_id)
  UNION ALL SELECT conv_id, n, 0, [], 0 FROM n),
g AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS deepest, any_value(tokens) AS tokens,
    sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY depth, node),
below AS (SELECT x.node AS top, y.depth AS d, y.n_convs, y.tokens, y.deepest FROM g x JOIN g y ON y.depth >= x.depth AND y.node[1:x.depth] = x.node),
s AS (SELECT top, sum((n_convs - 1) * tokens)::BIGINT AS saved_tokens, count(*) FILTER (deepest = d) AS n_leaves, count(*) FILTER (d = len(top) + 1) AS n_children FROM below GROUP BY top)
SELECT g.conv_id, g.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, g.n_convs, n_children, n_leaves, saved_tokens, g.ends_sha256
FROM g JOIN s ON s.top = g.node LEFT JOIN g up ON up.depth = g.depth - 1 AND up.node = g.node[1:g.depth - 1]"""
