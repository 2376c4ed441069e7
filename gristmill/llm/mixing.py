"""Mixing sources to target weights, in DataFrame operations only.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share the total size; a target stops at three times its source's size and the
excess goes to the others by weight until none is above.

Blocks. A source's documents are dealt by hash into blocks of about
``docs_per_block`` documents, of more where a source would have over MOST_BLOCKS
blocks, so the tables of blocks and the tree's urns are bounded whatever the
input; the blocks stand in a hashed (permuted) order. A source needs whole passes
over its blocks plus a part of one more; every (pass, block) is a draw, so the
source has an exact quota of draws.

Splitting tree. At each node of a binary tree over the output shards the
quotas are split by a multivariate hypergeometric draw: an urn with the node's
draws is emptied into left slots and right slots, source by source. Each shard
ends with an exact quota of every source and takes that many consecutive draws
of the source's permuted sequence, so shards are disjoint and cover all draws.
Within a shard, rows are ordered by a hash (a local shuffle): ``mixed_rows`` deals
rows by shard and sorts them so. There is a shard for DOCS_PER_SHARD documents.

The last draw of a source is a partial block: its documents are tried in hashed
order and taken while they fit, so a source misses its target by less than its
smallest document left over.

All randomness is a hash of (seed, identity), hence reruns agree. Edge cases:
null text has size 0; a source without words has target 0 and its documents are
taken as often as whole passes say (0 words each way); rows of equal doc_id,
source and text are told apart by an ordinal among them, and their draws are one
value, so they should be few; empty tables give empty ones; texts of any length
are one row and never split; other columns pass through, and only names that
begin with ``_mix_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
DOCS_PER_BLOCK = 256
MOST_BLOCKS = 1 << 16
DOCS_PER_SHARD = 1 << 16
LEAST_SHARDS, MOST_SHARDS = 16, 1 << 12
SEED = 20240


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _unit(*key: Column) -> Column:
    """A uniform number in [0, 1) that depends on the key alone."""
    return F.call_function("shiftrightunsigned", F.xxhash64(F.lit(SEED), *key), F.lit(11)).cast("double") / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Water filling: with the ratio most * size / weight ascending, the first k
    sources are capped and the rest share what is left; the right k is the
    least for which none of the rest is above its cap. The table has one row a
    source, and windows over it are as large as the list of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    one = F.lit(0)
    per = per.withColumn("i", F.row_number().over(W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("w", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    rise = W.partitionBy(one).orderBy(F.col("cap") / F.col("w"), "i")
    whole = W.partitionBy(one)
    per = per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    # were this source and all after it uncapped, they would share this much a weight
    per = per.withColumn("rate", (F.col("total") - F.coalesce(F.sum("cap").over(rise.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(rise.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("final", F.max(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.col("rate"))).over(whole))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """Rows (source, quota) -> (shard, source, first, n): a range of the source's draws for each shard.

    One row a tree node, holding the quota list of all sources; a level doubles the rows.
    """
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("source"), F.lit("")).alias("k"), F.col("source").isNull().alias("nil"), F.col("quota").cast("long").alias("q"), F.lit(0).cast("long").alias("first")))).alias("urn"))
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "urn")
    width = shards
    while width > 1:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("urn", F.lit(0).cast("long"), lambda a, x: a + x.q)
        slots = F.floor(total * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        lo, hi = F.col("lo"), F.col("hi")

        def draw(state, x):
            """Empty the urn's balls of one source: each goes left with chance (left slots) / (balls left)."""
            balls = F.when(x.q > 0, F.sequence(F.lit(1).cast("long"), x.q)).otherwise(F.array().cast("array<bigint>"))
            start = F.struct(state.slots.alias("slots"), state.balls.alias("balls"), F.lit(0).cast("long").alias("took"))

            def ball(s, i):
                left = (_unit(lo, hi, x.k, x.nil, i) * s.balls < s.slots).cast("long")
                return F.struct((s.slots - left).alias("slots"), (s.balls - 1).alias("balls"), (s.took + left).alias("took"))

            end = F.aggregate(balls, start, ball)
            return F.struct(end.slots.alias("slots"), end.balls.alias("balls"), F.concat(state.took, F.array(end.took)).alias("took"))

        empty = F.struct(slots.alias("slots"), total.alias("balls"), F.array().cast("array<bigint>").alias("took"))
        node = node.withColumn("took", F.when(hi - lo > 1, F.aggregate("urn", empty, draw, lambda s: s.took)))
        left = F.zip_with("urn", "took", lambda x, t: F.struct(x.k.alias("k"), x.nil.alias("nil"), t.alias("q"), x["first"].alias("first")))
        right = F.zip_with("urn", "took", lambda x, t: F.struct(x.k.alias("k"), x.nil.alias("nil"), (x.q - t).alias("q"), (x["first"] + t).alias("first")))
        half = lambda a, b, u: F.struct(a.alias("lo"), b.alias("hi"), u.alias("urn"))
        halves = F.when(F.col("took").isNull(), F.array(half(lo, hi, F.col("urn")))).otherwise(F.array(half(lo, mid, left), half(mid, hi, right)))
        node = node.select(F.explode(halves).alias("h")).select("h.*")
        width = (width + 1) // 2
    rows = node.select(F.col("lo").alias("shard"), F.explode("urn").alias("x")).filter("x.q > 0")
    return rows.select("shard", F.when(~F.col("x.nil"), F.col("x.k")).alias("source"), F.col("x.first").alias("first"), F.col("x.q").alias("n"))


def group_key() -> Column:
    """What rows of equal doc_id, source and text share."""
    return F.xxhash64(F.lit(SEED), "doc_id", "source", "text")


def mix_documents(docs: DataFrame, shards: int | None = None, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """One row a document: row_key, group_key, doc_id, copy, source, size, source_size, target, times, and
    ``draws``, an array with the (pass, shard, place) of each of its ``times`` copies."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), group_key().alias("group_key")), "sizes")
    per = targets(rows)
    # whole passes, and blocks of about docs_per_block documents, whatever the source's size
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    per = scratch.keep(per.withColumn("passes", passes).withColumn("blocks", F.least(F.ceil(F.col("n_docs") / docs_per_block), F.lit(MOST_BLOCKS)).cast("long")), "targets")
    if shards is None:
        n = per.agg(F.sum("n_docs")).first()[0] or 0
        shards = min(MOST_SHARDS, max(LEAST_SHARDS, -(-n // DOCS_PER_SHARD)))
    s = per.select(F.col("source").alias("_s"), "source_size", "target", "passes", "blocks")
    # equal rows share doc_id, source and text, so which of them comes first makes no difference
    told = rows.withColumn("copy", F.row_number().over(W.partitionBy("group_key").orderBy("size")))
    told = told.withColumn("row_key", F.xxhash64("group_key", "copy"))
    told = told.join(s, told.source.eqNullSafe(F.col("_s"))).drop("_s").withColumn("block", F.pmod(F.col("row_key"), F.col("blocks")))
    told = scratch.keep(told, "dealt")
    # permuted blocks with the words before each; this window holds a source's blocks, not its documents
    blocks = told.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.join(s, blocks.source.eqNullSafe(F.col("_s"))).drop("_s")
    order = W.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED + 1), "block"), "block")
    blocks = blocks.withColumn("turn", F.row_number().over(order) - 1)
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # rest: words that the last pass still wants when it comes to this block
    rest = F.when(F.col("passes") < MOST, F.col("target") - F.col("passes") * F.col("source_size") - before).otherwise(0.0)
    blocks = blocks.withColumn("rest", F.greatest(rest, F.lit(0.0))).withColumn("extra", (F.col("rest") > 0).cast("long"))
    # a hashed block number may stay empty; the sequence of draws counts only blocks that hold documents
    blocks = scratch.keep(blocks.withColumn("held", F.count("*").over(W.partitionBy("source"))), "blocks")
    quotas = blocks.groupBy("source").agg((F.first("passes") * F.first("held") + F.sum("extra")).alias("quota"))
    ranges = scratch.keep(split_quotas(quotas, shards), "quotas")
    drawn = blocks.filter("passes + extra > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") + F.col("extra") - 1)))
    drawn = drawn.select("source", "block", "pass", (F.col("pass") * F.col("held") + F.col("turn")).alias("draw"))
    r = ranges.select(F.col("source").alias("_s"), "shard", "first", "n")
    drawn = drawn.join(r, drawn.source.eqNullSafe(F.col("_s")) & (F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("first") + F.col("n")))
    homes = drawn.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("homes"))  # four at most
    h = homes.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "homes")
    b = blocks.join(h, blocks.source.eqNullSafe(F.col("_s")) & (blocks.block == F.col("_b")), "left").select(F.col("source").alias("_s"), F.col("block").alias("_b"), "words", "rest", "homes")
    out = told.join(b, told.source.eqNullSafe(F.col("_s")) & (told.block == F.col("_b"))).drop("_s", "_b")
    # in the block where the target falls, documents in hashed order, each that still fits (a block is about docs_per_block rows)
    cols = ["row_key", "group_key", "doc_id", "copy", "size", "source_size", "target", "passes", "homes"]
    cut = out.filter("rest > 0 and rest < words").groupBy("source", "block").agg(F.first("rest").alias("rest"), F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))
    none = F.struct(F.col("rest").alias("left"), F.array().cast("array<boolean>").alias("more"))
    fits = lambda s, x: F.struct(F.when(x["size"] <= s.left, s.left - x["size"]).otherwise(s.left).alias("left"), F.concat(s.more, F.array(x["size"] <= s.left)).alias("more"))
    cut = cut.withColumn("more", F.aggregate("rows", none, fits, lambda s: s.more)).select("source", F.explode(F.arrays_zip("rows", "more")).alias("z"))
    cut = cut.select("source", *[F.col(f"z.rows.{c}").alias(c) for c in cols], F.col("z.more").alias("more"))
    whole = out.filter("not (rest > 0 and rest < words)").select("source", *cols, (F.col("rest") > 0).alias("more"))
    out = whole.unionByName(cut).withColumn("times", F.col("passes") + F.col("more").cast("long"))
    place = lambda x: F.struct(x["pass"].alias("pass"), x.shard.alias("shard"), F.xxhash64(F.lit(SEED + 2), F.col("row_key"), x["pass"]).alias("place"))
    draws = F.when(F.col("times") > 0, F.transform(F.slice("homes", 1, F.col("times").cast("int")), place)).otherwise(F.array().cast("array<struct<pass:bigint,shard:int,place:bigint>>"))
    return out.select("row_key", "group_key", "doc_id", "copy", "source", "size", "source_size", "target", "times", draws.alias("draws"))


def mixed_rows(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix itself: every drawn copy of every document with its ``draw`` (pass, shard, place), dealt by shard, in the order of its places.

    Texts are shuffled twice: to meet their draws, and to their shards.
    """
    mixed = mix_documents(docs, shards).filter("times > 0")
    draws = mixed.groupBy(F.col("group_key").alias("_mix_key")).agg(F.map_from_entries(F.collect_list(F.struct("copy", "draws"))).alias("_mix_draws"))
    told = docs.withColumn("_mix_key", group_key()).join(draws, "_mix_key")
    # the window asks for the partitioning that the join has made
    told = told.withColumn("_mix_copy", F.row_number().over(W.partitionBy("_mix_key").orderBy("_mix_key")))
    out = told.select(*docs.columns, F.explode(F.col("_mix_draws")[F.col("_mix_copy")]).alias("draw"))
    return out.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.place", "draw.pass")


def op4(docs: DataFrame) -> DataFrame:
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times", F.col("draws.shard").alias("shards"))
