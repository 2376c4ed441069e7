"""Quality rules with adaptive thresholds.

Every measured share of a document becomes an integer (per mille). For each
language and source a log-linear histogram of each measure is kept: the bucket
of v is v with all but its top seven bits cleared, so a bucket's relative width
is below 1/64, and sketches of two parts of the data merge by adding counts.
Equal texts of a group count once in it, so that copies of one page, however
many, do not set its thresholds. A document is kept when none of its measures lies
above the threshold that its own language and source set: upper quartile + 3
interquartile ranges + slack, but no more than the measure's ceiling, so that a
group with over a quarter of bad texts cannot excuse them. Slack keeps groups
whose spread is nought from rejecting a single odd symbol. A group of fewer than
FEW distinct texts takes the threshold of its language's merged sketches, and
that of all sketches if the language has as few.

The thresholds are then joined to the documents and filter them.

Edge cases: null text has no words and fails the base rule; null language or
source is a group of its own; a repeated row is measured once each and counts
once in the sketches; extra columns are ignored; empty tables give empty ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk
from .store import Scratch

SYMBOLS = b"#*$%&|<>"
#: Measure -> slack in per mille.
SLACK = {"symbol": 25, "dup_line": 500, "repeat": 250, "shout": 60, "capital": 250, "same_word": 60}
#: Measure -> greatest limit that a group can set, in per mille.
CEILING = {"symbol": 300, "dup_line": 800, "repeat": 300, "shout": 400, "capital": 900, "same_word": 300}
FEW = 40
_LINE = re.compile(rb"[^\x20\x09-\x0D]")
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_capitals", "n_same"]


def _range_counts(arr: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(arr, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def measure(texts: list[bytes]) -> np.ndarray:
    """One row of _COUNTS for each text."""
    w = tk.Words(texts, lower=False)
    out = np.zeros((len(texts), len(_COUNTS)), np.int64)
    out[:, 0] = w.counts
    inside = ~tk._SPACE[w.arr]
    out[:, 1] = _range_counts(inside & ((w.arr & 0xC0) != 0x80), w.byte_off)
    out[:, 2] = _range_counts(_IS_SYMBOL[w.arr], w.byte_off)
    out[:, 6] = _range_counts(w.arr == 33, w.byte_off)
    out[:, 7] = _range_counts((w.arr >= 65) & (w.arr <= 90), w.byte_off)
    same = np.zeros(len(w.hashes), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    out[:, 8] = _range_counts(same, w.off)
    g, off = w.shingles(8)
    if len(g):
        doc = np.repeat(np.arange(len(texts)), np.diff(off))
        _, which, count = np.unique(tk.mix(g + doc.astype(tk.U) * tk.U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[which] > 1)
        cover = np.zeros(len(w.hashes) + 1, np.int64)
        at = again - off[doc[again]] + w.off[doc[again]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + 8, -1)
        out[:, 4] = _range_counts(np.cumsum(cover)[:-1] > 0, w.off)
    for d, t in enumerate(texts):
        seen: set[bytes] = set()
        n = dup = 0
        for line in t.split(b"\n"):
            if _LINE.search(line):
                n += 1
                dup += line in seen
                seen.add(line)
        out[d, 5], out[d, 3] = n, dup
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a hash of the text and the counts; one narrow map."""
    head = ["doc_id", "lang", "source", "text_key"]
    rows = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_key"), "text")

    def task(batches):
        for b, texts in tk.parts(batches):
            m = measure(texts)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *(pa.array(m[:, k]) for k in range(len(_COUNTS)))], names=[*head, *_COUNTS])

    schema = rows.select(*head).schema
    for c in _COUNTS:
        schema = schema.add(c, "long")
    return rows.mapInArrow(task, schema)


def _shares() -> dict[str, Column]:
    share = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {"symbol": share("n_symbols", "word_chars"), "dup_line": share("n_dup_lines", "n_lines"), "repeat": share("n_repeat_words", "n_words"), "shout": share("n_shouts", "n_words"), "capital": share("n_capitals", "word_chars"), "same_word": share("n_same", "n_words")}


def bucket(v: Column) -> Column:
    """v with all but its top seven bits cleared."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of distinct texts: add up n to merge two of them."""
    values = [f"m_{k}" for k in SLACK]
    once = rows.groupBy("lang", "source", "text_key").agg(*[F.max(v).alias(v) for v in values])
    each = F.explode(F.map_from_arrays(F.array(*map(F.lit, SLACK)), F.array(*map(F.col, values)))).alias("measure", "v")
    return once.select("lang", "source", each).groupBy("lang", "source", "measure", bucket(F.col("v")).alias("bucket")).agg(F.sum(F.lit(1)).alias("n"))


def _fixed(values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("measure"))


def limits(sketches: DataFrame, *group: str) -> DataFrame:
    """(group, measure, total, limit) of sketches merged by group."""
    key = [*group, "measure"]
    w = W.partitionBy(*key)
    merged = sketches.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    quart = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))
    spread = ranked.groupBy(*key).agg(F.max("total").alias("total"), quart(1).alias("q1"), quart(3).alias("q3"))
    return spread.select(*key, "total", F.least(F.col("q3") + 3 * (F.col("q3") - F.col("q1")) + _fixed(SLACK), _fixed(CEILING)).alias("limit"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source, limits map) from merged sketches."""
    everywhere = {m: 0 for m in SLACK} | {r.measure: r.limit for r in limits(sketches).collect()}  # a row a measure
    wider = limits(sketches, "lang").select(F.col("lang").alias("_l"), F.col("measure").alias("_m"), F.when(F.col("total") >= FEW, F.col("limit")).alias("wide"))
    own = limits(sketches, "lang", "source")
    both = own.join(wider, own.lang.eqNullSafe(F.col("_l")) & (own.measure == F.col("_m")), "left")
    limit = F.coalesce(F.when(F.col("total") >= FEW, F.col("limit")), "wide", _fixed(everywhere)).alias("limit")
    return both.select("lang", "source", "measure", limit).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", "limit"))).alias("limits"))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the reason of every document."""
    scratch = Scratch(docs.sparkSession)
    rows = measured(docs)
    for k, c in _shares().items():
        rows = rows.withColumn(f"m_{k}", c)
    rows = scratch.keep(rows, "measured")
    chosen = thresholds(scratch.keep(sketch(rows), "sketch")).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "limits")
    out = rows.join(chosen, rows.lang.eqNullSafe(F.col("_l")) & rows.source.eqNullSafe(F.col("_s")), "left")
    over = F.filter(F.array(*[F.when(F.col(f"m_{k}") > F.col("limits")[k], F.lit(k)) for k in SLACK]), lambda x: x.isNotNull())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("over", over).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.size("over") == 0))


def op3(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("over", ",").alias("over"))
