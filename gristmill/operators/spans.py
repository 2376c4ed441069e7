"""Span algebra: matches with code-point offsets, merging, blanking, lines.

Offsets come from ``functions.spans``, within the row. Merging and blanking are
windows partitioned by document, so a partition holds one document's spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spans as S


def matches(df: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    """(key, pos, token, start, end) of every match, pos from 0; a row's matches come from that row alone."""
    rows = df.filter(F.col(text).rlike(pattern)).select(*key, F.posexplode(S.found(F.col(text), pattern)).alias("pos", "m"))
    return rows.select(*key, "pos", F.col("m.token").alias("token"), *[F.col(f"m.{c}").cast("long").alias(c) for c in ("start", "end")])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are derived once a row, however often later steps read them (a projection may be put into each of its uses)."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def merged(spans: DataFrame, key: list[str], limit: str | None = None) -> DataFrame:
    """Spans clamped to [0, limit], empty ones dropped, touching ones merged."""
    end = F.least("end", limit) if limit else F.col("end")
    s = spans.select(*key, F.greatest("start", F.lit(0)).alias("start"), end.alias("end")).filter("start < end")
    w = W.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def blanked(docs: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """(key, text) with the merged spans as blanks of equal length."""
    w = W.partitionBy(key).orderBy("start")
    cut = merged(spans, [key]).withColumn("from", F.coalesce(F.lag("end").over(w), F.lit(0)))
    cut = cut.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "from"))).alias("cuts"))
    out = docs.select(key, text).join(cut, key, "left")
    piece = F.transform("cuts", lambda c: F.concat(F.substr(F.col(text), c["from"] + 1, c["start"] - c["from"]), F.repeat(F.lit(" "), c["end"] - c["start"])))
    tail = F.substr(F.col(text), F.element_at("cuts", -1)["end"] + 1, F.length(text))
    return out.select(key, F.when(F.col("cuts").isNull(), F.col(text)).otherwise(F.concat(F.array_join(piece, ""), tail)).alias(text))


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, end, content) of every line."""
    rows = df.select(key, F.posexplode(S.lines(F.col(text))).alias("line", "m"))
    return rows.select(key, "line", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("start", "end")], F.col("m.token").alias("content"))


def facing(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, line, at, content, next) of the lines that match a pattern, with the line below; both come from the row alone."""
    rows = df.select(key, S.lines(F.col(text)).alias("_l"))
    each = F.transform("_l", lambda x, i: F.struct(i.alias("line"), x["start"].cast("long").alias("at"), x["token"].alias("content"), F.get("_l", i + 1)["token"].alias("next")))
    return rows.select(key, F.explode(F.filter(each, lambda x: x["content"].rlike(pattern))).alias("x")).select(key, "x.*")
