"""Derivations and completeness: values that follow from values that were read.

Items and heads are as in ``validate``, with nulls for what was not read. The item
rules are applied in the order gross and taxable, inapplicable heads, only item's
total: the last one reads what the first two have filled in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .validate import EPSILON, PAIRS, TOLERANCE

# Mandatory fields in the order in which missing ones are listed.
PARTY = ["Gstin", "LglNm", "Addr1", "Loc", "Pin", "Stcd"]
ITEM = ["SlNo", "PrdDesc", "HsnCd", "Qty", "Unit", "UnitPrice", "TotAmt", "AssAmt", "GstRt", "CgstAmt", "SgstAmt", "IgstAmt", "TotItemVal"]
TOTALS = ["AssVal", "CgstVal", "SgstVal", "IgstVal", "TotInvVal"]
HEADS = {"intra": ["IgstAmt"], "inter": ["CgstAmt", "SgstAmt"]}
HEAD_TOTALS = {"intra": ["IgstVal"], "inter": ["CgstVal", "SgstVal"]}


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def kind() -> Column:
    """intra or inter where both state codes are known."""
    return F.when(F.col("seller_stcd") == F.col("buyer_stcd"), "intra").when(F.col("seller_stcd") != F.col("buyer_stcd"), "inter")


def gross_and_taxable(items: DataFrame) -> DataFrame:
    """TotAmt from AssAmt + discount, or else AssAmt from TotAmt - discount."""
    gross = F.coalesce(F.col("TotAmt"), F.col("AssAmt") + _zero(F.col("Discount")))
    taxable = F.coalesce(F.col("AssAmt"), F.col("TotAmt") - _zero(F.col("Discount")))
    return items.withColumns({"TotAmt": gross, "AssAmt": taxable})


def _content(fields: list[str], but: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields if f not in but])


def inapplicable_heads(rows: DataFrame, heads: dict[str, list[str]], fields: list[str]) -> DataFrame:
    """0 for tax heads that the supply cannot have, on rows that hold anything else. Needs a ``kind`` column."""
    new = {}
    for k, names in heads.items():
        for n in names:
            fill = F.col(n).isNull() & (F.col("kind") == k) & _content([f for f in fields if f in rows.columns], names)
            new[n] = F.when(fill, 0.0).otherwise(F.col(n))
    return rows.withColumns(new)


def total_heads(heads: DataFrame) -> DataFrame:
    """0 for the totals of tax heads that the supply cannot have, where another total was read."""
    return inapplicable_heads(heads.withColumn("kind", kind()), HEAD_TOTALS, TOTALS).drop("kind")


def single_item_total(items: DataFrame, heads: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """TotItemVal of an only item: its own sum, where the printed TotInvVal agrees with it."""
    total = heads.select("doc", F.col("TotInvVal").alias("_total"))
    own = F.col("AssAmt") + F.col("CgstAmt") + F.col("SgstAmt") + F.col("IgstAmt") + _zero(F.col("CesAmt"))
    fits = (F.count("*").over(W.partitionBy("doc")) == 1) & (F.abs(own - F.col("_total")) <= tolerance + EPSILON)
    return items.join(total, "doc", "left").withColumn("TotItemVal", F.coalesce(F.col("TotItemVal"), F.when(fits, F.round(own, 2)))).drop("_total")


def totals_from_item(heads: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Absent totals from an only item's fields: all of them, if the completed block agrees with TotInvVal, or none."""
    one = items.groupBy("doc").agg(F.count("*").alias("_n"), *[F.first(i).alias(f"_{i}") for _, i in PAIRS]).filter("_n = 1")
    both = heads.join(one, "doc", "left")
    filled = {t: F.coalesce(F.col(t), F.col(f"_{i}")) for t, i in PAIRS}
    total = reduce(lambda a, b: a + b, [_zero(filled[t]) for t, _ in PAIRS]) + _zero(F.col("RndOffAmt"))
    whole = reduce(lambda a, b: a & b, [filled[t].isNotNull() for t in TOTALS[:-1]])
    agrees = whole & F.coalesce(F.abs(total - F.col("TotInvVal")) <= tolerance + EPSILON, F.lit(False))
    return both.withColumns({t: F.when(agrees, filled[t]).otherwise(F.col(t)) for t, _ in PAIRS}).drop("_n", *[f"_{i}" for _, i in PAIRS])


def assumed_pos(heads: DataFrame, complete: Column) -> DataFrame:
    """Pos and its source: the buyer's state code, assumed where nothing mandatory is missing."""
    return heads.withColumn("Pos", F.when(complete, F.col("buyer_stcd"))).withColumn("pos_source", F.when(F.col("Pos").isNotNull(), "assumed"))


def optional_defaults(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Optional amounts that were not read are the schema's default, 0."""
    return rows.withColumns({f: _zero(F.col(f)) for f in fields})


def missing(prefix: Column | str, fields: list[str]) -> Column:
    """Array of the paths among fields that are null or blank, in order."""
    blank = lambda f: F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == ""
    head = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.array_compact(F.array(*[F.when(blank(f), F.concat(head, F.lit(f))) for f in fields]))


def retry(first: DataFrame, second: DataFrame) -> DataFrame:
    """Results of attempt 1 that have a payload or a refusal, and attempt 2 of all others, taken whole."""
    failed = first.filter("payload is null and not refused").select("doc")
    return first.join(failed, "doc", "left_anti").withColumn("attempts", F.lit(1)).unionByName(second.join(failed, "doc", "left_semi").withColumn("attempts", F.lit(2)))
