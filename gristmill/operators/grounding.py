"""Grounding: a model's value counts only if the document prints it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import normalise, standalone

NEAR = 0.005
LEAST_LENGTH = 2


def number_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token, value, credit) of every number printed; a row's figures come from that row alone."""
    return docs.select(key, F.posexplode(numbers.tokens(F.col(text))).alias("pos", "t")).select(key, "pos", "t.token", "t.value", "t.credit")


def signed(tokens: DataFrame) -> DataFrame:
    """Tokens with the sign that their notation gives them."""
    return tokens.withColumn("signed", F.when(F.col("credit").isNotNull(), -F.col("value")).otherwise(F.col("value")))


def ground_numbers(values: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """values (key, field, number) with status kept, credit (only its negative is printed) or ungrounded."""
    t = signed(tokens).groupBy(key).agg(F.collect_list("signed").alias("_t"))
    near = lambda x: F.coalesce(F.exists("_t", lambda v: F.abs(v - x) <= NEAR), F.lit(False))
    status = F.when(F.col("number").isNull(), "missing").when(near(F.col("number")), "kept").when(near(-F.col("number")), "credit").otherwise("ungrounded")
    return values.join(t, key, "left").withColumn("status", status).drop("_t")


def ground_string(value: Column, text: Column) -> Column:
    """kept, kept_short (a token of its own, to be warned of) or ungrounded; missing for null."""
    v, t = normalise(value), normalise(text)
    short = F.length(v) < LEAST_LENGTH
    return F.when(value.isNull(), "missing").when(short & (v != "") & standalone(value, t), "kept_short").when(~short & t.contains(v), "kept").otherwise("ungrounded")


def only_within(value: Column, remaining: Column) -> Column:
    """Whether a kept digit field is no token of its own in the remaining text, so that its place is a guess.

    For an HSN code that is a note (info), for a PIN a warning.
    """
    return value.isNotNull() & ~F.coalesce(standalone(value, normalise(remaining)), F.lit(False))


def reindexed(raw: DataFrame, key: str) -> DataFrame:
    """(key, idx, item) of a JSON array's object members, idx contiguous from 0."""
    rows = raw.select(key, F.posexplode(F.from_json("items", "array<string>")).alias("p", "item"))
    rows = rows.filter(F.ltrim("item").startswith("{"))
    return rows.select(key, (F.row_number().over(W.partitionBy(key).orderBy("p")) - 1).alias("idx"), "item")
