"""How sure OCR was of a value: by its offsets in the document, or by where it is printed.

Pages come with their OCR words in one array (null for a page with a text layer),
so a look-up is a join of a value with its document's pages and a filter in the row.
Where a row has the OCR rows beside the value, ``in_rows`` and ``printed_in_rows`` look it
up in one pass over them: nothing is shuffled and no array of words is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from .pages import page_starts, read_rows

_WORD = r"[\p{L}\p{N}_]"


def paged(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, page, method, text, start, words) of pages (doc, page, method, text) and words (doc, page, start, end, confidence).

    ``start`` is the page's offset in the document's text. ``words`` is null for native
    pages and empty for a page of which OCR read nothing.
    """
    per = words.groupBy(F.col("doc").alias("_d"), F.col("page").alias("_p")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "confidence"))).alias("words"))
    whole = page_starts(pages.select("doc", "page", "method", F.coalesce("text", F.lit("")).alias("text")), "doc", "page", "text")
    rows = whole.join(per, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")), "left").drop("_d", "_p")
    none = F.array().cast("array<struct<start:int,end:int,confidence:double>>")
    return rows.withColumn("words", F.when(F.col("method") != "native", F.coalesce("words", none)))


def of_span(words: Column, start: Column, end: Column) -> Column:
    """The least confidence of the words that a span touches; null for an empty span or none."""
    touched = F.filter(words, lambda w: (w["start"] < end) & (w["end"] > start))
    return F.when(start < end, F.array_min(F.transform(touched, lambda w: w["confidence"])))


def in_rows(rows: Column, start: Column, end: Column) -> Column:
    """The confidence of a span of a document by its OCR rows, an array of (page, native, text, conf) in order.

    As in ``of_offsets``: of the page that the first character is on, up to that page's
    end; null on native pages, between pages, for an empty span or one without words.
    Words, lines and pages are one character apart, so offsets are running sums.
    """

    def step(acc: Column, x: Column) -> Column:
        to = acc["at"] + F.length(x["text"])
        touches = (start < end) & (acc["at"] < end) & (to > start)
        # the first word touched tells the page; a start in front of a page's first word is on none
        here = F.coalesce((acc["at"] <= start) | (acc["page"] == x["page"]), F.lit(False))
        home = F.coalesce(acc["home"], F.when(touches, F.struct(F.when(here, x["page"]).alias("page"))))
        counts = touches & ~x["native"] & F.when(acc["home"].isNull(), here).otherwise(acc["home"]["page"] == x["page"])
        then = F.struct((to + 1).alias("at"), x["page"].alias("page"), home.alias("home"), F.when(counts, F.least(acc["least"], x["conf"])).otherwise(acc["least"]).alias("least"))
        return F.when(acc["at"] >= end, acc).otherwise(then)  # nothing further on is touched

    none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("struct<page:int>").alias("home"), F.lit(None).cast("double").alias("least"))
    return F.aggregate(read_rows(rows), none, step, lambda acc: acc["least"] / 100)


def printed_in_rows(text: Column, rows: Column, value: Column) -> Column:
    """The least confidence of all places where a page's text (``pages.text_of_rows``) prints a value, as in ``of_text``, by its OCR rows."""
    return F.array_min(F.transform(printed_at(text, value), lambda at: in_rows(rows, at, at + F.length(value))))


def of_offsets(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """spans (doc, start, end, ...) with ``confidence``: of the page that the first character is on, up to that page's end; null on native pages."""
    p = pages.select(F.col("doc").alias("_d"), F.col("start").alias("_at"), (F.col("start") + F.length("text")).alias("_to"), "words")
    rows = spans.join(p, (F.col("doc") == F.col("_d")) & (F.col("start") >= F.col("_at")) & (F.col("start") < F.col("_to")), "left")
    return rows.withColumn("confidence", of_span(F.col("words"), F.col("start") - F.col("_at"), F.least("end", "_to") - F.col("_at"))).drop("_d", "_at", "_to", "words")


def printed_at(text: Column, value: Column) -> Column:
    """Offsets at which a value is printed as a token; matches may overlap.

    A side of the value is tested only if its own character there is a word character.
    """
    edge = lambda at, pattern: F.when(F.substr(value, at, F.lit(1)).rlike(_WORD), pattern).otherwise("")
    token = F.concat(F.lit("(?s)(?="), edge(F.lit(1), rf"(?<!{_WORD})"), quoted(value), edge(F.length(value), rf"(?!{_WORD})"), F.lit(")"))
    # nothing is used up by a look-ahead, so a piece begins wherever the value does
    pieces = F.split(text, token, -1)
    first = F.regexp_like(text, F.concat(F.lit(r"\A"), token))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    starts = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<int>")).otherwise(F.filter(starts, lambda at: (at > 0) | first))


def of_text(values: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, value, confidence): the least confidence of all places where OCR pages print the value; null for none."""
    asked = values.select("doc", "value").distinct()
    p = pages.filter("words is not null").select(F.col("doc").alias("_d"), "text", "words")
    hits = printed_at(F.col("text"), F.col("value"))
    found = F.array_min(F.transform(hits, lambda at: of_span(F.col("words"), at, at + F.length("value"))))
    rows = asked.join(p, F.col("doc") == F.col("_d"), "left").withColumn("c", found)
    return rows.groupBy("doc", "value").agg(F.min("c").alias("confidence"))


def of_fields(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, path, confidence) of fields (doc, path, printed): the least of all their spellings, unknown ones left out."""
    each = fields.select("doc", "path", F.explode("printed").alias("value"))
    known = of_text(each, pages).select(F.col("doc").alias("_d"), F.col("value").alias("_v"), "confidence")
    return each.join(known, (F.col("doc") == F.col("_d")) & (F.col("value") == F.col("_v"))).groupBy("doc", "path").agg(F.min("confidence").alias("confidence"))
