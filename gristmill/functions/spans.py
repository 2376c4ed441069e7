"""Spans within a row: matches with code-point offsets, as arrays of structs.

No shuffle and no key: rows with equal ids do not meet. Java reports positions in
UTF-16 units, so a text is split around its matches and lengths are added up. An
array holds one text's matches and is grown match by match, which is meant for
pages and invoices, not for a text with very many matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<struct<token:string,start:int,end:int>>"
#: Noncharacters that mark the matches of a text, which must not hold them itself.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def _placed(pieces: Column, gap, token) -> Column:
    """array<struct<token, start, end>> of pieces that each have a gap and then, but for the last, a token."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(gap(x))
        end = start + F.coalesce(F.length(token(x)), F.lit(0))
        one = F.struct(token(x).alias("token"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(token(x).isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out")), step, lambda acc: acc["out"])


def found(text: Column, pattern: str) -> Column:
    """array<struct<token, start, end>> of all matches, in order; empty for a null text."""
    text = F.coalesce(text, F.lit(""))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"))
    # the pattern runs over the text once: matches are marked, then cut at the marks
    pieces = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _CLOSE, -1)
    token = lambda x: F.when(F.contains(x, F.lit(_OPEN)), F.substring_index(x, _OPEN, -1))
    marked = F.transform(pieces, lambda x: F.struct(F.substring_index(x, _OPEN, 1).alias("gap"), token(x).alias("token")))
    return _placed(F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), both).otherwise(marked), lambda x: x["gap"], lambda x: x["token"])


def let(value: Column, use) -> Column:
    """``use`` of a value that is derived once, however often it is read."""
    return F.get(F.transform(F.array(value), use), 0)


def lines(text: Column) -> Column:
    """array<struct<token, start, end>> of all lines; ``token`` is the line without its line feed."""
    ends = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line")))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["line"])
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(x["line"].alias("token"), acc["at"].alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(ends, F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out")), step, lambda acc: acc["out"])


def meets(a: Column, b: Column) -> Column:
    """Whether two spans have a character in common."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart(spans: Column, claims: Column) -> Column:
    """The spans that meet none of the claims."""
    return F.filter(spans, lambda x: ~F.exists(claims, lambda c: meets(x, c)))


def merged(spans: Column) -> Column:
    """array<struct<start, end>> of the spans, cut at 0, empty ones left out, those that touch or overlap as one."""
    cut = F.transform(spans, lambda x: F.struct(F.greatest(x["start"], F.lit(0)).alias("start"), x["end"].alias("end")))

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) == 0) | (x["start"] > last["end"]), F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider)))

    return F.aggregate(F.array_sort(F.filter(cut, lambda x: x["start"] < x["end"])), F.array().cast("array<struct<start:int,end:int>>"), step)


def line_before(text: Column, start: Column) -> Column:
    """What stands on the line in front of an offset."""
    return F.substring_index(F.substr(text, F.lit(1), start), "\n", -1)


def line_after(text: Column, end: Column) -> Column:
    """What stands on the line behind an offset."""
    return F.substring_index(F.substr(text, end + 1), "\n", 1)


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks of equal length in place of the spans; they may touch, overlap or pass its ends."""
    inside = F.filter(F.transform(spans, lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("start"), F.least(s["end"], F.length(text)).alias("end"))), lambda s: s["start"] < s["end"])

    def step(acc: Column, s: Column) -> Column:
        from_ = F.greatest(acc["at"], s["start"])
        end = F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, from_ - acc["at"]), F.repeat(F.lit(" "), end - from_)).alias("out"))

    return F.aggregate(F.array_sort(inside), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
