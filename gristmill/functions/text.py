"""Text expressions: Unicode-aware stripping, normalising and token tests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, and "$" only at the very end or before a line feed.
UNICODE = "(?Ud)"


#: All that (?U)\s matches.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind (trim() knows spaces only)."""
    return F.btrim(c, F.lit(SPACE))


def squeeze(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{UNICODE}\s+", " "))


def normalise(c: Column) -> Column:
    """squeeze and lower case; equals case folding for ASCII."""
    return F.lower(squeeze(c))


def quoted(c: Column) -> Column:
    """The value as a literal regular expression."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")


def standalone(value: Column, normalised: Column) -> Column:
    """Whether the value stands in the normalised text as a token of its own."""
    return F.regexp_like(normalised, F.concat(F.lit(r"(?U)\b"), quoted(normalise(value)), F.lit(r"\b")))


def said(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its value; null if a value is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def warning(field: Column | str, message: Column, check: str, severity: str = "warning") -> Column:
    """struct(field, message, severity, check), null without a message."""
    at = field if isinstance(field, Column) else F.lit(field)
    return F.when(message.isNotNull(), F.struct(at.alias("field"), message.alias("message"), F.lit(severity).alias("severity"), F.lit(check).alias("check")))
