"""Invoice dates: day-first reading and the calendar test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the month vocabulary. A gap is one blank, or a hyphen with a blank on either side at most.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
# Unit words that make "3 June 26 Nos" an item row.
UNITS = "nos|pcs|kgs?|mtrs?|ltrs?|sqft|sets?|boxes|box|pkt|units?|no[.]"
_GAP = r"(?:[ \t]|[ \t]?-[ \t]?)"
_ROW = rf"(?![ \t]*\b(?:{UNITS})(?![A-Za-z]))"
#: Any date shape, a fragment of a serial and an item row included.
SHAPE = rf"(?i)(?=[0-9])(?:\b[0-9]{{1,2}}{_GAP}(?:{MONTHS})\b{_GAP}(?:[0-9]{{4}}|[0-9]{{2}})\b|\b[0-9]{{1,2}}[/.\-][0-9]{{1,2}}[/.\-](?:[0-9]{{4}}|[0-9]{{2}})\b)"
#: A numeric date that goes on from a serial ("SFPL/24-25/0731") is none, nor is a two-digit year before a unit word.
DATE = rf"(?i)(?=[0-9])(?:\b[0-9]{{1,2}}{_GAP}(?:{MONTHS})\b{_GAP}(?:[0-9]{{4}}\b|[0-9]{{2}}\b{_ROW})|\b(?<![\p{{L}}\p{{N}}][/\-])[0-9]{{1,2}}[/.\-][0-9]{{1,2}}[/.\-](?:[0-9]{{4}}|[0-9]{{2}})\b)"
_NUMERIC = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]+)\z"
_NAMED = r"(?i)^([0-9]{1,2})[ \t-]+([a-z]{3})[a-z]*[ \t-]+([0-9]+)\z"
_ORDER = "jan feb mar apr may jun jul aug sep oct nov dec"


def parts(printed: Column) -> tuple[Column, Column, Column, Column]:
    """(day, month, year, whether the month is a name), day first, two-digit years in this century."""
    named = printed.rlike(_NAMED)
    pick = lambda k: F.when(named, F.regexp_extract(printed, _NAMED, k)).otherwise(F.regexp_extract(printed, _NUMERIC, k))
    month = F.when(named, ((F.instr(F.lit(_ORDER), F.lower(pick(2))) + 3) / 4).cast("int")).otherwise(pick(2).try_cast("int"))
    year = pick(3).try_cast("int")
    return pick(1).try_cast("int"), month, F.when(F.length(pick(3)) == 2, year + 2000).otherwise(year), named


def normalise(printed: Column) -> Column:
    """DD/MM/YYYY as read, whether or not the calendar has it."""
    d, m, y, _ = parts(printed)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws("/", two(d), two(m), F.lpad(y.cast("string"), 4, "0"))


def in_calendar(day: Column, month: Column, year: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd").isNotNull()


def real(printed: Column) -> Column:
    """Whether the calendar has it: as read for month names, in either order for numbers."""
    d, m, y, named = parts(printed)
    return in_calendar(d, m, y) | (~named & in_calendar(m, d, y))
