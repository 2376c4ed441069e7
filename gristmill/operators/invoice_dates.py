"""The invoice date of a text, with its label, and what about it is in doubt.

Everything happens within the row: date shapes and labels are arrays with offsets,
so a document is one task's row and equal ids do not meet. Dates are candidates
unless they meet a claimed span (the invoice number), go on from a serial or open an
item's quantity. A null or empty text has no date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import spans as S
from ..functions.text import UNICODE, said, squeeze, warning
from . import rules

CHECK = "extract_rules"
FIELD = "DocDtls.Dt"

# Windows, item rows, month names, messages.
WINDOW = 40
CONTEXT = 30
DOC_NO_LABEL = r"(?i)\btax[ \t]+invoice[ \t]+no\b|\binvoice[ \t]+number\b|\binvoice[ \t]+no\b|\binvoice[ \t]*#|\bbill[ \t]+number\b|\bbill[ \t]+no\b|\binv[ \t]+no\b"
ROW_UNITS = "nos|pcs|kgs?|mtrs?|ltrs?|sqft|sets?|boxes|box|pkt|units?|hrs?|gms?|tons?|doz|dzn|prs|pairs?|rolls?|rol|bags?|btl|bdl|bun|ctn|sqm|sqy|qtl|tbs|thd|unt|cbm|kls?"
ROW_NUMBER = r"(?<![A-Za-z0-9/\-])[0-9][0-9,]*(?:\.[0-9]+)?(?![A-Za-z0-9]|[/\-][0-9])"
ROW_NUMBERS = 2
NAMES = "January February March April May June July August September October November December".split()
NONE = "No date was found in the document, so the invoice date could not be extracted."
UNCLAIMED = (
    "The document prints an invoice-date label ('{label}' at character {at}) with no date of its own after it (an empty invoice-date cell, "
    "or its value printed too far from the label to belong to it), so the invoice date '{printed}' was read as {value} from {source} "
    "instead. A blank invoice-date cell leaves the next column's date printed where the invoice date should be, and a due date or a delivery date filed as the invoice "
    "date is wrong in a way no later check can question. Confirm that {value} is the invoice date before filing."
)
COMPETING = (
    "Invoice date '{printed}' was read as {value} from {source}; the document carries no 'Invoice Date' label and also carries {others}. A due "
    "date, a supply date or another document's date filed as the invoice date is wrong, so confirm which of these is the invoice date."
)
ITEM_ROW = (
    "Invoice date '{printed}' was read as {value} from its position (the first date in the document); no date label names it, and it begins a line that "
    "reads as an item row rather than a date field — its day sits where an item row prints its serial number, and the rest of the line carries a unit or further "
    "numeric columns. OCR joins a row's columns with single spaces, which removes the column gap that otherwise tells an item row from a date. The line was left in "
    "the text stage 2 reads, so the item row is not passed on short of its first columns. Confirm that {value} is the invoice date and not an item row's first column before filing."
)
IMPOSSIBLE = (
    "Invoice date '{printed}' normalises to {value}, which is not a real calendar date ({month} {year} has no day {day}). It was still "
    "emitted as {value} because GSTN requires DD/MM/YYYY, but the date was misread or mistyped. Confirm the date against the document."
)
NO_DAY = (
    "Invoice date '{printed}' has {first} as its first component, which cannot be a day of the month. It was still emitted day-first as {value} because GSTN requires "
    "DD/MM/YYYY, but the date was probably misread. Confirm the date against the document."
)
NO_MONTH = (
    "Invoice date '{printed}' has {second} as its second component, which cannot be a month. It was still emitted day-first as {value} because GSTN requires "
    "DD/MM/YYYY, but the source is most likely MM/DD/YYYY. Confirm the date against the document."
)
MONTH_FIRST = (
    "Invoice date '{printed}' was read day-first as {value} because GSTN requires DD/MM/YYYY, but another date on the document can only be read month-first, so "
    "this one may be MM/DD and mean {second} {other_month} {year}. Confirm the date against the document."
)
AMBIGUOUS = (
    "Invoice date '{printed}' is ambiguous: it reads as either {first} {month} {year} (day-first) or {second} {other_month} {year} (month-first), and no other date on "
    "the document settles it. Day-first was used because GSTN requires DD/MM/YYYY. Confirm the date against the document."
)


def candidates(text: Column, claims: Column, shapes: Column | None = None) -> Column:
    """array<struct<token, start, end, value, first, second, year, named>> of the dates of a text; ``claims`` has the spans taken before, ``shapes`` all shapes, where they are at hand."""

    def stands(x: Column) -> Column:
        named = x["token"].rlike("(?i)[a-z]")
        serial = ~named & F.substr(text, x["start"] - 1, F.lit(2)).rlike(r"[\p{L}\p{N}][/\-]$") & (x["start"] > 1)
        short = x["token"].rlike(r"(?:^|[^0-9])[0-9]{2}\z")
        quantity = named & short & S.line_after(text, x["end"]).rlike(rf"(?i)^[ \t]*\b(?:{dates.UNITS})(?![A-Za-z])")
        return ~(serial | quantity)

    def read(x: Column) -> Column:
        first, second, year, named = dates.parts(x["token"])
        return F.struct(x["token"].alias("token"), x["start"].alias("start"), x["end"].alias("end"), dates.normalise(x["token"]).alias("value"), first.alias("first"), second.alias("second"), year.alias("year"), named.alias("named"))

    return F.transform(F.filter(S.apart(S.found(text, dates.SHAPE) if shapes is None else shapes, claims), stands), read)


def as_printed(text: Column, label: Column) -> Column:
    """A label with the words in front of it that belong to it: letters only, on its line and within its column."""
    there = F.greatest(label["end"] - CONTEXT, F.lit(0))
    line = F.substring_index(F.substr(text, there + 1, label["end"] - there), "\n", -1)
    cell = F.regexp_extract(line, r"^(?:.*  )?(.*)$", 1)
    words = squeeze(F.regexp_extract(cell, rf"{UNICODE}(?<!\S)\p{{L}}+(?:\s+\p{{L}}+)*\s*\z", 0))
    return F.when(words != "", words).otherwise(squeeze(label["token"]))


def labels(text: Column) -> Column:
    """array<struct<tier, token, start, end>> of the date labels, by tier, then place."""
    row = lambda k, token, x: F.struct(F.lit(k).alias("tier"), token.alias("token"), (x["end"] - F.length(token)).alias("start"), x["end"].alias("end"))

    def by_tier(found: Column) -> Column:
        # one pass for all tiers: the last word of the first tier's label is one of the last tier as well
        long = F.filter(found, lambda x: F.length(x["token"]) > 5)
        dated = F.filter(found, lambda x: F.length(x["token"]) == 5)
        short = F.filter(found, lambda x: F.length(x["token"]) != 5)
        return F.concat(F.transform(long, lambda x: row(0, x["token"], x)), F.transform(dated, lambda x: row(1, x["token"], x)), F.transform(short, lambda x: row(2, F.regexp_extract(x["token"], r"[A-Za-z]+\z", 0), x)))

    return S.let(S.found(text, rules.DATE_LABEL), by_tier)


def named_by(found: Column, labels_: Column) -> Column:
    """array<struct<at, tier, start, label>>: the labels that name a date, each the first one within reach unless another label stands between."""

    def reach(x: Column) -> Column:
        first = F.get(F.filter(found, lambda d: d["start"] >= x["end"]), 0)
        return F.struct(first["start"].alias("at"), x["tier"].alias("tier"), x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"))

    def names(r: Column) -> Column:
        between = F.exists(labels_, lambda m: (r["end"] <= m["start"]) & (m["end"] <= r["at"]))
        return F.coalesce((r["at"] - r["end"] <= WINDOW) & ~between, F.lit(False))

    return F.filter(F.transform(labels_, reach), names)


def doc_date(docs: DataFrame, claims: str | None = None, shapes: str | None = None) -> DataFrame:
    """docs (text and any other columns) with ``date``: struct(printed, value, start, end, tier, consumed) or null, and ``date_warnings``.

    ``claims`` is a column of spans that hold no date, ``shapes`` one of date shapes where they are at hand. The date with the best label
    (tier, then place) counts, else the first. ``consumed`` is false where the date
    opens a line that reads as an item row.
    """
    text = F.coalesce("text", F.lit(""))
    taken = F.col(claims) if claims else F.array().cast("array<struct<start:int,end:int>>")
    rows = docs.withColumn("_dates", candidates(text, taken, F.col(shapes) if shapes else None)).withColumn("_labels", labels(text)).withColumn("_named", named_by(F.col("_dates"), F.col("_labels")))
    best = F.array_min(F.transform("_named", lambda r: F.struct(r["tier"].alias("tier"), r["at"].alias("at"))))
    rows = rows.withColumn("_best", best).withColumn("_d", F.get(F.filter("_dates", lambda d: F.coalesce(d["start"] == F.col("_best")["at"], F.lit(True))), 0))
    d, tier = F.col("_d"), F.col("_best")["tier"]

    def label_of(at: Column) -> Column:
        return F.array_min(F.transform(F.filter("_named", lambda r: r["at"] == at), lambda r: F.struct(r["tier"].alias("tier"), r["start"].alias("start"), as_printed(text, r).alias("said"))))["said"]

    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("the '"), label_of(d["start"]), F.lit("' label")), F.lit("its position (the first date in the document)")))
    head = F.get(F.filter("_labels", lambda x: x["tier"] == 0), 0)
    base = {"printed": d["token"], "value": d["value"]}
    unclaimed = F.when(F.coalesce(tier, F.lit(-1)) != 0, said(UNCLAIMED, label=head["token"], at=head["start"], source=F.col("_source"), **base))
    differing = F.filter("_dates", lambda x: (x["start"] != d["start"]) & (x["value"] != d["value"]))
    others = F.array_distinct(F.transform(differing, lambda x: F.coalesce(F.concat(F.lit("'"), label_of(x["start"]), F.lit("' -> "), x["value"]), F.concat(F.lit("an unlabelled "), x["value"]))))
    competing = F.when(tier.isin(1, 2) & (F.size(others) > 0), said(COMPETING, source=F.col("_source"), others=F.array_join(others, ", "), **base))
    rest = S.line_after(text, d["end"])
    numbers = F.regexp_count(rest, F.lit(ROW_NUMBER))
    opens = F.trim(F.regexp_replace(S.line_before(text, d["start"]), r"(?U)\s", "")) == ""
    row = tier.isNull() & opens & ~rest.rlike(DOC_NO_LABEL) & (rest.rlike(rf"(?i)\b(?:{ROW_UNITS})(?![A-Za-z])") | (numbers >= ROW_NUMBERS))
    item_row = F.when(row, said(ITEM_ROW, **base))
    month = lambda n: F.get(F.array(*map(F.lit, NAMES)), n - 1)
    first, second, year = d["first"], d["second"], F.lpad(d["year"].cast("string"), 4, "0")
    impossible = F.when(~dates.in_calendar(first, second, d["year"]), said(IMPOSSIBLE, month=month(second), year=d["year"], day=first, **base))
    elsewhere = F.filter("_dates", lambda x: ~x["named"] & (x["start"] != d["start"]))
    day = F.exists(elsewhere, lambda x: x["first"] > 12)
    month_first = F.exists(elsewhere, lambda x: (x["first"] <= 12) & (x["second"] > 12))
    two = {"first": first, "second": second, "month": month(second), "other_month": month(first), "year": year}
    order = (
        F.when(d["named"], impossible)
        .when(~first.between(1, 31), said(NO_DAY, first=first, **base))
        .when(~second.between(1, 12), said(NO_MONTH, second=second, **base))
        .when(impossible.isNotNull(), impossible)
        .when((first > 12) | (first == second) | day, None)
        .when(month_first, said(MONTH_FIRST, **base, **{k: two[k] for k in ("second", "other_month", "year")}))
        .otherwise(said(AMBIGUOUS, **base, **two))
    )
    order = F.when(d.isNotNull(), order)
    none = F.when(d.isNull(), F.lit(NONE))
    notes = F.array_compact(F.array(*[warning(FIELD, m, CHECK) for m in (none, unclaimed, competing, item_row, order)]))
    date = F.when(d.isNotNull(), F.struct(d["token"].alias("printed"), d["value"].alias("value"), d["start"].alias("start"), d["end"].alias("end"), tier.alias("tier"), (~F.coalesce(row, F.lit(False))).alias("consumed")))
    return rows.withColumn("date", date).withColumn("date_warnings", notes).drop("_dates", "_labels", "_named", "_best", "_d", "_source")
