"""Invoice numbers: candidates beside and below each label, refusals, choice and competing labels.

A label offers the token beside it on its line and the tokens in its column on the
next line. A token is refused for what else it is: part of a GSTIN, a date or
part of one, part of a longer number, a quantity, a heading word or a truncated one.
Null and empty texts have no label; a document id stands for one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import spans as S
from ..functions.text import said, strip, warning
from . import rules
from .spans import once

# Heading words that are no numbers, the shortest number without digit or separator, the longest number.
HEADINGS = "amount bill date dated description dt due gstin hsn invoice no nos number of particulars place qty rate ref reference sac sl sr supply tax total".split()
SHORTEST = 4
LONGEST = 30
# Reasons and messages.
REASONS = {
    "gstin": "was already matched as a GSTIN, which is not an invoice number",
    "date": "is a date, so it is the document's date column read where the invoice number should be rather than a serial number",
    "date_part": "is one component of the date '{printed}' the document prints in that position, so it is the date column read where the invoice number should be rather than a serial number",
    "number": "is one run of a longer number rather than a whole serial number",
    "quantity": "is a quantity carrying a unit rather than a serial number",
    "heading": "is one of the words invoices print as a column heading or a label rather than as a serial number",
    "truncated": "carries no digit, no '/' or '-' separator and fewer than 4 characters, so it reads as a truncated word rather than a whole serial number",
    "no_digit": "carries no digit, and nothing on that row names it as the invoice number rather than a neighbouring column's value",
}
COLUMN = (
    "Invoice number '{value}' was read from the row below the label '{label}' rather than from beside it, because the document prints "
    "the labels as a header row and the values underneath. Nothing on that row names it as the invoice number rather than a neighbouring column's value, so "
    "confirm it against the document before filing."
)
NO_DIGIT = (
    "Invoice number '{value}' was read from beside the label '{label}' but carries no digit, {confirmation}. GST Rule 46(b) "
    "allows a serial of letters alone, so it was taken as the invoice number, but a blank invoice-number cell leaves the next column's heading in "
    "exactly this position. Confirm it against the document before filing."
)
NOTHING_BELOW = "and no value was printed in the label's own column on the line below to confirm it"
REFUSED_BELOW = "and the row below prints '{token}' in the label's own column, which confirms nothing because it {reason}"
CUT = (
    "The invoice number token after '{label}' runs past 30 characters; only its first 30 ('{value}') were taken, so the value is shorter than the text on the "
    "document. Confirm the invoice number against the document."
)
COMPETING = (
    "Invoice number '{value}' was read from '{label}' at character {at}, the first invoice-number label in the document, but the "
    "document also prints {others}. A line referring to another document ('Ref: Your Bill No. 7788 dated ...', an e-Way bill number, a "
    "purchase order) carries an invoice-number label of its own, and printed above the invoice's own header it is the one read first — so the number filed would "
    "be that other document's. Confirm which of these is this invoice's own number before filing."
)
ONE_COMPETING = "'{label}' at character {at} carrying '{value}'"
WRAPPED = (
    "The document prints {printed} at character {at}, which reads as an invoice-number label wrapped across a line break. A label is only recognised "
    "when its own words are printed on one line, so this one could not be read as a label and no value was taken from beside it or below it. Any number "
    "reported for DocDtls.No was read from a different label on the page and may belong to that other label rather than to this one. Read the invoice number "
    "from the document."
)
NO_LABEL = (
    "No invoice number label ('Invoice No', 'Bill No', 'Tax Invoice No', 'Inv No') was found, so the invoice number could not be extracted. A label is only "
    "recognised when its own words are printed on one line, so a label OCR split across a line break ('Invoice' above 'No.') is not found even though the "
    "document prints one; if the document shows an invoice number, read it from the document."
)
NO_VALUE = (
    "The invoice number label '{label}' at character {at} is not followed by a value on its own line or in its column on the line below, so the "
    "invoice number could not be extracted. Read it from the document rather than from the text after the label."
)
BESIDE_REFUSED = "The invoice number label '{label}' at character {at} is followed by '{token}', which was not accepted as the invoice number because it {reason}"
BESIDE_NONE = "The invoice number label '{label}' at character {at} is not followed by a value on its own line"
BELOW_REFUSED = "; the row below prints '{token}' in the label's column, which was not accepted as the invoice number either because it {reason}"
BELOW_NONE = "; no value was printed in the label's column on the line below either"
UNREAD = ". The invoice number could not be extracted; if one is visible on the document, enter it manually."
GAP = r"^[ \t.:#\-]*"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9/\-]*"
UNIT = rf"\b(?:{dates.UNITS})(?![A-Za-z])"
_TOKEN = "struct<token:string,start:int,digit:boolean,reason:string,printed:string>"


def rank(label: Column) -> Column:
    low = F.lower(label)
    return F.coalesce(*[F.when(low.startswith(r), i) for i, r in enumerate(rules.RANKS)], F.lit(len(rules.RANKS)))


def _faced(text: Column) -> Column:
    """array<struct<label, label_start, l, r, at, content, next>>: labels with their columns [l, r) and the next line."""

    def read(x: Column) -> Column:
        before, after = S.line_before(text, x["start"]), F.split(F.substr(text, x["end"] + 1), "\n", 3)
        l, r = F.length(before), F.length(before) + x["end"] - x["start"]
        return F.struct(x["token"].alias("label"), x["start"].alias("label_start"), l.alias("l"), r.alias("r"), (x["start"] - l).alias("at"), F.concat(before, x["token"], F.get(after, 0)).alias("content"), F.get(after, 1).alias("next"))

    return F.transform(S.found(text, rules.DOC_NO), read)


def _labels(docs: DataFrame) -> DataFrame:
    """(doc, label, label_start, l, r, at, content, next)."""
    return docs.select("doc", F.inline(_faced(F.col("text"))))


def _judged(c: Column, below: bool, gstins: Column, shapes: Column) -> Column:
    """struct(token, start, digit, reason, printed) of a candidate (token, start, end, before, after).

    reason (null: accepted): gstin, date, date_part, number, quantity, heading, truncated
    or no_digit. Any real date shape refuses a token, even one inside a serial.
    """
    on = F.filter(shapes, lambda d: S.meets(d, c) & dates.real(d["token"]))
    first = F.array_min(F.transform(on, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["token"].alias("token"))))
    read = F.struct(first.alias("d"), c["token"].rlike("[0-9]").alias("digit"))
    part = F.coalesce(c["before"].rlike(r"^[0-9][.,]\z"), F.lit(False)) | c["after"].rlike(r"^(?:\.[0-9]|,[0-9]{2,3}(?![0-9]))")
    unit = c["after"].rlike(f"(?i){UNIT}" if below else rf"(?i)^[ \t]*{UNIT}")
    low = F.lower(c["token"])

    def judge(x: Column) -> Column:
        d, digit = x["d"], x["digit"]
        reason = (
            F.when(~digit & F.lit(below), "no_digit")
            .when(F.exists(gstins, lambda g: S.meets(g, c)), "gstin")
            .when((d["start"] == c["start"]) & (d["end"] == c["end"]), "date")
            .when(d.isNotNull(), "date_part")
            .when(part, "number")
            .when(unit, "quantity")
            .when(digit, None)
            .when(low.isin(*HEADINGS), "heading")
            .when(~low.rlike("[/-]") & (F.length(c["token"]) < SHORTEST), "truncated")
        )
        return F.struct(c["token"].alias("token"), c["start"].alias("start"), digit.alias("digit"), reason.alias("reason"), d["token"].alias("printed"))

    return S.let(read, judge)


def _beside(x: Column, gstins: Column, shapes: Column) -> Column:
    """The judged token beside a label, null without one."""
    rest = F.substr(x["content"], x["r"] + 1)
    named = F.struct(rest.alias("rest"), F.regexp_extract(rest, GAP + f"({TOKEN})", 1).alias("token"))

    def candidate(y: Column) -> Column:
        gap = F.position(y["token"], y["rest"]) - 1  # what stands before the token holds none of its characters
        start = x["at"] + x["r"] + gap
        before = F.substr(x["content"], x["r"] + gap - 1, F.lit(2))
        return F.struct(y["token"].alias("token"), start.alias("start"), (start + F.length(y["token"])).alias("end"), before.alias("before"), F.substr(y["rest"], gap + F.length(y["token"]) + 1).alias("after"))

    return S.let(named, lambda y: F.when(y["token"] != "", S.let(candidate(y), lambda c: _judged(c, False, gstins, shapes))))


def _below(x: Column, gstins: Column, shapes: Column) -> Column:
    """array<struct<distance, start, x>> of the judged tokens in a label's column on the next line."""
    under = F.filter(S.found(x["next"], TOKEN), lambda m: (m["start"] < x["r"]) & (m["end"] > x["l"]))
    from_ = x["at"] + F.length(x["content"]) + 1

    def candidate(m: Column) -> Column:
        before = F.when(m["start"] >= 2, F.substr(x["next"], m["start"] - 1, F.lit(2)))
        return F.struct(m["token"].alias("token"), (from_ + m["start"]).alias("start"), (from_ + m["end"]).alias("end"), before.alias("before"), F.substr(x["next"], m["end"] + 1).alias("after"), F.abs(m["start"] - x["l"]).alias("distance"))

    judged = lambda c: F.struct(c["distance"].alias("distance"), c["start"].alias("start"), _judged(c, True, gstins, shapes).alias("x"))
    return F.transform(F.transform(under, candidate), judged)


def _choice(x: Column, gstins: Column, shapes: Column) -> Column:
    """A label's value and method (regex: beside, column: below), or what was refused on either side.

    A token with a digit beside the label comes first, then the nearest accepted one
    below, then one without a digit beside it.
    """
    good = lambda b: b.isNotNull() & b["reason"].isNull()
    at_once = lambda b: F.coalesce(good(b) & b["digit"], F.lit(False))

    def sides(b: Column) -> Column:
        def nearest(us: Column) -> Column:
            refused = F.transform(F.filter(us, lambda u: u["x"]["reason"].isNotNull()), lambda u: F.struct((~u["x"]["digit"]).alias("word"), u["distance"].alias("distance"), u["start"].alias("start"), u["x"].alias("x")))
            return F.struct(F.array_min(F.filter(us, lambda u: u["x"]["reason"].isNull()))["x"].alias("u"), F.array_min(refused)["x"].alias("n"), b.alias("b"))

        # the line below is read only where what stands beside does not settle it
        return F.when(at_once(b), F.struct(F.lit(None).cast(_TOKEN).alias("u"), F.lit(None).cast(_TOKEN).alias("n"), b.alias("b"))).otherwise(S.let(_below(x, gstins, shapes), nearest))

    def choose(s: Column) -> Column:
        b, u, n = s["b"], s["u"], s["n"]
        taken = F.when(at_once(b), b).otherwise(F.coalesce(u, F.when(good(b), b)))
        silent = at_once(b) | u.isNotNull()
        why = lambda y: F.struct(y["token"].alias("token"), y["reason"].alias("reason"), y["printed"].alias("printed"))
        return F.struct(
            x["label_start"].cast("long").alias("label_start"), x["label"].alias("label"), rank(x["label"]).alias("rank"), taken["token"].alias("printed"), F.substr(taken["token"], F.lit(1), F.lit(LONGEST)).alias("value"), taken["start"].cast("long").alias("start"),
            F.when(taken.isNotNull(), F.when(at_once(b), "regex").when(u.isNotNull(), "column").otherwise("regex")).alias("method"), F.when(~good(b), why(b)).alias("beside_refused"), F.when(~silent, why(n)).alias("below_refused"),
        )

    return S.let(S.let(_beside(x, gstins, shapes), sides), choose)


def doc_no(docs: DataFrame) -> DataFrame:
    """One row a document: the number of its first label that yields one, within the row.

    outcome: taken, refused (with the first label that has a refusal), no_value or no_label.
    notes: column (chosen by layout), no_digit, cut (longer than LONGEST), competing
    (a later label, as specific, names another number), wrapped (a label broken over lines).
    """
    return read(docs.select("doc", "text")).select("doc", "number.*")


def read(docs: DataFrame, gstins: str | None = None, shapes: str | None = None) -> DataFrame:
    """docs with ``number``: what ``doc_no`` has of each. The columns hold GSTIN and date shapes, where they are at hand."""
    text = F.coalesce("text", F.lit(""))
    kept = docs.columns
    rows = once(docs, _faced=_faced(text))
    labels = F.transform("_faced", lambda x: F.struct(x["label_start"].alias("start"), (x["label_start"] + F.length(x["label"])).alias("end")))
    none = F.array().cast(S._NONE)
    at_hand = lambda c, pattern: F.when(F.size("_faced") > 0, F.col(c) if c else S.found(text, pattern))
    rows = once(rows, _dates=F.coalesce(at_hand(shapes, dates.SHAPE), none), _gstins=F.transform(at_hand(gstins, rules.GSTIN), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), wrapped=F.transform(rules.wrapped(text, labels), lambda x: F.struct(x["start"].cast("long").alias("start"), x["token"].alias("token"))))
    rows = once(rows, all=F.when(F.size("_faced") > 0, F.transform("_faced", lambda x: _choice(x, F.col("_gstins"), F.col("_dates")))))
    t = F.get(F.filter("all", lambda x: x["value"].isNotNull()), 0)
    no = F.get(F.filter("all", lambda x: x["beside_refused"]["token"].isNotNull() | x["below_refused"]["token"].isNotNull()), 0)
    rows = once(rows, t=t, no=no)
    t, no = F.col("t"), F.col("no")
    rows = once(rows, rivals=F.filter("all", lambda x: (x["label_start"] > t["label_start"]) & (x["rank"] <= t["rank"]) & (x["value"] != t["value"])), said=F.coalesce(t, no, F.get("all", 0)))
    rivals, said_ = F.col("rivals"), F.col("said")
    outcome = F.when(F.col("all").isNull(), "no_label").when(t.isNotNull(), "taken").when(no.isNotNull(), "refused").otherwise("no_value")
    notes = F.array(
        F.when(t["method"] == "column", "column"), F.when((t["method"] == "regex") & ~t["value"].rlike("[0-9]"), "no_digit"), F.when(F.length(t["printed"]) > LONGEST, "cut"),
        F.when(F.size(rivals) > 0, "competing"), F.when(F.size("wrapped") > 0, "wrapped"),
    )
    number = F.struct(
        outcome.alias("outcome"), said_["label"].alias("label"), said_["label_start"].alias("label_start"), t["value"].alias("value"), t["start"].alias("start"), (t["start"] + F.length(t["value"])).alias("end"), t["method"].alias("method"),
        said_["beside_refused"].alias("beside_refused"), said_["below_refused"].alias("below_refused"), F.transform(rivals, lambda x: F.struct(x["label"].alias("label"), x["label_start"].alias("label_start"), x["value"].alias("value"))).alias("competing"), F.array_compact(notes).alias("notes"),
        F.length(t["printed"]).alias("printed_size"), F.col("wrapped"),
    )
    return rows.select(*kept, number.alias("number"))


def _reason(refused: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.replace(texts[refused["reason"]], F.lit("{printed}"), F.coalesce(refused["printed"], F.lit("")))


def warnings(found: DataFrame) -> DataFrame:
    """``doc_no`` with ``no_warnings``: what is in doubt about the number, or why there is none, in sentences."""
    label, at, value = F.col("label"), F.col("label_start"), F.col("value")
    beside, below = F.col("beside_refused"), F.col("below_refused")
    has = lambda note: F.array_contains("notes", note)
    under = F.when(below["token"].isNull(), F.lit(NOTHING_BELOW)).otherwise(said(REFUSED_BELOW, token=below["token"], reason=_reason(below)))
    others = F.array_distinct(F.transform("competing", lambda x: said(ONE_COMPETING, label=x["label"], at=x["label_start"], value=x["value"])))
    head = F.when(beside["token"].isNull(), said(BESIDE_NONE, label=label, at=at)).otherwise(said(BESIDE_REFUSED, label=label, at=at, token=beside["token"], reason=_reason(beside)))
    tail = F.when(below["token"].isNull(), F.lit(BELOW_NONE)).otherwise(said(BELOW_REFUSED, token=below["token"], reason=_reason(below)))
    outcome = F.col("outcome")
    single = [
        F.when(outcome == "no_label", F.lit(NO_LABEL)), F.when(outcome == "no_value", said(NO_VALUE, label=label, at=at)), F.when(outcome == "refused", F.concat(head, tail, F.lit(UNREAD))),
        F.when(has("column"), said(COLUMN, value=value, label=label)), F.when(has("no_digit"), said(NO_DIGIT, value=value, label=label, confirmation=under)),
        F.when(has("cut"), said(CUT, label=label, value=value)), F.when(has("competing"), said(COMPETING, value=value, label=label, at=at, others=F.array_join(others, ", "))),
    ]
    part = lambda w: F.array_join(F.transform(F.split(w["token"], r"\r\n|\r|\n"), lambda x: F.concat(F.lit("'"), strip(x), F.lit("'"))), " above ")
    wrapped = F.transform("wrapped", lambda w: warning("DocDtls.No", said(WRAPPED, printed=part(w), at=w["start"]), "extract_rules"))
    return found.withColumn("no_warnings", F.concat(F.array_compact(F.array(*[warning("DocDtls.No", m, "extract_rules") for m in single])), wrapped))
