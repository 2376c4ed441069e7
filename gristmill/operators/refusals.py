"""Which documents are refused and why, and what reading their pages left in doubt.

pages: (doc, page, method, text), page from 1, method native or ocr_required. A native
page is read first; OCR pages are read again, the currency detector with currency signs blanked,
and refuse only for a kind not found before. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import said, squeeze, strip, warning
from .pages import detect_currency, detect_export, reverse_charge

CHECK = "ingest"
KINDS = ["export_sez", "multi_currency"]
FIELDS = {"export_sez": "TranDtls.SupTyp", "multi_currency": "ValDtls.TotInvValFc"}

# Signs and messages.
GLYPHS = "$€£¥"
WHY = {
    "EXP": "for an export the buyer has no GSTIN by design",
    "SEZ": "for an SEZ supply the SEZ unit or developer holds a GSTIN but the supply is zero-rated and treated as inter-state regardless of the buyer's state",
}
EXPORT = (
    'Detected export/SEZ wording: "{phrase}" on page {page}. This maps to TranDtls.SupTyp, most likely {values}. '
    "Build 1 cannot process export or SEZ invoices: {why}, while BuyerDtls.Gstin, BuyerDtls.Stcd, BuyerDtls.Pos and the tax-split rule all "
    "assume a domestic B2B buyer, so the output would be a broken payload. What you can do: prepare the INV-01 through the e-invoice portal's export/SEZ flow "
    "or the offline utility with SupTyp set to {values}. If this document is actually a domestic supply, the quoted phrase is what triggered the refusal, so check whether it "
    "appears only in printed boilerplate rather than describing this supply."
)
CURRENCY = (
    'Detected a non-rupee currency indicator: "{phrase}" on page {page}. This corresponds to ValDtls.TotInvValFc (invoice value in foreign currency), meaning '
    "the invoice states non-rupee amounts. Build 1 cannot process it because the extractor assumes every amount is in rupees and would silently misparse foreign-currency figures "
    "as INR. What you can do: if the invoice also shows INR amounts, use those, or convert the figures at the exchange rate printed on the invoice, then re-run. If this is an "
    "export invoice, follow the export/SEZ refusal's advice instead."
)
EVIDENCE = '"{phrase}" (page {page})'
FROM_OCR = "Found in text recovered by OCR from a page whose text layer build 1 could not read. "
BLANK = (
    "Page {page} had no usable text layer and OCR recovered no text from it either, so nothing on that page could contribute to the invoice. Any "
    "field reported missing below may simply be printed on this page."
)
GLYPH = (
    'OCR read a currency symbol on page {page}: "{token}". On its own that is not enough to refuse this document as a foreign-currency invoice, because a single '
    'mis-read character invents one: Tesseract returns "$55" for a printed "S55" and "£50.00" for a printed "850.00". Refusing on that evidence would discard an '
    "invoice the tool read correctly and tell you, as fact, that it states non-rupee amounts. {outcome} A currency named in words, an exchange rate, or an ISO code "
    "beside an amount still refuses the document outright, on a scan as on a text layer."
)
GLYPH_REFUSED = (
    "This document was refused for another reason, so nothing on it was parsed into amounts at all and there are no figures below for this to cast doubt on."
)
GLYPH_PARSED = (
    "So every amount below was parsed as rupees. If this invoice really does quote a foreign currency, those figures are wrong -- check the quoted text on the page."
)


def _hits(text: Column, page: Column, ocr: Column) -> Column:
    """array<struct<rank, kind, evidence, message>> of one page."""
    export, money = detect_export(text), detect_currency(F.when(ocr, F.translate(text, GLYPHS, " " * len(GLYPHS))).otherwise(text))
    why = F.concat_ws(" and ", *[F.when(export["likely"].contains(k), w) for k, w in WHY.items()])
    of = lambda i, phrase, message: F.when(phrase.isNotNull(), F.struct(F.lit(i).alias("rank"), F.lit(KINDS[i]).alias("kind"), said(EVIDENCE, phrase=phrase, page=page).alias("evidence"), message.alias("message")))
    return F.array_compact(F.array(of(0, export["phrase"], said(EXPORT, phrase=export["phrase"], page=page, values=export["likely"], why=why)), of(1, money, said(CURRENCY, phrase=money, page=page))))


def read(pages: DataFrame) -> DataFrame:
    """(doc, pages, refusals, ingest_warnings, reverse_charge), one row a document.

    refusals: array of struct(kind, field, evidence, message), those of native pages
    (export, then currency) before those of OCR pages by page.
    """
    text, page, ocr = F.coalesce("text", F.lit("")), F.col("page"), F.col("method") != "native"
    blank = ocr & (strip(text) == "")
    token = squeeze(F.regexp_extract(text, rf"\S*[{GLYPHS}]\S*", 0))
    one = pages.select(
        "doc", "page", "method", ocr.alias("ocr"), F.when(~blank, _hits(text, page, ocr)).alias("hits"), blank.alias("blank"), F.when(ocr & ~blank & (token != ""), token).alias("glyph"),
        reverse_charge(text).alias("rc"),
    )
    rows = one.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "method", "ocr", "hits", "blank", "glyph"))).alias("p"), F.bool_or("rc").alias("reverse_charge"))
    # native pages by kind, then OCR pages by page; the first of each kind counts
    all_ = F.flatten(F.transform("p", lambda x: F.transform(F.coalesce(x["hits"], F.array().cast("array<struct<rank:int,kind:string,evidence:string,message:string>>")), lambda h: F.struct(x["ocr"].alias("ocr"), F.when(x["ocr"], x["page"]).otherwise(0).alias("at"), h["rank"].alias("rank"), x["page"].alias("page"), h["kind"].alias("kind"), h["evidence"].alias("evidence"), h["message"].alias("message")))))
    rows = rows.withColumn("_all", F.array_sort(all_))
    first = F.filter("_all", lambda h, i: F.array_position(F.transform("_all", lambda y: y["kind"]), h["kind"]) == i + 1)
    rows = rows.withColumn("_first", first)
    refusals = F.transform("_first", lambda h: F.struct(h["kind"].alias("kind"), F.when(h["kind"] == KINDS[0], FIELDS[KINDS[0]]).otherwise(FIELDS[KINDS[1]]).alias("field"), h["evidence"].alias("evidence"), h["message"].alias("message")))
    told = F.transform("_first", lambda h: warning(F.when(h["kind"] == KINDS[0], FIELDS[KINDS[0]]).otherwise(FIELDS[KINDS[1]]), F.concat(F.when(h["ocr"], FROM_OCR).otherwise(""), h["message"], F.lit(" Evidence: "), h["evidence"], F.lit(".")), CHECK))
    blanks = F.transform(F.filter("p", lambda x: x["blank"]), lambda x: warning(F.concat(F.lit("page["), x["page"], F.lit("]")), said(BLANK, page=x["page"]), CHECK))
    outcome = F.when(F.size("_first") > 0, GLYPH_REFUSED).otherwise(GLYPH_PARSED)
    glyphs = F.transform(F.filter("p", lambda x: x["glyph"].isNotNull()), lambda x: warning("ValDtls.TotInvValFc", said(GLYPH, page=x["page"], token=x["glyph"], outcome=outcome), CHECK))
    metas = F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["method"].alias("method")))
    return rows.select("doc", metas.alias("pages"), refusals.alias("refusals"), F.concat(told, blanks, glyphs).alias("ingest_warnings"), "reverse_charge")
