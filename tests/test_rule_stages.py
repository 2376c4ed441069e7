"""Rule extraction in stages, dates with their doubts and parties, on literal rows."""

from __future__ import annotations

from gristmill.functions import spans as S
from gristmill.functions.text import said
from gristmill.operators import claims, invoice_dates, parties
from pyspark.sql import functions as F

SELLER, BUYER = "29KLMNP4321Q1Z6", "27RSTUV8765W1ZY"


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc long, text string")


def test_offsets_are_code_points_and_rows_stand_alone(spark):
    docs = spark.createDataFrame([(1, "😀 9 8"), (1, "aaaa 9 8"), (1, ""), (1, None), (1, "7")], "doc long, text string")
    got = docs.select("text", F.transform(S.found(F.col("text"), "[0-9]"), lambda x: F.concat_ws(":", x.token, x.start, x.end)).alias("m")).collect()
    assert {r.text: list(r.m) for r in got} == {"😀 9 8": ["9:2:3", "8:4:5"], "aaaa 9 8": ["9:5:6", "8:7:8"], "": [], None: [], "7": ["7:0:1"]}
    got = docs.select("text", F.transform(S.lines(F.concat("text", F.lit("\n\nx"))), lambda x: F.concat_ws(":", x.token, x.start, x.end)).alias("m")).collect()
    assert {r.text: list(r.m or []) for r in got}["7"] == ["7:0:1", ":2:2", "x:3:4"]


def test_blanked(spark):
    spans = F.expr("array(named_struct('start', 3, 'end', 5), named_struct('start', -2, 'end', 1), named_struct('start', 4, 'end', 6), named_struct('start', 8, 'end', 99), named_struct('start', 7, 'end', 7))")
    assert one(spark, "0123456789").select(S.blanked(F.col("text"), spans)).first()[0] == " 12   67  "
    assert said("{a} of {b}", a=F.lit(1), b=F.lit("x")) is not None


def dated(docs):
    rows = invoice_dates.doc_date(docs, "c" if "c" in docs.columns else None).collect()
    return {r.doc: (r.date and (r.date.printed, r.date.value, r.date.tier, r.date.consumed), [w.message for w in r.date_warnings]) for r in rows}


DATES = [
    (None, None, ["No date was found"]),
    ("", None, ["No date was found"]),
    ("Invoice Date: 25/04/2026", ("25/04/2026", "25/04/2026", 0, True), []),
    ("Invoice Date: 04/05/26", ("04/05/26", "04/05/2026", 0, True), ["either 4 May 2026 (day-first) or 5 April 2026 (month-first)"]),
    ("Invoice Date: 04/05/26 Due 25/05/2026", ("04/05/26", "04/05/2026", 0, True), []),
    ("Invoice Date: 04/05/26 Due 05/25/2026", ("04/05/26", "04/05/2026", 0, True), ["may be MM/DD and mean 5 April 2026"]),
    ("Date 31-Feb-2026", ("31-Feb-2026", "31/02/2026", 2, True), ["(February 2026 has no day 31)"]),
    ("Date 45/04/2026", ("45/04/2026", "45/04/2026", 2, True), ["has 45 as its first component"]),
    ("Date 04/25/2026", ("04/25/2026", "04/25/2026", 2, True), ["has 25 as its second component"]),
    ("Invoice Date:        Due Date: 30/05/2026", ("30/05/2026", "30/05/2026", 2, True), ["('Invoice Date' at character 0) with no date of its own after it (an empty invoice-date cell, or its value printed too far from the label to belong to it), so the invoice date '30/05/2026' was read as 30/05/2026 from the 'Due Date' label instead"]),
    ("Challan dated 20 Mar 2026\nShipped 22 Mar 2026 due date 23 Mar 2026", ("20 Mar 2026", "20/03/2026", 1, True), ["from the 'Challan dated' label; the document carries no 'Invoice Date' label and also carries an unlabelled 22/03/2026, 'due date' -> 23/03/2026."]),
    ("Goods\n1 May 2026 hosting 1 5,000.00", ("1 May 2026", "01/05/2026", None, False), ["begins a line that reads as an item row"]),
    ("1 May 2026 hosting 3 Hrs", ("1 May 2026", "01/05/2026", None, False), ["begins a line that reads as an item row"]),
    ("03 Jun 2026    Invoice No. 42   Total 11,800.00", ("03 Jun 2026", "03/06/2026", None, True), []),
    ("Serial AB/24-01-25 of 7 Jul 2026", ("7 Jul 2026", "07/07/2026", None, True), []),
    ("3 June 26 Nos\nsent 4 June 2026", ("4 June 2026", "04/06/2026", None, True), []),
]


def test_dates_in_doubt(spark):
    got = dated(spark.createDataFrame([(i, r[0]) for i, r in enumerate(DATES)], "doc long, text string"))
    for i, (text, date, parts) in enumerate(DATES):
        assert got[i][0] == date, text
        assert len(got[i][1]) == len(parts), (text, got[i][1])
        assert all(p in m for p, m in zip(parts, got[i][1], strict=True)), text


def test_a_claimed_span_holds_no_date(spark):
    docs = spark.createDataFrame([(1, []), (2, [(3, 11)])], "doc long, c array<struct<start:int,end:int>>").withColumn("text", F.lit("No 24-01-25 sent 7 Jul 2026"))
    got = dated(docs)
    assert (got[1][0][0], got[2][0][0]) == ("24-01-25", "7 Jul 2026")


PARTIES = [
    (f"Sold By: A\nGSTIN: {SELLER}\nBill To: B\nGSTIN {BUYER}", (SELLER, "label"), (BUYER, "label"), [], []),
    (f"{SELLER} and {BUYER}", (SELLER, "position"), (BUYER, "position"), ["SellerDtls.Gstin"], [f"GSTIN {SELLER} was assigned to the seller and GSTIN {BUYER} to the buyer from position"]),
    (f"Buyer {SELLER} {SELLER}", (SELLER, "position"), None, ["SellerDtls.Gstin", "BuyerDtls.Gstin"], [f"Note that the document labels GSTIN {SELLER} as the buyer", "Only one checksum-valid GSTIN"]),
    (f"{SELLER[:-1]}T", None, None, ["SellerDtls.Gstin", "BuyerDtls.Gstin"] * 2, ["at character 0 failed validation (checksum mismatch: computed check character '6' but position 15 is 'T')"] * 2 + ["so the seller GSTIN", "so the buyer GSTIN"]),
    (None, None, None, ["SellerDtls.Gstin", "BuyerDtls.Gstin"], ["so the seller GSTIN", "so the buyer GSTIN"]),
]


def test_parties(spark):
    rows = {r.doc: r for r in parties.resolve(spark.createDataFrame([(i, r[0]) for i, r in enumerate(PARTIES)], "doc long, text string")).collect()}
    for i, (text, seller, buyer, fields, parts) in enumerate(PARTIES):
        r = rows[i]
        assert (r.seller and (r.seller.value, r.seller.method), r.buyer and (r.buyer.value, r.buyer.method)) == (seller, buyer), text
        assert [w.field for w in r.party_warnings] == fields, text
        assert all(p in w.message for p, w in zip(parts, r.party_warnings, strict=True)), text


STAGES = [
    # the number takes a date shape, which then is no date
    (f"Invoice No: INV/24-01-25/7\nDate: 03 Jun 2026\nGSTIN {SELLER} {BUYER}\nHSN 998313", "INV/24-01-25/7", None, ["998313"]),
    ("Invoice No: 2026/0417\nInvoice Date 17-Apr-2026 HSN 5208", "2026/0417", "17/04/2026", ["5208"]),
    # four digits of the number are no HSN code
    ("Tax Invoice No 5208 HSN 5208\nHSN 5209 dated 5 May 2026", "5208", "05/05/2026", ["5208", "5209"]),
    ("Invoice No 4711  HSN: 4711-24, 4711", "4711", None, ["4711"]),
    ("Goods\n1 May 2026 hosting 1 5,000.00 SAC 998315", None, "01/05/2026", ["998315"]),
    ("", None, None, []),
    (None, None, None, []),
]


def test_stages(spark):
    docs = spark.createDataFrame([(i, s[0]) for i, s in enumerate(STAGES)], "doc long, text string")
    got = {r.doc: r for r in claims.extract(docs).collect()}
    assert len(got) == len(STAGES)
    assert got[0].doc_no is None  # a real date within the token refuses it
    assert "is one component of the date '24-01-25'" in next(w.message for w in got[0].warnings if w.field == "DocDtls.No")
    for i, (text, no, date, hsn) in enumerate(STAGES):
        r = got[i]
        if i:
            assert (r.doc_no and r.doc_no.value, r.date and r.date.value) == (no, date), text
        assert [x.value for x in r.hsn] == hsn, text
        for f in filter(None, (r.seller, r.buyer, r.doc_no, *r.hsn)):
            assert text[f.start : f.end] == f.value
        kept = "".join(c for k, c in enumerate(text or "") if not any(s.start <= k < s.end for s in r.consumed))
        assert not any(x.value in kept for x in filter(None, (r.seller, r.buyer)))
        assert all(a.end < b.start for a, b in zip(r.consumed, r.consumed[1:], strict=False))
    assert "1 May 2026 hosting" in STAGES[4][0] and all(s.start > 10 for s in got[4].consumed)
