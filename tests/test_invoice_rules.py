"""Invoice rules on small literal rows."""

from __future__ import annotations

import pytest
from gristmill.operators import derive, docno, rules


@pytest.mark.parametrize(
    "text, want",
    [
        ("Invoice QRM/23-24/0518 dated 03/06/2026", ["03/06/2026"]),
        ("1. 3 June 26 Nos\nDate: 3 June 26", ["3 June 26"]),
        ("3 June 26 pcs 4 June 2026 Nos", ["4 June 2026"]),
        ("(01-04-26) 2.4.2026", ["01-04-26", "2.4.2026"]),
        ("5 May 26 nosegay", ["5 May 26"]),
        ("", []),
    ],
)
def test_dates(spark, text, want):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc long, text string")
    assert [r.token for r in sorted(rules.date_candidates(docs).collect(), key=lambda r: r.start)] == want


HSN_ROWS = [
    ("4  Freight inward  HSN 996511  1 Nos", ["996511"]),
    ("HSN/SAC Code\n996511\n", ["996511"]),
    ("HSN/SAC Code\n" + "_" * 50 + "\n996511\n", []),
    ("Row  HSN 63053  Qty 8", []),
    ("2   Jute sack   HSN 63053200   25 Pcs   40   1000", ["63053200"]),
    ("No Goods HSN Qty Rate Amount\n1 Sacks 6305 25 40 1000", []),
    ("SAC 996511 2 750 1500", ["996511"]),
    ("Amount 4500 HSN 996511\n", ["996511"]),
    ("Total 4500 HSN totals\n", []),
    ("HSN totals   Amount 7500\n", []),
    ("HSN/SAC : 996511 / 63053200", ["996511", "63053200"]),
    ("HSN/SAC Code : 63053200, 996511, 7310", ["63053200", "996511", "7310"]),
    ("Carriage charged under 996511 (SAC)", ["996511"]),
    ("63053200 - HSN of jute sacks", ["63053200"]),
    ("HSN of jute sacks: 63053200", ["63053200"]),
    ("Invoice Date 9 Nov 2025  HSN 996511", ["996511"]),
    ("HSN 2024-25/0107", []),
    ("HSN 32,750.00 or 4500.00", []),
    ("5 Canal View, Nagpur 440010    HSN/SAC   Qty   Rate\n", []),
    ("HSN Code\nNagpur 440010", []),
    ("HSN Code\n\n996511", []),
    ("No Goods Qty Rate HSN/SAC\n2002 Jute sack 25 40 63053200", []),
    ("Sacks 63053200 HSN 25 Pcs\n", []),
    ("1 Sack HSN 63053200\n2 Drum HSN 7310\n3 Sack HSN 63053200", ["63053200", "7310"]),
    ("b" * 100_000 + " HSN 996511", ["996511"]),
    ("", []),
    (None, []),
]


def test_hsn_codes(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HSN_ROWS)], "doc long, text string")
    got: dict[int, list[str]] = {}
    for r in sorted(rules.hsn_codes(docs).collect(), key=lambda r: r.start):
        got.setdefault(r.doc, []).append(r.code)
    assert {i: got.get(i, []) for i in range(len(HSN_ROWS))} == {i: w for i, (_, w) in enumerate(HSN_ROWS)}
    claimed = spark.createDataFrame([(0, 20, 26)], "doc long, start long, end long")
    assert rules.hsn_codes(docs.filter("doc = 0"), claimed).count() == 0


def test_order_of_dates(spark):
    rows = [("Date: 03/04/2026", "ambiguous"), ("Date: 04/04/2026", None), ("Date: 13/04/2026", None), ("Date: 04/13/2026", "no_month"), ("Date: 31/04/2026", "impossible"), ("Date: 3-Apr-2026", None), ("Date: 03/04/2026 Due 15/04/2026", None), ("Date: 03/04/2026 Due 04/15/2026", "maybe_month_first"), ("Date: 03/04/2026 Due 5-May-2026", "ambiguous"), ("Date: 32/04/2026", "no_day"), ("Date: 31-Feb-2026", "impossible")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc long, text string")
    found = rules.date_candidates(docs)
    assert {r.doc: r.note for r in rules.date_order(found, rules.labelled_dates(docs, found)).collect()} == {i: w for i, (_, w) in enumerate(rows)}


def test_total_of_an_only_item_is_its_own_sum(spark):
    item = "doc long, idx int, AssAmt double, CgstAmt double, SgstAmt double, IgstAmt double, CesAmt double, TotItemVal double"
    rows = [(1, 0, 100.0, 9.0, 9.0, 0.0, None, None), (2, 0, 100.0, 9.0, 9.0, 0.0, None, None), (3, 0, 1.0, 0.0, 0.0, 0.0, None, 7.0), (4, 0, 1.0, 0.0, 0.0, 0.0, None, None), (4, 1, 1.0, 0.0, 0.0, 0.0, None, None), (5, 0, 1.0, None, 0.0, 0.0, None, None)]
    heads = spark.createDataFrame([(1, 118.03), (2, 118.2), (3, 1.0), (4, 2.0), (5, 1.0)], "doc long, TotInvVal double")
    got = {(r.doc, r.idx): r.TotItemVal for r in derive.single_item_total(spark.createDataFrame(rows, item), heads).collect()}
    assert got == {(1, 0): 118.0, (2, 0): None, (3, 0): 7.0, (4, 0): None, (4, 1): None, (5, 0): None}


# text, outcome, value, method, reasons beside and below, notes
DOC_NO_ROWS = [
    ("Invoice No.      Dated\nQR-0518         09/11/2025\n", "taken", "QR-0518", "column", "heading", None, ["column"]),
    ("Date Invoice No.\n09/11/2025 QR-0518\n", "taken", "QR-0518", "column", None, None, ["column"]),
    ("Invoice No   Date   Amount\n0518   09/11/2025   32750.00\n", "taken", "0518", "column", "heading", None, ["column"]),
    ("Invoice No.   Place of Supply\nKerala\nBill No: 6123\n", "taken", "6123", "regex", None, None, []),
    ("Invoice No: QR-9\n4410 other\n", "taken", "QR-9", "regex", None, None, []),
    ("Invoice No.   Invoice Date\n 30 Nov 2025\n", "refused", None, None, "heading", "date_part", []),
    ("Invoice No. 09/11/2025\n", "refused", None, None, "date", None, []),
    ("Invoice No. 27RSTUV8765W1ZY\n", "refused", None, None, "gstin", None, []),
    ("Invoice No. 32,750.00\n", "refused", None, None, "number", None, []),
    ("Invoice No: INV/24-01-25\n", "refused", None, None, "date_part", None, []),
    ("Invoice No: 6 Nos\n", "refused", None, None, "quantity", None, []),
    ("Invoice No: QRS 0518\n", "refused", None, None, "truncated", None, []),
    ("Invoice No: QRML-DOM\n", "taken", "QRML-DOM", "regex", None, None, ["no_digit"]),
    ("Invoice No.   e-Way Bill No.\n6 Nos\n", "taken", "e-Way", "regex", None, "quantity", ["no_digit"]),
    ("Against your Bill No. 6123 dated 02-Nov-2025\nInvoice No. QR-0518\n", "taken", "6123", "regex", None, None, ["competing"]),
    ("Invoice No. QR-9\ne-Way Bill No. 31\nInvoice No. QR-9\n", "taken", "QR-9", "regex", None, None, []),
    ("Invoice Number: QRS-" + "4" * 35 + "\n", "taken", "QRS-" + "4" * 26, "regex", None, None, ["cut"]),
    ("Tax Invoice\nInvoice No:\n\n\nKaveri Looms and Sons\n", "no_value", None, None, None, None, []),
    ("Invoice\nNo: 17\n", "no_label", None, None, None, None, ["wrapped"]),
    ("", "no_label", None, None, None, None, []),
    (None, "no_label", None, None, None, None, []),
]


def test_doc_no(spark):
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(DOC_NO_ROWS)], "doc long, text string")
    reason = lambda x: x and x.reason
    rows = {r.doc: r for r in docno.doc_no(docs).collect()}
    got = {i: (r.outcome, r.value, r.method, reason(r.beside_refused), reason(r.below_refused), r.notes) for i, r in rows.items()}
    assert got == {i: w[1:] for i, w in enumerate(DOC_NO_ROWS)}
    for i, r in rows.items():
        assert r.value is None or DOC_NO_ROWS[i][0][r.start : r.end] == r.value
    assert [(c.label, c.value) for c in rows[14].competing] == [("Invoice No", "QR-0518")]
