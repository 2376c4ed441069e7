"""Invoices end to end: payload, provenance, warnings in order, refusals, a second attempt, and OCR confidences."""

from __future__ import annotations

import json

import pytest
from gristmill.operators import confidence, pages, refusals
from gristmill.plans import parse, stage_queries
from pyspark.sql import functions as F

from tests import compare

SELLER, BUYER = "29KLMNP4321Q1Z6", "27RSTUV8765W1ZY"
TEXT = f"""TAX INVOICE
Sold By: Lotus Mills
14 Tank Bund Road, Bengaluru 560009
GSTIN: {SELLER}
Bill To: Harbour Traders
7 Dock Street, Mumbai 400001
GSTIN: {BUYER}
Tax Invoice No. LM/0042
Invoice Date: 17-Apr-2026
Sl Item HSN Qty Rate Value
1 Cotton yarn HSN 5205 10 Kgs 120.00 1,200.00
IGST 5% 60.00
Total 1,260.00
"""
ITEM = {"SlNo": 1, "PrdDesc": "cotton YARN", "HsnCd": "5205", "Qty": 10, "Unit": "kgs", "UnitPrice": 120.0, "TotAmt": None, "AssAmt": 1200, "GstRt": 5, "CgstAmt": None, "SgstAmt": None, "IgstAmt": 60, "TotItemVal": None}
ANSWER = {
    "items": [ITEM],
    "seller": {"LglNm": "Lotus Mills", "Addr1": "14 Tank Bund Road", "Loc": "Bengaluru", "Pin": "560009"},
    "buyer": {"LglNm": "Harbour Traders", "Addr1": "7 Dock Street", "Loc": "Mumbai", "Pin": 400001},
    "totals": {"AssVal": None, "IgstVal": 60.0, "TotInvVal": 1260},
}


def changed(**kw):
    return json.dumps(ANSWER | kw)


def word_rows(doc, page, text, low="Harbour"):
    out, at = [], 0
    for w in text.split(" "):
        for part in w.split("\n"):
            if part:
                out.append((doc, page, at, at + len(part), 0.4 if part == low else 0.9))
            at += len(part) + 1
    return out


@pytest.fixture(scope="module")
def results(spark):
    p = [
        (1, 1, "native", TEXT), (2, 1, "native", TEXT), (3, 1, "native", TEXT + "Supply meant for export under LUT"), (4, 1, "ocr_required", TEXT), (4, 2, "ocr_required", " \n"), (5, 1, "native", TEXT),
        (6, 1, "native", TEXT), (6, 2, "ocr_required", "Exchange rate 83.2 $55"), (7, 1, "native", TEXT + "Whether tax is payable under reverse charge: Yes"), (8, 1, "native", None),
    ]
    a = [
        (1, 1, changed()), (2, 1, changed(items=[])), (2, 2, changed()), (4, 1, changed()), (5, 1, "no json"), (5, 2, changed(buyer=ANSWER["buyer"] | {"Pin": "Mumbai"})), (7, 1, changed()), (8, 1, changed()),
        (3, 1, changed()), (6, 1, changed()),
    ]
    pages_ = spark.createDataFrame(p, "doc long, page int, method string, text string")
    answers = spark.createDataFrame(a, "doc long, attempt int, content string")
    words = spark.createDataFrame(word_rows(4, 1, TEXT), "doc long, page int, start int, end int, confidence double")
    out = parse.parse_invoices(pages_, answers, words)
    found = {r.doc: r for r in out.collect()}
    found["json"] = {r.doc: json.loads(r.json) for r in parse.result_json(out).filter("doc in (1, 3)").collect()}
    return found


def test_payload(results):
    i = results[1].invoice
    assert (i.Version, i.TranDtls.SupTyp, i.TranDtls.RegRev, i.DocDtls.No, i.DocDtls.Dt) == ("1.1", "B2B", None, "LM/0042", "17/04/2026")
    assert (i.SellerDtls.Gstin, i.SellerDtls.Stcd, i.SellerDtls.Pin, i.BuyerDtls.Pin, i.BuyerDtls.Pos) == (SELLER, "29", 560009, 400001, "27")
    (item,) = i.ItemList
    # the document's spelling, and what follows from what was read
    assert (item.PrdDesc, item.Unit, item.TotAmt, item.CgstAmt, item.SgstAmt, item.TotItemVal, item.Discount, item.IsServc) == ("Cotton yarn", "Kgs", 1200.0, 0.0, 0.0, 1260.0, 0.0, "N")
    assert (i.ValDtls.AssVal, i.ValDtls.CgstVal, i.ValDtls.IgstVal, i.ValDtls.TotInvVal, i.ValDtls.RndOffAmt) == (1200.0, 0.0, 60.0, 1260.0, 0.0)
    assert results[1].attempts == 1 and results[1].missing_fields == []


def leaf_paths(x, at=""):
    if isinstance(x, dict):
        return [p for k, v in x.items() for p in leaf_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(x, list):
        return [p for k, v in enumerate(x) for p in leaf_paths(v, f"{at}[{k}]")]
    return [at]


def test_every_leaf_has_a_source(results):
    payload = results["json"][1]["invoice"]
    sources = {k: v.source for k, v in results[1].field_provenance.items()}
    assert set(leaf_paths(payload)) == set(sources)
    assert {sources[p] for p in ("SellerDtls.Gstin", "DocDtls.No", "DocDtls.Dt")} == {"regex"}
    assert {sources[p] for p in ("SellerDtls.Stcd", "ItemList[0].TotAmt", "ItemList[0].CgstAmt", "ItemList[0].TotItemVal", "ItemList[0].IsServc", "ValDtls.AssVal", "ValDtls.SgstVal")} == {"derived"}
    assert {sources[p] for p in ("SellerDtls.LglNm", "ItemList[0].Qty", "ValDtls.TotInvVal")} == {"llm"}
    assert {sources[p] for p in ("Version", "TranDtls.TaxSch", "BuyerDtls.Pos", "ItemList[0].Discount", "ValDtls.CesVal")} == {"assumed"}


def test_warnings_in_order(results):
    w = results[1].warnings
    checks = [x.check for x in w]
    order = ["ingest", "extract_rules", "extract_llm", "pipeline", "validate_item_total"]
    assert [order.index(c) for c in checks] == sorted(order.index(c) for c in checks)
    llm = [x.field for x in w if x.check == "extract_llm"]
    assert llm == ["ItemList[0].SlNo", "ItemList[0].Discount", "ItemList[0].CesAmt", "ItemList[0].HsnCd", "ValDtls.CesVal", "ValDtls.RndOffAmt"]
    notes = [x.field for x in w if x.check == "pipeline"]
    assert notes == ["ItemList[0].TotAmt", "ItemList[0].CgstAmt", "ItemList[0].SgstAmt", "ItemList[0].TotItemVal", "ValDtls.CgstVal", "ValDtls.SgstVal", "ValDtls.AssVal", "BuyerDtls.Pos"]
    assert "It was set to 1200.00 from the INV-01 identity TotAmt = AssAmt + Discount, using the taxable value 1200.00 and the discount 0.00" in next(x.message for x in w if x.field == "ItemList[0].TotAmt")
    assert not [x for x in w if x.severity == "warning" and x.check.startswith("validate")]


def test_second_attempt(results):
    r = results[2]
    assert r.invoice.ItemList[0].PrdDesc == "Cotton yarn" and r.attempts == 2
    assert r.warnings[-1].field == "attempts" and "(missing: ItemList, ValDtls.AssVal)" in r.warnings[-1].message and "second attempt, taken whole" in r.warnings[-1].message
    r = results[5]
    assert r.invoice is None and r.attempts == 2 and r.missing_fields == ["BuyerDtls.Pin"]
    assert "BuyerDtls.Pin" not in r.field_provenance and any("must be a number, but the text read at that field was 'Mumbai'" in x.message for x in r.warnings)
    assert "(missing: SellerDtls.LglNm, SellerDtls.Addr1" in r.warnings[-1].message and "also produced no payload" in r.warnings[-1].message
    assert not [x for x in r.warnings if x.check.startswith("validate")]


def test_refusals(results):
    r = results[3]
    assert [(x.kind, x.field, x.evidence) for x in r.refusals] == [("export_sez", "TranDtls.SupTyp", '"Supply meant for export" (page 1)')]
    assert r.invoice is None and r.missing_fields == [] and r.field_provenance == {} and r.attempts == 1
    assert "most likely EXPWOP" in r.warnings[0].message and r.warnings[0].message.endswith('Evidence: "Supply meant for export" (page 1).')
    assert results["json"][3]["refusals"][0]["kind"] == "export_sez" and "invoice" not in results["json"][3]
    r = results[6]
    assert [x.kind for x in r.refusals] == ["multi_currency"]
    assert r.warnings[0].message.startswith(refusals.FROM_OCR) and 'on page 2: "$55"' in r.warnings[1].message and "refused for another reason" in r.warnings[1].message


def test_ocr(results):
    r = results[4]
    assert r.invoice is not None and [w.field for w in r.warnings][0] == "page[2]"
    p = r.field_provenance
    assert p["BuyerDtls.LglNm"].ocr_confidence == 0.4 and p["SellerDtls.LglNm"].ocr_confidence == 0.9 and p["DocDtls.No"].ocr_confidence == 0.9
    assert p["ItemList[0].TotAmt"].ocr_confidence is None and results[1].field_provenance["SellerDtls.LglNm"].ocr_confidence is None
    assert results[7].invoice.TranDtls.RegRev == "Y" and results[8].invoice is None and len(results[8].missing_fields) > 10


def test_printed_at(spark):
    rows = [("3 x 3/3 A3 3", "3", [0, 4, 6, 11]), ("aaa aa", "aa", [4]), ("(250.00)(250.00)", "(250.00)", [0, 8]), ("..,..", "..", [0, 3]), ("...", "..", [0, 1]), ("😀 x.y", "x.y", [2]), ("xXy", "X", []), ("", "a", []), ("abc", "", []), ("a_b a", "a", [4]), ("a\nb a b", "a\nb", [0])]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, t string, v string")
    for r in df.select("i", confidence.printed_at(F.col("t"), F.col("v")).alias("at")).collect():
        assert r.at == rows[r.i][2], rows[r.i]


def test_confidence_of_offsets(spark):
    pages_ = spark.createDataFrame([(1, 1, "ocr_required", "ab cd"), (1, 2, "native", "ef"), (1, 3, "ocr_required", "gh"), (2, 1, "ocr_required", None)], "doc long, page int, method string, text string")
    words = spark.createDataFrame([(1, 1, 0, 2, 0.9), (1, 1, 3, 5, 0.5), (1, 3, 0, 2, 0.7)], "doc long, page int, start int, end int, confidence double")
    spans = [(1, 0, 2, 0.9), (1, 1, 4, 0.5), (1, 3, 11, 0.5), (1, 5, 7, None), (1, 6, 8, None), (1, 9, 10, 0.7), (1, 40, 50, None), (1, 1, 1, None), (2, 0, 1, None)]
    got = confidence.of_offsets(spark.createDataFrame([s[:3] for s in spans], "doc long, start int, end int"), confidence.paged(pages_, words)).collect()
    assert sorted(((r.doc, r.start, r.end), r.confidence) for r in got) == sorted(((s[0], s[1], s[2]), s[3]) for s in spans)


def test_reverse_charge(spark):
    rows = [
        ("Reverse Charge:" + "\n" * 210 + "Yes", True), ("Reverse charge: No", False), ("Reverse Charge (Yes/No): Y", True), ("Reverse Charge Yes / No : No", False), ("This supply attracts reverse charge on freight", True), ("Reverse Charge Applicable\nPlace", False),
        ("Tax payable on reverse charge: Applicable", True), ("Whether tax is payable on reverse charge", False), ("No. 4 supply attracts reverse charge here", True), ("This is not subject to reverse charge today", False), ("Reverse charge", False), ("RCM: n/a", False),
        ("Tax is payable under reverse charge   5,000", False), ("tax payable under reverse charge - 0.00", False), (None, False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    for r in df.select("i", pages.reverse_charge(F.col("t")).alias("g")).collect():
        assert r.g == rows[r.i][1], rows[r.i]


def test_printed_invoices_match_sql(spark, sf):
    """Every invoice of the star schema, printed, read back by an answer with gaps, and assembled."""
    n, mine, theirs = compare.difference(stage_queries.parse_invoice(spark, sf), compare.tables(sf), stage_queries.PARSE_SQL)
    assert n > 1000 and not mine and not theirs
