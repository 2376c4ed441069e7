"""Rule extraction within the row: no shuffle, and patterns that ask for a first character match as those that do not."""

from __future__ import annotations

import re

import pytest
from gristmill.functions import spans as S
from gristmill.operators import claims, docno, invoice_dates, rules
from pyspark.sql import functions as F

LABELS = ["Tax Invoice No. 1", "tax\ninvoice no", "Invoice\nNo 5", "Invoice number# 4 Bill No", "INVOICE #\nbill number Inv No", "Inv\r\nNo, invoices no, Invoice No_1", "Taxinvoice no éinvoice no", "invoice  \t\r\n  no", "", None]


def shuffled(df) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return bool(re.search(r"^\W*(?:Join|Aggregate|Window)", plan, re.M))


def test_invoice_numbers_stay_within_the_row(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LABELS)], "doc long, text string")
    assert not shuffled(docno.warnings(docno.doc_no(docs)))
    assert [r.outcome for r in docno.doc_no(docs).orderBy("doc").collect()] == ["taken", "no_value", "no_label", "taken", "refused"] + ["no_label"] * 5


def test_the_line_below_counts_where_nothing_settles_it(spark):
    rows = [(1, "Invoice No.   Date\nINV-7   25/04/2026"), (2, "Invoice No. 11/7\nINV-8"), (3, "Invoice No. e-Way\n    25/04/2026"), (4, "Invoice No\n1,200.00"), (5, "Invoice No 27AAPFU0939F1ZV\nabc")]
    got = {r.doc: (r.value, r.method, r.beside_refused and r.beside_refused.reason, r.below_refused and r.below_refused.reason) for r in docno.doc_no(spark.createDataFrame(rows, "doc long, text string")).collect()}
    assert got == {1: ("INV-7", "column", "heading", None), 2: ("11/7", "regex", None, None), 3: ("e-Way", "regex", None, "date"), 4: (None, None, None, "number"), 5: (None, None, "gstin", "no_digit")}


@pytest.mark.parametrize("space", [r"[ \t]", r"[ \t\r\n]"])
def test_labels_as_by_plain_alternatives(spark, space):
    plain = rf"(?i)\btax{space}+invoice{space}+no\b|\binvoice{space}+number\b|\binvoice{space}+no\b|\binvoice{space}*#|\bbill{space}+number\b|\bbill{space}+no\b|\binv{space}+no\b"
    docs = spark.createDataFrame([(t,) for t in LABELS], "t string")
    short = rules.DOC_NO if space == r"[ \t]" else rules.DOC_NO_WRAPPED
    rows = docs.select(S.found(F.col("t"), plain).alias("a"), S.found(F.col("t"), short).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(len(r.a) for r in rows) >= 6


def test_broken_labels_by_their_gate(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LABELS)], "doc long, text string")
    inside = lambda a, b: any(a.start <= x.start and x.end <= a.end for x in b)
    every = docs.select("doc", S.found(F.col("text"), rules.DOC_NO).alias("one"), S.found(F.col("text"), rules.DOC_NO_WRAPPED).alias("any")).collect()
    want = {(r.doc, m.start, m.token) for r in every for m in r.any if not inside(m, r.one)}
    assert {(r.doc, r.start, r.token) for r in rules.wrapped_labels(docs).collect()} == want and len(want) == 3


def test_extraction_stays_within_the_row(spark):
    rows = [(1, "Invoice No INV-7\nDated 25/04/2026\nHSN: 9983, 5208 2026\nGSTIN 27AAPFU0939F1ZV"), (2, None), (3, "HSN\n998314")]
    got = claims.extract(spark.createDataFrame(rows, "doc long, text string"))
    assert not shuffled(got)
    found = {r.doc: (r.doc_no and r.doc_no.value, r.date and r.date.value, [h.value for h in r.hsn], [tuple(c) for c in r.consumed]) for r in got.collect()}
    assert found == {1: ("INV-7", "25/04/2026", ["9983", "5208"], [(11, 16), (23, 33), (34, 37), (39, 43), (45, 49), (61, 76)]), 2: (None, None, [], []), 3: (None, None, ["998314"], [(0, 3), (4, 10)])}


def test_date_labels_of_all_tiers_in_one_pass(spark):
    tiers = rules.DATE_TIERS
    given = ["Invoice Date invoice  dt: dated Date DT, update dated_ date", "invoicedate Invoice\nDate", "", None]
    t = F.coalesce(F.col("t"), F.lit(""))
    tier = lambda k, p: F.transform(S.found(t, p), lambda x: F.struct(F.lit(k).alias("tier"), x["token"].alias("token"), x["start"].alias("start"), x["end"].alias("end")))
    every = [tier(k, p) for k, p in enumerate(tiers)]
    rows = spark.createDataFrame([(g,) for g in given], "t string").select(F.concat(*every).alias("a"), invoice_dates.labels(t).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and [len(r.a) for r in rows] == [8, 1, 0, 0]


def test_spans_merged_in_the_row(spark):
    given = [[(3, 5), (5, 6), (-4, 1), (8, 8), (9, 7), (0, 2), (20, 30), (21, 22)], [], [(1, 2), (1, 2)]]
    d = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "doc int, s array<struct<start:int,end:int>>")
    assert [[tuple(x) for x in r.m] for r in d.select("doc", S.merged(F.col("s")).alias("m")).orderBy("doc").collect()] == [[(0, 2), (3, 6), (20, 30)], [], [(1, 2)]]
