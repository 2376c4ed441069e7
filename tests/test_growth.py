"""Queries on tables beyond sf0.1: keys past a million, and plans whose work does not multiply."""

from __future__ import annotations

import re

import pytest
from gristmill.functions import gstin
from gristmill.functions import spans as S
from gristmill.operators import docno, pages, rules, spans
from gristmill.plans import adapter as A
from gristmill.plans import queries as invoices
from pyspark.sql import functions as F

from tests import compare


def test_service_codes_of_large_keys(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (2, 3, 4, 899_999, 990_002, 990_029, 1_999_991, 9_900_017, 59_990_000)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    n, mine, theirs = compare.difference(invoices.queries()["is_service"](spark, str(tmp_path)), compare.tables(str(tmp_path)), invoices.oracle_sql()["is_service"])
    assert n == 9 and not mine and not theirs


def test_parties_filter_is_not_multiplied(spark, sf):
    plan = invoices.queries()["resolve_parties"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5000  # pushed below the steps it took the whole derivation with it, many times over


def test_adapter_reads_lines_once_for_texts(spark, sf):
    plan = A.table(spark, sf, "SELECT doc, text FROM texts")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= 1 and "Window" not in plan


def test_tied_spans_are_merged_once(spark):
    rows = [(1, 102, 117, 210), (1, 182, 223, 210), (1, 182, 221, 210)] * 2
    got = spans.merged(spark.createDataFrame(rows, "doc long, start long, end long, size long"), ["doc"], "size").collect()
    assert sorted(map(tuple, got)) == [(1, 102, 117), (1, 182, 210)]


@pytest.mark.parametrize("text", ["", "no match", "12", "a1b22\n333", "﷐ 1 ﷑ 22", "1﷑", "𝟙é 7 ☃ 8"])
def test_offsets_with_marks_in_the_text(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(S.found(F.col("t"), "[0-9]+").alias("m")).first().m
    assert [(m.token, m.start, m.end) for m in got] == _by_re(text)


def _by_re(text):
    return [(m.group(), *m.span()) for m in re.finditer("[0-9]+", text)]


def test_check_digits(spark):
    given = ["27AAPFU0939F1Z", "29AAGCB7383J1Z", "ZZZZZZZZZZZZZZ", "09AZ18MN27KQ4Z"]
    value = gstin.ALPHABET.index
    want = [gstin.ALPHABET[(36 - sum(sum(divmod(value(c) * (1 + i % 2), 36)) for i, c in enumerate(g)) % 36) % 36] for g in given]
    got = spark.createDataFrame([(g,) for g in given], "g string").select(gstin.check_digit(F.col("g")).alias("d")).collect()
    assert [r.d for r in got] == want and want[0] == "V"


def test_lines_and_labels_stay_within_the_row(spark, sf):
    texts = spark.createDataFrame([(1, "Invoice No.\nINV-7\nHSN\n9983")], "doc long, text string")
    for df in (docno._labels(texts), rules.wrapped_labels(texts), rules.doc_numbers(texts)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    assert [(r.at, r.content, r.next) for r in spans.facing(texts, "doc", "text", "INV|99").collect()] == [(12, "INV-7", "HSN"), (22, "9983", None)]


def test_detector_filters_agree_with_detectors(spark):
    given = ["Shipping Bill To: yard", "shipping bill 7", "ſez unit", "under LUT", "2 CAD drawings", "Total USD 1,200.00", "Currency: EUR", "conversion rate", "£", "Invoice 7", "", None]
    d = spark.createDataFrame([(t,) for t in given], "t string")
    t = F.col("t")
    old = lambda ps, f: F.array_max(F.array(*[F.coalesce(t.rlike(f + p), F.lit(False)) for p in ps]))
    r = d.select(t, pages.has_export(t).alias("e"), old([p for p, _, _ in pages.EXPORT], "(?iU)").alias("oe"), pages.has_currency(t).alias("c"), old(pages.CURRENCY, "(?U)").alias("oc")).collect()
    assert all(bool(x.e) == x.oe and bool(x.c) == x.oc for x in r)


def test_only_figures_beside_a_notation_are_held_against_patterns(spark):
    from gristmill.functions import numbers

    rows = [(1, "(", ")", True), (2, "", " cR\n", True), (3, "", "-\n", True), (4, "x − ", "", True), (5, "Total ", "\n", False), (6, "INV/", " - ", False)]
    t = spark.createDataFrame(rows, "id int, before string, after string, may boolean")
    got = t.select("id", "may", numbers.may_be_credit(t.before, t.after).alias("got"), numbers.credit(F.concat("before", F.lit("\uffff"), "after"), F.lit("5")).isNotNull().alias("is_credit")).collect()
    assert [(r.id, r.got) for r in got] == [(r.id, r.may) for r in got]
    assert [r.id for r in got if r.is_credit] == [1, 2, 3, 4]


def test_spelling_reads_no_figure(spark, sf):
    from gristmill.plans import queries

    plan = queries.queries()["ground_spelling"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and r"[0-9,]*\.?[0-9]+" not in plan
