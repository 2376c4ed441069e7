"""Parsing of invoices end to end, as one job over many documents.

pages: (doc, page, method, text), page from 1; answers: (doc, attempt, content), what
a model said to each document's prompt in attempt 1 and 2; words: OCR words (doc,
page, start, end, confidence) of pages that are not native.

Refused documents leave before the rules, so no prompt is made for them. Documents
without a payload take their second answer, whole. Rules, and each attempt's fields,
are written once to the shared folder, so that a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import said, warning
from ..operators import answers as A
from ..operators import assembly, claims, confidence, refusals, validate
from ..operators import pages as P
from .store import written

# The note on a second attempt.
RETRIED = (
    "Stage 2 was retried once, because the first attempt produced no payload (missing: {missing}) and nothing was refused -- the documented provider-side "
    "non-determinism makes that outcome an expected occasional event, not evidence about the document. {outcome} The attempt count is recorded in "
    "extraction_meta.attempts so a change in the underlying failure rate can never hide behind a silent retry."
)
SECOND = (
    "This payload is the second attempt, taken whole. Responses are never merged across attempts, because each response is only internally coherent -- a "
    "payload spliced from two would be neither of them."
)
NEITHER = (
    "The second attempt also produced no payload, and this result is the second attempt's. Two attempts are the limit: past that, re-asking the same "
    "question spends time without changing the honest answer, which is that this run could not read the document."
)
_WARNINGS = "array<struct<field:string,message:string,severity:string,check:string>>"


def prompts(pages: DataFrame) -> DataFrame:
    """(doc, prompt) of every document that is not refused: what to ask a model."""
    rules, _ = _rules(pages)
    return A.prompt(A.confirmed(rules))


def _rules(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    read = written(refusals.read(pages), "read")
    live = read.filter(F.size("refusals") == 0)
    docs = written(P.join_pages(pages.join(live.select("doc"), "doc", "left_semi"), "doc", "page", "text"), "docs")
    rules = claims.extract(docs).join(live.select("doc", "reverse_charge"), "doc")
    return written(rules, "rules"), read


def _attempt(rules: DataFrame, content: DataFrame, paged: DataFrame, tolerance: float) -> DataFrame:
    """One pass over the documents of ``rules``; a document without an answer has a null one."""
    sources = A.confirmed(rules)
    parsed = A.parsed(rules.select("doc").join(content.select("doc", "content"), "doc", "left"))
    resolved = written(A.resolved(parsed, sources), "fields")
    field = lambda path, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(path).alias("path"), F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end")))
    stcd = lambda path, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(path).alias("path"), F.col(f"{c}.start").alias("start"), (F.col(f"{c}.start") + 2).alias("end")))
    given = F.array_compact(F.array(field("SellerDtls.Gstin", "seller"), field("BuyerDtls.Gstin", "buyer"), stcd("SellerDtls.Stcd", "seller"), stcd("BuyerDtls.Stcd", "buyer"), field("DocDtls.No", "doc_no"), field("DocDtls.Dt", "date")))
    spans = rules.select("doc", F.explode(given).alias("f")).select("doc", "f.*")
    kept = resolved.filter(F.coalesce(F.size("printed") > 0, F.lit(False))).select("doc", "path", "printed")
    return assembly.assembled(rules, resolved, A.all_warnings(parsed, resolved), confidence.of_offsets(spans, paged), confidence.of_fields(kept, paged), tolerance)


def parse_invoices(pages: DataFrame, answers: DataFrame, words: DataFrame | None = None, tolerance: float = validate.TOLERANCE) -> DataFrame:
    """(doc, invoice, missing_fields, refusals, pages, field_provenance, warnings, attempts), one row a document.

    ``invoice`` is null where the document is refused or anything mandatory is
    missing; exactly one of the three says why not, or what was read.
    """
    rules, read = _rules(pages)
    if words is None:
        words = pages.sparkSession.createDataFrame([], "doc long, page int, start int, end int, confidence double")
    paged = written(confidence.paged(pages, words), "pages")
    first = written(_attempt(rules, answers.filter("attempt = 1"), paged, tolerance), "first")
    failed = first.filter("invoice is null").select("doc", F.col("missing").alias("_before"))
    again = _attempt(rules.join(failed.select("doc"), "doc", "left_semi"), answers.filter("attempt = 2"), paged, tolerance).join(failed, "doc")
    before = F.when(F.size("_before") > 0, F.array_join("_before", ", ")).otherwise("none recorded")
    note = warning("attempts", said(RETRIED, missing=before, outcome=F.when(F.col("invoice").isNotNull(), SECOND).otherwise(NEITHER)), assembly.CHECK, "info")
    again = again.withColumn("warnings", F.concat("warnings", F.array(note))).drop("_before").withColumn("attempts", F.lit(2))
    both = first.filter("invoice is not null").withColumn("attempts", F.lit(1)).unionByName(again)
    out = read.join(both, "doc", "left")
    empty: Column = F.array().cast("array<string>")
    return out.select(
        "doc", "invoice", F.coalesce("missing", empty).alias("missing_fields"), "refusals", "pages", F.coalesce("provenance", F.create_map().cast("map<string,struct<source:string,ocr_confidence:double>>")).alias("field_provenance"),
        F.concat("ingest_warnings", F.coalesce("warnings", F.array().cast(_WARNINGS))).alias("warnings"), F.coalesce("attempts", F.lit(1)).alias("attempts"),
    )


def result_json(results: DataFrame) -> DataFrame:
    """(doc, json): the result object of each document; nulls of the payload are left out."""
    meta = F.struct("pages", "field_provenance", "warnings", "attempts").alias("extraction_meta")
    return results.select("doc", F.to_json(F.struct("invoice", "missing_fields", "refusals", meta)).alias("json"))
