"""Rule extraction in stages, each of which leaves what earlier ones have taken.

GSTINs are taken first, then parties and their state codes, the invoice number, the
date (which the number's span cannot hold) and the HSN codes (which neither can).
``extract`` gives one row a document with its fields, the spans that are used up,
and all warnings in stage order, within the row. A document id stands for one text; null and
empty texts have no fields and the warnings that say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import spans as S
from . import docno, invoice_dates, parties, rules
from .spans import once

_SPAN = "array<struct<start:int,end:int>>"


def extract(docs: DataFrame) -> DataFrame:
    """(doc, text, seller, buyer, doc_no, date, hsn, consumed, warnings).

    Fields are struct(value, start, end, method); ``hsn`` is an array of them, each
    code once; ``consumed`` the merged spans of all GSTIN shapes, the number, the
    date (unless it opens an item row) and the HSN codes with their labels.
    """
    span = lambda a: F.coalesce(F.transform(a, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))), F.array().cast(_SPAN))
    rows = once(docs.select("doc", "text"), _shapes=S.found(F.col("text"), dates.SHAPE))
    rows = docno.read(parties.resolve(rows), "gstins", "_shapes")
    rows = docno.warnings(rows.select(*[c for c in rows.columns if c != "number"], "number.*"))
    number = F.when(F.col("value").isNotNull(), F.struct("value", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "method"))
    rows = rows.select("doc", "text", "seller", "buyer", "gstins", "_shapes", "party_warnings", "no_warnings", number.alias("doc_no"))
    rows = rows.withColumn("_taken", span(F.array_compact(F.array("doc_no"))))
    rows = invoice_dates.doc_date(rows, "_taken", "_shapes")
    rows = once(rows, _claims=F.concat(span(F.col("gstins")), F.col("_taken")))
    rows = rules.hsn_in_rows(rows, "_claims", "_shapes")
    rows = once(rows, codes=F.array_sort(F.array_distinct(F.transform("codes", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["code"].alias("code"))))), _code_labels=span(F.transform("codes", lambda x: F.struct(x["label_start"].alias("start"), x["label_end"].alias("end")))))
    first = F.filter(F.transform("codes", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: F.get(F.filter("codes", lambda z: z["code"] == y["x"]["code"]), 0)["start"] == y["x"]["start"])
    hsn = F.transform(first, lambda y: F.struct(y["x"]["code"].alias("value"), y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), F.lit("regex").alias("method")))
    used = F.concat("_claims", span(F.array_compact(F.array(F.when(F.col("date")["consumed"], F.col("date"))))), span(F.col("codes")), F.col("_code_labels"))
    date = F.when(F.col("date").isNotNull(), F.struct(F.col("date.value").alias("value"), F.col("date.start").alias("start"), F.col("date.end").alias("end"), F.lit("regex").alias("method")))
    return rows.select(
        "doc", "text", "seller", "buyer", "doc_no", date.alias("date"), F.coalesce(hsn, F.array().cast("array<struct<value:string,start:int,end:int,method:string>>")).alias("hsn"),
        S.merged(used).alias("consumed"), F.concat("party_warnings", "no_warnings", "date_warnings").alias("warnings"),
    )
