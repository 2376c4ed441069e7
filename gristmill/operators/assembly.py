"""Assembly: from rules and a grounded answer to a payload, or to what is missing.

A mandatory field that was not read is derived where a rule allows it and reported
missing otherwise; a document with anything missing has no payload. Every leaf of a
payload has a provenance, no missing path has one, and every derivation has a note
in place of the answer's own note that the value was not found.

One row a document throughout; items are rows (doc, idx) until they are
gathered, in order, into the payload's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gstin
from ..functions.text import said, strip, warning
from . import answers, derive, validate

CHECK = "pipeline"

# Messages.
MISSING = (
    "{path} is mandatory in INV-01 but could not be read from this document, so no invoice payload was produced. It was left missing rather than filled with an "
    "empty string, a zero or a plausible-looking placeholder: a fabricated mandatory field is worse than an absent one. The warnings from the extraction stages above "
    "say what was seen at this field's position."
)
BAD_PIN = (
    "{path} is mandatory in INV-01 and must be a number, but the text read at that field was '{text}'. It was left missing rather than coerced into a "
    "number, because a PIN code invented from non-numeric text would look exactly like one that was read."
)
NO_ROWS = "ItemList is mandatory in INV-01 and needs at least one line item, but stage 2 returned no usable rows. No row was invented to satisfy the schema."
ZERO = (
    "{path} is mandatory in INV-01 but is not printed on this document. It was set to zero because the supply is {kind}: the seller's state code ({seller}) and the "
    "buyer's ({buyer}) say the tax falls to {other}, so this head cannot apply and no invoice prints a column for it. The zero was derived from those two state codes, "
    "not read from the page. Note that the state codes are the registered states, not the true place of supply, so confirm the split if this is an SEZ supply or a bill-to/ship-to case."
)
GROSS = (
    "{path} (gross amount before discount) is mandatory in INV-01 but is not printed as a column of its own on this document, which prints only the taxable value. It "
    "was set to {value} from the INV-01 identity TotAmt = AssAmt + Discount, using the taxable value {read} and the discount {discount} "
    "that were read. It was derived, not read from the page: if this invoice does carry a gross figure that differs, the printed one is the correct value."
)
TAXABLE = (
    "{path} (taxable value) is mandatory in INV-01 but stage 2 returned no value for it, while the gross amount on the same row was read. It was set to "
    "{value} from the INV-01 identity AssAmt = TotAmt - Discount -- the exact inverse of the rule that fills an unprinted gross amount -- using the "
    "gross amount {read} and the discount {discount}. It was derived, not read from the page. Mind the discount: if this invoice prints a discount that "
    "was not read, the discount used here is zero and this derived taxable value equals the gross amount -- wrong by exactly the discount. The arithmetic checks "
    "compare this value against the row's own total and against the document totals, so a real disagreement is flagged beside it; if one is, check the invoice's discount line first."
)
ROW_TOTAL = (
    "{path} (per-line total) is mandatory in INV-01 but is not printed as a column of its own on this document. It was set to {value} from the INV-01 identity "
    "TotItemVal = AssAmt + CgstAmt + SgstAmt + IgstAmt + CesAmt + StateCesAmt + OthChrg -- the identity validate_item_total enforces -- using the amounts the "
    "row carries: read from the page, or filled by a rule whose own note appears beside this one. It was derived, not read from the page. The derivation was allowed "
    "only because this invoice carries exactly one line item and the derived value reconciles with the printed document total ValDtls.TotInvVal "
    "({total}) within the {tolerance} tolerance. On a multi-line invoice, or where that reconciliation fails, this field is reported missing instead and no payload is produced."
)
FROM_ITEM = (
    "{path} was returned null by stage 2, but this invoice carries exactly one line item, and on a single-line invoice {path} is definitionally the same "
    "number as {item}, which was read from the page. It was set to {value} from that identity. It was derived, not read. The derivation "
    "was allowed only because the completed ValDtls block reconciles with the printed document total ValDtls.TotInvVal ({total}) within the "
    "{tolerance} tolerance, on the identity validate_invoice_total enforces. It fills a total only from a row value stage 2 read, never from "
    "one this pipeline derived. On a multi-line invoice the totals block constrains only the sum across rows, so nothing is derived there; where "
    "the reconciliation fails nothing is filled either, and a mandatory total is then reported missing and no payload is produced."
)
POS = (
    "BuyerDtls.Pos (place of supply) was not read from the document -- build 2 does not extract it -- so it was assumed equal to the buyer's registered "
    "state code ({stcd}). A genuine bill-to/ship-to supply, where the goods go to a different state from the one the buyer is registered in, has "
    "a different place of supply, and the CGST/SGST-versus-IGST split follows the place of supply. Confirm it against the document before filing."
)
NOT_FOUND = "was not found in the document"
#: Order of the notes: parties and number, items, totals, place of supply.
_ITEMS_AT, _TOTALS_AT, _POS_AT = 1000, 1 << 50, 1 << 60

_TEXT_FIELDS = {n for n, numeric in answers.ITEM if not numeric}
_NOTE = "array<struct<seq:bigint,w:struct<field:string,message:string,severity:string,check:string>>>"
_SOURCE = "array<struct<key:string,value:struct<source:string,ocr_confidence:double>>>"


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _note(seq: Column | int, path: Column | str, message: Column, severity: str = "warning") -> Column:
    w = warning(path, message, CHECK, severity)
    return F.when(w.isNotNull(), F.struct((seq if isinstance(seq, Column) else F.lit(seq)).cast("long").alias("seq"), w.alias("w")))


def _source(path: Column | str, source: str, confidence: Column | None = None) -> Column:
    c = F.lit(None).cast("double") if confidence is None else confidence
    return F.struct((path if isinstance(path, Column) else F.lit(path)).alias("key"), F.struct(F.lit(source).alias("source"), c.alias("ocr_confidence")).alias("value"))


def items_of(resolved: DataFrame) -> DataFrame:
    """(doc, idx, fields of an item) of a resolved answer."""
    rows = resolved.filter(F.col("path").startswith("ItemList[")).withColumn("idx", F.floor(F.col("seq") / 20).cast("int"))
    cols = [F.max(F.when(F.col("name") == n, F.col("number" if numeric else "text"))).alias(n) for n, numeric in answers.ITEM]
    return rows.groupBy("doc", "idx").agg(*cols).withColumn("StateCesAmt", F.lit(None).cast("double"))


def heads_of(resolved: DataFrame) -> DataFrame:
    """(doc, seller_LglNm, ..., AssVal, ...): parties and totals of a resolved answer."""
    rows = resolved.filter(~F.col("path").startswith("ItemList["))
    cols = [F.max(F.when(F.col("path") == f"{block}.{n}", F.col("text"))).alias(f"{p}_{n}") for p, block in answers.PARTIES for n in answers.PARTY]
    cols += [F.max(F.when(F.col("path") == f"ValDtls.{n}", F.col("number"))).alias(n) for n in answers.TOTALS]
    return rows.groupBy("doc").agg(*cols)


def _zero_note(seq: Column | int, path: Column | str, head: str, was: Column, now: Column) -> Column:
    intra = F.col("kind") == "intra"
    applies = F.col("kind").isNotNull() & was.isNull() & now.isNotNull() & F.when(intra, F.lit(head.startswith("Igst"))).otherwise(F.lit(not head.startswith("Igst")))
    text = said(
        ZERO, path=path if isinstance(path, Column) else F.lit(path), kind=F.when(intra, "intra-state").otherwise("inter-state"), seller=F.col("seller_stcd"), buyer=F.col("buyer_stcd"),
        other=F.when(intra, "CGST and SGST").otherwise("IGST"),
    )
    return _note(seq, path, F.when(applies, text), "info")


def derived_items(items: DataFrame, heads: DataFrame, tolerance: float) -> DataFrame:
    """Items with derived fields, ``notes``, ``missing``, ``derived`` (paths) and ``sources`` of the derived ones."""
    raw = [n for n, _ in answers.ITEM]
    rows = items.select("*", *[F.col(n).alias(f"_raw_{n}") for n in raw]).join(heads.select("doc", "seller_stcd", "buyer_stcd", derive.kind().alias("kind"), F.col("TotInvVal").alias("_printed")), "doc")
    rows = derive.gross_and_taxable(rows)
    rows = derive.inapplicable_heads(rows, derive.HEADS, derive.ITEM)
    rows = derive.single_item_total(rows, heads, tolerance)
    at = lambda n: F.concat(F.lit("ItemList["), F.col("idx"), F.lit(f"].{n}"))
    seq = lambda k: F.col("idx").cast("long") * 100 + _ITEMS_AT + k
    new = lambda n: F.col(f"_raw_{n}").isNull() & F.col(n).isNotNull()
    discount = F.coalesce("Discount", F.lit(0.0))
    notes = [
        _note(seq(0), at("TotAmt"), F.when(new("TotAmt"), said(GROSS, path=at("TotAmt"), value=_two(F.col("TotAmt")), read=_two(F.col("AssAmt")), discount=_two(discount))), "info"),
        _note(seq(1), at("AssAmt"), F.when(new("AssAmt"), said(TAXABLE, path=at("AssAmt"), value=_two(F.col("AssAmt")), read=_two(F.col("TotAmt")), discount=_two(discount))), "info"),
        *[_zero_note(seq(2 + k), at(h), h, F.col(f"_raw_{h}"), F.col(h)) for k, h in enumerate(("IgstAmt", "CgstAmt", "SgstAmt"))],
        _note(seq(5), at("TotItemVal"), F.when(new("TotItemVal"), said(ROW_TOTAL, path=at("TotItemVal"), value=_two(F.col("TotItemVal")), total=_two(F.col("_printed")), tolerance=F.lit(f"{tolerance:.10g}"))), "info"),
    ]
    could = ["TotAmt", "AssAmt", "IgstAmt", "CgstAmt", "SgstAmt", "TotItemVal"]
    gone = lambda n: F.coalesce(strip(F.col(n).cast("string")), F.lit("")) == ""
    absent = [_note(seq(20 + k), at(n), F.when(gone(n), said(MISSING, path=at(n)))) for k, n in enumerate(derive.ITEM)]
    missing = F.array_compact(F.array(*[F.when(gone(n), at(n)) for n in derive.ITEM]))
    sources = F.array_compact(F.array(*[F.when(new(n), _source(at(n), "derived")) for n in could], F.when(F.size(missing) == 0, _source(at("IsServc"), "derived"))))
    return rows.withColumn("notes", F.array_compact(F.array(*notes, *absent))).withColumn("missing", missing).withColumn("derived", F.array_compact(F.array(*[F.when(new(n), at(n)) for n in could]))).withColumn("sources", sources)


def derived_heads(heads: DataFrame, items: DataFrame, tolerance: float) -> DataFrame:
    """Heads with derived totals, ``total_notes``, ``total_missing``, ``total_derived`` and ``total_sources``; ``items`` as they were read."""
    names = [t for t, _ in validate.PAIRS] + ["RndOffAmt", "TotInvVal"]
    rows = heads.withColumn("StCesVal", F.lit(None).cast("double")).withColumn("kind", derive.kind())
    rows = rows.select("*", *[F.col(n).alias(f"_raw_{n}") for n in names])
    rows = derive.inapplicable_heads(rows, derive.HEAD_TOTALS, derive.TOTALS)
    rows = rows.select("*", *[F.col(n).alias(f"_mid_{n}") for n in names])
    rows = derive.totals_from_item(rows, items, tolerance)
    zero = [_zero_note(_TOTALS_AT + k, f"ValDtls.{n}", n, F.col(f"_raw_{n}"), F.col(f"_mid_{n}")) for k, n in enumerate(("IgstVal", "CgstVal", "SgstVal"))]
    from_item = lambda n: F.col(f"_mid_{n}").isNull() & F.col(n).isNotNull()
    filled = [
        _note(_TOTALS_AT + 10 + k, f"ValDtls.{t}", F.when(from_item(t), said(FROM_ITEM, path=F.lit(f"ValDtls.{t}"), item=F.lit(f"ItemList[0].{i}"), value=_two(F.col(t)), total=_two(F.col("TotInvVal")), tolerance=F.lit(f"{tolerance:.10g}"))), "info")
        for k, (t, i) in enumerate(validate.PAIRS)
    ]
    new = {n: F.col(f"_raw_{n}").isNull() & F.col(n).isNotNull() for n in names}
    absent = [_note(_TOTALS_AT + 20 + k, f"ValDtls.{n}", F.when(F.col(n).isNull(), F.lit(MISSING.replace("{path}", f"ValDtls.{n}")))) for k, n in enumerate(derive.TOTALS)]
    out = rows.withColumns({
        "total_notes": F.array_compact(F.array(*zero, *filled, *absent)),
        "total_missing": F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(f"ValDtls.{n}")) for n in derive.TOTALS])),
        "total_derived": F.array_compact(F.array(*[F.when(c, F.lit(f"ValDtls.{n}")) for n, c in new.items()])),
        "total_sources": F.array_compact(F.array(*[F.when(c, _source(f"ValDtls.{n}", "derived")) for n, c in new.items()])),
    })
    return out.drop(*[f"_{w}_{n}" for w in ("raw", "mid") for n in names])


def leaves(value: Column, kind: T.DataType, path: Column | None = None) -> Column:
    """array<string>: the paths of all values of a nested payload, in order, nulls left out."""
    if isinstance(kind, T.StructType):
        below = [leaves(value[f.name], f.dataType, F.lit(f.name) if path is None else F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.flatten(F.array(*below)))
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(each), F.array().cast("array<string>"))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(path))


def _payload(reverse_charge: Column) -> Column:
    none = F.lit(None).cast("string")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0)).alias(n)

    def party(p: str) -> list[Column]:
        return [
            F.col(f"{p}.value").alias("Gstin"), F.col(f"{p}_LglNm").alias("LglNm"), none.alias("TrdNm"), F.col(f"{p}_Addr1").alias("Addr1"), none.alias("Addr2"), F.col(f"{p}_Loc").alias("Loc"),
            gstin.pin(F.col(f"{p}_Pin")).alias("Pin"), F.col(f"{p}_stcd").alias("Stcd"),
        ]

    totals = [F.col(n) for n in ("AssVal", "CgstVal", "SgstVal", "IgstVal")] + [zero(n) for n in ("CesVal", "StCesVal", "RndOffAmt")] + [F.col("TotInvVal")]
    return F.struct(
        F.lit("1.1").alias("Version"), F.struct(F.lit("GST").alias("TaxSch"), F.lit("B2B").alias("SupTyp"), F.when(reverse_charge, "Y").alias("RegRev"), none.alias("IgstOnIntra")).alias("TranDtls"),
        F.struct(F.lit("INV").alias("Typ"), F.col("doc_no.value").alias("No"), F.col("date.value").alias("Dt")).alias("DocDtls"),
        F.struct(*party("seller")).alias("SellerDtls"), F.struct(*party("buyer"), F.col("buyer_stcd").alias("Pos")).alias("BuyerDtls"), F.col("items").alias("ItemList"), F.struct(*totals).alias("ValDtls"),
    )


def _item() -> Column:
    zero = {"Discount", "CesAmt", "StateCesAmt", "OthChrg"}
    order = ["SlNo", "PrdDesc", "IsServc", "HsnCd", "Qty", "Unit", "UnitPrice", "TotAmt", "Discount", "AssAmt", "GstRt", "CgstAmt", "SgstAmt", "IgstAmt", "CesAmt", "StateCesAmt", "OthChrg", "TotItemVal"]
    of = lambda n: gstin.is_service(F.col("HsnCd")) if n == "IsServc" else F.lit(0.0) if n == "OthChrg" else F.coalesce(F.col(n), F.lit(0.0)) if n in zero else F.col(n)
    return F.struct(*[of(n).alias(n) for n in order])


def assembled(rules: DataFrame, resolved: DataFrame, said_of_answer: DataFrame, rule_sources: DataFrame, answer_sources: DataFrame, tolerance: float = validate.TOLERANCE) -> DataFrame:
    """(doc, invoice, missing, provenance, warnings), one row for each document of ``rules``.

    rules: ``claims.extract`` with a column reverse_charge. resolved and said_of_answer:
    of ``answers``. rule_sources, answer_sources: (doc, path, confidence) of the
    fields that rules and the answer gave. warnings: those of rules, the answer, the
    assembly and, for a payload, the validators, in this order.
    """
    stcd = lambda p: F.substring(F.col(f"{p}.value"), 1, 2).alias(f"{p}_stcd")
    heads = rules.select("doc", "seller", "buyer", "doc_no", "date", F.col("warnings").alias("rule_warnings"), "reverse_charge", stcd("seller"), stcd("buyer")).join(heads_of(resolved), "doc", "left")
    raw = items_of(resolved)
    rows = derived_items(raw, heads, tolerance)
    gathered = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", _item().alias("item"), "notes", "missing", "derived", "sources"))).alias("g"))
    whole = derived_heads(heads, raw, tolerance).join(gathered, "doc", "left")
    flat = lambda c, kind: F.coalesce(F.flatten(F.col(f"g.{c}")), F.array().cast(kind))
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    required: list[tuple[str, Column, Column]] = []
    for p, block in answers.PARTIES:
        for n in derive.PARTY:
            value = F.col(f"{p}.value") if n == "Gstin" else F.col(f"{p}_stcd") if n == "Stcd" else F.col(f"{p}_{n}")
            path = f"{block}.{n}"
            absent = F.when(blank(value), F.lit(MISSING.replace("{path}", path)))
            if n == "Pin":
                absent = F.when(value.isNull(), F.lit(MISSING.replace("{path}", path))).when(gstin.pin(value).isNull(), said(BAD_PIN, path=F.lit(path), text=value))
            required.append((path, absent.isNotNull(), absent))
    for path, value in (("DocDtls.No", F.col("doc_no.value")), ("DocDtls.Dt", F.col("date.value"))):
        required.append((path, blank(value), F.when(blank(value), F.lit(MISSING.replace("{path}", path)))))
    no_rows = F.col("g").isNull()
    required.append(("ItemList", no_rows, F.when(no_rows, F.lit(NO_ROWS))))
    head_missing = F.array_compact(F.array(*[F.when(gone, F.lit(path)) for path, gone, _ in required]))
    head_notes = F.array_compact(F.array(*[_note(k, path, message) for k, (path, _, message) in enumerate(required)]))
    whole = whole.withColumn("items", F.col("g.item")).withColumn("missing", F.concat(head_missing, flat("missing", "array<string>"), "total_missing"))
    whole = whole.withColumn("_derived", F.concat(flat("derived", "array<string>"), "total_derived"))
    complete = F.size("missing") == 0
    pos = F.array_compact(F.array(_note(_POS_AT, "BuyerDtls.Pos", F.when(complete, said(POS, stcd=F.col("buyer_stcd"))), "info")))
    whole = whole.withColumn("_notes", F.array_sort(F.concat(head_notes, flat("notes", _NOTE), "total_notes", pos))).withColumn("invoice", F.when(complete, _payload(F.col("reverse_charge"))))
    # provenance: one source a path, none for what is missing, and "assumed" for what no stage gave
    entry = lambda d: d.groupBy("doc").agg(F.collect_list(F.struct(F.col("path").alias("key"), F.struct("source", F.col("confidence").alias("ocr_confidence")).alias("value"))).alias("e"))
    rule_source = F.when(F.col("path").endswith(".Stcd"), "derived").otherwise("regex")
    read = entry(rule_sources.select("doc", "path", "confidence", rule_source.alias("source")).unionByName(answer_sources.select("doc", "path", "confidence", F.lit("llm").alias("source"))))
    whole = whole.join(read, "doc", "left")
    kept = F.filter(F.concat(F.coalesce("e", F.array().cast(_SOURCE)), flat("sources", _SOURCE), "total_sources"), lambda x: ~F.array_contains(F.col("missing"), x["key"]))
    whole = whole.withColumn("_kept", kept)
    paths = leaves(F.col("invoice"), whole.schema["invoice"].dataType)
    rest = F.transform(F.array_except(paths, F.col("_kept.key")), lambda p: _source(p, "assumed"))
    whole = whole.withColumn("provenance", F.map_from_entries(F.concat("_kept", rest)))
    told = said_of_answer.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sub", "w"))), lambda x: x["w"]).alias("told"))
    whole = whole.join(told, "doc", "left")
    none = F.array().cast("array<struct<field:string,message:string,severity:string,check:string>>")
    answer = F.filter(F.coalesce("told", none), lambda w: ~(F.array_contains(F.col("_derived"), w["field"]) & w["message"].contains(NOT_FOUND)))
    done = whole.select("doc", "invoice", "missing", "provenance", F.concat("rule_warnings", answer, F.transform("_notes", lambda x: x["w"])).alias("warnings"))
    return done.join(checked(done.filter("invoice is not null"), tolerance), "doc", "left").select("doc", "invoice", "missing", "provenance", F.concat("warnings", F.coalesce("checks", none)).alias("warnings"))


def checked(done: DataFrame, tolerance: float) -> DataFrame:
    """(doc, checks): the validators' warnings on payloads, in order."""
    i = F.col("invoice")
    heads = done.select("doc", i["SellerDtls"]["Stcd"].alias("seller_stcd"), i["BuyerDtls"]["Stcd"].alias("buyer_stcd"), i["BuyerDtls"]["Pos"].alias("pos"), i["TranDtls"]["RegRev"].alias("reg_rev"), "invoice.ValDtls.*")
    items = done.select("doc", F.posexplode("invoice.ItemList").alias("idx", "item")).select("doc", "idx", "item.*")
    found = validate.messages(validate.all_checks(heads, items, tolerance), tolerance, heads)
    one = F.struct("check_rank", "seq", F.struct("field", "message", "severity", "check").alias("w"))
    return found.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["w"]).alias("checks"))
