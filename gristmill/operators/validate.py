"""Validators of invoices: item totals, invoice totals, sums over items, tax split.

Items: doc, idx, AssAmt, CgstAmt, SgstAmt, IgstAmt, CesAmt, StateCesAmt, OthChrg,
TotItemVal, GstRt. Heads: doc, the ValDtls columns, seller_stcd, buyer_stcd, pos,
reg_rev. Warnings: doc, check_rank, seq, field, actual, expected, severity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import said

TOLERANCE, EPSILON = 0.05, 1e-9
ITEM_TERMS = ["AssAmt", "CgstAmt", "SgstAmt", "IgstAmt", "CesAmt", "StateCesAmt", "OthChrg"]
TOTAL_TERMS = ["AssVal", "CgstVal", "SgstVal", "IgstVal", "CesVal", "StCesVal", "RndOffAmt"]
PAIRS = [("AssVal", "AssAmt"), ("CgstVal", "CgstAmt"), ("SgstVal", "SgstAmt"), ("IgstVal", "IgstAmt"), ("CesVal", "CesAmt"), ("StCesVal", "StateCesAmt")]
_COLUMNS = "doc", "check_rank", "seq", "field", "actual", "expected", "severity"


def off(actual: Column, expected: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(actual - expected) > tolerance + EPSILON


def plus(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, map(F.col, names))


def path(name: str) -> Column:
    return F.concat(F.lit("ItemList["), F.col("idx"), F.lit(f"].{name}"))


def _warning(rank: int, seq: Column, field: Column, actual: Column, expected: Column) -> list[Column]:
    return [F.col("doc"), F.lit(rank).alias("check_rank"), seq.cast("int").alias("seq"), field.alias("field"), actual.alias("actual"), expected.alias("expected"), F.lit("warning").alias("severity")]


def item_total(items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    return items.filter(off(F.col("TotItemVal"), plus(ITEM_TERMS), tolerance)).select(*_warning(0, F.col("idx"), path("TotItemVal"), F.col("TotItemVal"), plus(ITEM_TERMS)))


def invoice_total(heads: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    return heads.filter(off(F.col("TotInvVal"), plus(TOTAL_TERMS), tolerance)).select(*_warning(1, F.lit(0), F.lit("ValDtls.TotInvVal"), F.col("TotInvVal"), plus(TOTAL_TERMS)))


def value_sums(heads: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Items are added up in item order, so equal inputs give equal sums on any cluster."""
    rows = items.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", *[i for _, i in PAIRS]))).alias("rows"))
    both = heads.join(rows, "doc")
    added = lambda name: F.aggregate(F.col("rows"), F.lit(0.0), lambda s, r: s + r[name])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t"), F.col(t).alias("a"), added(i).alias("e")) for k, (t, i) in enumerate(PAIRS)])).alias("x")
    return both.select("doc", each).filter(off(F.col("x.a"), F.col("x.e"), tolerance)).select(*_warning(2, F.col("x.k"), F.concat(F.lit("ValDtls."), F.col("x.t")), F.col("x.a"), F.col("x.e")))


def tax_split(heads: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """A skip is one note of severity info; reverse charge comes before place of supply."""
    why = F.when(F.coalesce(F.col("reg_rev"), F.lit("N")) == "Y", "TranDtls.RegRev").when(F.col("pos") != F.col("buyer_stcd"), "BuyerDtls.Pos")
    h = heads.select("doc", why.alias("why"), (F.col("seller_stcd") == F.col("buyer_stcd")).alias("intra"))
    none = F.lit(None).cast("double")
    skipped = h.filter("why is not null").select("doc", F.lit(3).alias("check_rank"), F.lit(0).alias("seq"), F.col("why").alias("field"), none.alias("actual"), none.alias("expected"), F.lit("info").alias("severity"))
    tax = F.col("AssAmt") * F.col("GstRt")
    side = F.when(F.col("intra"), tax / 2 / 100).otherwise(0.0)
    want = {"CgstAmt": side, "SgstAmt": side, "IgstAmt": F.when(F.col("intra"), 0.0).otherwise(tax / 100)}
    rows = h.filter("why is null").join(items, "doc")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.col(n).alias("a"), e.alias("e")) for k, (n, e) in enumerate(want.items())])).alias("x")
    rows = rows.select("doc", "idx", each).filter(off(F.col("x.a"), F.col("x.e"), tolerance))
    return rows.select(*_warning(3, F.col("idx") * 3 + F.col("x.k"), F.concat(F.lit("ItemList["), F.col("idx"), F.lit("]."), F.col("x.n")), F.col("x.a"), F.col("x.e"))).unionByName(skipped)


def all_checks(heads: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """All warnings; order by doc, check_rank, seq for the order of the checks."""
    return item_total(items, tolerance).unionByName(invoice_total(heads, tolerance)).unionByName(value_sums(heads, items, tolerance)).unionByName(tax_split(heads, items, tolerance))


def validity(heads: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc, valid, warnings): info does not invalidate."""
    n = warnings.groupBy("doc").agg(F.count("*").alias("n"), F.sum((F.col("severity") == "warning").cast("int")).alias("bad"))
    return heads.select("doc").join(n, "doc", "left").select("doc", (F.coalesce("bad", F.lit(0)) == 0).alias("valid"), F.coalesce("n", F.lit(0)).alias("warnings"))


# Formulas and check names as messages print them.
FORMULAS = [" + ".join(ITEM_TERMS), " + ".join(TOTAL_TERMS)]
CHECKS = ["validate_item_total", "validate_invoice_total", "validate_val_dtls_sums", "validate_tax_split"]


# What the tax split is compared with, and notes.
SPLIT_LIMITATION = (
    ". Note: this check compares the seller's and buyer's registered state codes (SellerDtls.Stcd vs BuyerDtls.Stcd) rather than the true Place of Supply, "
    "and may false-flag SEZ supplies and bill-to/ship-to cases."
)
SKIPPED_RCM = "Tax-split check skipped: RegRev is 'Y' (reverse charge), so tax is legitimately absent from the invoice face and the CGST/SGST/IGST split cannot be evaluated."
SKIPPED_POS = "Tax-split check skipped: place of supply (BuyerDtls.Pos = {pos}) differs from the buyer's registered state (BuyerDtls.Stcd = {stcd}); this rule cannot evaluate that case."
SPLITS = {
    True: {"CgstAmt": "AssAmt x GstRt / 2 / 100", "SgstAmt": "AssAmt x GstRt / 2 / 100", "IgstAmt": "0 (intra-state supply)"},
    False: {"CgstAmt": "0 (inter-state supply)", "SgstAmt": "0 (inter-state supply)", "IgstAmt": "AssAmt x GstRt / 100"},
}


def _significant(x: Column, digits: int = 10) -> Column:
    """A number of at least 0 with so many significant digits, without zeros behind the last one."""
    places = [F.when(x < 10**k, F.format_string(f"%.{digits - k}f", x)) for k in range(1, digits)]
    return F.regexp_replace(F.coalesce(*places, F.format_string("%.0f", x)), r"(\.[0-9]*?)0+$", "$1")


def messages(warnings: DataFrame, tolerance: float = TOLERANCE, heads: DataFrame | None = None) -> DataFrame:
    """With ``check`` and ``message``; those of the tax split (rank 3) need ``heads``."""
    leaf = F.element_at(F.split("field", r"\."), -1)
    pair = F.create_map(*[F.lit(x) for t, i in PAIRS for x in (t, f"sum of ItemList[].{i}")])
    formula = F.when(F.col("check_rank") == 0, FORMULAS[0]).when(F.col("check_rank") == 1, FORMULAS[1]).when(F.col("check_rank") == 2, pair[leaf])
    suffix, note = F.lit(""), F.lit(None).cast("string")
    rows = warnings
    if heads is not None:
        rows = rows.join(heads.select("doc", (F.col("seller_stcd") == F.col("buyer_stcd")).alias("_intra"), F.col("pos").alias("_pos"), F.col("buyer_stcd").alias("_stcd")), "doc", "left")
        split = {k: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[leaf] for k, names in SPLITS.items()}
        formula = formula.when(F.col("check_rank") == 3, F.when(F.col("_intra"), split[True]).otherwise(split[False]))
        suffix = F.when(F.col("check_rank") == 3, SPLIT_LIMITATION).otherwise("")
        note = F.when(F.col("field") == "TranDtls.RegRev", F.lit(SKIPPED_RCM)).when(F.col("field") == "BuyerDtls.Pos", said(SKIPPED_POS, pos=F.col("_pos"), stcd=F.col("_stcd")))
    two = lambda c: F.format_string("%.2f", F.col(c))
    delta = F.regexp_replace(_significant(F.round(F.abs(F.col("actual") - F.col("expected")), 8)), r"\.$", "")
    text = F.concat(leaf, F.lit(" is "), two("actual"), F.lit(" but "), formula, F.lit(" = "), two("expected"), F.lit(" (delta "), delta, F.lit(f" exceeds tolerance {tolerance:.10g})"), suffix)
    out = rows.withColumn("check", F.element_at(F.array(*map(F.lit, CHECKS)), F.col("check_rank") + 1)).withColumn("message", F.coalesce(note, text))
    return out.drop("_intra", "_pos", "_stcd")


#: The keys that each block of the payload may have.
ALLOWED = {
    "$": ["Version", "TranDtls", "DocDtls", "SellerDtls", "BuyerDtls", "ItemList", "ValDtls"],
    "$.TranDtls": ["TaxSch", "SupTyp", "RegRev", "IgstOnIntra"],
    "$.DocDtls": ["Typ", "No", "Dt"],
    "$.SellerDtls": ["Gstin", "LglNm", "TrdNm", "Addr1", "Addr2", "Loc", "Pin", "Stcd"],
    "$.BuyerDtls": ["Gstin", "LglNm", "TrdNm", "Addr1", "Addr2", "Loc", "Pin", "Stcd", "Pos"],
    "$.ValDtls": ["AssVal", "CgstVal", "SgstVal", "IgstVal", "CesVal", "StCesVal", "RndOffAmt", "TotInvVal"],
}


def unknown_keys(payload: Column) -> Column:
    """Paths of keys that the closed schema does not have, in block order."""
    blocks = []
    for where, keys in ALLOWED.items():
        part = payload if where == "$" else F.get_json_object(payload, where)
        extra = F.array_except(F.coalesce(F.json_object_keys(part), F.array().cast("array<string>")), F.array(*map(F.lit, keys)))
        blocks.append(F.transform(extra, _under(where)))
    return F.flatten(F.array(*blocks))


def _under(where: str):
    return lambda key: F.concat(F.lit(f"{where}."), key)
