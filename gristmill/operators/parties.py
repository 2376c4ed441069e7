"""Seller and buyer of a text: GSTINs, party labels, assignment and what about it is in doubt, within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gstin
from ..functions import spans as S
from ..functions.text import said, warning
from .rules import BARE, BUYER, GSTIN, LABEL_WINDOW, SELLER

CHECK = "extract_rules"
PATHS = {"seller": "SellerDtls", "buyer": "BuyerDtls"}

# Messages.
INVALID = (
    "GSTIN-shaped text '{token}' at character {at} failed validation ({reason}); it was not used as either party's GSTIN and could "
    "not be attributed to one. Re-read the document: a single misread character breaks the checksum."
)
ABSENT = "No checksum-valid GSTIN was found in the document, so the {party} GSTIN could not be extracted."
ONLY_ONE = "Only one checksum-valid GSTIN was found in the document, so no buyer GSTIN could be extracted."
ASSIGNED = "GSTIN {seller} was assigned to the seller"
ASSIGNED_BOTH = "GSTIN {seller} was assigned to the seller and GSTIN {buyer} to the buyer"
BY_POSITION = (
    "{assigned} from position in the document (the first GSTIN read is taken as the seller, which is where Indian invoices conventionally print it), not from a "
    "'Seller'/'Buyer' label. Reversing seller and buyer inverts who owes the tax, so confirm this assignment against the document before filing."
)
CONTRADICTED = (
    " Note that the document labels GSTIN {gstin} as the {party}, which contradicts this positional assignment; no label pair resolved both parties, so "
    "position decided it anyway. Check this GSTIN first."
)
STATE = "GSTIN {gstin} carries state code {code}: {note}"


def candidates(text: Column) -> Column:
    """array<struct<token, start, end, v>> of GSTIN shapes with their validation."""
    return F.transform(S.found(text, GSTIN), lambda x: F.struct(x["token"].alias("token"), x["start"].alias("start"), x["end"].alias("end"), gstin.validate(x["token"]).alias("v")))


def labels(text: Column) -> Column:
    """array<struct<party, start, end>>: party labels; a bare "to" or "from" only where a line, a cell or an answer begins."""

    def of(party: str, words: list[str]) -> Column:
        plain = [w.replace(" ", r"[ \t]+") for w in words if w not in BARE]
        bare = [w for w in words if w in BARE]
        begins = "".join(sorted({w[0] for w in words}))
        pattern = rf"(?i)(?=[ \t{begins}])(?:\b(?:{'|'.join(plain)})\b|(?<![^\n\r:|])[ \t]*\b(?:{'|'.join(bare)})\b)"
        return F.transform(S.found(text, pattern), lambda x: F.struct(F.lit(party).alias("party"), (x["start"] + F.length(F.regexp_extract(x["token"], r"^[ \t]*", 0))).alias("start"), x["end"].alias("end")))

    return F.concat(of("seller", SELLER), of("buyer", BUYER))


def _outer(found: Column) -> Column:
    """Without labels strictly inside a longer one."""
    return F.filter(found, lambda x: ~F.exists(found, lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])))


def resolve(docs: DataFrame) -> DataFrame:
    """docs with ``gstins`` (all shapes), ``seller``, ``buyer`` (struct(value, start, end, method) or null) and ``party_warnings``.

    By label where each party has exactly one labelled value and they differ; else
    the first valid GSTIN is the seller and the first other one the buyer.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("gstins", candidates(text)).withColumn("_labels", labels(text)).withColumn("_labels", _outer(F.col("_labels")))

    def near(x: Column) -> Column:
        close = F.filter("_labels", lambda y: (y["end"] <= x["start"]) & (y["start"] >= x["start"] - LABEL_WINDOW))
        best = F.array_max(F.transform(close, lambda y: F.struct(y["end"].alias("end"), (y["end"] - y["start"]).alias("size"), y["party"].alias("party"))))
        return F.struct(x["token"].alias("token"), x["start"].alias("start"), x["end"].alias("end"), best["party"].alias("party"))

    rows = rows.withColumn("_valid", F.transform(F.filter("gstins", lambda x: x["v"]["is_valid"]), near))
    of = lambda p: F.filter("_valid", lambda x: F.coalesce(x["party"] == p, F.lit(False)))
    values = lambda p: F.array_distinct(F.transform(of(p), lambda x: x["token"]))
    by_label = (F.size(values("seller")) == 1) & (F.size(values("buyer")) == 1) & (F.size(F.array_intersect(values("seller"), values("buyer"))) == 0)
    rows = rows.withColumn("_by_label", by_label).withColumn("_one", F.get("_valid", 0))
    rows = rows.withColumn("_two", F.get(F.filter("_valid", lambda x: x["token"] != F.col("_one")["token"]), 0))
    one, two = F.col("_one"), F.col("_two")
    take = lambda x, how: F.when(x.isNotNull(), F.struct(x["token"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), F.lit(how).alias("method")))
    chosen = {p: F.when(F.col("_by_label"), take(F.get(of(p), 0), "label")).otherwise(take(x, "position")) for p, x in (("seller", one), ("buyer", two))}
    against = F.concat(
        F.when(F.coalesce(one["party"] == "buyer", F.lit(False)), said(CONTRADICTED, gstin=one["token"], party=F.lit("buyer"))).otherwise(""),
        F.when(F.coalesce(two["party"] == "seller", F.lit(False)), said(CONTRADICTED, gstin=two["token"], party=F.lit("seller"))).otherwise(""),
    )
    assigned = F.when(two.isNull(), said(ASSIGNED, seller=one["token"])).otherwise(said(ASSIGNED_BOTH, seller=one["token"], buyer=two["token"]))
    position = F.when(~F.col("_by_label") & one.isNotNull(), F.concat(said(BY_POSITION, assigned=assigned), against))
    wrong = F.flatten(F.transform(F.filter("gstins", lambda x: ~x["v"]["is_valid"]), lambda x: F.array(*[warning(f"{p}.Gstin", said(INVALID, token=x["token"], at=x["start"], reason=x["v"]["reason"]), CHECK) for p in PATHS.values()])))
    absent = [warning(f"{path}.Gstin", F.when(one.isNull(), said(ABSENT, party=F.lit(p))), CHECK) for p, path in PATHS.items()]
    alone = warning("BuyerDtls.Gstin", F.when(~F.col("_by_label") & one.isNotNull() & two.isNull(), F.lit(ONLY_ONE)), CHECK)
    rows = rows.withColumns(chosen)

    def state(p: str) -> Column:
        code = F.substring(F.col(p)["value"], 1, 2)
        found = gstin.state(code)
        return warning(f"{PATHS[p]}.Stcd", F.when(found["status"].isin("discontinued", "unknown"), said(STATE, gstin=F.col(p)["value"], code=code, note=gstin.state_note(code))), CHECK)

    notes = F.concat(wrong, F.array_compact(F.array(*absent, warning("SellerDtls.Gstin", position, CHECK), alone, state("seller"), state("buyer"))))
    return rows.withColumn("party_warnings", notes).drop("_labels", "_valid", "_by_label", "_one", "_two")
