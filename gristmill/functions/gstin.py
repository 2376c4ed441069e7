"""GSTIN check digits, structure and state codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The check alphabet, the segments of a GSTIN, the state codes.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The alphabet by what a character adds to the sum at an even position: the digits of twice its value in base 36.
DOUBLED = "".join(sorted(ALPHABET, key=lambda c: sum(divmod(2 * ALPHABET.index(c), 36))))
SEGMENTS = [
    (1, 2, "[0-9]{2}", "positions 1-2 must be digits (state code)"),
    (3, 7, "[A-Z]{5}", "positions 3-7 must be letters"),
    (8, 11, "[0-9]{4}", "positions 8-11 must be digits"),
    (12, 12, "[A-Z]", "position 12 must be a letter"),
    (13, 13, "[0-9A-Z]", "position 13 must be alphanumeric"),
    (14, 14, "Z", "position 14 must be the literal 'Z'"),
    (15, 15, "[0-9A-Z]", "position 15 must be an alphanumeric check digit"),
]
STATES = {
    "01": "J&K", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana",
    "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh",
    "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya", "18": "Assam",
    "19": "West Bengal", "20": "Jharkhand", "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat",
    "26": "Dadra & Nagar Haveli and Daman & Diu", "27": "Maharashtra", "28": "Andhra Pradesh (legacy, pre-2014)",
    "29": "Karnataka", "30": "Goa", "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry",
    "35": "Andaman & Nicobar", "36": "Telangana", "37": "Andhra Pradesh (current)", "38": "Ladakh",
    "97": "Other Territory / UN bodies", "99": "Foreign (OIDAR)",
}
DISCONTINUED = {"25": "Daman & Diu"}
LEGACY = {"28"}
# Notes on state codes.
DISCONTINUED_NOTE = (
    "State code 25 (Daman & Diu) was discontinued in 2020 when it merged into 26 (Dadra & Nagar Haveli and Daman & Diu); code-26 GSTINs took effect "
    "from 1 August 2020. Treat a 25 as either an OCR misread (25 vs 26, 28 or 35) or a stale record from before the switch-over. To tell them apart, "
    "check the document date: on a document dated on or before 31 July 2020 a 25 can be genuine; on a document dated 1 August 2020 or later it cannot "
    "be a genuine code-25 registration, so either the digits were misread (re-read the GSTIN; the true code may be 26, 28 or 35) or the supplier is "
    "still printing their pre-merger GSTIN (ask them for their migrated code-26 GSTIN). Then verify the GSTIN checksum: a misread digit usually "
    "breaks it, so a passing checksum points to a genuine pre-merger record before the switch-over, or to a supplier still printing the ceased GSTIN after it."
)
LEGACY_NOTE = (
    "State code 28 is the pre-2014 Andhra Pradesh code from before the Telangana split. Registrations issued under it remain legitimate. "
    "Current Andhra Pradesh registrations use 37 (Telangana uses 36)."
)


def check_digit(first14: Column) -> Column:
    """The mod-36 check character; null unless given 14 characters of the alphabet."""
    place = lambda i: F.instr(F.lit(ALPHABET if i % 2 else DOUBLED), F.substring(first14, i, 1))
    total = sum((place(i) for i in range(2, 15)), place(1)) - 14
    place = ((36 - total % 36) % 36 + 1).cast("int")
    return F.when(first14.rlike("^[0-9A-Z]{14}\\z"), F.substr(F.lit(ALPHABET), place, F.lit(1)))


def validate(gstin: Column) -> Column:
    """struct(is_valid, structural_ok, checksum_ok, state_code, pan, reason).

    checksum_ok is null when the structure failed; the first failing segment gives the reason.
    """
    read = lambda g: F.struct(g.alias("g"), _refusal(g).alias("reason"), check_digit(F.substring(g, 1, 14)).alias("computed"))
    return F.get(F.transform(F.transform(F.array(strip(gstin)), read), _validated), 0)  # stripped, read and summed up once


def _refusal(g: Column) -> Column:
    """What is wrong with the structure, null if nothing is."""
    whole = "".join(pattern for _, _, pattern, _ in SEGMENTS)
    reason = F.when(g.rlike(f"^{whole}\\z"), F.lit(None).cast("string")).when(g.isNull(), F.lit("expected a string, got null")).when(F.length(g) != 15, F.concat(F.lit("length must be 15 characters, got "), F.length(g)))
    for first, last, pattern, rule in SEGMENTS:
        part = F.substring(g, first, last - first + 1)
        low = F.regexp_extract(part, "^([^a-z]*)([a-z])", 2)
        at = F.length(F.regexp_extract(part, "^([^a-z]*)([a-z])", 1)) + first
        case = F.concat(F.lit("position "), at, F.lit(" must be uppercase, got lowercase '"), low, F.lit("'"))
        other = F.concat(F.lit(f"{rule}, got '"), part, F.lit("'"))
        reason = reason.when(~part.rlike(f"^{pattern}\\z"), F.when(part.rlike(f"^(?i:{pattern})\\z"), case).otherwise(other))
    return reason


def _validated(read: Column) -> Column:
    g, reason, computed = read["g"], read["reason"], read["computed"]
    given, structural = F.substring(g, 15, 1), reason.isNull()
    wrong = F.concat(F.lit("checksum mismatch: computed check character '"), computed, F.lit("' but position 15 is '"), given, F.lit("'"))
    right = structural & (computed == given)
    return F.struct(
        F.coalesce(right, F.lit(False)).alias("is_valid"), structural.alias("structural_ok"), F.when(structural, computed == given).alias("checksum_ok"),
        F.when(structural, F.substring(g, 1, 2)).alias("state_code"), F.when(structural, F.substring(g, 3, 10)).alias("pan"),
        F.coalesce(reason, F.when(computed != given, wrong)).alias("reason"),
    )


def state(code: Column) -> Column:
    """struct(code, name, status, is_valid) of a two-digit state code."""
    c = strip(code)
    names = F.create_map(*[F.lit(x) for kv in (STATES | DISCONTINUED).items() for x in kv])
    name = F.when(c.rlike("^[0-9]{2}\\z"), F.try_element_at(names, c))
    status = F.when(name.isNull(), "unknown").when(c.isin(*DISCONTINUED), "discontinued").when(c.isin(*LEGACY), "legacy").otherwise("active")
    return F.struct(c.alias("code"), name.alias("name"), status.alias("status"), status.isin("active", "legacy").alias("is_valid"))


def state_note(code: Column) -> Column:
    """What to know of a state code; null for an active one."""
    c = strip(code)
    odd = F.concat(F.lit("state codes are exactly two ASCII digits 0-9, got '"), c, F.lit("'"))
    status = state(code)["status"]
    return F.when(status == "discontinued", DISCONTINUED_NOTE).when(status == "legacy", LEGACY_NOTE).when(~c.rlike("^[0-9]{2}\\z"), odd).when(status == "unknown", F.concat(F.lit("no GST state code "), c))


def is_service(hsn: Column) -> Column:
    return F.when(hsn.rlike(r"^99[0-9]{4}\z"), "Y").otherwise("N")


def pin(c: Column) -> Column:
    """Digits as an integer, anything else null."""
    return F.when(strip(c).rlike(r"^[0-9]+\z"), strip(c).try_cast("int"))
