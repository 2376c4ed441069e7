"""A deterministic projection of the star schema into invoices, in SQL that Spark and DuckDB both run.

One invoice an order. Money is whole paise (bigint) so that both engines compute
alike; ``{div}`` is integer division, ``{x}`` in braces a table. Every eleventh
of the orders carries one of ten defects (column k), the last none.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.gstin import DOUBLED
from .store import new_path

_ALPHA = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_digit(first14: str) -> str:
    v = lambda i: f"(instr('{_ALPHA}', substr({first14}, {i}, 1)) - 1) * {2 - i % 2}"
    total = " + ".join(f"(({v(i)}) {{div}} 36 + ({v(i)}) % 36)" for i in range(1, 15))
    return f"substr('{_ALPHA}', CAST((36 - ({total}) % 36) % 36 + 1 AS INT), 1)"


def _first14(state: str, key: str) -> str:
    letters = " || ".join(f"chr(CAST(65 + ({key} * 7 + {i * 5}) % 26 AS INT))" for i in range(5))
    return f"({state} || {letters} || lpad(CAST({key} % 10000 AS VARCHAR(9)), 4, '0') || chr(CAST(65 + {key} % 26 AS INT)) || '1Z')"


def _state(key: str) -> str:
    return f"substr('2729072433', CAST(1 + 2 * ({key} % 5) AS INT), 2)"


_TWO = "lpad(CAST({x} AS VARCHAR(9)), 2, '0')"
_MONEY = "(CAST(({x}) {{div}} 100 AS VARCHAR(20)) || '.' || lpad(CAST(({x}) % 100 AS VARCHAR(9)), 2, '0'))"

_LINES = f"""
li AS (SELECT l_orderkey AS doc, l_partkey AS part, l_suppkey AS supp,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INT) AS idx,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS gross, CAST(round(l_discount * 100) AS BIGINT) AS dpct,
    CAST(round(l_tax * 100) AS BIGINT) AS rate, CAST(l_quantity AS BIGINT) AS qty FROM {{lineitem}}),
"""
_FIRST = f"""hd AS (SELECT o.o_orderkey AS doc, o.o_custkey AS cust, f.supp, o.o_orderdate AS dt, {_state('f.supp')} AS sstate, {_state('o.o_custkey')} AS bstate, o.o_orderkey % 11 AS k
    FROM {{orders}} o JOIN (SELECT doc, supp FROM li WHERE idx = 0) f ON f.doc = o.o_orderkey),
"""
_ITEMS = f"""am AS (SELECT li.*, hd.k, hd.sstate = hd.bstate AS intra, (gross * dpct + 50) {{div}} 100 AS disc, gross - (gross * dpct + 50) {{div}} 100 AS ass FROM li JOIN hd ON hd.doc = li.doc),
tx AS (SELECT am.*, CASE WHEN intra THEN (ass * rate + 100) {{div}} 200 ELSE 0 END AS half, CASE WHEN intra THEN 0 ELSE (ass * rate + 50) {{div}} 100 END AS ig FROM am),
items AS (SELECT doc, idx, part, qty, rate, disc, intra, k,
    CASE WHEN k <> 2 THEN gross END AS tot, CASE WHEN k <> 1 THEN ass END AS ass,
    CASE WHEN k = 5 AND NOT intra THEN NULL WHEN k = 4 THEN ig ELSE half END AS cg,
    CASE WHEN k = 5 AND NOT intra THEN NULL WHEN k = 4 THEN 0 ELSE half END AS sg,
    CASE WHEN k = 5 AND intra THEN NULL WHEN k = 4 THEN 2 * half ELSE ig END AS ig,
    CASE WHEN k <> 8 THEN ass + 2 * half + ig + CASE WHEN k = 0 AND idx = 0 THEN 500 ELSE 0 END END AS val FROM tx),
"""
_SUMS = f"""sm AS (SELECT doc, CAST(count(*) AS BIGINT) AS n, CAST(sum(ass) AS BIGINT) AS ass, CAST(sum(half) AS BIGINT) AS half, CAST(sum(ig) AS BIGINT) AS ig FROM tx GROUP BY doc),
"""
_HEADS = f"""heads AS (SELECT hd.doc, hd.cust, hd.supp, hd.dt, hd.sstate, hd.bstate, hd.k, sm.n,
    CASE WHEN hd.k = 6 THEN {_state('(hd.cust + 1)')} ELSE hd.bstate END AS pos, CASE WHEN hd.k = 7 THEN 'Y' END AS reg_rev,
    CASE WHEN hd.k <> 9 THEN sm.ass END AS ass, CASE WHEN hd.k <> 9 THEN sm.half END AS cg, CASE WHEN hd.k <> 9 THEN sm.half END AS sg, CASE WHEN hd.k <> 9 THEN sm.ig END AS ig,
    sm.ass + 2 * sm.half + sm.ig + CASE WHEN hd.k = 3 THEN 500 ELSE 0 END AS total FROM hd JOIN sm ON sm.doc = hd.doc),
"""
_IDS = f"""g1 AS (SELECT doc, cust, supp, sstate, bstate, k, {_first14('sstate', 'supp')} AS s14, {_first14('bstate', 'cust')} AS b14 FROM heads),
g2 AS (SELECT doc, cust, supp, sstate, bstate, k, s14, b14, {check_digit('s14')} AS sd, {check_digit('b14')} AS bd FROM g1),
ids AS (SELECT doc, cust, supp, sstate, bstate, k, s14 || CASE WHEN supp % 7 <> 3 THEN sd WHEN sd = '0' THEN '1' ELSE '0' END AS seller,
    CASE WHEN cust % 13 = 5 THEN lower(b14) || bd WHEN cust % 13 = 6 THEN b14 ELSE b14 || bd END AS buyer FROM g2),
"""
_TEXTS = f"""texts AS (SELECT i.doc, i.k, i.seller, i.buyer, 'TAX INVOICE' || chr(10)
    || CASE WHEN i.doc % 3 = 0 THEN 'Bill To: Buyer ' || CAST(i.cust AS VARCHAR(20)) || chr(10) || 'GSTIN: ' || i.buyer || chr(10) || 'Supplier: Works ' || CAST(i.supp AS VARCHAR(20)) || chr(10) || 'GSTIN: ' || i.seller
            WHEN i.doc % 3 = 1 THEN 'Sold By: Works ' || CAST(i.supp AS VARCHAR(20)) || chr(10) || 'GSTIN: ' || i.seller || chr(10) || 'Buyer: Firm ' || CAST(i.cust AS VARCHAR(20)) || chr(10) || 'GSTIN: ' || i.buyer
            ELSE 'GSTIN ' || i.seller || chr(10) || 'GSTIN ' || i.buyer END || chr(10)
    || CASE WHEN i.doc % 5 = 0 THEN 'Bill No: B-' WHEN i.doc % 5 = 1 THEN 'Tax Invoice No. TI/' WHEN i.doc % 5 = 2 THEN 'Inv No ' WHEN i.doc % 5 = 3 THEN 'Invoice' || chr(10) || 'No: W' ELSE 'Invoice No: INV/' END || CAST(i.doc AS VARCHAR(20)) || chr(10)
    || CASE WHEN i.doc % 4 = 0 THEN 'Invoice Date: ' WHEN i.doc % 4 = 1 THEN 'Dated ' WHEN i.doc % 4 = 2 THEN 'Date: ' ELSE 'Issued ' END
    || CASE WHEN i.doc % 7 < 4 THEN {_TWO.format(x='day(h.dt)')} || '/' || {_TWO.format(x='month(h.dt)')} || '/' || CAST(year(h.dt) AS VARCHAR(9))
            WHEN i.doc % 7 < 6 THEN CAST(day(h.dt) AS VARCHAR(9)) || '-' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(h.dt) * 3 - 2 AS INT), 3) || '-' || CAST(year(h.dt) AS VARCHAR(9))
            ELSE CAST(month(h.dt) AS VARCHAR(9)) || '.' || CAST(day(h.dt) AS VARCHAR(9)) || '.' || substr(CAST(year(h.dt) AS VARCHAR(9)), 3, 2) END || chr(10)
    || CASE i.k WHEN 0 THEN 'Supply meant for export under LUT' WHEN 1 THEN 'Shipping Bill To: yard' WHEN 2 THEN 'SEZ unit, with payment of IGST' WHEN 3 THEN 'Total USD 1,200.00'
            WHEN 4 THEN 'Currency: EUR' WHEN 5 THEN '2 CAD drawings' WHEN 6 THEN 'Reverse Charge: No' WHEN 7 THEN 'Reverse Charge: Yes' WHEN 8 THEN 'This supply attracts reverse charge on freight' WHEN 9 THEN 'Whether tax is payable on reverse charge' ELSE 'Thank you' END || chr(10)
    || 'HSN: ' || lpad(CAST(i.doc * 37 % 1000000 AS VARCHAR(9)), 6, '0') || ' Qty ' || CAST(h.n AS VARCHAR(9)) || chr(10)
    || CASE WHEN i.doc % 6 = 0 THEN 'Discount (250.00)' WHEN i.doc % 6 = 1 THEN 'Discount 250.00 CR' WHEN i.doc % 6 = 2 THEN 'Discount 250.00-' WHEN i.doc % 6 = 3 THEN 'Freight - 200.00' ELSE 'Round off 0.00' END || chr(10)
    || 'Total ' || {_MONEY.format(x='h.total')} AS text
    FROM ids i JOIN heads h ON h.doc = i.doc)"""

INVOICES = _LINES + _FIRST + _ITEMS + _SUMS + _HEADS + _IDS + _TEXTS

# The same tables with less work, for Spark: one aggregation of the lines gives an
# order's first supplier and both of the taxes it may bear, heads are no join of it with
# itself, and texts are printed from the row that has the identifiers. Order keys are keys.
_SUMMED = """
ln AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, gross - (gross * dpct + 50) DIV 100 AS ass, rate
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross, CAST(round(l_discount * 100) AS BIGINT) AS dpct, CAST(round(l_tax * 100) AS BIGINT) AS rate FROM {lineitem})),
sm AS (SELECT doc, min(struct(n, part, supp)).supp AS supp, count(*) AS n, sum(ass) AS ass, sum((ass * rate + 100) DIV 200) AS half, sum((ass * rate + 50) DIV 100) AS ig FROM ln GROUP BY doc),
"""
_ONE = f"""hd AS (SELECT o.o_orderkey AS doc, o.o_custkey AS cust, f.supp, o.o_orderdate AS dt, {_state('f.supp')} AS sstate, {_state('o.o_custkey')} AS bstate, o.o_orderkey % 11 AS k, f.n, f.ass, f.half, f.ig
    FROM {{orders}} o JOIN sm f ON f.doc = o.o_orderkey),
tax AS (SELECT doc, cust, supp, dt, sstate, bstate, k, n, ass, CASE WHEN sstate = bstate THEN half ELSE 0 END AS half, CASE WHEN sstate = bstate THEN 0 ELSE ig END AS ig FROM hd),
"""


def _one_row(sql: str) -> str:
    """A table expression over a join of one order's rows, over the one row that holds them all."""
    for join in (" FROM hd JOIN sm ON sm.doc = hd.doc", " FROM ids i JOIN heads h ON h.doc = i.doc", "\n    FROM ids i JOIN heads h ON h.doc = i.doc"):
        sql = sql.replace(join, " FROM tax" if "sm" in join else " FROM ids")
    return re.sub(r"\b(?:hd|sm|h|i)\.(?=[a-z])", "", sql)


_MORE = ", sstate, bstate, k"  # what the identifiers' tables carry on, to which texts add what they print
FOR_SPARK = _LINES + _SUMMED.lstrip() + _ONE + _ITEMS + _one_row(_HEADS) + _IDS.replace(_MORE, _MORE + ", dt, n, total") + _one_row(_TEXTS)
for _c in ("s14", "b14"):  # a character's share of the sum is its place in an alphabet in that order
    FOR_SPARK = FOR_SPARK.replace(check_digit(_c), f"substr('{_ALPHA}', CAST((36 - (" + " + ".join(f"instr('{_ALPHA if i % 2 else DOUBLED}', substr({_c}, {i}, 1))" for i in range(1, 15)) + " - 14) % 36) % 36 + 1 AS INT), 1)")

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]


def for_spark(sql: str, sf_dir: str) -> str:
    return sql.format(div="DIV", **{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES})


def for_duckdb(sql: str) -> str:
    return sql.format(div="//", **{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """A select over the adapter's tables."""
    return spark.sql(for_spark(f"WITH {FOR_SPARK} {select}", sf_dir))


_WRITTEN: dict[tuple, str] = {}


def kept(df: DataFrame) -> DataFrame:
    """The same table of every query of an application, written once to the shared folder and read from there."""
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), *df.columns)
    try:
        return df.sparkSession.read.schema(df.schema).parquet(_WRITTEN[key])
    except (KeyError, AnalysisException):  # not yet, or no longer there
        _WRITTEN[key] = path = new_path(df.sparkSession, "adapter")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in rupees (double), nulls where a defect hides a value."""
    r = "CAST({} AS DOUBLE) / 100.0 AS {}"
    cols = ", ".join(r.format(a, b) for a, b in (("tot", "TotAmt"), ("disc", "Discount"), ("ass", "AssAmt"), ("cg", "CgstAmt"), ("sg", "SgstAmt"), ("ig", "IgstAmt"), ("val", "TotItemVal")))
    return kept(table(spark, sf_dir, f"SELECT doc, idx, k, CAST(rate AS DOUBLE) AS GstRt, CAST(qty AS DOUBLE) AS Qty, {cols}, CAST(0 AS DOUBLE) AS CesAmt, CAST(0 AS DOUBLE) AS StateCesAmt, CAST(0 AS DOUBLE) AS OthChrg FROM items"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = "CAST({} AS DOUBLE) / 100.0 AS {}"
    cols = ", ".join(r.format(a, b) for a, b in (("ass", "AssVal"), ("cg", "CgstVal"), ("sg", "SgstVal"), ("ig", "IgstVal"), ("total", "TotInvVal")))
    return kept(table(spark, sf_dir, f"SELECT doc, k, n, sstate AS seller_stcd, bstate AS buyer_stcd, pos, reg_rev, {cols}, CAST(0 AS DOUBLE) AS CesVal, CAST(0 AS DOUBLE) AS StCesVal, CAST(0 AS DOUBLE) AS RndOffAmt FROM heads"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(table(spark, sf_dir, "SELECT doc, text FROM texts"))
