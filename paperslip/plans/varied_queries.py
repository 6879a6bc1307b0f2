"""Queries over receipts in many layouts: each text is made from the tables together with what it truly says, and oracles give that truth.

The text of a case is one SQL expression that Spark and DuckDB both evaluate, so both sides read the same lines; what is
read from them is compared with the numbers that they were made from, not with the operators' patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperslip.operators import dates as D
from paperslip.operators import fields as X
from paperslip.operators import items as I
from paperslip.operators import payment as P
from paperslip.operators import vat as V
from paperslip.plans.fixtures import items, table
from paperslip.plans.lines_sql import ON_LINES

_TEXT = "CAST({0} AS VARCHAR(40))"


def _receipts(spark, sf) -> DataFrame:
    """(doc_id, n, v, g, d): net, VAT of 20 % and gross amount, and the day of each order."""
    sums = items(spark, sf).groupBy("doc_id").agg(F.sum("price").cast("decimal(16,2)").alias("n"))
    v = (F.col("n") * F.expr("0.20BD")).cast("decimal(16,2)")
    days = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("d")).groupBy("doc_id").agg(F.min("d").alias("d"))
    return sums.join(days, "doc_id").select("doc_id", "n", v.alias("v"), (F.col("n") + v).cast("decimal(16,2)").alias("g"), "d")


RECEIPTS_SQL = """, r0 AS (SELECT doc_id, subtotal AS n, CAST(subtotal * CAST(0.20 AS DECIMAL(3,2)) AS DECIMAL(16,2)) AS v, CAST(min(o_orderdate) AS DATE) AS d FROM sm JOIN orders ON o_orderkey = doc_id GROUP BY ALL),
  r AS (SELECT doc_id, n, v, CAST(n + v AS DECIMAL(16,2)) AS g, d FROM r0)"""


def _cases(rows: DataFrame, cases: list[tuple], text: int = 0) -> DataFrame:
    """Each document's case by its number."""
    chosen = "CASE doc_id % {} {} END".format(len(cases), " ".join(f"WHEN {i} THEN {c[text]}" for i, c in enumerate(cases)))
    return rows.withColumn("text", F.expr(chosen))


def _truth(cases: list[tuple], i: int, kind: str) -> str:
    return "CAST(CASE doc_id % {} {} END AS {})".format(len(cases), " ".join(f"WHEN {k} THEN {c[i]}" for k, c in enumerate(cases)), kind)


# ---- amounts: text, amount, rank, confidence, negative; m is the net amount cut down to below 1,000

_M = "CAST(n % 900 + 1 AS DECIMAL(16,2))"
_MT, _MW = _TEXT.format(_M), f"CAST(floor({_M}) AS BIGINT)"
_WT = _TEXT.format(_MW)
AMOUNT_CASES = [
    (f"'PAID £' || {_MT}", _M, 0, 1.15, "false"),
    (f"'PAID £7' || lpad({_MT}, 6, '0')", f"{_M} + 7000", 1, 1.10, "false"),
    (f"'PAID £' || {_WT}", _MW, 2, 1.00, "false"),
    (f"'SUMME ' || {_MT} || ' €'", _M, 3, 1.00, "false"),
    (f"'SUMME ' || {_WT} || '€'", _MW, 5, 0.85, "false"),
    (f"'gbp ' || {_MT}", _M, 6, 0.75, "false"),
    (f"{_MT} || ' USD'", _M, 7, 0.70, "false"),
    (f"'SUM 1,' || lpad({_MT}, 6, '0')", f"{_M} + 1000", 8, 0.65, "false"),
    (f"'SUM 1.' || lpad(replace({_MT}, '.', ','), 6, '0')", f"{_M} + 1000", 9, 0.60, "false"),
    (f"'SUM 1 ' || lpad({_MT}, 6, '0')", f"{_M} + 1000", 10, 0.55, "false"),
    (f"'SUM ' || {_MT}", _M, 11, 0.50, "false"),
    (f"'SUM ' || {_WT} || '.5'", f"{_MW} + 0.5", 12, 0.40, "false"),
    (f"{_TEXT.format(_MW + ' + 10')} || ' paid'", f"{_MW} + 10", 13, 0.35, "false"),
    ("'PAID £O.55'", "0.55", 14, 0.35, "false"),
    (f"'REFUND -£' || {_MT}", _M, 0, 1.15, "true"),
    (f"'REFUND £' || {_MT} || '-'", _M, 0, 1.15, "true"),
]

# ---- dates: text and whether it is labelled

_Y, _MO, _D = _TEXT.format("extract(YEAR FROM d)"), "CAST(extract(MONTH FROM d) AS INT)", "CAST(extract(DAY FROM d) AS INT)"
_YY, _MM, _DD = f"substring({_Y}, 3, 2)", f"lpad({_TEXT.format(_MO)}, 2, '0')", f"lpad({_TEXT.format(_D)}, 2, '0')"
_MON = f"substring('JanFebMarAprMayJunJulAugSepOctNovDec', {_MO} * 3 - 2, 3)"
_MONTH = "CASE {} {} END".format(_MO, " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"], 1)))
DATE_CASES = [
    *((f"'Date: ' || {_DD} || '{s}' || {_MM} || '{s}' || {y}", "true") for s in "-/." for y in (_Y, _YY)),
    *((f"'on ' || {_DD} || '{s}' || {_MM} || '{s}' || {y}", "false") for s in "-/." for y in (_Y, _YY)),
    (f"{_TEXT.format(_D)} || '/' || {_TEXT.format(_MO)} || '/' || {_Y}", "false"),
    (f"{_Y} || '-' || {_MM} || '-' || {_DD}", "false"),
    (f"{_Y} || '-' || {_MM} || '-' || {_DD} || 'T10:11:12'", "false"),
    (f"'no ' || {_Y} || {_MM} || {_DD}", "false"),
    (f"'no ' || {_YY} || {_MM} || {_DD}", "false"),
    *((f"{_DD} || ' ' || {m} || '{s}' || {y}", "false") for m in (_MON, _MONTH) for s in (" ", "''", " ''") for y in (_Y, _YY)),
    *((f"'INVOICE ' || upper({m}) || ' ' || {_DD} || '{s}' || {_Y}", "true") for m in (_MON, _MONTH) for s in (" ", ", ", "th, ")),
    *((f"{_DD} || '{s}' || {_MON} || '{s}' || {y}", "false") for s in ("", "-", "/", ".") for y in (_Y, _YY)),
    (f"{_MON} || {_DD} || {_Y}", "false"),
]

# ---- VAT lines: text, layout, code, rate, net, vat, total, consistent

_N, _V, _G = (_TEXT.format(x) for x in "nvg")
VAT_CASES = [
    (f"'VAT @ 20%: £' || {_V} || ' on £' || {_N}", "'rate_on_net'", "NULL", 20, "n", "v", "g", "true"),
    (f"'Net: £' || {_N} || ' VAT: £' || {_V} || ' Total: £' || {_G}", "'named_parts'", "NULL", "NULL", "n", "v", "g", "true"),
    (f"'20.00 % VAT B £ ' || {_V}", "'rate_word_code'", "'B'", 20, "NULL", "v", "NULL", "true"),
    (f"'20% VAT ' || {_V}", "'rate_word'", "NULL", 20, "NULL", "v", "NULL", "true"),
    (f"'TVA 20% ' || {_N} || ' €' || {_V} || ' €' || {_G}", "'foreign_table'", "NULL", 20, "n", "v", "g", "true"),
    (f"'VAT @ 20% £' || {_V}", "'word_at_rate'", "NULL", 20, "NULL", "v", "NULL", "true"),
    ("'VAT @ 20%'", "'word_at_rate'", "NULL", 20, "NULL", "NULL", "NULL", "true"),
    (f"'VAT @ 20% £' || {_V} || ' £' || {_N}", "'word_at_rate'", "NULL", 20, "n", "v", "g", "true"),
    (f"'VAT 20% £' || {_N} || ' £' || {_G}", "'word_at_rate'", "NULL", 20, "n", "v", "g", "true"),
    (f"'A(20.00%) ' || {_V} || ' ' || {_N} || ' ' || {_G}", "'joined_code_table'", "'A'", 20, "n", "v", "g", "true"),
    (f"'A1: ( 20% ) £' || {_V}", "'joined_code_table'", "'A1'", 20, "NULL", "v", "NULL", "true"),
    (f"'G 20.0% £' || {_N} || ' £' || {_V} || ' £' || {_G}", "'code_table'", "'G'", 20, "n", "v", "g", "true"),
    (f"'A1 20% Rated ' || {_N} || ' ' || {_V} || ' ' || {_G}", "'rated_code_table'", "'A1'", 20, "n", "v", "g", "true"),
    (f"'20% ' || {_N} || ' ' || {_V} || ' ' || {_G}", "'rate_table'", "NULL", 20, "n", "v", "g", "true"),
    (f"{_N} || ' 20% ' || {_G}", "'net_rate_total'", "NULL", 20, "n", "v", "g", "true"),
    (f"'Inc. VAT £' || {_V}", "'included'", "NULL", "NULL", "NULL", "v", "NULL", "true"),
    (f"'Totals ' || {_N} || ' ' || {_V} || ' ' || {_G}", "'totals'", "NULL", "NULL", "n", "v", "g", "true"),
    (f"{_V} || ' ' || {_N} || ' ' || {_G}", "'amounts'", "NULL", "NULL", "n", "v", "g", "true"),
    (f"'A: ' || {_V} || ' ' || {_N}", "'code_amount'", "'A'", "NULL", "n", "v", "g", "true"),
    (f"'Z 0% ' || {_N} || ' 0.00 ' || {_N}", "'code_table'", "'Z'", 0, "n", "0", "n", "true"),
    (f"'VAT 20 % ' || replace({_V}, '.', ',')", "'word_at_rate'", "NULL", 20, "NULL", "v", "NULL", "true"),
    (f"'S 2O% ' || {_N} || ' ' || {_V} || ' ' || {_TEXT.format('g + 5')}", "'code_table'", "'S'", 20, "n", "v", "g + 5", "false"),
    (f"'B 60% ' || {_N} || ' ' || {_V} || ' ' || {_G}", "'code_table'", "'B'", 60, "n", "v", "g", "false"),
    (f"'tax of this receipt ' || {_V} || ' and more'", "'tokens'", "NULL", "NULL", "NULL", "v", "NULL", "true"),
]


def _vat_lines(spark, sf) -> DataFrame:
    """A table's header, a line of each case, and lines that are none: a discount, an item, a number and a total."""
    rows = _cases(_receipts(spark, sf).where("n >= 10"), VAT_CASES)
    one = lambda k, t: F.struct(F.lit(k).cast("long").alias("line_number"), t.alias("text"))
    lines = [F.lit("VAT RATE NET GROSS"), F.col("text"), F.lit("DISCOUNT 10% OFF -£5.50"), F.lit("BREAD WHITE 5 x £12.00"), F.lit("VAT REG NO: 123 4567 89"), F.concat(F.lit("TOTAL £"), F.col("g").cast("string")), F.lit(None).cast("string")]
    return rows.select("doc_id", F.inline(F.array(*(one(k, t) for k, t in enumerate(lines, 1)))))


# ---- items in flat text and in answers


def _triples(spark, sf) -> DataFrame:
    """(doc_id, item_no, name, q, u, t): items of up to 20 pieces, with names of two words."""
    it = items(spark, sf)
    return it.select("doc_id", "item_no", F.expr("initcap(split(name, ' ')[0]) || ' K' || CAST(item_no AS STRING)").alias("name"), F.expr("qty % 20 + 1").alias("q"), F.col("price").alias("u"), F.expr("CAST((qty % 20 + 1) * price AS DECIMAL(16,2))").alias("t"))


TRIPLES_SQL = """, tr AS (SELECT doc_id, item_no, upper(string_split(name, ' ')[1][1]) || lower(string_split(name, ' ')[1][2:]) || ' K' || CAST(item_no AS VARCHAR) AS name, qty % 20 + 1 AS q, CAST(price AS DECIMAL(16,2)) AS u, CAST((qty % 20 + 1) * price AS DECIMAL(16,2)) AS t FROM it)"""


def _flat_texts(spark, sf) -> DataFrame:
    """By document: name and numbers in turn, all numbers and then all names, all names and then all numbers, and the second with joined names and line breaks."""
    rows = _triples(spark, sf)
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "name", "q", "u", "t"))).alias("r"))
    number = lambda x: F.concat_ws(" ", x["q"], x["u"], x["t"])
    turns = F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["name"], number(x))), " ")
    numbers, names = F.array_join(F.transform("r", number), " "), F.array_join(F.transform("r", lambda x: x["name"]), " ")
    kind = F.col("doc_id") % 4
    body = F.when(kind == 0, turns).when(kind == 1, F.concat_ws(" ", numbers, names)).when(kind == 2, F.concat_ws(" ", names, numbers)).otherwise(F.concat_ws("\n", F.regexp_replace(numbers, " ", "\n"), names))
    return per.select("doc_id", F.concat(F.lit("THE SHOP 12 ITEM Qty PRICE\nAMOUNT "), body, F.lit("\nSubtotal 99.00 Service 3.00")).alias("text"))


def _answers(spark, sf) -> DataFrame:
    """Records whose items are objects, lists, strings or all of these, with items that are none, stray keys and dirty receipt numbers."""
    rows = items(spark, sf)
    name, price = F.col("name"), F.col("price").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    shape = (F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, F.col("item_no")).otherwise(0)) % 8
    cat = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    qty = F.col("qty").cast("string")
    item = (
        F.when(shape == 0, cat('{"name": ', quoted(name), ', "quantity": ', qty, ', "total_price": ', price, "}"))
        .when(shape == 1, cat('{"description": ', quoted(name), ', "qty": ', quoted(qty), ', "price": ', quoted(cat("£", price)), "}"))
        .when(shape == 2, cat('{"item": [', quoted(name), ', 1], "quantity": ', qty, '.0, "amount": {"value": ', price, "}}"))
        .when(shape == 3, cat("[", quoted(name), ", ", qty, ", ", price, "]"))
        .when(shape == 4, cat("[", quoted(name), ", ", quoted(cat("$", price)), "]"))
        .when(shape == 5, cat("[", quoted(name), ', {"quantity": ', qty, ', "price": ', price, "}]"))
        .when(shape == 6, quoted(cat("  ", name, " ")))
        .otherwise(cat('{"name": "", "item": ', quoted(name), ', "unit_price": ', price, "}"))
    )
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_no", item.alias("j")))).alias("r"))
    array = F.array_join(F.transform("r", lambda x: x["j"]), ", ")
    number = F.when(F.col("doc_id") % 5 == 0, '"ITEM QTY 5"').when(F.col("doc_id") % 5 == 1, quoted(F.repeat(F.lit("9"), 130))).otherwise(quoted(cat("R", F.col("doc_id").cast("string"))))
    record = cat('{"receipt_number": ', number, ', "quantity": 3, "unit_price": 1.5, "total_amount": "12.00", "items": [', array, ', {"name": "Grand Total", "price": 5}, ["VAT", 1.0], "x", [], 7, [{"name": "odd"}, 3]]}')
    return per.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit('{"items": "none", "receipt_number": null')).otherwise(record).alias("record"))


_SHAPE = "(doc_id + CASE WHEN doc_id % 3 = 0 THEN item_no ELSE 0 END) % 8"


QUERIES = {
    "c1_amount_layouts": lambda s, d: X.mine_amounts(_cases(_receipts(s, d), AMOUNT_CASES).withColumn("line_number", F.lit(1).cast("long"))),
    "c3_date_layouts": lambda s, d: D.mine_dates(_cases(_receipts(s, d), DATE_CASES).withColumn("line_number", F.lit(1).cast("long"))),
    "j11_locate_renderings": lambda s, d: D.locate_source_line(_receipts(s, d).select("doc_id", F.date_format("d", "yyyy-MM-dd").alias("value")), _cases(_receipts(s, d), DATE_CASES[:13]).withColumn("line_number", F.lit(1).cast("long"))),
    "c12_vat_layouts": lambda s, d: V.parse_vat_lines(_vat_lines(s, d)),
    "c17_normalize_items": lambda s, d: I.normalize_items(_answers(s, d)),
    "c17_clean_records": lambda s, d: I.clean_records(_answers(s, d)),
    "c19_recover_items_flat": lambda s, d: I.recover_items_flat(_flat_texts(s, d)),
}
ORACLE_SQL = {
    "c1_amount_layouts": f"""{ON_LINES}{RECEIPTS_SQL} SELECT doc_id, CAST(1 AS BIGINT) AS line_number, {_truth(AMOUNT_CASES, 1, 'DECIMAL(16,2)')} AS amount, {_truth(AMOUNT_CASES, 2, 'INT')} AS rank, {_truth(AMOUNT_CASES, 3, 'DECIMAL(4,2)')} AS confidence, {_truth(AMOUNT_CASES, 4, 'BOOLEAN')} AS negative FROM r""",
    "c3_date_layouts": f"""{ON_LINES}{RECEIPTS_SQL} SELECT doc_id, d AS day, CAST(1 AS BIGINT) AS line_number, {_truth(DATE_CASES, 1, 'BOOLEAN')} AS labelled FROM r""",
    "j11_locate_renderings": f"""{ON_LINES}{RECEIPTS_SQL} SELECT doc_id, strftime(d, '%Y-%m-%d') AS value, CASE WHEN doc_id % 13 < 12 OR (extract(DAY FROM d) > 9 AND extract(MONTH FROM d) > 9) THEN CAST(1 AS BIGINT) END AS line_number FROM r""",
    "c12_vat_layouts": f"""{ON_LINES}{RECEIPTS_SQL} SELECT doc_id, CAST(2 AS BIGINT) AS line_number, {_truth(VAT_CASES, 1, 'VARCHAR')} AS layout, {_truth(VAT_CASES, 2, 'VARCHAR')} AS code, {_truth(VAT_CASES, 3, 'DECIMAL(5,2)')} AS rate, {_truth(VAT_CASES, 4, 'DECIMAL(16,2)')} AS net, {_truth(VAT_CASES, 5, 'DECIMAL(16,2)')} AS vat, {_truth(VAT_CASES, 6, 'DECIMAL(16,2)')} AS total, {_truth(VAT_CASES, 7, 'BOOLEAN')} AS consistent FROM r WHERE n >= 10""",
    "c17_normalize_items": f"""{ON_LINES} SELECT doc_id, CAST(item_no AS INT) AS item_no, name, CASE WHEN {_SHAPE} IN (4, 6, 7) THEN 1 ELSE qty END AS quantity, CASE WHEN {_SHAPE} <> 6 THEN CAST(price AS DECIMAL(16,2)) END AS total_price FROM it WHERE doc_id % 7 <> 0""",
    "c17_clean_records": f"""{ON_LINES} SELECT doc_id, 'receipt_number' AS field, CASE WHEN doc_id % 5 > 1 THEN 'R' || doc_id END AS value FROM sm WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'total_amount', '12.00' FROM sm WHERE doc_id % 7 <> 0""",
    "c19_recover_items_flat": f"""{ON_LINES}{TRIPLES_SQL} SELECT doc_id, CAST(item_no AS INT) AS item_no, name, CAST(q AS INT) AS quantity, u AS unit_price, t AS total_price FROM tr""",
}
