"""Registered queries of the field operators and what they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperslip.operators import dates as D
from paperslip.operators import fields as X
from paperslip.plans.fixtures import items, lines, table
from paperslip.plans.line_queries import classified
from paperslip.plans.lines_sql import ALL_SQL, ON_LINES, q


def with_extras(spark, sf):
    """Receipt lines, every fifth with a discount line and every second with a VAT number."""
    base = lines(spark, sf)
    docs = base.where("line_number = 3").select("doc_id")
    discount = docs.where("doc_id % 5 = 0").select("doc_id", F.lit(900).cast("long").alias("line_number"), F.concat(F.lit("DISCOUNT 10% OFF -£"), (F.col("doc_id") % 90 + 1).cast("string"), F.lit(".50")).alias("text"))
    vat = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(901).cast("long").alias("line_number"), F.concat(F.lit("VAT REG NO: GB"), F.lpad(F.col("doc_id").cast("string"), 9, "1")).alias("text"))
    return base.unionByName(discount).unionByName(vat)


EXTRAS_SQL = """, extras AS (SELECT doc_id, line_number, text FROM lines
  UNION ALL SELECT doc_id, 900, 'DISCOUNT 10% OFF -£' || CAST(doc_id % 90 + 1 AS VARCHAR) || '.50' FROM lines WHERE line_number = 3 AND doc_id % 5 = 0
  UNION ALL SELECT doc_id, 901, 'VAT REG NO: GB' || lpad(CAST(doc_id AS VARCHAR), 9, '1') FROM lines WHERE line_number = 3 AND doc_id % 2 = 0)"""
TEXTS_SQL = r", texts AS (SELECT doc_id, string_agg(text, E'\n' ORDER BY line_number) AS text FROM extras GROUP BY doc_id)"


def totals(spark, sf):
    per = items(spark, sf).groupBy("doc_id").agg(F.sum("price").cast("decimal(16,2)").alias("subtotal"))
    return per.select("doc_id", "subtotal", *expected())


def expected():
    """Tax and total of a receipt by its subtotal; every seventh total is wrong."""
    rate = F.when(F.col("doc_id") % 7 == 0, F.expr("1.50BD")).otherwise(F.expr("1.20BD"))
    return (F.col("subtotal") * F.expr("0.20BD")).cast("decimal(16,2)").alias("tax"), (F.col("subtotal") * rate).cast("decimal(16,2)").alias("total")


TOTALS_SQL = """, totals AS (SELECT doc_id, subtotal, CAST(subtotal * CAST(0.20 AS DECIMAL(3,2)) AS DECIMAL(16,2)) AS tax, CAST(subtotal * CAST(CASE WHEN doc_id % 7 = 0 THEN 1.50 ELSE 1.20 END AS DECIMAL(3,2)) AS DECIMAL(16,2)) AS total FROM sm)"""


def flagship(spark, sf):
    """Total per receipt: class of its line, amount, and its reconciliation against the items."""
    paid = X.payable_amounts(classified(spark, sf), keep=("line_type", "confidence"))
    sums = items(spark, sf).groupBy("doc_id").agg(F.sum("price").cast("decimal(16,2)").alias("item_sum"))
    out = paid.join(sums, "doc_id")
    due = (F.col("item_sum") * F.expr("1.20BD")).cast("decimal(16,2)")
    return out.select("doc_id", "amount", "line_type", "confidence", "item_sum", (F.abs(F.col("amount") - due) > 1).alias("finding"))


def _located(spark, sf):
    """Values of the second and third lines: the day as it stands and as a date, the number in lower case, and one that is not there."""
    rows = lines(spark, sf)
    day = F.substring("text", 7, 10)
    iso = F.when(day.like("__/__/____"), F.concat_ws("-", F.substring(day, 7, 4), F.substring(day, 4, 2), F.substring(day, 1, 2)))
    number = F.concat(F.lit("r"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    of_line = F.when(F.col("line_number") == 2, F.array_compact(F.array(day, iso))).when(F.col("line_number") == 3, F.array(number, F.lit("not there")))
    return D.locate_source_line(rows.where("line_number IN (2, 3)").select("doc_id", F.explode(of_line).alias("value")), rows)


def _checked(spark, sf):
    docs = X.whole_texts(with_extras(spark, sf))
    shape = X.analyze_structure(docs).select("doc_id", F.col("tax_system")).join(X.discount_context(docs).select("doc_id", "has_discounts"), "doc_id")
    swapped = totals(spark, sf).select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.col("total")).otherwise(F.col("subtotal")).alias("subtotal"), F.when(F.col("doc_id") % 10 == 0, F.col("subtotal")).otherwise(F.when(F.col("doc_id") % 11 == 0, (F.col("subtotal") / 2).cast("decimal(16,2)")).otherwise(F.col("total"))).alias("total"))
    return X.check_totals(swapped.join(shape, "doc_id"))


QUERIES = {
    "flagship_totals": flagship,
    "t4_payable_amounts": lambda s, d: X.payable_amounts(lines(s, d)),
    "t5_priority_amounts": lambda s, d: X.priority_amounts(lines(s, d)),
    "t5_net_after_discount": lambda s, d: X.net_after_discount(lines(s, d)),
    "c1_mine_amounts": lambda s, d: X.mine_amounts(lines(s, d)),
    "c1_amounts_in_documents": lambda s, d: X.mine_amounts(table(s, d, "documents").select("doc_id", F.lit(1).cast("long").alias("line_number"), "text")),
    "c2_mine_rates": lambda s, d: X.mine_rates(with_extras(s, d)),
    "c3_mine_dates": lambda s, d: D.mine_dates(lines(s, d)),
    "c7_mine_tax_numbers": lambda s, d: X.mine_tax_numbers(with_extras(s, d)),
    "w3_receipt_numbers": lambda s, d: X.receipt_numbers(lines(s, d)),
    "w4_proximity_amounts": lambda s, d: X.proximity_amounts(lines(s, d)),
    "w5_best_candidate": lambda s, d: X.best_candidate(X.candidates(lines(s, d))),
    "w6_bottom_up_amount": lambda s, d: X.bottom_up_amount(lines(s, d)),
    "w11_contextual_suppliers": lambda s, d: X.contextual_suppliers(lines(s, d)),
    "c14_score_suppliers": lambda s, d: X.score_suppliers(lines(s, d)),
    "j4_match_suppliers": lambda s, d: X.match_suppliers(lines(s, d), table(s, d, "supplier")),
    "j11_locate_source_line": _located,
    "a7_reconcile_totals": lambda s, d: X.reconcile_totals(totals(s, d), items(s, d)),
    "a14_analyze_structure": lambda s, d: X.analyze_structure(X.whole_texts(with_extras(s, d))),
    "a15_discount_context": lambda s, d: X.discount_context(X.whole_texts(with_extras(s, d))),
    "a18_vote_country": lambda s, d: X.vote_country(X.whole_texts(lines(s, d))),
    "c21_check_totals": _checked,
}

_AM = lambda p=X.AMOUNT, t="text": f"list_transform(regexp_extract_all({t}, {q(p)}, 1), lambda x: TRY_CAST(replace(x, ',', '') AS DECIMAL(16,2)))"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {0}) = 1"
_VOTE = {c: f"len(regexp_extract_all(text, {q(m)}))" for _, c, _, m, _ in X.CURRENCY}
_STRUCTURE = f"""SELECT doc_id,
  CASE WHEN {_VOTE['UK']} >= {_VOTE['US']} AND {_VOTE['UK']} >= {_VOTE['EU']} THEN 'GBP' WHEN {_VOTE['US']} >= {_VOTE['EU']} THEN 'USD' ELSE 'EUR' END AS currency,
  CASE WHEN uk >= us AND uk >= eu THEN 'GBP' WHEN us >= eu THEN 'USD' ELSE 'EUR' END AS tax_system,
  (SELECT r FROM (SELECT unnest(rates) AS r) GROUP BY r ORDER BY count(*) DESC, r LIMIT 1) AS tax_rate,
  CASE WHEN flags >= 4 THEN 'complex' WHEN flags >= 2 THEN 'moderate' ELSE 'simple' END AS complexity
  FROM (SELECT *, {', '.join(f"CASE WHEN regexp_matches(lower(text), {q(x[4])}) THEN 1 ELSE 0 END + CASE WHEN {_VOTE[x[1]]} > 0 THEN 2 ELSE 0 END AS {x[1].lower()}" for x in X.CURRENCY)},
    list_filter(list_transform(regexp_extract_all(text, '(\\d{{1,2}}(?:\\.\\d{{1,2}})?)\\s*%', 1), lambda x: TRY_CAST(x AS DECIMAL(5,2))), lambda x: x >= 5 AND x <= 30) AS rates,
    CAST(contains(lower(text), 'discount') AS INT) + CAST(regexp_matches(lower(text), 'vat|tax') AS INT) + CAST(regexp_matches(lower(text), 'service charge|tip') AS INT) + CAST(len(string_split(text, E'\\n')) > 15 AS INT) + CAST(regexp_matches(lower(text), 'visa|card') AS INT) AS flags
    FROM texts)"""
_N = " + ".join(f"CAST(contains(lower(text), {q(w)}) AS INT)" for w in X.DISCOUNT_WORDS)
_CONTEXT = f"""SELECT doc_id, n_words, CAST(CASE WHEN x THEN greatest(least(0.4 * n_words, 1) * 0.6, 0.3) ELSE least(0.4 * n_words, 1) END AS DECIMAL(4,2)) AS confidence,
  CASE WHEN x THEN greatest(least(0.4 * n_words, 1) * 0.6, 0.3) ELSE least(0.4 * n_words, 1) END > 0.3 AS has_discounts
  FROM (SELECT doc_id, {_N} AS n_words, regexp_matches(lower(text), {q('|'.join(X.DISCOUNT_EXCLUDED))}) AS x FROM texts)"""
_BUSINESS = " + ".join(f"CASE WHEN regexp_matches(text, {q(p if p.startswith('^[A-Z') else '(?i)' + p)}) THEN CAST({v} AS DECIMAL(4,2)) ELSE CAST(0 AS DECIMAL(4,2)) END" for p, v in X.BUSINESS)


def _amounts_sql(source: str) -> str:
    """The rules in SQL: what stands behind an amount is read with it, as there is no look-ahead."""
    x = "regexp_replace(regexp_replace(x, '[Oo]', '0', 'g'), '\\s', '', 'g')"
    comma, point = f"length({x}) - instr(reverse({x}), ',')", f"length({x}) - instr(reverse({x}), '.')"
    value = f"""TRY_CAST(CASE WHEN contains({x}, ',') AND contains({x}, '.') AND {point} > {comma} THEN replace({x}, ',', '') WHEN contains({x}, ',') AND contains({x}, '.') OR regexp_matches({x}, '^[^,]*,\\d{{2}}$') THEN replace(replace({x}, '.', ''), ',', '.') ELSE replace({x}, ',', '') END AS DECIMAL(16,2))"""
    parts = []
    for r, p in X.AMOUNT_RULES:
        p = q("(?i)" + p.replace(r"(?!\d)", r"(?:\D|$)").replace("(?=", "(?:"))
        found = f"list_filter(list_transform(regexp_extract_all(text, {p}, 1), lambda x: {{'v': {value}, 'p': regexp_matches({x}, '[.,]\\d{{2}}$')}}), lambda y: y.v BETWEEN 0.01 AND 999999.99)[1]"
        parts.append(f"SELECT doc_id, line_number, {r} AS rank, text, {found} AS f FROM {source} s")
    sure = "CAST(1 - 0.05 * rank + CASE WHEN rank < 6 THEN 0.1 ELSE 0 END + CASE WHEN f.p THEN 0.05 ELSE 0 END AS DECIMAL(4,2))"
    return f"""SELECT doc_id, line_number, f.v AS amount, rank, {sure} AS confidence, regexp_matches(text, {q(X.NEGATIVE)}) AS negative FROM ({' UNION ALL '.join(parts)}) WHERE f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, line_number ORDER BY {sure} DESC, rank) = 1"""


_TOKEN = r"\b([A-Z0-9_#-]*[0-9][A-Z0-9_#-]{3,19})\b"
_KW = r"(?i)\b(?:receipt|invoice|order|ref)\s*(?:no|number|#)[:\s#.]*([A-Za-z0-9_#-]{3,20})"
_TIERS = [f"nullif(regexp_extract(text, {q(_KW)}, 1), '')", *(f"nullif(regexp_extract(coalesce({c}, ''), {q(_TOKEN)}, 1), '')" for c in ("text", "nx", "bf"))]
_DEC = r"(\d+\.\d{2})"

ORACLE_SQL = {
    "flagship_totals": f"""{ALL_SQL}, paid AS (SELECT doc_id, line_number, list_max({_AM()}) AS amount FROM lines WHERE regexp_matches(text, {q(X.any_of(X.PAYABLE))}) AND NOT regexp_matches(text, {q(X.any_of(X.NOT_PAYABLE))})),
        best AS (SELECT * FROM paid WHERE amount IS NOT NULL {_FIRST.format('amount DESC, line_number')})
        SELECT best.doc_id, amount, line_type, confidence, subtotal AS item_sum, abs(amount - CAST(subtotal * CAST(1.20 AS DECIMAL(3,2)) AS DECIMAL(16,2))) > 1 AS finding FROM best JOIN bonused b ON b.doc_id = best.doc_id AND b.line_number = best.line_number JOIN sm ON sm.doc_id = best.doc_id""",
    "t4_payable_amounts": f"""{ON_LINES}, paid AS (SELECT doc_id, line_number, list_max({_AM()}) AS amount FROM lines WHERE regexp_matches(text, {q(X.any_of(X.PAYABLE))}) AND NOT regexp_matches(text, {q(X.any_of(X.NOT_PAYABLE))}))
        SELECT doc_id, amount, line_number, count(*) OVER (PARTITION BY doc_id) AS n_candidates FROM paid WHERE amount IS NOT NULL {_FIRST.format('amount DESC, line_number')}""",
    "t5_priority_amounts": f"""{ON_LINES}, c AS (SELECT doc_id, line_number, CASE {' '.join(f"WHEN regexp_matches(upper(text), {q(p)}) THEN {r}" for r, p, _ in X.SUBTOTALS)} END AS rank, {_AM()}[-1] AS amount FROM lines)
        SELECT doc_id, amount, CAST(CASE rank {' '.join(f'WHEN {r} THEN {v}' for r, _, v in X.SUBTOTALS)} END AS DECIMAL(3,2)) AS confidence, line_number FROM c WHERE rank IS NOT NULL AND amount IS NOT NULL {_FIRST.format('rank, line_number')}""",
    "t5_net_after_discount": f"""{ON_LINES}, c AS (SELECT doc_id, line_number, CASE {' '.join(f"WHEN contains(lower(text), {q(k)}) THEN {i}" for i, k in enumerate(X.NET_KEYWORDS))} END AS rank, list_max({_AM()}) AS amount FROM lines)
        SELECT doc_id, amount, rank, CAST(CASE WHEN rank < 7 THEN 0.95 - 0.05 * rank ELSE 0.80 - 0.05 * (rank - 7) END AS DECIMAL(4,2)) AS confidence FROM c WHERE rank IS NOT NULL AND amount IS NOT NULL {_FIRST.format('rank, line_number')}""",
    "c1_mine_amounts": f"""{ON_LINES}, a AS (SELECT doc_id, 3 + item_no AS line_number, price AS amount FROM it UNION ALL SELECT doc_id, 4 + n, subtotal FROM sm UNION ALL SELECT doc_id, 5 + n, CAST(subtotal * 0.20 AS DECIMAL(16,2)) FROM sm UNION ALL SELECT doc_id, 6 + n, CAST(subtotal * 1.20 AS DECIMAL(16,2)) FROM sm)
        SELECT doc_id, line_number, CAST(amount AS DECIMAL(16,2)) AS amount, CASE WHEN amount < 1000 THEN 0 ELSE 1 END AS rank, CAST(CASE WHEN amount < 1000 THEN 1.15 ELSE 1.10 END AS DECIMAL(4,2)) AS confidence, false AS negative FROM a WHERE amount BETWEEN 0.01 AND 999999.99""",
    "c1_amounts_in_documents": _amounts_sql("(SELECT doc_id, CAST(1 AS BIGINT) AS line_number, text FROM documents)"),
    "c2_mine_rates": f"""{ON_LINES}{EXTRAS_SQL} SELECT doc_id, line_number, TRY_CAST(x AS DECIMAL(5,2)) AS rate FROM (SELECT doc_id, line_number, unnest(regexp_extract_all(text, '(\\d{{1,3}}(?:\\.\\d{{1,2}})?)\\s*%', 1)) AS x FROM extras) WHERE TRY_CAST(x AS DECIMAL(5,2)) BETWEEN 0 AND 100""",
    "c3_mine_dates": f"""{ON_LINES} SELECT doc_id, CAST(min(o_orderdate) AS DATE) AS day, CAST(2 AS BIGINT) AS line_number, true AS labelled FROM sm JOIN orders ON o_orderkey = doc_id GROUP BY doc_id""",
    "c7_mine_tax_numbers": f"""{ON_LINES}{EXTRAS_SQL}, c AS (SELECT doc_id, line_number, regexp_replace(regexp_replace(regexp_extract(upper(text), 'VAT\\s*(?:REG(?:ISTRATION)?\\s*)?(?:NO|NUMBER|REG)[.:\\s]*([A-Z0-9 -]{{5,20}})', 1), '[^A-Z0-9-]', '', 'g'), '[A-Z]+$', '') AS number FROM extras)
        SELECT doc_id, number, line_number, CAST(0.90 AS DECIMAL(3,2)) AS confidence FROM c WHERE length(number) BETWEEN 7 AND 12 {_FIRST.format('line_number')}""",
    "w3_receipt_numbers": f"""{ON_LINES}, n AS (SELECT *, lead(text) OVER w AS nx, lag(text) OVER w AS bf FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_number, text)),
        c AS (SELECT doc_id, line_number, coalesce({', '.join(_TIERS)}) AS number, CASE {' '.join(f'WHEN {t} IS NOT NULL THEN {i}' for i, t in enumerate(_TIERS, 1))} END AS tier FROM n WHERE regexp_matches(text, '(?i)\\b(?:receipt|invoice|order|ref)\\s*(?:no|number|#)?'))
        SELECT doc_id, number, tier, line_number FROM c WHERE number IS NOT NULL {_FIRST.format('tier, line_number')}""",
    "w4_proximity_amounts": f"""{ON_LINES}, n AS (SELECT *, lead(text) OVER w AS nx, lag(text) OVER w AS bf FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_number, text)),
        c AS (SELECT *, {_AM(_DEC)}[-1] AS a, {_AM(_DEC, "coalesce(nx, '')")}[-1] AS b, {_AM(_DEC, "coalesce(bf, '')")}[-1] AS e FROM n WHERE regexp_matches(text, '(?i)cash tendered|visa|card'))
        SELECT doc_id, line_number, coalesce(a, b, e) AS amount, CASE WHEN a IS NOT NULL THEN 'line' WHEN b IS NOT NULL THEN 'next' WHEN e IS NOT NULL THEN 'previous' END AS where_found FROM c""",
    "w5_best_candidate": f"""{ON_LINES}, c AS ({' UNION ALL '.join(f"SELECT doc_id, line_number, '{f}' AS field, regexp_extract(text, {q(p)}, 1) AS value, CAST({s} AS DECIMAL(3,2)) AS score, {r} AS rule FROM lines WHERE regexp_matches(text, {q(p)})" for f, r, p, s in X.CANDIDATE_RULES)})
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, line_number, rule) = 1""",
    "w6_bottom_up_amount": f"""{ON_LINES}, c AS (SELECT doc_id, line_number, regexp_matches(text, '(?i)\\btotal\\b') AND NOT regexp_matches(text, '(?i)subtotal|saving') AS t, regexp_matches(text, '(?i)subtotal|net|vat') AS n, list_max({_AM(_DEC)}) AS amount FROM lines)
        SELECT doc_id, arg_max(amount, CASE WHEN t THEN line_number END) AS total, max(amount) FILTER (n) AS net, max(line_number) FILTER (t) AS line_number FROM c WHERE amount IS NOT NULL AND (t OR n) GROUP BY doc_id""",
    "w11_contextual_suppliers": f"""{ON_LINES}, c AS (SELECT doc_id, line_number, coalesce(nullif(regexp_extract(text, '(?i)(?:thank you for shopping at|welcome to)\\s+(.+)$', 1), ''), nullif(regexp_extract(text, '^(.+)\\s(?:LTD|LIMITED|PLC)$', 1), '')) AS name,
          (row_number() OVER (PARTITION BY doc_id ORDER BY line_number, text) - 1) * 100 / greatest(1, count(*) OVER (PARTITION BY doc_id) - 1) AS r FROM lines)
        SELECT doc_id, line_number, name, CAST(CASE WHEN r <= 10 THEN 0.9 WHEN r <= 25 THEN 0.7 WHEN r <= 75 THEN 0.5 ELSE 0.8 END AS DECIMAL(2,1)) AS weight FROM c WHERE name IS NOT NULL""",
    "c14_score_suppliers": f"""{ON_LINES} SELECT doc_id, line_number, text, CAST(least(greatest({_BUSINESS} + greatest(0.30 - 0.05 * (line_number - 1), 0.10) + CASE WHEN len(string_split(text, ' ')) BETWEEN 2 AND 5 THEN 0.10 ELSE 0 END, 0), 1) * 0.8 + 0.16 AS DECIMAL(5,3)) AS score FROM lines WHERE line_number <= 5""",
    "j4_match_suppliers": f"""{ON_LINES}, k AS (SELECT CAST(s_suppkey AS BIGINT) AS suppkey, upper(replace(s_name, '#', ' ')) AS name FROM supplier),
        h AS (SELECT doc_id, suppkey, line_number, length(name) AS n, CAST(CAST(greatest(0.30 - 0.05 * (line_number - 1), 0.10) + CASE WHEN upper(text) = name THEN 0.40 WHEN starts_with(upper(text), name) THEN 0.30 WHEN suffix(upper(text), name) THEN 0.25 ELSE 0.15 END AS DECIMAL(6,2)) / 1.8 AS DECIMAL(5,3)) AS score
          FROM lines JOIN k ON contains(upper(text), name) WHERE line_number <= 8)
        SELECT doc_id, suppkey, line_number, score FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC, line_number, suppkey) = 1""",
    "j11_locate_source_line": f"""{ON_LINES}, v AS (SELECT doc_id, substring(text, 7, 10) AS value FROM lines WHERE line_number = 2 UNION ALL SELECT doc_id, 'r' || lpad(CAST(doc_id AS VARCHAR), 8, '0') FROM lines WHERE line_number = 3 UNION ALL SELECT doc_id, 'not there' FROM lines WHERE line_number = 3)
        SELECT v.doc_id, value, min(line_number) AS line_number FROM v LEFT JOIN lines l ON l.doc_id = v.doc_id AND contains(lower(text), lower(value)) GROUP BY v.doc_id, value
        UNION ALL SELECT doc_id, substring(text, 13, 4) || '-' || substring(text, 10, 2) || '-' || substring(text, 7, 2), line_number FROM lines WHERE line_number = 2""",
    "a7_reconcile_totals": f"""{ON_LINES}{TOTALS_SQL} SELECT doc_id, subtotal AS item_sum, total, abs(subtotal + tax - total) > 1 AND abs(subtotal + tax - total) > total * 0.05 AS finding, abs(subtotal + tax - total) > greatest(total * 0.01, 0.02) AS error FROM totals""",
    "a14_analyze_structure": f"{ON_LINES}{EXTRAS_SQL}{TEXTS_SQL} {_STRUCTURE}",
    "a15_discount_context": f"{ON_LINES}{EXTRAS_SQL}{TEXTS_SQL} {_CONTEXT}",
    "a18_vote_country": f"""{ON_LINES}, texts AS (SELECT doc_id, string_agg(text, E'\\n' ORDER BY line_number) AS text FROM lines GROUP BY doc_id),
        v AS (SELECT doc_id, {', '.join(f"{_VOTE[x[1]]} + 2 * len(regexp_extract_all(lower(text), {q(x[4])})) AS {x[1].lower()}" for x in X.CURRENCY)} FROM texts)
        SELECT doc_id, CASE WHEN uk >= us AND uk >= eu THEN 'UK' WHEN us >= eu THEN 'US' ELSE 'EU' END AS country, CASE WHEN uk >= us AND uk >= eu THEN 'GBP' WHEN us >= eu THEN 'USD' ELSE 'EUR' END AS currency, CAST(greatest(uk, us, eu) AS INT) AS votes FROM v WHERE greatest(uk, us, eu) > 0""",
    "c21_check_totals": f"""{ON_LINES}{EXTRAS_SQL}{TEXTS_SQL}{TOTALS_SQL}, st AS ({_STRUCTURE}), cx AS ({_CONTEXT}),
        t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN total ELSE subtotal END AS s, CASE WHEN doc_id % 10 = 0 THEN subtotal WHEN doc_id % 11 = 0 THEN CAST(CAST(subtotal AS DECIMAL(18,4)) * 0.5 AS DECIMAL(16,2)) ELSE total END AS t FROM totals),
        j AS (SELECT t.*, tax_system = 'GBP' AND has_discounts AND s > t AS swap FROM t JOIN st USING (doc_id) JOIN cx USING (doc_id))
        SELECT doc_id, CASE WHEN swap THEN t ELSE s END AS subtotal, CASE WHEN swap THEN s ELSE t END AS total, swap AS swapped, CASE WHEN swap THEN t ELSE s END > CASE WHEN swap THEN s ELSE t END * 1.3 AS warning FROM j""",
}
