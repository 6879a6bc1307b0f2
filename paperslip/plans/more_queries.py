"""Registered queries of layout, payment, contact and knowledge-base operators and what they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperslip.operators import fields as X
from paperslip.operators import knowledge as K
from paperslip.operators import layout as Y
from paperslip.operators import payment as P
from paperslip.operators import retrieval as R
from paperslip.operators import vat as V
from paperslip.plans.field_queries import ORACLE_SQL as FIELD_SQL
from paperslip.plans.field_queries import EXTRAS_SQL, TEXTS_SQL, with_extras
from paperslip.plans.fixtures import WORDS_SQL, items, lines, table, words
from paperslip.plans.lines_sql import ON_LINES, q

ON_WORDS = f"{ON_LINES}, {WORDS_SQL}"


def with_contact(spark, sf):
    """Receipt lines (numbers times ten) with address, post code, telephone and change lines."""
    base = lines(spark, sf)
    tens = base.select("doc_id", (F.col("line_number") * 10).alias("line_number"), "text")
    first, total = base.where("line_number = 1").select("doc_id"), base.where("text LIKE 'TOTAL %'")
    pick = lambda n, text: first.select("doc_id", F.lit(n).cast("long").alias("line_number"), text.alias("text"))
    address = pick(11, F.concat((F.col("doc_id") % 300 + 1).cast("string"), F.lit(" HIGH STREET")))
    code = pick(12, F.concat(F.lit("LEEDS LS"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" 4AB"))).where("doc_id % 3 = 0")
    phone = pick(13, F.concat(F.lit("TEL: 0113 496 0"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")))
    change = total.where("doc_id % 4 = 0").select("doc_id", (F.col("line_number") * 10 + 5).alias("line_number"), F.concat(F.lit("CHANGE DUE £"), (F.col("doc_id") % 20).cast("string"), F.lit(".50")).alias("text"))
    return tens.unionByName(address).unionByName(code).unionByName(phone).unionByName(change)


CONTACT_SQL = """, contact AS (SELECT doc_id, line_number * 10 AS line_number, text FROM lines
  UNION ALL SELECT doc_id, 11, CAST(doc_id % 300 + 1 AS VARCHAR) || ' HIGH STREET' FROM lines WHERE line_number = 1
  UNION ALL SELECT doc_id, 12, 'LEEDS LS' || CAST(doc_id % 9 + 1 AS VARCHAR) || ' 4AB' FROM lines WHERE line_number = 1 AND doc_id % 3 = 0
  UNION ALL SELECT doc_id, 13, 'TEL: 0113 496 0' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') FROM lines WHERE line_number = 1
  UNION ALL SELECT doc_id, line_number * 10 + 5, 'CHANGE DUE £' || CAST(doc_id % 20 AS VARCHAR) || '.50' FROM lines WHERE starts_with(text, 'TOTAL ') AND doc_id % 4 = 0)"""


def _when(rules, t="text"):
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {q(p)}) THEN '{k}'" for k, p in rules) + " END"


PAYMENTS_SQL = f""", payments AS (SELECT doc_id, line_number, {_when(P.METHODS)} AS method, CAST(0.6 + CASE WHEN regexp_matches(text, '(?i)^(?:cash|visa|card)') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '\\*{{4,}}\\d{{4}}') THEN 0.2 ELSE 0 END AS DECIMAL(3,1)) AS confidence
  FROM lines WHERE {_when(P.METHODS)} IS NOT NULL AND NOT regexp_matches(text, '(?i)card reader|cashew'))"""
_CONTEXT_SQL = FIELD_SQL["a15_discount_context"].rsplit(TEXTS_SQL, 1)[1]
DETAILS_SQL = f"""{EXTRAS_SQL}{TEXTS_SQL}, context AS ({_CONTEXT_SQL}), details AS (SELECT doc_id, line_number, {_when(P.DISCOUNT_KINDS)} AS kind, TRY_CAST(nullif(regexp_extract(text, '(\\d+\\.\\d{{2}})', 1), '') AS DECIMAL(16,2)) AS amount FROM extras
  WHERE doc_id IN (SELECT doc_id FROM context WHERE has_discounts) AND NOT regexp_matches(text, '(?i)^(?:sub)?total|^vat') AND regexp_matches(text, '(?i)discount|saving|offer|% off|voucher'))"""


def _kb(spark, sf):
    b = table(spark, sf, "benchmark")
    kind = F.when(F.col("item_id") % 3 == 0, "tax_rule").when(F.col("item_id") % 3 == 1, "layout_pattern").otherwise("template")
    return b.select(K.kb_id(kind, F.concat(F.lit("item="), F.col("item_id").cast("string")), F.col("text")).alias("id"), kind.alias("doc_type"), F.col("text").alias("content"), F.lit(1).alias("version"))


KB_SQL = """kb AS (SELECT substring(md5(kind || '|item=' || CAST(item_id AS VARCHAR) || '|' || substring(text, 1, 100)), 1, 16) AS id, kind AS doc_type, text AS content, 1 AS version, item_id
  FROM (SELECT *, CASE item_id % 3 WHEN 0 THEN 'tax_rule' WHEN 1 THEN 'layout_pattern' ELSE 'template' END AS kind FROM benchmark))"""


def _updates(spark, sf):
    old = _kb(spark, sf).join(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("content")), "content").where("item_id % 2 = 0").select("id", "doc_type", F.concat(F.lit("v2 "), "content").alias("content"), F.lit(2).alias("version"))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    new = docs.select(K.kb_id(F.lit("learned"), F.concat(F.lit("doc="), F.col("doc_id").cast("string")), F.col("text")).alias("id"), F.lit("learned").alias("doc_type"), F.col("text").alias("content"), F.lit(1).alias("version"))
    return old.unionByName(new)


def _search(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id IS NOT NULL")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), e


_COS = "round(list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])), 6)"
UNIT_SQL = "u0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u FROM u0)"


def _by_index(spark, sf):
    """The same search through cells, as many as find 0.95 of the best rows."""
    queries, kb = _search(spark, sf)
    index = R.build_index(kb, ["label"])
    return K.similarity_topk(queries, index, 10, ["label"], R.probes_for(index, kb, queries, 10, ["label"]))


def _with_retry(spark, sf):
    """Every third query asks for a label that no row has."""
    queries, kb = _search(spark, sf)
    return R.with_retry(queries.withColumn("label", F.when(F.col("query_id") % 3 == 0, -1).otherwise(F.col("label"))), kb, 5, ["label"])


_TYPES = [t for t, _, _ in K.QUOTAS]


def _retrieved(spark, sf):
    """Labels as types; countries and vendor types by id, some rows for all vendors, some queries without either."""
    queries, kb = _search(spark, sf)
    one_of = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    rows = kb.select("vec_id", "embedding", one_of(_TYPES, F.pmod("label", F.lit(4))).alias("doc_type"), one_of(["UK", "FR", "US"], F.col("vec_id") % 3).alias("country"), one_of(["grocery", "petrol", "universal", "other"], F.col("vec_id") % 4).alias("vendor_type"))
    asked = queries.select("query_id", "embedding", F.when(F.col("query_id") % 100 != 0, one_of(["UK", "FR", "US"], F.col("query_id") % 3)).alias("country"), F.when(F.col("query_id") % 60 != 0, one_of(["grocery", "petrol"], F.col("query_id") % 2)).alias("vendor_type"))
    return K.retrieve_context(asked, rows, least=0.05)


def _sources(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    now = d.where("CAST(path AS BIGINT) % 10 <> 0")
    before = d.where("CAST(path AS BIGINT) % 10 <> 1").withColumn("digest", F.when(F.col("path").cast("long") % 10 == 2, F.lit("old")).otherwise(F.col("digest")))
    return K.detect_changes(now, before)


def _quota(spark, sf):
    e = table(spark, sf, "events")
    p = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "auto").otherwise("review").alias("mode"), (F.col("event_id") % 3 + 1).alias("n"), "ts")
    return K.daily_quota(p, {"auto": 100, "review": 50})


def _context(spark, sf):
    hits = table(spark, sf, "benchmark").select((F.col("item_id") % 7).alias("query_id"), F.col("item_id").alias("rank"), "text")
    return K.build_context(hits)


def _vendors(spark, sf):
    """Receipts with addresses and telephones; every third supplier is of another country, every fourth has a second pattern, within words; telephones are those of some receipts."""
    key = F.col("s_suppkey").cast("long")
    name = F.replace("s_name", F.lit("#"), F.lit(" "))
    known = table(spark, sf, "supplier").select(
        key.alias("vendor"), F.explode(F.array_compact(F.array(name, F.when(key % 4 == 0, F.substring(name, 2, 30))))).alias("name"), F.when(key % 3 == 0, "FR").otherwise("UK").alias("country"), F.when(key % 5 == 0, "grocery").alias("type"),
        F.when(key % 2 == 0, F.array(F.lit("High Street"), F.lit("Leeds"))).alias("address"), F.concat(F.lit("0113 496 0"), F.lpad((key % 1000).cast("string"), 3, "0")).alias("phone"),
    )
    receipts = with_contact(spark, sf)
    countries = receipts.where("line_number = 10 AND doc_id % 5 <> 0").select("doc_id", F.lit("UK").alias("country"))
    return K.match_vendors(receipts, known, countries)


def _neighbour(spark, sf):
    return P.apply_rules(lines(spark, sf), P.NEIGHBOUR_RULES)


def _rules_sql(rules):
    fields = list(dict.fromkeys(r["field"] for r in rules))
    parts = []
    for f in fields:
        values = []
        for i, r in enumerate(rules):
            if r["field"] == f:
                group = lambda c: f"nullif(regexp_extract(coalesce({c}, ''), {q(r['pattern'])}, 1), '')"  # noqa: B023, E731
                v = {"regex_extract": lambda: group("text"), "regex_match_line": lambda: f"CASE WHEN regexp_matches(text, {q(r['pattern'])}) THEN text END", "look_ahead": lambda: f"CASE WHEN regexp_matches(text, {q(r['trigger'])}) THEN {group('nx')} END", "look_behind": lambda: f"CASE WHEN regexp_matches(bf, {q(r['trigger'])}) THEN {group('text')} END", "constant": lambda: f"CASE WHEN regexp_matches(text, {q(r['pattern'])}) THEN {q(r['value'])} END"}[r["strategy"]]()  # noqa: B023
                values.append((i, v))
        rule = "CASE " + " ".join(f"WHEN {v} IS NOT NULL THEN {i}" for i, v in values) + " END"
        parts.append(f"SELECT doc_id, line_number, '{f}' AS field, coalesce({', '.join(v for _, v in values)}) AS value, {rule} AS rule FROM n")
    return f"{ON_LINES}, n AS (SELECT *, lead(text) OVER w AS nx, lag(text) OVER w AS bf FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_number, text)) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


#: A line of each kind of card detail, in the order of the kinds.
CARD_LINES = [("Auth Code: 1234", "authorization_code"), ("************1234", "primary_account_number"), ("AID: A000", "application_identifier"), ("TID: 77", "terminal_info"), ("VISA DEBIT ****1234", "card_brand"), ("Contactless", "payment_method_type"), ("Apple Pay", "digital_wallet"), ("PIN OK", "transaction_status"), ("12:30", "transaction_timestamp"), ("a fee of £5", "transaction_fee"), ("Batch 12", "receipt_reference"), ("CVV shown", "security_info"), ("Payment made", "card_processing_info"), ("nothing at all", "other_card_detail"), ("VISA auth code 5 approved", "authorization_code"), ("Visa Apple Pay", "card_brand")]


def _card_lines(spark, sf):
    text = F.element_at(F.array(*(F.lit(t) for t, _ in CARD_LINES)), (F.col("doc_id") % len(CARD_LINES) + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")).distinct().select("doc_id", F.lit(1).cast("long").alias("line_number"), text.alias("text"))


def _stated(spark, sf):
    """Every tenth receipt states its total discount, every seventh twice, with one amount of none first."""
    docs = lines(spark, sf).where("line_number = 3").select("doc_id")
    line = lambda n, text: docs.where("doc_id % 10 = 0 OR doc_id % 7 = 0").select("doc_id", F.lit(n).cast("long").alias("line_number"), text.alias("text"))
    return line(950, F.when(F.col("doc_id") % 7 == 0, "Total savings: £0.00").otherwise("nothing")).unionByName(line(951, F.concat(F.lit("YOU SAVED: £1,0"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(".25")))).unionByName(line(952, F.lit("discount: 3.00")))


def _headed(spark, sf):
    """Receipts of four kinds of heads: the supplier's line as it is, a greeting, a date before an unknown company, and an unknown name."""
    kind = F.col("doc_id") % 4
    own = F.when(F.col("line_number") != 1, F.col("text")).when(kind == 0, F.col("text")).when(kind == 1, F.lit("Welcome to the corner house")).when(kind == 2, F.concat(F.lit("Unknown "), F.col("doc_id").cast("string"), F.lit(" Ltd"))).otherwise(F.concat(F.lit("  nameless "), F.col("doc_id").cast("string")))
    rows = lines(spark, sf).select("doc_id", F.col("line_number") + 1, own.alias("text")).toDF("doc_id", "line_number", "text")
    return rows.unionByName(rows.where("line_number = 2").select("doc_id", F.lit(1).cast("long").alias("line_number"), F.lit("12/05/2023").alias("text")))


def _suppliers_by_rules(spark, sf):
    names = table(spark, sf, "supplier").select(F.explode(F.array(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit("Supplier"))).alias("name"))
    return P.supplier_by_rules(_headed(spark, sf), P.SUPPLIER_RULES, names, excludes=("subtotal",))


QUERIES = {
    "x1_supplier_by_rules": _suppliers_by_rules,
    "x1_net_by_rules": lambda s, d: P.amount_by_rules(with_contact(s, d), P.NET_RULES),
    "a16_ocr_confidence": lambda s, d: Y.ocr_confidence(table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id")), words(s, d)),
    "t1_reconstruct_lines": lambda s, d: Y.reconstruct_lines(words(s, d)),
    "w8_group_words": lambda s, d: Y.group_words(words(s, d)),
    "w12_tallest_text": lambda s, d: Y.tallest_text(words(s, d)),
    "j13_label_below": lambda s, d: Y.label_below(words(s, d)),
    "j14_context_below": lambda s, d: Y.context_below(words(s, d)),
    "j15_nearest_overlap_above": lambda s, d: Y.nearest_overlap_above(words(s, d)),
    "j16_validate_domains": lambda s, d: Y.validate_domains(table(s, d, "pages")),
    "c9_tag_payments": lambda s, d: P.tag_payments(lines(s, d)),
    "t3_best_payment": lambda s, d: P.best_payment(P.tag_payments(lines(s, d))),
    "c10_tag_card_details": lambda s, d: P.tag_card_details(_card_lines(s, d)),
    "c10_count_card_details": lambda s, d: P.count_card_details(P.tag_card_details(lines(s, d).where(F.col("text").rlike("^(?:CASH|VISA)")))),
    "c6_mine_cards": lambda s, d: P.mine_cards(lines(s, d)),
    "j12_enrich_payments": lambda s, d: P.enrich_payments(P.tag_payments(lines(s, d)), lines(s, d)),
    "a11_payment_summary": lambda s, d: P.payment_summary(P.tag_payments(lines(s, d))),
    "c11_tag_change": lambda s, d: P.tag_change(with_contact(s, d)),
    "c4_mine_phones": lambda s, d: P.mine_phones(table(s, d, "documents")),
    "c5_mine_contacts": lambda s, d: P.mine_contacts(table(s, d, "documents")),
    "c5_contacts_in_pages": lambda s, d: P.mine_contacts(table(s, d, "pages"), "page_id", "html"),
    "c8_mine_postcodes": lambda s, d: P.mine_postcodes(X.whole_texts(with_contact(s, d).where("line_number IN (11, 12, 13)"))),
    "w9_address_blocks": lambda s, d: P.address_blocks(with_contact(s, d)),
    "j17_discount_details": lambda s, d: P.discount_details(with_extras(s, d), X.discount_context(X.whole_texts(with_extras(s, d)))),
    "a10_discount_totals": lambda s, d: P.discount_totals(P.discount_details(with_extras(s, d), X.discount_context(X.whole_texts(with_extras(s, d)))), with_extras(s, d).unionByName(_stated(s, d))),
    "c12_parse_vat_lines": lambda s, d: V.parse_vat_lines(with_extras(s, d)),
    "a8_vat_summary": lambda s, d: P.vat_summary(V.parse_vat_lines(with_extras(s, d))),
    "c13_consolidate_suppliers": lambda s, d: P.consolidate_suppliers(lines(s, d).where("line_number = 1").select(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" TILL 4"))).when(F.col("doc_id") % 3 == 1, F.lower("text")).otherwise(F.col("text")).alias("name"))),
    "t2_top_n": lambda s, d: P.top_n(items(s, d).select("doc_id", "item_no", "name", "price"), ["doc_id"], [F.desc("price"), "item_no"], 3),
    "x1_apply_rules": lambda s, d: P.apply_rules(lines(s, d), P.RULES),
    "w2_neighbour_extract": _neighbour,
    "s5_chunk_documents": lambda s, d: K.chunk_documents(table(s, d, "documents")),
    "u4_upsert_kb": lambda s, d: K.upsert_kb(_kb(s, d), _updates(s, d)),
    "u5_delete_kb": lambda s, d: K.delete_kb(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), table(s, d, "embeddings").where("label % 2 = 1").select(F.col("vec_id").alias("id"))),
    "u6_detect_changes": _sources,
    "a12_kb_stats": lambda s, d: K.kb_stats(table(s, d, "embeddings"), "label"),
    "j1_similarity_topk": lambda s, d: K.similarity_topk(*_search(s, d), 10, ["label"]),
    "j1_index_topk": _by_index,
    "j1_topk_with_retry": _with_retry,
    "j2_retrieve_context": _retrieved,
    "c16_build_context": _context,
    "j3_match_vendors": _vendors,
    "w7_daily_quota": _quota,
}

ORACLE_SQL = {
    "x1_supplier_by_rules": f"""{ON_LINES} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Supplier' || substr(text, 9, length(text) - 12) WHEN 1 THEN 'The Corner House' WHEN 2 THEN 'Unknown ' || doc_id || ' Ltd' ELSE 'nameless ' || doc_id END AS name,
        CAST(2 AS BIGINT) AS line_number, CAST(doc_id % 4 AS INT) AS rule FROM lines WHERE line_number = 1""",
    "x1_net_by_rules": f"{ON_LINES} SELECT doc_id, subtotal AS amount FROM sm WHERE subtotal > 0",
    "a16_ocr_confidence": f"{ON_WORDS} SELECT k AS doc_id, CAST(coalesce(CAST(sum(confidence) AS DOUBLE) / count(confidence), 0.8) AS DECIMAL(6,4)) AS confidence FROM (SELECT DISTINCT o_orderkey AS k FROM orders) LEFT JOIN words ON doc_id = k GROUP BY k",
    "t1_reconstruct_lines": f"{ON_LINES} SELECT doc_id, line_number, text FROM lines",
    "w8_group_words": f"{ON_WORDS} SELECT w.doc_id, w.word_id // 1000 AS line_number, any_value(l.text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words w JOIN lines l ON l.doc_id = w.doc_id AND l.line_number = w.word_id // 1000 GROUP BY ALL",
    "w12_tallest_text": f"{ON_WORDS} SELECT doc_id, arg_min(text, word_id) AS text, 12 AS height FROM words WHERE NOT regexp_matches(text, '(?i)^(?:receipt|total|date:?)$') GROUP BY doc_id",
    "j13_label_below": f"""{ON_WORDS}, p AS (SELECT l.doc_id, l.word_id AS label_id, w.text FROM words l JOIN words w ON w.doc_id = l.doc_id AND w.y0 > l.y1 AND w.y0 - l.y1 < 150 AND length(w.text) >= 3 WHERE regexp_matches(l.text, '(?i)^(?:date|no|receipt):?$') QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.word_id ORDER BY w.y0, w.x0, w.word_id) = 1)
        SELECT doc_id, label_id, text, CAST(0.80 + greatest(0.05 - 0.01 * (row_number() OVER (PARTITION BY doc_id ORDER BY label_id) - 1), 0) AS DECIMAL(4,2)) AS confidence FROM p""",
    "j14_context_below": f"""{ON_WORDS} SELECT c.doc_id, c.word_id, count(w.word_id) AS n, CAST(least(0.15 * count(w.word_id), 0.3) AS DECIMAL(4,2)) AS bonus FROM words c LEFT JOIN words w ON w.doc_id = c.doc_id AND w.y0 > c.y1 AND w.y0 - c.y1 < 100 AND regexp_matches(w.text, {q(Y.ADDRESS_WORDS)}) WHERE regexp_matches(c.text, '(?i)^(?:ltd|limited)$') GROUP BY ALL""",
    "j15_nearest_overlap_above": f"""{ON_WORDS}, a AS (SELECT * FROM words WHERE regexp_matches(text, '^(?:TOTAL|LIMITED)$') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY y0, word_id) = 1)
        SELECT a.doc_id, a.word_id AS anchor_id, w.text FROM a JOIN words w ON w.doc_id = a.doc_id AND w.y1 <= a.y0 AND w.x0 < a.x1 AND w.x1 > a.x0 QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY w.y1 DESC, w.word_id) = 1""",
    "j16_validate_domains": r"""WITH p AS (SELECT page_id, regexp_extract(url, 'https?://(?:www\.)?([^/:]+)', 1) AS domain, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages), l AS (SELECT *, string_split(domain, '.')[1] AS label FROM p),
        n AS (SELECT *, list_filter(regexp_split_to_array(t, '[^A-Za-z0-9]+'), lambda w: contains(lower(w), lower(label)))[1] AS name FROM l)
        SELECT page_id, domain, CASE WHEN length(label) > 0 AND name IS NOT NULL THEN name ELSE label END AS name, CAST(CASE WHEN length(label) > 0 AND name IS NOT NULL THEN 0.9 ELSE 0.4 END AS DECIMAL(2,1)) AS confidence FROM n""",
    "c9_tag_payments": f"{ON_LINES}{PAYMENTS_SQL} SELECT * FROM payments",
    "t3_best_payment": f"{ON_LINES}{PAYMENTS_SQL} SELECT * FROM payments QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, line_number) = 1",
    "c10_tag_card_details": "SELECT DISTINCT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS line_number, [" + ", ".join(q(k) for _, k in CARD_LINES) + f"][o_orderkey % {len(CARD_LINES)} + 1] AS kind FROM orders",
    "c10_count_card_details": f"{ON_LINES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'other_card_detail' ELSE 'primary_account_number' END AS kind, CAST(1 AS BIGINT) AS n FROM sm",
    "c6_mine_cards": f"""{ON_LINES}, m AS (SELECT doc_id, line_number, regexp_extract(text, {q(P.CARD)}, 2) AS last4, length(regexp_extract(text, {q(P.CARD)}, 1)) AS n FROM lines)
        SELECT doc_id, last4, CASE WHEN n >= 11 THEN 1 WHEN n > 0 THEN 2 ELSE 3 END AS tier, line_number FROM m WHERE last4 <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n >= 11 THEN 1 WHEN n > 0 THEN 2 ELSE 3 END, line_number) = 1""",
    "j12_enrich_payments": f"""{ON_LINES}{PAYMENTS_SQL}, r AS (SELECT doc_id, line_number, nullif(lower(regexp_extract(text, '(?i)(visa|mastercard|amex)', 1)), '') AS brand, nullif(regexp_extract(text, '\\*{{4,}}(\\d{{4}})', 1), '') AS last4 FROM lines),
        s AS (SELECT doc_id, arg_max(last4, line_number) FILTER (last4 IS NOT NULL) AS last4, arg_min(brand, line_number) FILTER (brand IS NOT NULL) AS brand FROM r GROUP BY doc_id)
        SELECT p.doc_id, line_number, method, CASE WHEN method IN ('card', 'masked') THEN last4 END AS last4, CASE WHEN method IN ('card', 'masked') THEN brand END AS brand FROM payments p LEFT JOIN s ON s.doc_id = p.doc_id""",
    "a11_payment_summary": f"{ON_LINES}{PAYMENTS_SQL} SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods, bool_or(method IN ('card', 'masked')) AS has_card, bool_or(method = 'cash') AS has_cash FROM payments GROUP BY doc_id",
    "c11_tag_change": f"""{ON_LINES}{CONTACT_SQL}, r AS (SELECT doc_id, line_number, TRY_CAST(nullif(regexp_extract(text, '(\\d+\\.\\d{{2}})', 1), '') AS DECIMAL(16,2)) AS amount, CASE WHEN contains(lower(text), 'due') THEN 'due' WHEN contains(lower(text), 'given') THEN 'given' ELSE 'plain' END AS kind FROM contact WHERE regexp_matches(text, {q(P.CHANGE)}) AND NOT regexp_matches(text, '(?i)exchange|change of'))
        SELECT doc_id, amount, kind FROM r WHERE amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_number DESC) = 1""",
    "c4_mine_phones": f"WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(P.PHONE)}, 1)) AS x FROM documents), n AS (SELECT DISTINCT doc_id, regexp_replace(x, '[^0-9]', '', 'g') AS number FROM x) SELECT number, count(*) AS n_docs FROM n WHERE length(number) BETWEEN 9 AND 13 GROUP BY number",
    "c5_mine_contacts": " UNION ALL ".join(f"SELECT '{k}' AS kind, lower(v) AS value, CAST(sum(n) AS BIGINT) AS n_docs FROM (SELECT v, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(p)}, 1)) AS v FROM documents) GROUP BY v) GROUP BY lower(v)" for k, p in (("email", P.EMAIL), ("website", P.SITE))),
    "c5_contacts_in_pages": " UNION ALL ".join(f"SELECT '{k}' AS kind, lower(v) AS value, CAST(sum(n) AS BIGINT) AS n_docs FROM (SELECT v, count(DISTINCT page_id) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, {q(p)}, 1)) AS v FROM pages) GROUP BY v) GROUP BY lower(v)" for k, p in (("email", P.EMAIL), ("website", P.SITE))),
    "c8_mine_postcodes": f"""{ON_LINES}{CONTACT_SQL}, t AS (SELECT doc_id, string_agg(text, E'\\n' ORDER BY line_number) AS text FROM contact WHERE line_number IN (11, 12, 13) GROUP BY doc_id)
        SELECT * FROM (SELECT doc_id, coalesce({', '.join(f"nullif(regexp_extract(text, {q(p)}, 1), '')" for _, _, p in P.POSTCODES)}) AS code, CASE {' '.join(f"WHEN regexp_matches(text, {q(p)}) THEN '{c}'" for _, c, p in P.POSTCODES)} END AS country FROM t) WHERE code IS NOT NULL""",
    "w9_address_blocks": f"""{ON_LINES}{CONTACT_SQL} SELECT doc_id, 1 AS block, 11 AS first_line, CASE WHEN doc_id % 3 = 0 THEN 12 ELSE 11 END AS last_line, string_agg(text, ', ' ORDER BY line_number) AS text FROM contact WHERE line_number IN (11, 12) GROUP BY doc_id""",
    "j17_discount_details": f"{ON_LINES}{DETAILS_SQL} SELECT * FROM details",
    "a10_discount_totals": f"""{ON_LINES} SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR doc_id % 7 = 0 THEN CAST(1000.25 + doc_id % 100 AS DECIMAL(16,2)) ELSE CAST(doc_id % 90 + 1.5 AS DECIMAL(16,2)) END AS total, doc_id % 10 = 0 OR doc_id % 7 = 0 AS stated FROM sm WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""",
    "c12_parse_vat_lines": f"""{ON_LINES} SELECT doc_id, 5 + n AS line_number, 'word_at_rate' AS layout, CAST(NULL AS VARCHAR) AS code, CAST(20 AS DECIMAL(5,2)) AS rate, CAST(NULL AS DECIMAL(16,2)) AS net, CAST(subtotal * 0.20 AS DECIMAL(16,2)) AS vat, CAST(NULL AS DECIMAL(16,2)) AS total, true AS consistent FROM sm""",
    "a8_vat_summary": f"{ON_LINES} SELECT doc_id, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS n_rate, CAST(0 AS BIGINT) AS n_net, CAST(1 AS BIGINT) AS n_vat, CAST(0 AS BIGINT) AS n_total FROM sm",
    "c13_consolidate_suppliers": f"""{ON_LINES}, w AS (SELECT array_to_string(list_transform(string_split(lower(text), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS name, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS key FROM lines WHERE line_number = 1),
        k AS (SELECT key, name, count(*) AS n FROM w GROUP BY ALL) SELECT key, min(name) AS name, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_variants FROM k GROUP BY key""",
    "t2_top_n": f"{ON_LINES} SELECT doc_id, item_no, name, price, row_number() OVER (PARTITION BY doc_id ORDER BY price DESC, item_no) AS rank FROM it QUALIFY rank <= 3",
    "x1_apply_rules": _rules_sql(P.RULES),
    "w2_neighbour_extract": _rules_sql(P.NEIGHBOUR_RULES),
    "s5_chunk_documents": "SELECT doc_id, k AS chunk, substring(text, k * 960 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(CAST(greatest(length(text) - 41, 0) // 960 + 1 AS BIGINT))) AS k FROM documents WHERE text IS NOT NULL)",
    "u4_upsert_kb": f"""WITH {KB_SQL}, r AS (SELECT id, doc_type, content, version FROM kb UNION ALL SELECT k.id, k.doc_type, 'v2 ' || k.content, 2 FROM kb k JOIN benchmark b ON b.text = k.content WHERE b.item_id % 2 = 0
          UNION ALL SELECT substring(md5('learned|doc=' || CAST(doc_id AS VARCHAR) || '|' || substring(text, 1, 100)), 1, 16), 'learned', text, 1 FROM documents WHERE text IS NOT NULL)
        SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, content) = 1""",
    "u5_delete_kb": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 1)",
    "u6_detect_changes": "SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 10 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (0, 1, 2)",
    "a12_kb_stats": "SELECT label AS doc_type, count(*) AS n FROM embeddings GROUP BY ROLLUP (label)",
    "j1_similarity_topk": f"WITH {UNIT_SQL}, p AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS relevance FROM u a JOIN u b ON a.label = b.label WHERE a.vec_id % 20 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_id) AS rank FROM p QUALIFY rank <= 10",
    "j1_topk_with_retry": f"WITH {UNIT_SQL}, p AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS relevance, a.vec_id % 3 <> 0 AS filtered FROM u a JOIN u b ON a.label = b.label OR a.vec_id % 3 = 0 WHERE a.vec_id % 20 = 0) SELECT query_id, vec_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_id) AS rank, filtered FROM p QUALIFY rank <= 5",
    "j2_retrieve_context": f"""WITH {UNIT_SQL}, p AS (SELECT a.vec_id AS query_id, ['field_definition', 'tax_rule', 'layout_pattern', 'template'][b.label % 4 + 1] AS doc_type, b.vec_id, {_COS} AS relevance FROM u a JOIN u b
            ON CASE b.label % 4 WHEN 0 THEN true WHEN 2 THEN a.vec_id % 60 = 0 OR b.vec_id % 4 IN (a.vec_id % 2, 2) ELSE a.vec_id % 100 = 0 OR a.vec_id % 3 = b.vec_id % 3 END WHERE a.vec_id % 20 = 0),
        k AS (SELECT * FROM p WHERE relevance >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id, doc_type ORDER BY relevance DESC, vec_id) <= CASE doc_type WHEN 'field_definition' THEN 5 WHEN 'template' THEN 2 ELSE 3 END)
        SELECT *, count(*) OVER (PARTITION BY query_id) AS n_hits FROM k""",
    "c16_build_context": r"""WITH t AS (SELECT item_id % 7 AS query_id, item_id, substring(regexp_replace(regexp_replace(regexp_replace(text, '[*xX]{4,}[ -]?\d{4}|\b(?:\d{4}[ -]?){3}\d{4}\b', '[card]', 'g'), '\d{2}/\d{2}/\d{4}', '[date]', 'g'), '\d+(?:\.\d+)?', '[n]', 'g'), 1, 150) AS t FROM benchmark)
        SELECT query_id, substring(string_agg(t, E'\n' ORDER BY item_id), 1, 1500) AS context FROM t WHERE trim(t) <> '' GROUP BY query_id""",
    "j3_match_vendors": f"""{ON_LINES}{CONTACT_SQL}, v AS (SELECT CAST(s_suppkey AS BIGINT) AS vendor, upper(replace(s_name, '#', ' ')) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'FR' ELSE 'UK' END AS country, CASE WHEN s_suppkey % 5 = 0 THEN 'grocery' ELSE 'other' END AS type, s_suppkey % 2 = 0 AS placed, s_suppkey % 4 = 0 AS two, '0113 496 0' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS phone FROM supplier),
        t AS (SELECT doc_id, string_agg(text, E'\\n' ORDER BY line_number) AS text FROM contact GROUP BY doc_id),
        h AS (SELECT DISTINCT doc_id, vendor FROM contact JOIN v ON contains(upper(text), name) WHERE doc_id % 5 = 0 OR country = 'UK'),
        c AS (SELECT h.doc_id, h.vendor, type, (CASE WHEN two THEN 3 ELSE 2 END + CASE WHEN placed AND contains(text, 'HIGH STREET') THEN 0.5 ELSE 0 END + CASE WHEN placed AND contains(text, 'LEEDS') THEN 0.5 ELSE 0 END + CASE WHEN contains(text, phone) THEN 0.5 ELSE 0 END) / CASE WHEN two THEN 6 ELSE 4 END AS c FROM h JOIN v ON v.vendor = h.vendor JOIN t ON t.doc_id = h.doc_id),
        b AS (SELECT * FROM c WHERE c >= 0.4 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY least(c, 1) DESC, vendor) = 1)
        SELECT t.doc_id, vendor, coalesce(type, CASE WHEN regexp_matches(text, 'SUPERMARKET|GROCERY|FRESH|MART|STORE|SHOP') THEN 'grocery' WHEN regexp_matches(text, 'PETROL|FUEL|GAS STATION|PUMP|SHELL|BP|EXXON') THEN 'petrol' ELSE 'other' END) AS vendor_type, CAST(CASE WHEN c IS NULL THEN 0.3 ELSE least(c, 1) END AS DECIMAL(6,4)) AS confidence FROM t LEFT JOIN b ON b.doc_id = t.doc_id""",
    "w7_daily_quota": """SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'auto' ELSE 'review' END AS mode, coalesce(sum(event_id % 3 + 1) OVER (PARTITION BY CAST(ts AS DATE), event_id % 2 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < CASE WHEN event_id % 2 = 0 THEN 100 ELSE 50 END AS admitted FROM events""",
}
