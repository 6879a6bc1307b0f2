"""Registered queries of the line operators and what they are checked against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperslip.operators import lines as L
from paperslip.plans.fixtures import lines, table
from paperslip.plans.lines_sql import ALL_SQL, NOISE_SQL, ON_LINES


def classified(spark, sf):
    return L.context_bonus(L.classify_lines(L.line_features(lines(spark, sf))))


def _labelled(spark, sf):
    docs = table(spark, sf, "documents")
    predicted = docs.select("doc_id", F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("predicted"), F.expr("CAST(CAST(doc_id % 100 AS DECIMAL(5,2)) / 100 AS DECIMAL(4,2))").alias("confidence"))
    return L.prefer_actual_class(predicted, table(spark, sf, "labels"))


def _routed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", (1 + F.col("doc_id") % 3).alias("page_count"), (F.col("n_chars") % 800).alias("width"))
    return L.route_layout(docs).select("doc_id", "route")


FEATURES = ["doc_id", "line_number", "position", "in_header", "in_footer", "n_chars", "n_words", "n_company_info", "n_transaction_summary", "n_tax_and_fees", "n_itemization", "n_payment", "n_date_and_time", "n_identification", "n_miscellaneous", "n_price", "n_percentage", "n_date", "n_number", "n_card_number", "n_postcode", "n_vat_number", "has_total_keywords", "has_price_and_quantity", "all_caps", "has_colon"]

def _typed(spark, sf):
    """Classified lines with a type by the document's payment and a level by the mean confidence of its lines."""
    rows = classified(spark, sf)
    mean = F.avg("confidence").over(Window.partitionBy("doc_id"))
    return rows.withColumns({"document_type": F.when(F.col("doc_id") % 3 == 0, "cash").when(F.col("doc_id") % 50 != 1, "card"), "confidence_level": F.when(mean >= F.expr("0.8BD"), "high").otherwise("low")})


QUERIES = {
    "fx1_lines": lines,
    "p1_line_features": lambda s, d: L.line_features(lines(s, d)).select(*FEATURES),
    "p2_classify_lines": lambda s, d: L.classify_lines(L.line_features(lines(s, d))).select("doc_id", "line_number", "line_type", "confidence", "rule", "priority", F.array_join("reasons", ",").alias("reasons")),
    "p3_filter_noise": lambda s, d: L.filter_noise(lines(s, d)),
    "p5_prefer_actual_class": _labelled,
    "p6_route_layout": _routed,
    "p7_normalize_corpus": lambda s, d: L.normalize_corpus(table(s, d, "documents")),
    "w1_context_bonus": lambda s, d: classified(s, d).select("doc_id", "line_number", "line_type", "confidence", "bonus"),
    "w10_tag_sections": lambda s, d: L.tag_sections(lines(s, d)),
    "u1_candidate_lines": lambda s, d: L.candidate_lines(classified(s, d).where(L.has_summary_words())),
    "u2_vat_candidates": lambda s, d: L.vat_candidates(classified(s, d)),
    "a1_classification_summary": lambda s, d: L.classification_summary(classified(s, d)),
    "a2_corpus_stats": lambda s, d: L.corpus_stats(_typed(s, d)),
    "a3_reconstruction_summary": lambda s, d: L.reconstruction_summary(table(s, d, "documents")),
}

ORACLE_SQL = {
    "fx1_lines": f"{ON_LINES} SELECT doc_id, line_number, text FROM lines",
    "p1_line_features": f"{ALL_SQL} SELECT {', '.join(FEATURES)} FROM features",
    "p2_classify_lines": f"{ALL_SQL} SELECT doc_id, line_number, line_type, confidence, rule, priority, array_to_string(reasons, ',') AS reasons FROM classified",
    "p3_filter_noise": f"{ON_LINES} SELECT doc_id, line_number, text FROM lines WHERE {NOISE_SQL}",
    "p5_prefer_actual_class": """
        SELECT d.doc_id, CASE WHEN hit THEN actual ELSE predicted END AS class, hit AS overridden FROM (
          SELECT d.doc_id, l.quality AS actual, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS predicted,
            coalesce(l.quality <> CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AND d.doc_id % 100 < 70, false) AS hit
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) d""",
    "p6_route_layout": """SELECT doc_id, CASE WHEN doc_id % 3 > 0 OR (n_chars % 800 >= 400 AND regexp_matches(lower(text), '(qty|quantity|description|unit price)')) THEN 'FULL_PAGE' ELSE 'VERTICAL' END AS route FROM documents""",
    "p7_normalize_corpus": r"""
        WITH a AS (SELECT doc_id, coalesce(text, '') AS b0, regexp_replace(coalesce(text, ''), '([A-Za-z])-\n([a-z])', '\1\2', 'g') AS b1 FROM documents),
        b AS (SELECT *, regexp_replace(b1, '([0-9.,])[Oo]([0-9]|\b)', '\g<1>0\2', 'g') AS b2x FROM a),
        c AS (SELECT *, regexp_replace(b1, '([0-9.,])[Oo]([0-9]|\b)', '\1' || '0' || '\2', 'g') AS b2 FROM a),
        d AS (SELECT *, regexp_replace(b2, '([0-9.,])[lI]([0-9]|\b)', '\1' || '1' || '\2', 'g') AS b3 FROM c),
        e AS (SELECT doc_id, b0, trim(regexp_replace(b3, '[ \t]+', ' ', 'g')) AS text,
            len(regexp_extract_all(b0, '([A-Za-z])-\n([a-z])')) + len(regexp_extract_all(b1, '([0-9.,])[Oo]([0-9]|\b)')) + len(regexp_extract_all(b2, '([0-9.,])[lI]([0-9]|\b)')) AS n FROM d)
        SELECT doc_id, text, CAST(n AS INT) AS n_corrections,
          CAST(greatest(0, least(1, 1 - least(0.02 * n, 0.3) + CASE WHEN n <= 2 THEN 0.05 ELSE 0 END - CASE WHEN length(text) * 2 < length(b0) THEN 0.2 ELSE 0 END)) AS DECIMAL(4,2)) AS confidence FROM e""",
    "w1_context_bonus": f"{ALL_SQL} SELECT doc_id, line_number, line_type, confidence, bonus FROM bonused",
    "w10_tag_sections": f"""{ON_LINES}
        SELECT doc_id, line_number, CASE WHEN max(CAST(contains(lower(text), 'thank you') AS INT)) OVER w = 1 THEN 'footer' WHEN max(CAST(regexp_matches(lower(text), '^(subtotal|total)') AS INT)) OVER w = 1 THEN 'totals'
          WHEN max(CAST(regexp_matches(lower(text), 'x £[0-9]') AS INT)) OVER w = 1 THEN 'items' ELSE 'header' END AS section,
          CAST(regexp_extract_all(text, '([0-9]+[.][0-9]{{2}})', 1)[-1] AS DECIMAL(16,2)) AS line_total
        FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_number, text ROWS UNBOUNDED PRECEDING)""",
    "u1_candidate_lines": f"{ALL_SQL} SELECT DISTINCT doc_id, line_number, text FROM bonused WHERE line_type IN ('SUMMARY_KEY_VALUE', 'VAT_DATA') OR regexp_matches(lower(text), 'total|balance|amount due')",
    "u2_vat_candidates": f"""{ALL_SQL} SELECT doc_id, line_number, text, line_type = 'VAT_DATA' AS known, NOT regexp_matches(text, '[0-9]') AS header
        FROM bonused WHERE line_type = 'VAT_DATA' OR contains(lower(text), 'vat') OR contains(lower(text), 'tax')""",
    "a1_classification_summary": f"""{ALL_SQL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line_type = 'ITEM_DATA') AS n_items, count(*) FILTER (line_type = 'SUMMARY_KEY_VALUE') AS n_summary,
        count(*) FILTER (line_type = 'VAT_DATA') AS n_vat, count(DISTINCT rule) AS n_rules, min(confidence) AS min_confidence, max(confidence) AS max_confidence, CAST(sum(confidence) AS DECIMAL(18,2)) AS sum_confidence,
        count(*) FILTER (confidence >= 0.9) AS n_very_high, count(*) FILTER (confidence >= 0.75 AND confidence < 0.9) AS n_high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.75) AS n_medium,
        bool_or(line_type = 'HEADER') AS has_header, bool_or(line_type = 'FOOTER') AS has_footer, count(*) FILTER (bonus > 0) AS n_bonus FROM bonused GROUP BY doc_id""",
    "a2_corpus_stats": f"""{ALL_SQL}, t AS MATERIALIZED (SELECT line_type, rule, CASE WHEN confidence >= 0.9 THEN 'very_high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS bucket,
            CASE WHEN doc_id % 3 = 0 THEN 'cash' WHEN doc_id % 50 <> 1 THEN 'card' END AS document_type, CASE WHEN avg(confidence) OVER (PARTITION BY doc_id) >= 0.8 THEN 'high' ELSE 'low' END AS confidence_level FROM bonused),
        g AS (SELECT document_type, confidence_level, line_type, rule, bucket, count(*) AS n, grouping(document_type) AS a, grouping(line_type) AS b, grouping(rule) AS c, grouping(bucket) AS e FROM t
            GROUP BY GROUPING SETS ((), (line_type), (rule), (line_type, rule), (bucket), (document_type, confidence_level), (document_type, confidence_level, line_type), (document_type, confidence_level, rule), (document_type, confidence_level, line_type, rule), (document_type, confidence_level, bucket)))
        SELECT CASE a WHEN 0 THEN 'type_level_' ELSE '' END || CASE WHEN e = 0 THEN 'bucket' WHEN b = 0 AND c = 0 THEN 'class_rule' WHEN b = 0 THEN 'class' WHEN c = 0 THEN 'rule' ELSE 'all' END AS grouping, document_type, confidence_level, line_type, rule, bucket, n,
            CAST(n * 100.0 / (SELECT max(h.n) FROM g h WHERE h.a = g.a AND h.b = 1 AND h.c = 1 AND h.e = 1 AND h.document_type IS NOT DISTINCT FROM g.document_type AND h.confidence_level IS NOT DISTINCT FROM g.confidence_level) AS DECIMAL(7,3)) AS percent FROM g""",
    "a3_reconstruction_summary": r"""
        WITH d AS (SELECT source, length(trim(coalesce(text, ''))) > 0 AS ok, CASE WHEN length(trim(coalesce(text, ''))) > 0 THEN len(string_split(text, E'\n')) ELSE 0 END AS k FROM documents)
        SELECT source, count(*) AS n_docs, count(*) FILTER (ok) AS n_ok, CAST(sum(k) AS BIGINT) AS n_lines, CAST(grouping(source) AS INT) AS overall,
          CAST(count(*) FILTER (ok) * 100.0 / count(*) AS DECIMAL(7,3)) AS success_percent FROM d GROUP BY ROLLUP (source)""",
}
ORACLE_SQL["p7_normalize_corpus"] = ORACLE_SQL["p7_normalize_corpus"].replace(r"""        b AS (SELECT *, regexp_replace(b1, '([0-9.,])[Oo]([0-9]|\b)', '\g<1>0\2', 'g') AS b2x FROM a),
""", "")
