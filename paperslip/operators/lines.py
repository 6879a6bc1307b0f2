"""Line operators: features, rule cascade, context bonus, noise, normalisation, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: keyword categories and patterns that the class thresholds depend on
KEYWORDS = {
    "company_info": ["ltd", "limited", "plc", "inc", "corp", "store", "shop", "market", "pharmacy", "supermarket", "express", "tesco", "sainsbury", "asda", "morrisons", "aldi", "lidl", "co-op", "waitrose"],
    "transaction_summary": ["total", "subtotal", "sub-total", "sub total", "balance", "due", "amount", "sum", "net", "gross", "final", "grand total"],
    "tax_and_fees": ["vat", "tax", "rate", "duty", "levy", "@", "%", "percent", "inclusive", "exclusive", "exempt", "zero rated"],
    "itemization": ["qty", "quantity", "description", "item", "product", "price", "each", "unit", "per", "x", "amount", "line", "no."],
    "payment": ["card", "debit", "credit", "visa", "mastercard", "amex", "cash", "contactless", "chip", "pin", "payment", "paid", "tender", "change", "auth code", "terminal", "aid", "pan"],
    "date_and_time": ["date", "time", "am", "pm", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"],
    "identification": ["receipt", "transaction", "sale", "purchase", "order", "ref", "reference", "number", "id", "seq", "till", "register", "operator"],
    "miscellaneous": ["thank you", "thanks", "welcome", "come again", "visit", "customer service", "opening hours", "phone", "tel", "www", "website", "email", "address", "postcode"],
}
PATTERNS = {
    "price": r"(?i)[£$€¥]?\s*\d+[.,]\d{2}|[£$€¥]\s*\d+|\d+[.,]\d{2}\s*[£$€¥]",
    "percentage": r"(?i)\d+[.,]?\d*\s*%|@\s*\d+[.,]?\d*",
    "date": r"(?i)\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{2,4}[/-]\d{1,2}[/-]\d{1,2}",
    "time": r"(?i)\d{1,2}:\d{2}(?::\d{2})?(?:\s*[ap]m)?",
    "phone": r"(?i)(?:\+44\s?)?0\d{3,4}\s?\d{3,4}\s?\d{3,4}|\d{11}",
    "email": r"(?i)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "website": r"(?i)www\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}|[a-zA-Z0-9.-]+\.com",
    "number": r"\b\d+\b",
    "card_number": r"(?i)\*+\d{4}|x+\d{4}",
    "postcode": r"(?i)[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2}",
    "vat_number": r"(?i)(?:vat\s*(?:no\.?|number))?\s*:?\s*\d{9,12}",
}
#: What a text must hold for a pattern to match: some sign in it, or a quicker pattern; most lines lack it.
ASKED = {
    "percentage": ("%", "@"),
    "date": ("/", "-"),
    "time": (":",),
    "phone": r"\d{4}",
    "email": ("@",),
    "website": ("www.", ".com"),
    "card_number": r"(?i)[*x]\d{4}",
    "vat_number": r"\d{9}",
}
#: Families of lines that are not names or items.
NOISE = {
    "date": r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    "tax": r"(?i)^\s*(?:vat|tax)\b",
    "receipt_number": r"(?i)^\s*(?:receipt|invoice|order)\s*(?:no|number|#)",
    "totals": r"(?i)^\s*(?:sub\s?total|total|balance|amount due)\b",
    "card": r"\*{4,}\d{4}",
    "politeness": r"(?i)thank you|come again|welcome",
}


def _hits(words: list[str]) -> Column:
    """How many of the words the text has. By way of an array: a sum of a term per word is a method too large for the JVM's compiler and runs interpreted."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains("_t", w)))


def _count(name: str) -> Column:
    """How often a pattern matches, looked for only where the text holds what it asks for."""
    n, asked = F.regexp_count("text", F.lit(PATTERNS[name])), ASKED.get(name)
    if asked is None:
        return n
    able = F.col("text").rlike(asked) if isinstance(asked, str) else F.lit(False)
    for sign in asked if isinstance(asked, tuple) else ():
        able = able | F.contains("_t", F.lit(sign))
    return F.when(able, n).otherwise(0)


def _apart(value: Column) -> Column:
    """The same value by way of an array, which Spark computes outside of whole-stage code: there a step is cut into
    small methods, while as one method the features were too large for the JVM's compiler and ran interpreted."""
    return F.get(F.transform(F.array(value), lambda x: x), F.lit(0))


def line_features(lines: DataFrame) -> DataFrame:
    """Counts, position and flags of every line; one window per document, no other shuffle.

    Position is i / max(1, n - 1); header up to 0.25, footer from 0.75. A null text is an empty line.
    """
    by_doc = Window.partitionBy("doc_id")
    t = F.lower(F.trim("text"))
    base = lines.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_t", t)
    n, i = F.count(F.lit(1)).over(by_doc), F.row_number().over(by_doc.orderBy("line_number", "text")) - 1
    ratio = (i.cast("decimal(10,0)") / F.greatest(F.lit(1).cast("long"), n - 1).cast("decimal(10,0)")).cast("decimal(12,6)")
    base = base.withColumn("position", ratio)
    base = base.withColumns({f"n_{k}": _hits(v) for k, v in KEYWORDS.items()} | {f"n_{k}": _count(k) for k in PATTERNS} | {"n_price": _apart(_count("price"))})
    has = lambda *w: _hits(list(w)) > 0
    trimmed = F.trim("text")
    flags = {
        "is_first": F.col("position") == 0,
        "in_header": F.col("position") <= 0.25,
        "in_footer": F.col("position") >= 0.75,
        "n_chars": F.length("text"),
        "n_words": F.regexp_count("text", F.lit("[^ ]+")),
        "has_qty_description": (has("qty", "quantity")) & has("description"),
        "has_total_keywords": has("total", "subtotal", "balance", "due"),
        "has_vat_keywords": has("vat", "tax", "@"),
        "has_price_and_quantity": (F.col("n_price") > 0) & (F.col("n_number") > 0),
        "has_contact_info": (F.col("n_phone") > 0) | (F.col("n_email") > 0) | (F.col("n_website") > 0),
        "all_caps": (trimmed == F.upper(trimmed)) & (trimmed != F.lower(trimmed)) & (F.length(trimmed) > 2),
        "has_colon": F.contains("text", F.lit(":")),
    }
    base = base.withColumns(flags)
    return base.withColumn("has_alignment", (F.col("n_words") >= 2) & F.contains("text", F.lit("   "))).drop("_t")


def _points(*terms: tuple[str, Column]) -> Column:
    """A capped sum of points, exact: added as whole hundredths."""
    hundredths = F.least(sum((F.when(when, round(100 * float(points))).otherwise(0) for points, when in terms), F.lit(0)), F.lit(100))
    return (hundredths.cast("decimal(3,0)") * F.expr("0.01BD")).cast("decimal(6,2)")


def _each(points: str, count: str, most: str) -> list[tuple[str, Column]]:
    """min(points x count, most) as steps."""
    from decimal import Decimal

    step, cap, out, k = Decimal(points), Decimal(most), [], 1
    while cap > 0:
        out.append((str(min(step, cap)), F.col(count) >= k))
        cap -= step
        k += 1
    return out


def scores() -> dict[str, Column]:
    c = F.col
    body = ~c("in_header") & ~c("in_footer")
    price, percent = c("n_price") > 0, c("n_percentage") > 0
    return {
        "s_item_header": _points(("0.6", c("has_qty_description")), ("0.5", c("n_itemization") >= 3), ("0.3", c("n_itemization") == 2), ("0.1", c("n_itemization") == 1), ("0.2", c("in_header")), ("0.15", c("has_alignment")), ("0.1", c("all_caps"))),
        "s_summary": _points(("0.5", c("has_total_keywords")), *_each("0.2", "n_transaction_summary", "0.4"), ("0.3", price), ("0.1", ~c("in_header")), ("0.1", c("has_colon") | c("has_alignment"))),
        "s_vat_data": _points(("0.4", c("has_vat_keywords")), *_each("0.15", "n_tax_and_fees", "0.3"), ("0.4", percent), ("0.2", price)),
        "s_header_area": _points(("0.3", c("in_header")), *_each("0.2", "n_company_info", "0.4"), ("0.2", c("is_first")), ("0.1", c("all_caps"))),
        "s_footer_area": _points(("0.3", c("in_footer")), *_each("0.2", "n_miscellaneous", "0.4"), ("0.2", c("has_contact_info")), *_each("0.1", "n_payment", "0.2")),
        "s_item_data": _points(("0.4", price), ("0.2", body), ("0.1", c("n_number") > 0), ("0.3", c("has_price_and_quantity"))),
        "s_vat_header": _points(("0.5", c("has_vat_keywords") & ~percent), *_each("0.2", "n_tax_and_fees", "0.4")),
    }


#: (priority, condition, class, confidence, rule): the first that holds.
CASCADE = [
    (1, "length(trim(text)) <= 2", "IGNORE", "0.95", "ignore_empty"),
    (2, "s_item_header >= 0.75", "ITEM_HEADER", "s_item_header", "item_header_strong"),
    (3, "s_summary >= 0.75", "SUMMARY_KEY_VALUE", "s_summary", "summary_strong"),
    (4, "s_vat_data >= 0.75", "VAT_DATA", "s_vat_data", "vat_data_strong"),
    (5, "in_header AND s_header_area >= 0.6", "HEADER", "s_header_area", "header_area"),
    (6, "in_footer AND s_footer_area >= 0.6", "FOOTER", "s_footer_area", "footer_area"),
    (7, "s_item_data >= 0.6", "ITEM_DATA", "s_item_data", "item_data_price"),
    (8, "s_item_header >= 0.6", "ITEM_HEADER", "s_item_header", "item_header_weak"),
    (9, "s_summary >= 0.6", "SUMMARY_KEY_VALUE", "s_summary", "summary_weak"),
    (10, "s_vat_header >= 0.6", "VAT_HEADER", "s_vat_header", "vat_header"),
    (11, "in_header", "HEADER", "0.3", "position_header"),
    (12, "in_footer", "FOOTER", "0.3", "position_footer"),
    (13, "true", "IGNORE", "0.2", "position_body"),
]


def classify_lines(features: DataFrame) -> DataFrame:
    """(doc_id, line_number, text, line_type, confidence, rule, priority, reasons) by the first rule of the cascade."""
    scored = features.withColumns(scores())
    made = [F.struct(F.lit(kind).alias("line_type"), F.expr(f"CAST({value} AS DECIMAL(6,2))").alias("confidence"), F.lit(rule).alias("rule"), F.lit(p).alias("priority")) for p, _, kind, value, rule in CASCADE]
    pick = made[-1]
    for (_, condition, *_), out in reversed(list(zip(CASCADE[:-1], made[:-1], strict=True))):
        pick = F.when(F.expr(condition), out).otherwise(pick)
    reasons = F.array_compact(F.array(*(F.when(F.col(flag), F.lit(flag)) for flag in ("has_total_keywords", "has_vat_keywords", "has_price_and_quantity", "has_contact_info", "all_caps"))))
    return scored.withColumn("_c", pick).select("doc_id", "line_number", "text", "_c.*", reasons.alias("reasons"), "position")


def context_bonus(classified: DataFrame) -> DataFrame:
    """Adds 0.05 to an item line after an item or its header, 0.1 to a summary line with an item among the three lines before; at most 1."""
    w = Window.partitionBy("doc_id").orderBy("line_number", "text")
    before = F.lag("line_type").over(w)
    recent = F.max((F.col("line_type") == "ITEM_DATA").cast("int")).over(w.rowsBetween(-3, -1))
    bonus = F.when((F.col("line_type") == "ITEM_DATA") & before.isin("ITEM_DATA", "ITEM_HEADER"), F.expr("0.05BD")).when((F.col("line_type") == "SUMMARY_KEY_VALUE") & (recent == 1), F.expr("0.10BD")).otherwise(F.expr("0.00BD"))
    return classified.withColumn("bonus", bonus.cast("decimal(4,2)")).withColumn("confidence", F.least((F.col("confidence") + F.col("bonus")).cast("decimal(6,2)"), F.lit("1").cast("decimal(6,2)")))


def filter_noise(lines: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Lines that no noise pattern of the families matches."""
    keep = F.lit(True)
    for f in families or list(NOISE):
        keep = keep & ~F.coalesce(F.col("text").rlike(NOISE[f]), F.lit(False))
    return lines.where(keep)


def prefer_actual_class(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled class where it differs and confidence is below 0.7; (doc_id, class, overridden)."""
    joined = predicted.join(labels.select("doc_id", F.col("quality").alias("actual")), "doc_id", "left")
    over = F.coalesce((F.col("actual") != F.col("predicted")) & (F.col("confidence") < F.expr("0.70BD")), F.lit(False))
    return joined.select("doc_id", F.when(over, F.col("actual")).otherwise(F.col("predicted")).alias("class"), over.alias("overridden"))


def route_layout(docs: DataFrame) -> DataFrame:
    """FULL_PAGE for more than one page, or a wide page with table words; else VERTICAL."""
    table = F.lower("text").rlike("(qty|quantity|description|unit price)")
    return docs.withColumn("route", F.when((F.col("page_count") > 1) | ((F.col("width") >= 400) & table), "FULL_PAGE").otherwise("VERTICAL"))


#: (name, pattern, replacement) in order.
REPAIRS = [("hyphen", r"([A-Za-z])-\n([a-z])", "$1$2"), ("zero", r"([0-9.,])[Oo]([0-9]|\b)", "${1}0$2"), ("one", r"([0-9.,])[lI]([0-9]|\b)", "${1}1$2"), ("blanks", r"[ \t]+", " ")]


def normalize_corpus(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_corrections, confidence): joined words, repaired digits, single blanks.

    confidence = 1 - min(0.02 n, 0.3), + 0.05 up to two corrections, - 0.2 if the text halved; within 0 and 1.
    """
    text, count = F.coalesce("text", F.lit("")), F.lit(0)
    for name, pattern, to in REPAIRS:
        if name != "blanks":
            count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_before"), F.trim(text).alias("text"), count.alias("n_corrections"))
    n = F.col("n_corrections")
    value = F.expr("1.00BD - least(0.02BD * n_corrections, 0.30BD)") + F.when(n <= 2, F.expr("0.05BD")).otherwise(F.expr("0.00BD")) - F.when(F.length("text") * 2 < F.length("_before"), F.expr("0.20BD")).otherwise(F.expr("0.00BD"))
    return out.withColumn("confidence", F.greatest(F.least(value, F.expr("1.00BD")), F.expr("0.00BD")).cast("decimal(4,2)")).drop("_before")


def candidate_lines(classified: DataFrame) -> DataFrame:
    """Lines of summary or VAT classes, and lines with total words; each once."""
    known = F.col("line_type").isin("SUMMARY_KEY_VALUE", "VAT_DATA") | F.lower("text").rlike("total|balance|amount due")
    row = F.struct("line_number", "text")
    return classified.select("doc_id", F.inline(F.when(known, F.array(row)))).distinct()  # a filter would be moved down and compute each score wherever a rule names it


def has_summary_words() -> Column:
    """Whether a line has a word of totals or taxes: by `scores`, no other line reaches 0.6 as a summary or 0.75 as VAT data.

    As a filter on classified lines it is moved down to where lines get their position, so that the others are not scored.
    """
    words = ["total", "balance", "due", "vat", *KEYWORDS["transaction_summary"], *KEYWORDS["tax_and_fees"]]
    return F.lower("text").rlike("|".join(map(re.escape, dict.fromkeys(words))))


def vat_candidates(classified: DataFrame) -> DataFrame:
    """VAT lines, and VAT-like lines of other classes; `known` tells them apart, `header` marks those without digits."""
    known = F.col("line_type") == "VAT_DATA"
    row = F.struct("doc_id", "line_number", "text", known.alias("known"), (~F.col("text").rlike("[0-9]")).alias("header"))
    return classified.select(F.inline(F.when(known | F.lower("text").rlike("vat|tax"), F.array(row))))  # a filter would be moved down and compute the class again


def tag_sections(lines: DataFrame) -> DataFrame:
    """header, items, totals or footer as a running state over the lines; item rows with the last price as total."""
    w = Window.partitionBy("doc_id").orderBy("line_number", "text").rowsBetween(Window.unboundedPreceding, 0)
    t = F.lower("text")
    seen = lambda p: F.max(t.rlike(p).cast("int")).over(w)
    state = F.when(seen("thank you") == 1, "footer").when(seen("^(subtotal|total)") == 1, "totals").when(seen("x £[0-9]") == 1, "items").otherwise("header")
    prices = F.regexp_extract_all("text", F.lit(r"([0-9]+[.][0-9]{2})"), F.lit(1))
    return lines.select("doc_id", "line_number", state.alias("section"), F.try_element_at(prices, F.lit(-1)).cast("decimal(16,2)").alias("line_total"))


def classification_summary(classified: DataFrame) -> DataFrame:
    """Per document: lines, confidence statistics and buckets, what was found, bonuses."""
    c = F.col
    return classified.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(c("line_type") == "ITEM_DATA").alias("n_items"),
        F.count_if(c("line_type") == "SUMMARY_KEY_VALUE").alias("n_summary"),
        F.count_if(c("line_type") == "VAT_DATA").alias("n_vat"),
        F.count_distinct("rule").alias("n_rules"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.sum("confidence").cast("decimal(18,2)").alias("sum_confidence"),
        F.count_if(c("confidence") >= F.expr("0.90BD")).alias("n_very_high"),
        F.count_if((c("confidence") >= F.expr("0.75BD")) & (c("confidence") < F.expr("0.90BD"))).alias("n_high"),
        F.count_if((c("confidence") >= F.expr("0.60BD")) & (c("confidence") < F.expr("0.75BD"))).alias("n_medium"),
        F.bool_or(c("line_type") == "HEADER").alias("has_header"),
        F.bool_or(c("line_type") == "FOOTER").alias("has_footer"),
        F.count_if(c("bonus") > 0).alias("n_bonus"),
    )


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= F.expr("0.90BD"), "very_high").when(confidence >= F.expr("0.75BD"), "high").when(confidence >= F.expr("0.60BD"), "medium").otherwise("low")


def corpus_stats(classified: DataFrame) -> DataFrame:
    """Lines over document type x confidence level, in all and by class, by rule, by class and rule and by bucket; the same over all documents. `percent` is of the lines of the type and level.

    (grouping, document_type, confidence_level, line_type, rule, bucket, n, percent); grouping names the set, as a null
    may also be a value. One pass with grouping sets.
    """
    both = ["document_type", "confidence_level"]
    parts = {"all": [], "class": ["line_type"], "rule": ["rule"], "class_rule": ["line_type", "rule"], "bucket": ["bucket"]}
    columns = [*both, "line_type", "rule", "bucket"]
    rows = classified.withColumn("bucket", confidence_bucket(F.col("confidence")))
    sets = [[F.col(c) for c in [*own, *by]] for own in ([], both) for by in parts.values()]
    stats = rows.groupingSets(sets, *map(F.col, columns)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_id"))
    names = {sum(1 << i for i, c in enumerate(reversed(columns)) if c not in [*own, *by]): (bool(own), name) for own in ([], both) for name, by in parts.items()}
    kind, within = F.lit(None).cast("string"), F.lit(False)
    for number, (own, name) in names.items():
        kind, within = F.when(F.col("_id") == number, name).otherwise(kind), F.when(F.col("_id") == number, own).otherwise(within)
    stats = stats.withColumns({"grouping": kind, "_own": within})
    total = F.max(F.when(F.col("grouping") == "all", F.col("n"))).over(Window.partitionBy("_own", *both))  # rows of sets, not of documents
    percent = (F.col("n").cast("decimal(18,0)") * 100 / total.cast("decimal(18,0)")).cast("decimal(7,3)")
    return stats.select(F.when(F.col("_own"), F.concat(F.lit("type_level_"), "grouping")).otherwise(F.col("grouping")).alias("grouping"), *columns, "n", percent.alias("percent"))


def reconstruction_summary(docs: DataFrame) -> DataFrame:
    """Per source and in all: documents, those with text, lines, success rate."""
    ok = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    n_lines = F.when(ok, F.size(F.split("text", "\n"))).otherwise(0)
    out = docs.select("source", ok.alias("ok"), n_lines.cast("long").alias("k")).rollup("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("ok").alias("n_ok"), F.sum("k").alias("n_lines"), F.grouping("source").cast("int").alias("overall"))
    return out.withColumn("success_percent", (F.col("n_ok").cast("decimal(18,0)") * 100 / F.col("n_docs").cast("decimal(18,0)")).cast("decimal(7,3)"))
