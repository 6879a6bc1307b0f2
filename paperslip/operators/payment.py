"""Payment and contact operators: tags, cards, change, phones, addresses, discounts, VAT lines, configured rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperslip.operators.dictionary import first_known

# fixed values: tags by the first keyword family that occurs
METHODS = [("digital", r"(?i)apple pay|google pay|paypal"), ("cash", r"(?i)\bcash\b|bargeld|especes|efectivo|contanti"), ("online", r"(?i)bank transfer|online"), ("card", r"(?i)\bvisa\b|mastercard|amex|debit|credit|maestro"), ("voucher", r"(?i)voucher|gift card"), ("masked", r"\*{4,}\d{4}")]
# fixed values: kinds of card details, the first that fits
DETAILS = [
    ("authorization_code", r"(?i)auth\s*code|authorization\s*code|auth\s*#|approval\s*code|reference\s*#|ref\s*#|transaction\s*#|txn\s*#|approval\s*#|trace\s*#"),
    ("primary_account_number", r"[*Xx]{11,16}\d{4}|[*Xx]{16}"),
    ("application_identifier", r"(?i)aid\s*[:=]"),
    ("terminal_info", r"(?i)(?:terminal|tid|merchant|mid|location|store)\s*[:=]"),
    ("card_brand", r"(?i)mastercard|master card|mc card|\bmc\b|visa|amex|american express|am ex|americanexpress|discover|maestro|jcb|diners"),
    ("payment_method_type", r"(?i)contactless|chip and pin|chip & pin|magnetic stripe|swipe|insert|tap|wave|nfc|emv"),
    ("digital_wallet", r"(?i)apple pay|google pay|samsung pay|android pay|paypal|apple wallet"),
    ("transaction_status", r"(?i)approved|declined|verified|pin ok|signature"),
    ("transaction_timestamp", r"\d{2}[:/]\d{2}[:/]\d{2,4}|\d{2}[:/]\d{2}"),
    ("transaction_fee", r"(?i)(?:fee|charge).*[£$€]\d+|[£$€]\d+.*(?:fee|charge)"),
    ("receipt_reference", r"(?i)(?:receipt|batch|sequence)\s*#?\s*\d+"),
    ("security_info", r"(?i)cv[v2]|security\s*code"),
    ("card_processing_info", r"(?i)card|payment|transaction|processed"),
]
OTHER_DETAIL = "other_card_detail"
# fixed values: lines that state a receipt's total discount
DISCOUNT_TOTALS = r"(?i)(?:discount|total\s+discount|discount\s+total|total\s+savings?|you\s+saved?)\s*:\s*[£$]?([\d,]+\.?\d*)"
CHANGE = r"(?i)\bchange\b|wechselgeld|monnaie|cambio|resto"
DISCOUNT_KINDS = [("percentage", r"(?i)\d+\s*%"), ("loyalty", r"(?i)loyalty|club"), ("voucher", r"(?i)voucher|coupon"), ("offer", r"(?i)offer|promotion"), ("staff", r"(?i)staff"), ("other", r"(?i)discount|saving")]
POSTCODES = [(1, "UK", r"\b([A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})\b"), (2, "US", r"\b(\d{5}-\d{4})\b"), (3, "CA", r"\b([A-Z]\d[A-Z] \d[A-Z]\d)\b"), (4, "IN", r"\b(\d{6})\b"), (5, "AU", r"\b(\d{4})\b")]
EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
SITE = r"((?:https?://|www\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
PHONE = r"(\(?\+?\d{2,4}\)?[ -]?\d{3,4}[ -]\d{3,4})"
CARD = r"(?:(\*{11,16}|\*{4,10}|[xX]{4,12})|(?:ending in) )(\d{4})"


def first_of(rules: list[tuple[str, str]], text: str = "text") -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.col(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tag_payments(lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, method, confidence): +0.1 for a keyword at the start, +0.2 for a masked number, on 0.6."""
    tagged = lines.withColumn("method", first_of(METHODS)).where("method IS NOT NULL AND NOT text RLIKE '(?i)card reader|cashew'")
    confidence = F.expr("0.6BD") + F.when(F.col("text").rlike(r"(?i)^(?:cash|visa|card)"), F.expr("0.1BD")).otherwise(F.expr("0.0BD")) + F.when(F.col("text").rlike(r"\*{4,}\d{4}"), F.expr("0.2BD")).otherwise(F.expr("0.0BD"))
    return tagged.select("doc_id", "line_number", "method", confidence.cast("decimal(3,1)").alias("confidence"))


def best_payment(payments: DataFrame) -> DataFrame:
    """The payment of the highest confidence per document, the first line of equals."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "line_number")
    return payments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tag_card_details(lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, kind): the kind of each line of card details, the first of the list that fits, `other_card_detail` if none does."""
    return lines.where("text IS NOT NULL").select("doc_id", "line_number", F.coalesce(first_of(DETAILS), F.lit(OTHER_DETAIL)).alias("kind"))


def count_card_details(details: DataFrame) -> DataFrame:
    """(doc_id, kind, n): lines by kind of card detail."""
    return details.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def mine_cards(lines: DataFrame) -> DataFrame:
    """(doc_id, last4, tier, line_number): the strictest mask per document: 11 to 16 signs, fewer, or `ending in`."""
    last4, mask = F.regexp_extract("text", CARD, 2), F.regexp_extract("text", CARD, 1)
    found = lines.select("doc_id", "line_number", last4.alias("last4"), F.when(F.length(mask) >= 11, 1).when(F.length(mask) > 0, 2).otherwise(3).alias("tier")).where("last4 <> ''")
    w = Window.partitionBy("doc_id").orderBy("tier", "line_number")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "last4", "tier", "line_number")


def enrich_payments(payments: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, method, last4, brand): card payments with the last masked number and the first brand of their document."""
    brand = F.nullif(F.lower(F.regexp_extract("text", r"(?i)(visa|mastercard|amex)", 1)), F.lit(""))
    last4 = F.nullif(F.regexp_extract("text", r"\*{4,}(\d{4})", 1), F.lit(""))
    rows = lines.select("doc_id", "line_number", brand.alias("brand"), last4.alias("last4")).where("brand IS NOT NULL OR last4 IS NOT NULL")
    at = F.col("line_number")
    per = rows.groupBy("doc_id").agg(F.max_by("last4", F.when(F.col("last4").isNotNull(), at)).alias("last4"), F.min_by("brand", F.when(F.col("brand").isNotNull(), at)).alias("brand"))
    card = F.col("method").isin("card", "masked")
    return payments.join(per, "doc_id", "left").select("doc_id", "line_number", "method", F.when(card, F.col("last4")).alias("last4"), F.when(card, F.col("brand")).alias("brand"))


def tag_change(lines: DataFrame) -> DataFrame:
    """(doc_id, amount, kind): the last change line with an amount."""
    amount = F.regexp_extract("text", r"(\d+\.\d{2})", 1).try_cast("decimal(16,2)")
    rows = lines.where(F.col("text").rlike(CHANGE) & ~F.col("text").rlike("(?i)exchange|change of")).select("doc_id", "line_number", amount.alias("amount"), F.when(F.lower("text").contains("due"), "due").when(F.lower("text").contains("given"), "given").otherwise("plain").alias("kind")).where("amount IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.max_by("amount", "line_number").alias("amount"), F.max_by("kind", "line_number").alias("kind"))


def payment_summary(payments: DataFrame) -> DataFrame:
    """(doc_id, n, methods, has_card, has_cash)."""
    return payments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), F.bool_or(F.col("method").isin("card", "masked")).alias("has_card"), F.bool_or(F.col("method") == "cash").alias("has_cash"))


def mine_values(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(value, n_docs): distinct matches with the number of documents that have them."""
    each = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("value"))
    return each.groupBy("value").agg(F.count(F.lit(1)).alias("n_docs"))


def mine_phones(docs: DataFrame) -> DataFrame:
    """(number, n_docs): phone-like numbers of 9 to 13 digits as digits."""
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(1))).alias("x")).select("doc_id", F.regexp_replace("x", "[^0-9]", "").alias("number"))
    return each.where("length(number) BETWEEN 9 AND 13").distinct().groupBy("number").agg(F.count(F.lit(1)).alias("n_docs"))


def mine_contacts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(kind, value, n_docs): e-mail addresses and web sites."""
    kind = lambda name, p: mine_values(docs, p, key, text).select(F.lit(name).alias("kind"), F.lower("value").alias("value"), "n_docs")
    return kind("email", EMAIL).unionByName(kind("website", SITE)).groupBy("kind", "value").agg(F.sum("n_docs").alias("n_docs"))


def mine_postcodes(docs: DataFrame) -> DataFrame:
    """(doc_id, code, country): the first pattern in order that matches."""
    code, country = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, name, p in reversed(POSTCODES):
        hit = F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
        code, country = F.coalesce(hit, code), F.when(hit.isNotNull(), F.lit(name)).otherwise(country)
    return docs.select("doc_id", code.alias("code"), country.alias("country")).where("code IS NOT NULL")


def discount_details(lines: DataFrame, context: DataFrame) -> DataFrame:
    """(doc_id, line_number, kind, amount): discount lines of documents with discount context; totals are left out."""
    rows = lines.join(context.where("has_discounts").select("doc_id"), "doc_id", "left_semi").where(~F.col("text").rlike("(?i)^(?:sub)?total|^vat"))
    amount = F.regexp_extract("text", r"(\d+\.\d{2})", 1).try_cast("decimal(16,2)")
    return rows.where(F.col("text").rlike("(?i)discount|saving|offer|% off|voucher")).select("doc_id", "line_number", first_of(DISCOUNT_KINDS).alias("kind"), amount.alias("amount"))


def discount_totals(details: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, total, stated): the amount of the first line that states the total discount, else the sum of a document's discounts; null if zero."""
    stated = F.replace(F.nullif(F.regexp_extract("text", DISCOUNT_TOTALS, 1), F.lit("")), F.lit(",")).try_cast("decimal(16,2)")
    first = lines.select("doc_id", "line_number", stated.alias("amount")).where("amount > 0").groupBy("doc_id").agg(F.min_by("amount", "line_number").alias("_stated"))
    sums = details.groupBy("doc_id").agg(F.sum("amount").cast("decimal(16,2)").alias("_sum"))
    both = sums.join(first, "doc_id", "full")
    return both.select("doc_id", F.nullif(F.coalesce("_stated", "_sum"), F.expr("CAST(0 AS DECIMAL(16,2))")).alias("total"), F.col("_stated").isNotNull().alias("stated"))


def address_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, first_line, last_line, text): runs of address-like lines after the first line, up to the first stop line."""
    w = Window.partitionBy("doc_id").orderBy("line_number", "text").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.col("text").rlike(r"(?i)^(?:date|receipt no)|£")
    like = F.col("text").rlike(r"(?i)street|road|avenue|lane|\b[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}\b|^\d+ [A-Z]|London|Leeds")
    rows = lines.withColumn("stopped", F.max(F.when(F.col("line_number") > 1, stop.cast("int")).otherwise(0)).over(w)).withColumn("like", like & (F.col("line_number") > 1))
    rows = rows.withColumn("gap", F.sum((~F.col("like")).cast("int")).over(w)).where("like AND stopped = 0")
    per = rows.groupBy("doc_id", "gap").agg(F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.array_sort(F.collect_list(F.struct("line_number", "text"))).alias("r"))
    return per.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")).alias("block"), "first_line", "last_line", F.array_join(F.transform("r", lambda x: x["text"]), ", ").alias("text"))


def vat_summary(vat: DataFrame) -> DataFrame:
    """(doc_id, n, n_rate, n_net, n_vat, n_total): VAT entries and how many have each part."""
    return vat.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"n_{c}") for c in ("rate", "net", "vat", "total")))


def consolidate_suppliers(names: DataFrame) -> DataFrame:
    """(key, name, n, n_variants): cleaned names with the number of their spellings and the most frequent one, the first of equals."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("name", r"(?i)\s+(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|till.*|terminal.*)$", ""), r"\s+", " "))
    cleaned = names.select(F.initcap(clean).alias("name"), F.lower(F.regexp_replace(clean, "[^A-Za-z0-9]", "")).alias("key"))
    counts = cleaned.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_variants"))


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows per group in the given order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


# ---- configured rules


def apply_rules(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """(doc_id, line_number, field, value, rule): configured rules on lines; the first rule of a field that gives a value on a line wins.

    Strategies: regex_extract (a group of this line), regex_match_line (the whole line), look_ahead (trigger
    here, value on the next line), look_behind (trigger on the line before, value here), constant.
    """
    w = Window.partitionBy("doc_id").orderBy("line_number", "text")
    rows = lines.withColumns({"_next": F.lead("text").over(w), "_before": F.lag("text").over(w)})

    def group(c: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), pattern, 1), F.lit(""))

    made = []
    for field in dict.fromkeys(r["field"] for r in rules):
        best = F.lit(None).cast("struct<value: string, rule: int>")
        for i, r in reversed([(i, r) for i, r in enumerate(rules) if r["field"] == field]):
            match r["strategy"]:
                case "regex_extract":
                    value = group("text", r["pattern"])
                case "regex_match_line":
                    value = F.when(F.col("text").rlike(r["pattern"]), F.col("text"))
                case "look_ahead":
                    value = F.when(F.col("text").rlike(r["trigger"]), group("_next", r["pattern"]))
                case "look_behind":
                    value = F.when(F.col("_before").rlike(r["trigger"]), group("text", r["pattern"]))
                case "constant":
                    value = F.when(F.col("text").rlike(r["pattern"]), F.lit(r["value"]))
                case other:
                    raise ValueError(f"no strategy {other}")
            best = F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(i).alias("rule"))).otherwise(best)
        made.append(F.when(best.isNotNull(), F.struct(F.lit(field).alias("field"), best["value"].alias("value"), best["rule"].alias("rule"))))
    return rows.select("doc_id", "line_number", F.inline(F.array_compact(F.array(*made))))


RULES = [
    {"field": "total", "strategy": "regex_extract", "pattern": r"^TOTAL £(\d+\.\d{2})"},
    {"field": "shop", "strategy": "regex_match_line", "pattern": r" LTD$"},
    {"field": "last_item", "strategy": "look_behind", "trigger": r"x £", "pattern": r"^SUBTOTAL £(\d+\.\d{2})"},
    {"field": "paid_by", "strategy": "look_ahead", "trigger": r"^TOTAL", "pattern": r"^([A-Z]+)"},
    {"field": "rate", "strategy": "constant", "pattern": r"VAT @ 20%", "value": "standard"},
    {"field": "total", "strategy": "regex_extract", "pattern": r"TOTAL £(\d+)"},
]
NEIGHBOUR_RULES = [r for r in RULES if r["strategy"] in ("look_ahead", "look_behind", "constant")]


def supplier_by_rules(lines: DataFrame, rules: list[dict], names: DataFrame | None = None, *, first: int = 8, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, name, line_number, rule): a document's supplier by the first strategy that finds one in its first lines.

    Lines that are blank, hold an excluded word or have only numbers and signs of dates are passed over. Strategies:
    known_match (the first line with one of `names` as whole words, the longest of its names), regex_extract (the pattern's
    group, capitalised), regex_match_line (the whole line) and fallback_first_line; patterns ignore case, the first line wins.
    """
    text = F.trim("text")
    able = lines.where((F.col("line_number") <= first) & (text != "") & ~text.rlike(r"^[\d/.:\-\s]+$")).select("doc_id", "line_number", text.alias("text"))
    for word in excludes:
        able = able.where(~F.contains(F.lower("text"), F.lit(word.lower())))
    made, found = [], []
    for i, r in enumerate(rules):
        pattern = f"(?i){r['pattern']}" if "pattern" in r else None
        match r["strategy"]:
            case "known_match":
                if names is None:
                    raise ValueError("known_match needs names")
                found.append(first_known(able, names).select("doc_id", F.lit(i).alias("rule"), "line_number", "name"))
                continue
            case "regex_extract":
                value = F.initcap(F.trim(F.nullif(F.regexp_extract("text", pattern, r.get("group", 1)), F.lit(""))))
            case "regex_match_line":
                value = F.when(F.col("text").rlike(pattern), F.col("text"))
            case "fallback_first_line":
                value = F.col("text")
            case other:
                raise ValueError(f"no strategy {other}")
        made.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("rule"), F.col("line_number"), value.alias("name"))))
    if made:
        found.append(able.select("doc_id", F.array_min(F.array(*made)).alias("x")).where("x IS NOT NULL").select("doc_id", "x.*"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("doc_id").agg(F.min(F.struct("rule", "line_number", "name")).alias("x")).select("doc_id", "x.name", "x.line_number", "x.rule")


def amount_by_rules(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """(doc_id, amount): the largest amount above zero that any rule finds in a document.

    regex_only looks at every line, context_line at those that hold one of its keywords; a pattern's two groups, pounds and
    pence, are joined by a dot, commas are left out.
    """
    parts = []
    for r in rules:
        whole = F.regexp_extract_all("text", F.lit(f"(?i){r['pattern']}"), F.lit(1))
        if r.get("groups", 1) == 2:
            whole = F.zip_with(whole, F.regexp_extract_all("text", F.lit(f"(?i){r['pattern']}"), F.lit(2)), lambda a, b: F.concat(a, F.lit("."), b))
        here = F.filter(F.transform(whole, lambda x: F.replace(x, F.lit(",")).try_cast("decimal(16,2)")), lambda x: x > 0)
        if r["strategy"] == "context_line":
            said = sum((F.contains(F.lower("text"), F.lit(k)).cast("int") for k in r["keywords"]), F.lit(0)) > 0
            here = F.when(said, here).otherwise(F.array().cast("array<decimal(16,2)>"))
        elif r["strategy"] != "regex_only":
            raise ValueError(f"no strategy {r['strategy']}")
        parts.append(F.array_max(here))
    best = F.array_max(F.array(*parts))
    return lines.where("text IS NOT NULL").select("doc_id", best.alias("amount")).where("amount IS NOT NULL").groupBy("doc_id").agg(F.max("amount").alias("amount"))


SUPPLIER_RULES = [
    {"strategy": "known_match"},
    {"strategy": "regex_extract", "pattern": r"welcome to (.+)$"},
    {"strategy": "regex_match_line", "pattern": r"\bltd$"},
    {"strategy": "fallback_first_line"},
]
NET_RULES = [{"strategy": "context_line", "keywords": ["subtotal", "net"], "pattern": r"(\d[\d,]*\.\d{2})"}, {"strategy": "regex_only", "pattern": r"net amount: (\d+) (\d{2})\b", "groups": 2}]
