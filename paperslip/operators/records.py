"""Record operators: grounding of extracted values, items, confidences, standard fields, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: legacy field names and their standard ones, by precedence
FIELD_NAMES = [
    ("total", "total_amount", 1), ("grand_total", "total_amount", 2), ("amount_due", "total_amount", 3), ("total_amount", "total_amount", 4),
    ("vat", "tax_amount", 1), ("tax", "tax_amount", 2), ("tax_amount", "tax_amount", 3),
    ("date", "receipt_date", 1), ("invoice_date", "receipt_date", 2), ("receipt_date", "receipt_date", 3),
    ("number", "receipt_number", 1), ("receipt_no", "receipt_number", 2), ("receipt_number", "receipt_number", 3),
    ("payment", "payment_method", 1), ("payment_type", "payment_method", 2), ("payment_method", "payment_method", 3),
]
PLACEHOLDERS = ["john doe", "acme", "123 main st", "example ltd", "1234567", "lorem"]


def _lacking(value: Column, low: Column) -> Column:
    """Whether a value is a claim that the text, in lower case, lacks."""
    claim = value.isNotNull() & (value != "") & (F.coalesce(value.try_cast("decimal(16,2)"), F.lit(1)) != 0)
    small = F.lower(value)
    short = F.regexp_replace(small, r"\.?0+$", "")
    number = small.rlike(r"^\d+\.\d+$")
    return claim & ~(F.contains(low, small) | (number & (F.contains(low, F.replace(small, F.lit("."), F.lit(","))) | F.contains(low, short))))


def ground_fields(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings (doc_id, field, value): values that the source text lacks; numbers also with a comma; null, empty and zero values pass."""
    return fields.join(texts.select("doc_id", "text"), "doc_id").where(_lacking(F.col("value"), F.lower("text"))).select("doc_id", "field", "value")


def _name_missing(name: Column, low: Column) -> Column:
    words = F.filter(F.split(F.lower(name), " "), lambda w: F.length(w) > 3)
    return (F.size(words) > 0) & ~F.exists(words, lambda w: F.contains(low, w))


def _price_missing(price: Column, text: Column) -> Column:
    return ~F.contains(text, price.cast("string"))


def ground_items(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings (doc_id, item_no, name_missing, price_missing): no word of over three letters of the name, or not the price, in the text."""
    missing = {"name_missing": _name_missing(F.col("name"), F.lower("text")), "price_missing": _price_missing(F.col("price"), F.col("text"))}
    joined = items.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "item_no", *(c.alias(n) for n, c in missing.items()))
    return joined.where("name_missing OR price_missing")


def _tokens(text: Column, least: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{least},}})"), F.lit(1)))


def context_leak(docs: DataFrame, context: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, token): the first word of six letters or more of the extracted values that the retrieved context holds and the document lacks."""
    said = fields.select("doc_id", F.explode(_tokens(F.col("value"), 6)).alias("token")).distinct()
    given = context.select("doc_id", F.explode(_tokens(F.col("context"), 6)).alias("token")).distinct()
    own = docs.select("doc_id", F.explode(_tokens(F.col("text"), 6)).alias("token")).distinct()
    return said.join(given, ["doc_id", "token"], "left_semi").join(own, ["doc_id", "token"], "left_anti").groupBy("doc_id").agg(F.min("token").alias("token"))


def placeholder_hits(fields: DataFrame, texts: DataFrame, words: list[str] = PLACEHOLDERS) -> DataFrame:
    """(doc_id, placeholder): listed placeholders in a value that the source lacks."""
    hit = _placeholders(F.col("value"), F.lower("text"), words)
    return fields.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", F.explode(hit).alias("placeholder")).distinct()


def _placeholders(value: Column, low: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(value), w) & ~F.contains(low, w))


def document_findings(docs: DataFrame, words: list[str] = PLACEHOLDERS) -> DataFrame:
    """Documents (text, fields (field, value), items (name, price)) with n_fields, n_items and n_placeholders: what `ground_fields`, `ground_items` and `placeholder_hits` find in each.

    All of a document is in its row, so that nothing is joined.
    """
    read = docs.select("*", F.inline(F.array(F.struct(F.lower("text").alias("_low")))))  # once a document
    low = F.col("_low")
    placeholders = F.flatten(F.transform("fields", lambda f: _placeholders(f["value"], low, words)))
    counts = {
        "n_fields": F.filter("fields", lambda f: _lacking(f["value"], low)),
        "n_items": F.filter("items", lambda i: _name_missing(i["name"], low) | _price_missing(i["price"], F.col("text"))),
        "n_placeholders": F.array_distinct(placeholders),
    }
    return read.select(*docs.columns, *(F.size(c).cast("long").alias(n) for n, c in counts.items()))


def token_confidence(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, field, token, confidence): of the first line that holds the token, 1 if none does."""
    tokens = fields.select("doc_id", "field", F.explode(F.array_distinct(F.filter(F.split("value", " "), lambda w: w != ""))).alias("token"))
    row = F.struct("line_number", F.lower("text").alias("text"), "confidence")
    docs = lines.where("line_number IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("_lines"))  # one document's lines; tokens meet them as one row
    first = F.try_element_at(F.filter("_lines", lambda l: F.contains(l["text"], F.lower("token"))), F.lit(1))["confidence"]
    return tokens.join(docs, "doc_id", "left").select("doc_id", "field", "token", F.coalesce(first, F.expr("CAST(1 AS DECIMAL(6,2))")).alias("confidence"))


def score_findings(findings: DataFrame, docs: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_findings, n_ and each of `kinds`, confidence): base 0.6 + 0.3 x relevance, less a fifth of it per finding, not below 0. Findings are (doc_id) and, for counts by kind, kind."""
    by_kind = {f"n_{k}": F.count_if(F.col("kind") == k) for k in kinds}
    n = findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_findings"), *(c.alias(name) for name, c in by_kind.items()))
    return score_counts(docs.join(n, "doc_id", "left").na.fill(0, ["n_findings", *by_kind]), kinds)


def score_counts(docs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """`score_findings` of documents that have n_findings and n_ and each of `kinds`."""
    base = (F.expr("0.6BD") + F.expr("0.3BD") * F.col("relevance")).cast("decimal(6,4)")
    return docs.select("doc_id", "n_findings", *(f"n_{k}" for k in kinds), F.greatest((base * (F.lit(1) - F.expr("0.2BD") * F.col("n_findings"))).cast("decimal(8,4)"), F.expr("CAST(0 AS DECIMAL(8,4))")).alias("confidence"))


# ---- items


def item_confidence(items: DataFrame) -> DataFrame:
    """(doc_id, n_items, confidence): the mean of each item's non-zero field confidences, then per document."""
    parts = F.array(
        F.when(F.length("name") >= 3, F.expr("0.95BD")).otherwise(F.expr("0.50BD")),
        F.when(F.col("qty") > 0, F.expr("0.90BD")).when(F.col("qty") == 0, F.expr("0.30BD")).otherwise(F.expr("0.20BD")),
        F.when(F.col("price") > 0, F.expr("0.95BD")).when(F.col("price") == 0, F.expr("0.30BD")).otherwise(F.expr("0.20BD")),
        F.when(F.col("name").rlike(r"\d"), F.expr("0.85BD")).otherwise(F.expr("0.00BD")),
    )
    some = F.filter(parts, lambda x: x > 0)
    mean = (F.aggregate(some, F.expr("CAST(0 AS DECIMAL(6,2))"), lambda a, x: (a + x).cast("decimal(6,2)")) / F.size(some)).cast("decimal(7,4)")
    return items.select("doc_id", mean.alias("m")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), (F.sum("m") / F.count(F.lit(1))).cast("decimal(7,4)").alias("confidence"))


def field_confidence(items: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, field, confidence): the mean over the items' maps (`confidences`), replaced by the document's own value (rows doc_id, field, confidence) where there is one."""
    maps = items.select("doc_id", F.explode("confidences").alias("field", "c"))
    means = maps.groupBy("doc_id", "field").agg((F.sum("c") / F.count("c")).cast("decimal(7,4)").alias("_mean"))
    given = own.where("confidence IS NOT NULL").select("doc_id", "field", F.col("confidence").cast("decimal(7,4)").alias("_own"))
    return means.join(given, ["doc_id", "field"], "full").select("doc_id", "field", F.coalesce("_own", "_mean").alias("confidence"))


def validate_records(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, errors, passed): no items, missing names, prices that are no number, above 100000 or below -10000."""
    per = items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce(F.trim("name") == "", F.lit(True))).alias("no_name"),
        F.bool_or(F.col("price").isNull()).alias("no_price"),
        F.bool_or(F.col("price") > 100000).alias("high"),
        F.bool_or(F.col("price") < -10000).alias("low"),
    )
    joined = docs.select("doc_id").distinct().join(per, "doc_id", "left")
    errors = F.array_compact(F.array(F.when(F.col("n").isNull(), "no_items"), F.when(F.col("no_name"), "missing_name"), F.when(F.col("no_price"), "price_not_numeric"), F.when(F.col("high"), "price_too_high"), F.when(F.col("low"), "price_too_low")))
    return joined.select("doc_id", F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("passed"))


def score_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, overall, decision): 0.4 reading + 0.3 pattern + 0.3 model confidence; review below 0.7 or on failed validation, approve from 0.85."""
    model = item_confidence(items).select("doc_id", F.col("confidence").alias("model"))
    clamp = lambda c: F.least(F.greatest(c, F.expr("CAST(0 AS DECIMAL(7,4))")), F.expr("CAST(1 AS DECIMAL(7,4))")).cast("decimal(7,4)")
    pattern = F.when(F.col("has_context"), F.expr("0.7BD")).otherwise(F.expr("0.5BD"))
    out = docs.join(model, "doc_id", "left").withColumn("model", F.coalesce("model", F.expr("CAST(0.5 AS DECIMAL(7,4))")))
    overall = (F.expr("0.4BD") * clamp(F.col("reading")) + F.expr("0.3BD") * pattern + F.expr("0.3BD") * clamp(F.col("model"))).cast("decimal(8,4)")
    return out.withColumn("overall", overall).select("doc_id", "overall", F.when(~F.col("valid") | (F.col("overall") < F.expr("0.7BD")), "review").when(F.col("overall") >= F.expr("0.85BD"), "approve").otherwise("accept").alias("decision"))


def route_low_confidence(fields: DataFrame, thresholds: dict[str, str], default: str = "0.75") -> DataFrame:
    """(doc_id, field, value, confidence, routed, review): fields below their threshold take the fallback value if 0.75 beats them; below 0.90 they are listed for review."""
    limit = F.lit(default).cast("decimal(3,2)")
    for name, value in thresholds.items():
        limit = F.when(F.col("field") == name, F.lit(value).cast("decimal(3,2)")).otherwise(limit)
    routed = F.col("confidence") < limit
    replace = routed & F.col("fallback").isNotNull() & (F.col("confidence") < F.expr("0.75BD"))
    return fields.select("doc_id", "field", F.when(replace, F.col("fallback")).otherwise(F.col("value")).alias("value"), F.when(replace, F.expr("0.75BD")).otherwise(F.col("confidence")).cast("decimal(3,2)").alias("confidence"), routed.alias("routed"), (F.col("confidence") < F.expr("0.90BD")).alias("review"))


def tax_patterns(items: DataFrame, least: str = "0.70") -> DataFrame:
    """(doc_id, net, tax, rates, effective_rate): over entries of enough confidence, where both sums are positive."""
    sure = items.where(F.col("confidence") >= F.lit(least).cast("decimal(3,2)"))
    per = sure.groupBy("doc_id").agg(F.sum("price").cast("decimal(18,2)").alias("net"), F.sum((F.col("price") * F.col("tax")).cast("decimal(18,4)")).cast("decimal(18,4)").alias("tax"), F.array_join(F.transform(F.array_sort(F.collect_set("tax")), lambda x: x.cast("string")), ",").alias("rates"))
    return per.where("net > 0 AND tax > 0").withColumn("effective_rate", (F.col("tax") * 100 / F.col("net")).cast("decimal(8,3)"))


# fixed values: words of item names, and of texts, by vendor type, in the order in which they decide
ITEM_WORDS = {"petrol": ["petrol", "diesel", "fuel", "litre", "gallon"], "pharmacy": ["tablet", "capsule", "medicine", "prescription", "pharmacy"], "grocery": ["milk", "bread", "cheese", "meat", "vegetable", "fruit"]}
TEXT_WORDS = {"grocery": ["supermarket", "grocery", "fresh"], "petrol": ["fuel", "petrol", "pump"], "pharmacy": ["pharmacy", "chemist"], "restaurant": ["restaurant", "cafe", "diner"]}


def infer_vendor_type(items: DataFrame, texts: DataFrame, item_words: dict[str, list[str]] = ITEM_WORDS, text_words: dict[str, list[str]] = TEXT_WORDS) -> DataFrame:
    """(doc_id, vendor_type) of every text: petrol by any item with such a word, then pharmacy, grocery from two items on; else by words of the text, else other. A null text or name has no words."""
    has = lambda column, words: F.coalesce(F.reduce(F.array(*map(F.lit, words)), F.lit(False), lambda acc, w: acc | F.contains(F.lower(column), w)), F.lit(False))
    per = items.groupBy("doc_id").agg(*(F.count_if(has("name", words)).alias(kind) for kind, words in item_words.items()))
    kind = F.lit(None).cast("string")
    for name, words in reversed(text_words.items()):
        kind = F.when(has("text", words), F.lit(name)).otherwise(kind)
    for name in reversed(list(item_words)):
        kind = F.when(F.col(name) >= (2 if name == "grocery" else 1), F.lit(name)).otherwise(kind)
    return texts.select("doc_id", "text").join(per, "doc_id", "left").select("doc_id", F.coalesce(kind, F.lit("other")).alias("vendor_type"))


def recover_items(lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, name, qty, price): items read back from lines of name, quantity and price."""
    p = r"^(.+) (\d+) x £(\d+\.\d{2})$"
    return lines.where(F.col("text").rlike(p)).select("doc_id", "line_number", F.regexp_extract("text", p, 1).alias("name"), F.regexp_extract("text", p, 2).cast("int").alias("qty"), F.regexp_extract("text", p, 3).cast("decimal(16,2)").alias("price"))


# ---- fields


def _names(spark) -> DataFrame:
    return spark.createDataFrame(FIELD_NAMES, "field string, standard string, rank int")


def rename_fields(fields: DataFrame) -> DataFrame:
    """(doc_id, field, value, extractor, renamed): legacy names replaced; unknown names stay. The map has a fixed number of rows."""
    joined = fields.join(F.broadcast(_names(fields.sparkSession)), "field", "left")
    return joined.select("doc_id", F.coalesce("standard", "field").alias("field"), "value", "extractor", (F.col("standard").isNotNull() & (F.col("standard") != F.col("field"))).alias("renamed"))


def standardize_fields(fields: DataFrame) -> DataFrame:
    """(doc_id, total_amount, tax_amount, receipt_date, receipt_number, payment_method): the first non-null value by precedence of its names."""
    joined = fields.join(F.broadcast(_names(fields.sparkSession)), "field").where("value IS NOT NULL")
    best = joined.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "standard").orderBy("rank", "value"))).where("_n = 1")
    return best.groupBy("doc_id").pivot("standard", sorted({s for _, s, _ in FIELD_NAMES})).agg(F.first("value"))


def migration_report(fields: DataFrame) -> DataFrame:
    """(standard, n_deprecated, n_standard, n_bare): uses of legacy and standard names, and amounts without decimals."""
    joined = fields.join(F.broadcast(_names(fields.sparkSession)), "field")
    old = F.col("field") != F.col("standard")
    return joined.groupBy("standard").agg(F.count_if(old).alias("n_deprecated"), F.count_if(~old).alias("n_standard"), F.count_if(F.col("standard").endswith("_amount") & ~F.col("value").rlike(r"\.\d{2}$")).alias("n_bare"))


def extraction_coverage(fields: DataFrame) -> DataFrame:
    """(field, n_docs, n, mean_confidence, share): documents and confidence per field, and its share of all fields."""
    per = fields.groupBy("field").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n"), (F.sum("score") / F.count(F.lit(1))).cast("decimal(7,4)").alias("mean_confidence"))
    return per.withColumn("share", (F.col("n").cast("decimal(18,0)") * 100 / F.sum("n").over(Window.partitionBy()).cast("decimal(18,0)")).cast("decimal(7,3)"))  # a row per field


def diff_corrections(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """(doc_id, field, before, after): fields that changed, one side null where the other alone has them."""
    a, b = original.select("doc_id", "field", F.col("value").alias("before")), corrected.select("doc_id", "field", F.col("value").alias("after"))
    return a.join(b, ["doc_id", "field"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


#: The least score of a field that is learnt, where it is not 0.70.
LEARNT_FROM = {"vendor": "0.90"}


def learn_patterns(fields: DataFrame, known: DataFrame, least: str = "0.70", by_kind: dict[str, str] = LEARNT_FROM) -> DataFrame:
    """(doc_id, kind, pattern, status): fields of enough score as pattern texts `Kind: value`; approved from 0.85, else pending.

    A vendor is learnt if its name is not among those of `known`, whatever the case. Null values are left out.
    """
    bar = F.expr(f"{least}BD")
    for kind, score in by_kind.items():
        bar = F.when(F.col("field") == kind, F.expr(f"{score}BD")).otherwise(bar)
    sure = fields.where("value IS NOT NULL").where(F.col("score") >= bar)
    names = known.select(F.upper("name").alias("_name")).distinct()
    new = sure.join(names, (F.col("field") == "vendor") & (F.upper("value") == F.col("_name")), "left_anti")
    return new.select("doc_id", F.col("field").alias("kind"), F.concat(F.initcap("field"), F.lit(": "), "value").alias("pattern"), F.when(F.col("score") >= F.expr("0.85BD"), "approved").otherwise("pending").alias("status"))


def ingest_responses(responses: DataFrame) -> DataFrame:
    """(id, parsed, total, vendor): raw model answers to records: fences, comments and trailing commas removed, the outermost braces read; unreadable rows are marked, not dropped."""
    body = F.regexp_replace("raw", r"```(?:json)?", "")
    body = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)//[^\n\"]*$", ""), r",\s*([}\]])", "$1")
    record = F.from_json(body, "total string, vendor string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ok = (body != "") & record["_corrupt"].isNull() & (record["total"].isNotNull() | record["vendor"].isNotNull())
    return responses.select("id", F.coalesce(ok, F.lit(False)).alias("parsed"), F.when(ok, record["total"]).alias("total"), F.when(ok, record["vendor"]).alias("vendor"))


def parse_rate(parsed: DataFrame, by: str) -> DataFrame:
    return parsed.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.count_if("parsed").cast("decimal(18,0)") * 100 / F.count(F.lit(1))).cast("decimal(7,3)").alias("percent"))
