"""Field operators: amounts, dates, numbers, suppliers and rates mined from lines, and the best of them per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperslip.operators.dictionary import names_in

# fixed values: keyword lists and patterns of the extraction
PAYABLE = [r"grand\s*total", r"net\s*total", r"amount\s*payable", r"amount\s*due", r"balance\s*due", r"net\s*payable", r"total\s*amount", r"\btotal\b", r"sum\s*total", r"final\s*amount", r"total\s*to\s*pay", r"amount\s*owing"]
NOT_PAYABLE = [r"change", r"balance\s*returned", r"amount\s*returned", r"refund", r"cash\s*back", r"change\s*due", r"balance\s*due\s*back", r"change\s*given", r"your\s*change"]
AMOUNT = r"(\d+(?:,\d{3})*(?:\.\d{1,2})?)"
_SIGN, _CODE = "[£$€¥₹₽¢]", "(?:GBP|USD|EUR|JPY|INR|CAD|AUD)"
#: (rank, pattern) of amounts in a line; rank 0 first.
AMOUNT_RULES = [
    (0, rf"{_SIGN}\s*(\d{{1,3}}(?:,\d{{3}})*\.\d{{2}})"),
    (1, rf"{_SIGN}\s*(\d+\.\d{{2}})"),
    (2, rf"{_SIGN}\s*(\d+)"),
    (3, rf"(\d{{1,3}}(?:,\d{{3}})*\.\d{{2}})\s*{_SIGN}"),
    (4, rf"(\d+\.\d{{2}})\s*{_SIGN}"),
    (5, rf"(\d+)\s*{_SIGN}"),
    (6, rf"{_CODE}\s*(\d{{1,3}}(?:,\d{{3}})*\.\d{{2}})"),
    (7, rf"(\d{{1,3}}(?:,\d{{3}})*\.\d{{2}})\s*{_CODE}"),
    (8, r"(\d{1,3}(?:,\d{3})+\.\d{2})(?!\d)"),
    (9, r"(\d{1,3}(?:\.\d{3})+,\d{2})(?!\d)"),
    (10, r"(\d{1,3}(?:\s\d{3})+\.\d{2})(?!\d)"),
    (11, r"(\d+\.\d{2})(?!\d)"),
    (12, r"(\d+\.\d{1})(?!\d)"),
    (13, r"(\d{2,})(?=\s*(?:paid|total|amount|charge|fee|payment))"),
    (14, rf"{_SIGN}\s*([O0]\d*\.\d{{2}})"),
    (15, rf"{_SIGN}\s*(\d*[O0]\d*\.\d{{2}})"),
    (16, rf"-\s*{_SIGN}\s*(\d+\.\d{{2}})"),
    (17, rf"{_SIGN}\s*(\d+\.\d{{2}})\s*-"),
]
NEGATIVE = rf"-\s*{_SIGN}\s*\d|{_SIGN}\s*\d[\d.,]*\s*-(?:\s|$)"
SUBTOTALS = [(1, r"SUB\s?TOTAL", "0.95"), (2, r"PRE\s?TOTAL|NET\s?TOTAL|TOTAL\s?BEFORE\s?TAX", "0.85"), (3, r"\bTOTAL\b", "0.65")]
NET_KEYWORDS = ["net after discount", "total after discount", "amount after discount", "final amount", "amount due", "balance due", "amount payable", "subtotal", "net total", "net amount", "total", "balance"]
BUSINESS = [(r"\bltd\b|\blimited\b", "0.30"), (r"\bplc\b", "0.30"), (r"\binc\b|\bcorp\b", "0.25"), (r"store|shop|market", "0.20"), (r"pharmacy|supermarket", "0.20"), (r"supplier|trading", "0.15"), (r"^[A-Z &'#0-9]+$", "0.10"), (r"\d{3,}", "-0.10"), (r"£", "-0.30"), (r":", "-0.20")]
CURRENCY = [(1, "UK", "GBP", r"£|GBP", r"\bvat\b"), (2, "US", "USD", r"[$]|USD", r"sales tax"), (3, "EU", "EUR", r"€|EUR", r"\b(?:mwst|tva|iva)\b")]


#: (field, rule, pattern, score) of candidates in long form.
CANDIDATE_RULES = [("total", 1, r"(?i)^total\b.*?(\d+\.\d{2})", "0.90"), ("total", 2, r"(?i)total.*?(\d+\.\d{2})", "0.70"), ("tax", 1, r"(?i)^vat\b.*?(\d+\.\d{2})", "0.85"), ("date", 1, r"(\d{2}/\d{2}/\d{4})", "0.80"), ("number", 1, r"(?i)receipt no[: ]*(\w+)", "0.95"), ("payment", 1, r"(?i)^(cash|visa)", "0.75")]


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(patterns)


def amounts_in(text: Column, pattern: str = AMOUNT) -> Column:
    """All amounts of a text as decimals; those that are no number are left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(",")).try_cast("decimal(16,2)"))
    return F.filter(found, lambda x: x.isNotNull())


def _first(cols: list[str], by: str = "doc_id") -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*cols))


def payable_amounts(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, amount, line_number, n_candidates): the largest amount on payable lines, the first line of equals; columns in `keep` are those of that line."""
    hit = lines.where(F.col("text").rlike(any_of(PAYABLE)) & ~F.col("text").rlike(any_of(NOT_PAYABLE)))
    each = hit.select("doc_id", F.array_max(amounts_in(F.col("text"))).alias("amount"), F.struct("line_number", *keep).alias("line")).where("amount IS NOT NULL")
    best = each.groupBy("doc_id").agg(F.max("amount").alias("amount"), F.max_by("line", F.struct("amount", -F.col("line.line_number"))).alias("line"), F.count(F.lit(1)).alias("n_candidates"))
    return best.select("doc_id", "amount", "line.*", "n_candidates").select("doc_id", "amount", "line_number", "n_candidates", *keep)


def priority_amounts(lines: DataFrame, rules=SUBTOTALS) -> DataFrame:
    """(doc_id, amount, confidence, line_number): the first line of the best rule, its last amount."""
    rank, confidence = F.lit(None).cast("int"), F.lit(None).cast("decimal(3,2)")
    for r, pattern, c in reversed(rules):
        hit = F.upper("text").rlike(pattern)
        rank, confidence = F.when(hit, F.lit(r)).otherwise(rank), F.when(hit, F.lit(c).cast("decimal(3,2)")).otherwise(confidence)
    found = lines.select("doc_id", "line_number", rank.alias("rank"), confidence.alias("confidence"), F.try_element_at(amounts_in(F.col("text")), F.lit(-1)).alias("amount")).where("rank IS NOT NULL AND amount IS NOT NULL")
    return found.withColumn("_n", _first(["rank", "line_number"])).where("_n = 1").select("doc_id", "amount", "confidence", "line_number")


def net_after_discount(lines: DataFrame) -> DataFrame:
    """(doc_id, amount, rank, confidence): the first keyword of the list that has a line with an amount; confidence falls by 0.05 a rank."""
    t = F.lower("text")
    rank = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(NET_KEYWORDS))):
        rank = F.when(F.contains(t, F.lit(k)), F.lit(i)).otherwise(rank)
    found = lines.select("doc_id", "line_number", rank.alias("rank"), F.array_max(amounts_in(F.col("text"))).alias("amount")).where("rank IS NOT NULL AND amount IS NOT NULL")
    out = found.withColumn("_n", _first(["rank", "line_number"])).where("_n = 1")
    return out.select("doc_id", "amount", "rank", F.expr("CAST(CASE WHEN rank < 7 THEN 0.95BD - 0.05BD * rank ELSE 0.80BD - 0.05BD * (rank - 7) END AS DECIMAL(4,2))").alias("confidence"))


def read_amount(found: Column) -> Column:
    """An amount as written, as a decimal: O is zero, the last of comma and point splits off the pence, a single comma before two digits does too."""
    return _as_decimal(_tidied(found))


def _tidied(found: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(found, "[Oo]", "0"), r"\s", "")


def _as_decimal(x: Column) -> Column:
    comma, point = F.length(x) - F.locate(",", F.reverse(x)), F.length(x) - F.locate(".", F.reverse(x))
    both = F.contains(x, F.lit(",")) & F.contains(x, F.lit("."))
    european = F.replace(F.replace(x, F.lit(".")), F.lit(","), F.lit("."))
    with_comma = F.when(both & (point > comma), F.replace(x, F.lit(","))).when(both | x.rlike(r"^[^,]*,\d{2}$"), european).otherwise(F.replace(x, F.lit(",")))
    return F.when(F.contains(x, F.lit(",")), with_comma).otherwise(x).try_cast("decimal(16,2)")


def _amount_by(rank: int, pattern: str) -> Column:
    """The first amount of a rule in the range as (confidence, _r, amount), null if there is none. Each step stands once, as a lambda's body is computed wherever it is used."""
    found = F.transform(F.regexp_extract_all("text", F.lit(f"(?i){pattern}"), F.lit(1)), _tidied)
    base = 1 - 0.05 * rank + (0.1 if rank < 6 else 0)
    sure = lambda x: F.when(x.rlike(r"[.,]\d{2}$"), F.expr(f"CAST({base + 0.05:.2f} AS DECIMAL(4,2))")).otherwise(F.expr(f"CAST({base:.2f} AS DECIMAL(4,2))"))
    read = F.transform(found, lambda x: F.struct(sure(x).alias("confidence"), F.lit(-rank).alias("_r"), _as_decimal(x).alias("amount")))
    return F.try_element_at(F.filter(read, lambda x: x["amount"].between(F.expr("0.01BD"), F.expr("999999.99BD"))), F.lit(1))


def mine_amounts(lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, amount, rank, confidence, negative): the best amount of each line, within 0.01 and 999999.99.

    Each rule has its first amount in the range; 1 - 0.05 rank, 0.10 more for the first six rules and 0.05 more with two
    decimals make the confidence (it may exceed 1), and the highest counts, the first rule of equals.
    """
    able = lines.where(F.col("text").rlike("[0-9]"))
    text = F.col("text")
    part = {rank: _amount_by(rank, pattern) for rank, pattern in AMOUNT_RULES}
    rules = lambda *ranks: F.coalesce(*(part[r] for r in ranks))
    # no later rule has a higher confidence than an earlier one; rules are tried only where the text holds what they ask for
    best = F.coalesce(
        F.when(text.rlike(_SIGN), rules(0, 1, 2, 3, 4, 5)),
        F.when(text.rlike(f"(?i){_CODE}"), rules(6, 7)),
        F.when(text.rlike(r"\d[.,\s]\d"), rules(8, 9, 10, 11, 12)),
        F.when(text.rlike(r"(?i)\d\s*(?:paid|total|amount|charge|fee|payment)"), part[13]),
        F.when(text.rlike(_SIGN), rules(14, 15, 16, 17)),
    )
    row = F.struct("doc_id", "line_number", best.alias("b"), text.rlike(NEGATIVE).alias("negative"))
    found = able.select(F.inline(F.filter(F.array(row), lambda x: x["b"].isNotNull())))  # a filter would be moved down and read every amount again
    return found.select("doc_id", "line_number", "b.amount", (-F.col("b._r")).alias("rank"), "b.confidence", "negative")


def mine_rates(lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, rate): every percentage between 0 and 100."""
    each = lines.select("doc_id", "line_number", F.explode(F.regexp_extract_all("text", F.lit(r"(\d{1,3}(?:\.\d{1,2})?)\s*%"), F.lit(1))).alias("x"))
    return each.select("doc_id", "line_number", F.col("x").try_cast("decimal(5,2)").alias("rate")).where("rate BETWEEN 0 AND 100")


def mine_tax_numbers(lines: DataFrame) -> DataFrame:
    """(doc_id, number, line_number, confidence): the first VAT number of 7 to 12 signs after a keyword."""
    raw = F.regexp_extract(F.upper("text"), r"VAT\s*(?:REG(?:ISTRATION)?\s*)?(?:NO|NUMBER|REG)[.:\s]*([A-Z0-9 -]{5,20})", 1)
    number = F.regexp_replace(F.regexp_replace(raw, "[^A-Z0-9-]", ""), "[A-Z]+$", "")
    found = lines.select("doc_id", "line_number", number.alias("number")).where("length(number) BETWEEN 7 AND 12")
    return found.withColumn("_n", _first(["line_number"])).where("_n = 1").select("doc_id", "number", "line_number", F.expr("0.90BD").alias("confidence"))


def receipt_numbers(lines: DataFrame) -> DataFrame:
    """(doc_id, number, tier, line_number): keyword then number; else a token with a digit on the keyword line, the next, the one before."""
    w = Window.partitionBy("doc_id").orderBy("line_number", "text")
    keyword = r"(?i)\b(?:receipt|invoice|order|ref)\s*(?:no|number|#)?"
    token = r"\b([A-Z0-9_#-]*[0-9][A-Z0-9_#-]{3,19})\b"
    near = lines.withColumns({"_next": F.lead("text").over(w), "_before": F.lag("text").over(w)}).where(F.col("text").rlike(keyword))
    own = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), p, 1), F.lit(""))
    tiers = [own("text", r"(?i)\b(?:receipt|invoice|order|ref)\s*(?:no|number|#)[:\s#.]*([A-Za-z0-9_#-]{3,20})"), own("text", token), own("_next", token), own("_before", token)]
    tier = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(tiers, 1))):
        tier = F.when(t.isNotNull(), F.lit(i)).otherwise(tier)
    found = near.select("doc_id", "line_number", F.coalesce(*tiers).alias("number"), tier.alias("tier")).where("number IS NOT NULL")
    return found.withColumn("_n", _first(["tier", "line_number"])).where("_n = 1").select("doc_id", "number", "tier", "line_number")


def proximity_amounts(lines: DataFrame, keyword: str = r"(?i)cash tendered|visa|card") -> DataFrame:
    """(doc_id, line_number, amount, where_found): a keyword line's last decimal amount, else that of the next or the previous line."""
    w = Window.partitionBy("doc_id").orderBy("line_number", "text")
    last = lambda c: F.try_element_at(amounts_in(F.coalesce(F.col(c), F.lit("")), r"(\d+\.\d{2})"), F.lit(-1))
    near = lines.withColumns({"_next": F.lead("text").over(w), "_before": F.lag("text").over(w)}).where(F.col("text").rlike(keyword))
    here, nxt, before = last("text"), last("_next"), last("_before")
    return near.select("doc_id", "line_number", F.coalesce(here, nxt, before).alias("amount"), F.when(here.isNotNull(), "line").when(nxt.isNotNull(), "next").when(before.isNotNull(), "previous").alias("where_found"))


def bottom_up_amount(lines: DataFrame) -> DataFrame:
    """(doc_id, total, net, line_number): the last total line's largest amount; the largest net amount of any strategy."""
    total = F.col("text").rlike(r"(?i)\btotal\b") & ~F.col("text").rlike(r"(?i)subtotal|saving")
    amount = F.array_max(amounts_in(F.col("text"), r"(\d+\.\d{2})"))
    found = lines.select("doc_id", "line_number", total.alias("is_total"), F.col("text").rlike(r"(?i)subtotal|net|vat").alias("is_net"), amount.alias("amount")).where("amount IS NOT NULL AND (is_total OR is_net)")
    at = F.when(F.col("is_total"), F.col("line_number"))
    return found.groupBy("doc_id").agg(F.max_by("amount", at).alias("total"), F.max(F.when(F.col("is_net"), F.col("amount"))).alias("net"), F.max(at).alias("line_number"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The first of the highest score per (doc_id, field): ties go to the lower line, then the lower rule."""
    w = Window.partitionBy("doc_id", "field").orderBy(F.desc("score"), "line_number", "rule")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _candidates_in(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.struct(F.lit(f).alias("field"), F.regexp_extract(text, p, 1).alias("value"), F.lit(s).cast("decimal(3,2)").alias("score"), F.lit(r).alias("rule"))) for f, r, p, s in CANDIDATE_RULES)))


def candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, field, value, score, line_number, rule): typed candidates of all fields, in long form."""
    return lines.select("doc_id", "line_number", F.inline(_candidates_in(F.col("text"))))


def with_best_fields(docs: DataFrame) -> DataFrame:
    """Documents with `lines` (line_number, text) as an array, and `fields` (field, value): the best candidates of their lines."""
    of_line = lambda l: F.transform(_candidates_in(l["text"]), lambda c: F.struct((-c["score"]).alias("_s"), l["line_number"].alias("line_number"), c["rule"].alias("rule"), c["field"].alias("field"), c["value"].alias("value")))
    every = docs.select("*", F.inline(F.array(F.struct(F.flatten(F.transform("lines", of_line)).alias("_every")))))  # each line is read once
    first = lambda f: F.array_min(F.filter("_every", lambda c: c["field"] == f))
    best = F.array_compact(F.array(*(first(f) for f in dict.fromkeys(f for f, *_ in CANDIDATE_RULES))))
    return every.select(*docs.columns, F.transform(best, lambda c: F.struct(c["field"].alias("field"), c["value"].alias("value"))).alias("fields"))



def score_suppliers(lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, text, score) of the first five lines: business patterns, position and word count, x 0.8 + 0.2 x reading confidence (column `confidence` where there is one and it is known, else 0.8)."""
    score = F.expr("0.00BD")
    for pattern, points in BUSINESS:
        score = score + F.when(F.col("text").rlike(pattern if pattern.startswith("^[A-Z") else f"(?i){pattern}"), F.lit(points).cast("decimal(4,2)")).otherwise(F.expr("0.00BD"))
    place = F.expr("CAST(greatest(0.30BD - 0.05BD * (line_number - 1), 0.10BD) AS DECIMAL(4,2))")
    n = F.size(F.split("text", " "))
    score = score + place + F.when(n.between(2, 5), F.expr("0.10BD")).otherwise(F.expr("0.00BD"))
    bounded = F.least(F.greatest(score, F.expr("0.00BD")), F.expr("1.00BD")).cast("decimal(4,2)")
    reading = F.coalesce(F.col("confidence").cast("decimal(4,2)"), F.expr("0.80BD")) if "confidence" in lines.columns else F.expr("0.80BD")
    return lines.where("line_number <= 5").select("doc_id", "line_number", "text", (bounded * F.expr("0.8BD") + F.expr("0.2BD") * reading).cast("decimal(5,3)").alias("score"))


def contextual_suppliers(lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, name, weight): names after thanking phrases, or business names, weighted by their place in the receipt."""
    w = Window.partitionBy("doc_id")
    ratio = (F.row_number().over(w.orderBy("line_number", "text")) - 1) * 100 / F.greatest(F.lit(1).cast("long"), F.count(F.lit(1)).over(w) - 1)
    name = F.coalesce(F.nullif(F.regexp_extract("text", r"(?i)(?:thank you for shopping at|welcome to)\s+(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"^(.+)\s(?:LTD|LIMITED|PLC)$", 1), F.lit("")))
    out = lines.select("doc_id", "line_number", name.alias("name"), ratio.alias("_r")).where("name IS NOT NULL")
    return out.select("doc_id", "line_number", "name", F.when(F.col("_r") <= 10, F.expr("0.9BD")).when(F.col("_r") <= 25, F.expr("0.7BD")).when(F.col("_r") <= 75, F.expr("0.5BD")).otherwise(F.expr("0.8BD")).alias("weight"))


def match_suppliers(lines: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(doc_id, suppkey, line_number, score): known names anywhere in the first eight lines.

    Score: place and kind of match over 1.8; ties to the longer name, then the line.
    """
    known = suppliers.select(F.col("s_suppkey").cast("long").alias("suppkey"), F.upper(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("name"))
    hit = names_in(lines.where("line_number <= 8").withColumn("_t", F.upper("text")), "_t", known)
    kind = F.when(F.col("_t") == F.col("name"), F.expr("0.40BD")).when(F.col("_t").startswith(F.col("name")), F.expr("0.30BD")).when(F.col("_t").endswith(F.col("name")), F.expr("0.25BD")).otherwise(F.expr("0.15BD"))
    scored = hit.select("doc_id", "suppkey", "line_number", F.length("name").alias("n"), ((F.expr("CAST(greatest(0.30BD - 0.05BD * (line_number - 1), 0.10BD) AS DECIMAL(4,2))") + kind) / F.expr("1.8BD")).cast("decimal(5,3)").alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("n"), "line_number", "suppkey")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "suppkey", "line_number", "score")


def vote_country(docs: DataFrame) -> DataFrame:
    """(doc_id, country, currency, votes): currency signs, and tax words twice; the first of equals; none without votes."""
    counts = [(F.regexp_count("text", F.lit(money)) + 2 * F.regexp_count(F.lower("text"), F.lit(tax))).alias(country) for _, country, _, money, tax in CURRENCY]
    best = F.array_max(F.array(*(F.struct(c.alias("votes"), F.lit(-rank).alias("rank"), F.lit(country).alias("country"), F.lit(code).alias("currency")) for c, (rank, country, code, _, _) in zip(counts, CURRENCY, strict=True))))
    return docs.select("doc_id", best.alias("b")).where("b.votes > 0").select("doc_id", "b.country", "b.currency", "b.votes")


def whole_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, text): the lines of a document in order."""
    rows = lines.groupBy("doc_id").agg(F.collect_list(F.struct("line_number", "text")).alias("r"))
    return rows.select("doc_id", whole_text(F.col("r")).alias("text"))


def whole_text(lines: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(lines), lambda r: r["text"]), "\n")


DISCOUNT_WORDS, DISCOUNT_EXCLUDED = ["discount", "saving", "offer", "% off", "promotion", "price cut"], ["no discount", "without discount"]


def discount_context(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, confidence, has_discounts): min(0.4 n, 1), x 0.6 and at least 0.3 with an exclusion phrase."""
    t = F.lower("text")
    n = sum((F.contains(t, F.lit(w)).cast("int") for w in DISCOUNT_WORDS), F.lit(0))
    excluded = t.rlike("|".join(DISCOUNT_EXCLUDED))
    base = docs.select("doc_id", n.alias("n_words"), excluded.alias("_x"))
    value = F.expr("CAST(least(0.40BD * n_words, 1.00BD) AS DECIMAL(4,2))")
    out = base.withColumn("confidence", F.when(F.col("_x"), F.greatest((value * F.expr("0.6BD")).cast("decimal(4,2)"), F.expr("0.30BD"))).otherwise(value).cast("decimal(4,2)"))
    return out.withColumn("has_discounts", F.col("confidence") > F.expr("0.30BD")).drop("_x")


def analyze_structure(docs: DataFrame) -> DataFrame:
    """(doc_id, currency, tax_system, tax_rate, complexity): votes, the modal rate between 5 and 30, and five flags."""
    t = F.lower("text")
    votes = {c: F.regexp_count("text", F.lit(m)) for _, c, _, m, _ in CURRENCY}
    system = {c: F.when(t.rlike(tax), 1).otherwise(0) + F.when(votes[c] > 0, 2).otherwise(0) for _, c, _, _, tax in CURRENCY}
    top = lambda v: F.array_max(F.array(*(F.struct(v[c].alias("n"), F.lit(-r).alias("r"), F.lit(x).alias("x")) for r, c, x, _, _ in CURRENCY)))
    rates = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(\d{1,2}(?:\.\d{1,2})?)\s*%"), F.lit(1)), lambda x: x.try_cast("decimal(5,2)")), lambda x: (x >= 5) & (x <= 30))
    common = F.array_max(F.transform(F.array_distinct(rates), lambda x: F.struct(F.size(F.filter(rates, lambda y: y == x)).alias("n"), (-x).alias("r"), x.alias("rate"))))
    flags = sum((f.cast("int") for f in (t.rlike("discount"), t.rlike("vat|tax"), t.rlike("service charge|tip"), F.size(F.split("text", "\n")) > 15, t.rlike("visa|card"))), F.lit(0))
    return docs.select("doc_id", top(votes)["x"].alias("currency"), top(system)["x"].alias("tax_system"), common["rate"].alias("tax_rate"), F.when(flags >= 4, "complex").when(flags >= 2, "moderate").otherwise("simple").alias("complexity"))


def check_totals(totals: DataFrame) -> DataFrame:
    """(doc_id, subtotal, total, swapped, warning): UK receipts with discounts whose subtotal exceeds the total are swapped; a subtotal over 1.3 times the total warns."""
    swap = (F.col("tax_system") == "GBP") & F.col("has_discounts") & (F.col("subtotal") > F.col("total"))
    out = totals.select("doc_id", F.when(swap, F.col("total")).otherwise(F.col("subtotal")).alias("subtotal"), F.when(swap, F.col("subtotal")).otherwise(F.col("total")).alias("total"), F.coalesce(swap, F.lit(False)).alias("swapped"))
    return out.withColumn("warning", F.col("subtotal") > F.col("total") * F.expr("1.3BD"))


def totals_differ(item_sum: Column) -> Column:
    diff = F.abs(item_sum + F.col("tax") - F.col("total"))
    return F.coalesce((diff > 1) & (diff > F.col("total") * F.expr("0.05BD")), F.lit(False))


def reconcile_totals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_sum, total, finding, error): items and tax against the total (over 1.0 and 5%), subtotal and tax against it (over 1% and 0.02)."""
    sums = items.groupBy("doc_id").agg(F.sum("price").cast("decimal(16,2)").alias("item_sum"))
    gap = F.abs(F.col("subtotal") + F.col("tax") - F.col("total"))
    out = docs.join(sums, "doc_id", "left").withColumn("item_sum", F.coalesce("item_sum", F.expr("CAST(0 AS DECIMAL(16,2))")))
    return out.select("doc_id", "item_sum", "total", totals_differ(F.col("item_sum")).alias("finding"), F.coalesce(gap > F.greatest(F.col("total") * F.expr("0.01BD"), F.expr("0.02BD")), F.lit(False)).alias("error"))
