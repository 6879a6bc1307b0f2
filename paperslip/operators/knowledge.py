"""Knowledge-base operators: loading, search, context, upserts, changes, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperslip.operators import retrieval as R
from paperslip.operators.dictionary import names_in, whole_words
from paperslip.operators.fields import whole_texts


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 40) -> DataFrame:
    """(doc_id, chunk, text): windows of `size` characters, each `overlap` into the one before; the last may be shorter."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))
    return docs.where("text IS NOT NULL").select("doc_id", "text", F.posexplode(starts).alias("chunk", "at")).select("doc_id", "chunk", F.substring("text", F.col("at") + 1, F.lit(size)).alias("text"))


def kb_id(doc_type: Column, metadata: Column, content: Column) -> Column:
    """16 hex digits of the digest of type, metadata and the first 100 characters."""
    return F.substring(F.md5(F.concat_ws("|", doc_type, metadata, F.substring(content, 1, 100))), 1, 16)


def upsert_kb(kb: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows by id: an update replaces what is there; of several rows of one id the highest version stays."""
    rows = kb.unionByName(updates)
    w = Window.partitionBy("id").orderBy(F.desc("version"), "content")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete_kb(kb: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id is not among those of `gone`."""
    return kb.join(gone.select("id").distinct(), "id", "left_anti")


def kb_stats(kb: DataFrame, by: str) -> DataFrame:
    """(doc_type, n): rows by type and in all (null type)."""
    return kb.rollup(F.col(by).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


def detect_changes(now: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, change): added, removed and changed sources by digest."""
    a, b = now.select("path", F.col("digest").alias("_a")), snapshot.select("path", F.col("digest").alias("_b"))
    both = a.join(b, "path", "full")
    return both.select("path", F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").alias("change")).where("change IS NOT NULL")


def similarity_topk(queries: DataFrame, kb: DataFrame | R.Index, k: int, equal: list[str], probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, relevance, rank): the k most relevant rows per query among those that agree on the filter columns; ties to the smaller id. Exact on a table, by `probes` cells on an index."""
    return R.best(R.search(queries, kb, k, equal, probes=probes), k, ["query_id"]).select("query_id", "vec_id", "relevance", "rank")


#: (type, quota, filter column of the rows): what a query gets of each type; a filter of vendor_type takes rows for all vendors, too.
QUOTAS = [("field_definition", 5, None), ("tax_rule", 3, "country"), ("layout_pattern", 3, "vendor_type"), ("template", 2, "country")]
UNIVERSAL = "universal"


def retrieve_context(queries: DataFrame, kb: DataFrame, quotas: list[tuple] = QUOTAS, least: float = 0.3) -> DataFrame:
    """(query_id, doc_type, vec_id, relevance, n_hits): per query and type at most its quota, of at least `least` relevance, and the number of a query's hits.

    Queries are (query_id, embedding, country, vendor_type); rows (vec_id, embedding, doc_type, country, vendor_type). A type's
    filter asks for the query's own country, or its vendor type or 'universal'; a query without one takes all rows of the type.
    """
    scopes, asked, limit = F.lit(None).cast("array<string>"), [], F.lit(0)
    scope = lambda c: F.concat(F.lit("="), F.col(c))
    for kind, quota, by in quotas:
        own = F.array(F.lit("*")) if by is None else F.array_compact(F.array(F.lit("*"), scope(by)))
        scopes = F.when(F.col("doc_type") == kind, own).otherwise(scopes)
        wanted = [F.lit("*")] if by is None else [F.coalesce(scope(by), F.lit("*")), *([F.when(F.col(by).isNotNull(), F.lit("=" + UNIVERSAL))] if by == "vendor_type" else [])]
        asked += [F.when(w.isNotNull(), F.struct(F.lit(kind).alias("doc_type"), w.alias("scope"))) for w in wanted]
        limit = F.when(F.col("doc_type") == kind, F.lit(quota)).otherwise(limit)
    rows = kb.withColumn("scope", F.explode(scopes)).select("vec_id", "embedding", "doc_type", "scope")
    each = queries.select("query_id", "embedding", F.inline(F.array_distinct(F.array_compact(F.array(*asked)))))
    hits = R.search(each, rows, max(q for _, q, _ in quotas), ["doc_type", "scope"]).where(F.col("relevance") >= least).select("query_id", "doc_type", "vec_id", "relevance").distinct()
    kept = R.best(hits, max(q for _, q, _ in quotas), ["query_id", "doc_type"]).where(F.col("rank") <= limit)
    return kept.select("query_id", "doc_type", "vec_id", "relevance", F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("n_hits"))


def build_context(hits: DataFrame, per_hit: int = 150, most: int = 1500) -> DataFrame:
    """(query_id, context): hit texts by rank with card numbers, dates and numbers masked, without blank ones and example lines, each cut to `per_hit` and all to `most` characters.

    Every hit has a character and a line break at least, so that no more than `most` / 2 of a query's hits are gathered.
    """
    body = F.concat_ws("\n", F.filter(F.split("text", "\n"), lambda x: ~F.rlike(x, F.lit(r"(?i)^\s*(?:example|e\.g\.)"))))
    for pattern, mask in ((r"[*xX]{4,}[ -]?\d{4}|\b(?:\d{4}[ -]?){3}\d{4}\b", "[card]"), (r"\d{2}/\d{2}/\d{4}", "[date]"), (r"\d+(?:\.\d+)?", "[n]")):
        body = F.regexp_replace(body, pattern, mask)
    rows = hits.select("query_id", "rank", F.substring(body, 1, per_hit).alias("t")).where("trim(t) <> ''")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "t"))).where(F.col("_n") <= most // 2)
    per = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_n", "t"))).alias("xs"))
    return per.select("query_id", F.substring(F.array_join(F.transform("xs", lambda x: x["t"]), "\n"), 1, most).alias("context"))


# fixed values: types of vendors by the first list that has a word in the text
VENDOR_TYPES = [
    ("grocery", ["SUPERMARKET", "GROCERY", "FRESH", "MART", "STORE", "SHOP"]),
    ("petrol", ["PETROL", "FUEL", "GAS STATION", "PUMP", "SHELL", "BP", "EXXON"]),
    ("pharmacy", ["PHARMACY", "CHEMIST", "DRUG STORE", "MEDICAL"]),
    ("restaurant", ["RESTAURANT", "CAFE", "COFFEE", "DINER", "BISTRO", "EATERY"]),
    ("ecommerce", ["AMAZON", "EBAY", "ORDER", "INVOICE", "DISPATCH"]),
]


def match_vendors(lines: DataFrame, vendors: DataFrame, countries: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """(doc_id, vendor, vendor_type, confidence): the best vendor of each document from 0.4 on, the smallest of equals; else none, with a type told by words, at 0.3.

    Vendors are rows (vendor, name), one for each name pattern of a vendor, and, where there are any, country, type,
    address (an array of words), phone (a pattern) and website, which are the same in all rows of a vendor;
    countries are (doc_id, country). A pattern that stands in a line as whole words gives two points, else within words
    one; each address word, the phone and the website anywhere in the document half a point. Confidence is points
    over 2 * patterns + 2, 1 at most. Vendors of another country than the document's do not count. `first` limits
    the lines that names are looked for in. The dictionary may be of any size. Documents of blank lines have no type and
    confidence 0.
    """
    kinds = {"address": "array<string>"}
    there = lambda c: (F.col(c) if c in vendors.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c)
    patterns = vendors.select("vendor", F.upper("name").alias("name")).distinct()
    about = vendors.select("vendor", *map(there, ("country", "type", "address", "phone", "website"))).groupBy("vendor").agg(*(F.first(c).alias(c) for c in ("country", "type", "address", "phone", "website")))
    about = about.join(patterns.groupBy("vendor").agg(F.count(F.lit(1)).alias("_patterns")), "vendor")
    head = (lines if first is None else lines.where(F.col("line_number") <= first)).select("doc_id", F.upper("text").alias("t"))
    hit = names_in(head, "t", patterns)
    each = hit.groupBy("doc_id", "vendor", "name").agg(F.max(F.when(whole_words("t", "name"), 2).otherwise(1)).alias("points"))
    named = each.groupBy("doc_id", "vendor").agg(F.sum("points").cast("decimal(10,1)").alias("points"))
    if countries is not None:
        named = named.join(countries.select("doc_id", F.col("country").alias("_of")), "doc_id", "left")
    else:
        named = named.withColumn("_of", F.lit(None).cast("string"))
    named = named.join(about, "vendor").where("country IS NULL OR _of IS NULL OR country = _of")
    texts = whole_texts(lines).select("doc_id", F.col("text").alias("_text"))
    named = named.join(texts, "doc_id")
    upper = F.upper("_text")
    half = lambda c: F.when(F.coalesce(c, F.lit(False)), F.expr("0.5BD")).otherwise(F.expr("0.0BD"))
    words = F.expr("0.5BD") * F.size(F.filter(F.coalesce("address", F.array().cast("array<string>")), lambda w: (w != "") & F.contains(upper, F.upper(w))))
    points = F.col("points") + words + half((F.col("phone") != "") & F.rlike(upper, F.col("phone"))) + half((F.col("website") != "") & F.contains(F.lower("_text"), F.lower("website")))
    scored = named.select("doc_id", "vendor", F.coalesce("type", F.lit("other")).alias("vendor_type"), F.least(points / (2 * F.col("_patterns") + 2), F.expr("1.0BD")).cast("decimal(6,4)").alias("confidence")).where("confidence >= 0.4BD")
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "vendor")
    best = scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    kind = F.lit("other")
    for name, keys in reversed(VENDOR_TYPES):
        kind = F.when(sum((F.contains(upper, F.lit(k)).cast("int") for k in keys), F.lit(0)) > 0, F.lit(name)).otherwise(kind)
    out = texts.select("doc_id", F.when(F.trim("_text") != "", kind).alias("_kind")).join(best, "doc_id", "left")
    missing = F.when(F.col("_kind").isNull(), F.expr("0.0BD")).otherwise(F.expr("0.3BD"))
    return out.select("doc_id", "vendor", F.coalesce("vendor_type", "_kind").alias("vendor_type"), F.coalesce("confidence", missing).cast("decimal(6,4)").alias("confidence"))


def daily_quota(patterns: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(id, mode, admitted): a request is admitted while the patterns admitted or not before it that day stay below the limit, so the last one may overshoot.

    Counts run within the hour first and then over the hours of a day, so that no day is in one task.
    """
    day, hour = F.to_date("ts"), F.hour("ts")
    rows = patterns.select("id", "mode", "n", "ts", day.alias("day"), hour.alias("hour"))
    inner = Window.partitionBy("day", "mode", "hour").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("day", "mode", "hour").agg(F.sum("n").alias("h"))
    hours = hours.select("day", "mode", "hour", F.coalesce(F.sum("h").over(Window.partitionBy("day", "mode").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    counted = rows.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(hours, ["day", "mode", "hour"])
    limit = F.lit(0)
    for m, n in limits.items():
        limit = F.when(F.col("mode") == m, F.lit(n)).otherwise(limit)
    return counted.select("id", "mode", ((F.col("_in") + F.col("_before")) < limit).alias("admitted"))
