"""Items of model answers of any shape, and items recovered from flat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words of an item table's head and foot, keys of an item, and names that are no items
HEAD = "ITEM|QTY|QUANTITY|PRICE|AMUUNT|AMOUNT"
FOOT = "SUBTOTAL|GRAND TOTAL|TOTAL|CGST|SGST|GST|VAT|TAX|TOKEN"
NAME_KEYS, QUANTITY_KEYS, PRICE_KEYS = ["name", "description", "item"], ["quantity", "qty"], ["total_price", "price", "amount", "unit_price"]
NO_ITEMS = ["gst", "cgst", "sgst", "vat", "tax", "total", "subtotal", "grand total", "discount", "service charge"]
STRAY_KEYS = ["quantity", "qty", "unit_price", "total_price"]
#: A receipt number with one of these words, or too long, is a piece of the item table.
TABLE_WORDS, LONGEST_NUMBER, LONGEST_BRACKETED = ["ITEM", "QTY", "PRICE", "AMUUNT", "AMOUNT"], 120, 30

_AMOUNT = "decimal(16,2)"


# ---- answers of any shape, as VARIANT


def _string(v: Column, path: str = "$") -> Column:
    return F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _amount(text: Column) -> Column:
    """The number in a text, without currency signs and thousands; zero counts as none, as an empty text does."""
    return F.nullif(F.regexp_replace(text, "[^0-9.-]", "").try_cast(_AMOUNT), F.lit(0).cast(_AMOUNT))


def _from_object(v: Column) -> Column:
    name = F.coalesce(*(x for k in NAME_KEYS for x in (_string(v, f"$.{k}[0]"), _string(v, f"$.{k}"))), F.lit("N/A"))
    quantity = F.coalesce(*(_string(v, f"$.{k}") for k in QUANTITY_KEYS), F.lit("1"))
    price = F.coalesce(*(_amount(F.coalesce(_string(v, f"$.{k}.value"), _string(v, f"$.{k}"))) for k in PRICE_KEYS))
    return F.struct(name.alias("name"), quantity.alias("quantity"), price.alias("total_price"))


def _from_list(v: Column) -> Column:
    """[name, quantity, price], [name, price] or [name, {...}]: the price is the last part that has a number or is an object."""
    parts = F.try_variant_get(v, "$", "array<variant>")
    rest = F.reverse(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    found = F.transform(rest, lambda p: F.when(_is(p, "OBJECT"), F.struct(_from_object(p)["total_price"].alias("price"), _from_object(p)["quantity"].alias("quantity"))).when(~_is(p, "ARRAY") & _string(p).rlike(r"\d"), F.struct(_amount(_string(p)).alias("price"), F.lit(None).cast("string").alias("quantity"))))
    first = F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))
    second = F.try_element_at(parts, F.lit(2))
    quantity = F.when((F.size(parts) >= 3) & ~_is(second, "OBJECT"), _string(second))
    head = F.try_element_at(parts, F.lit(1))
    return F.when((F.size(parts) > 0) & ~_is(head, "OBJECT"), F.struct(_string(head).alias("name"), F.coalesce(quantity, first["quantity"], F.lit("1")).alias("quantity"), first["price"].alias("total_price")))


def normalize_items(records: DataFrame, column: str = "record") -> DataFrame:
    """(doc_id, item_no, name, quantity, total_price) of the `items` of JSON records: objects, lists and strings, also mixed in one array.

    Names of taxes, totals and the like, and those of one sign, are dropped; items are numbered as they stood. Records that are no JSON, or
    whose items are no array, give none. A quantity that is no whole number is 1.
    """
    v = F.try_parse_json(column)
    each = records.select("doc_id", F.posexplode(F.try_variant_get(v, "$.items", "array<variant>")).alias("at", "v"))
    x = F.col("v")
    one = F.when(_is(x, "OBJECT"), _from_object(x)).when(_is(x, "ARRAY"), _from_list(x)).when(_is(x, "STRING"), F.struct(_string(x).alias("name"), F.lit("1").alias("quantity"), F.lit(None).cast(_AMOUNT).alias("total_price")))
    kept = F.filter(F.array(one), lambda i: (F.length(i["name"]) > 1) & ~F.lower(i["name"]).isin(NO_ITEMS))  # a filter behind it would be moved down and read every item again, once per column
    rows = each.select("doc_id", (F.col("at") + 1).alias("item_no"), F.inline(kept))
    return rows.select("doc_id", "item_no", "name", F.coalesce(F.col("quantity").try_cast("decimal(18,2)").try_cast("int"), F.lit(1)).alias("quantity"), "total_price")


def clean_records(records: DataFrame, column: str = "record") -> DataFrame:
    """(doc_id, field, value): the top-level fields of JSON records but `items`; keys of items that leaked to the top are dropped, receipt numbers with pieces of the item table are null."""
    fields = F.try_variant_get(F.try_parse_json(column), "$", "map<string, variant>")
    each = records.select("doc_id", F.explode(fields).alias("field", "v")).where(~F.col("field").isin([*STRAY_KEYS, "items"]))
    value = F.try_variant_get("v", "$", "string")
    dirty = (F.length(value) > LONGEST_NUMBER) | F.upper(value).rlike("|".join(TABLE_WORDS)) | (value.rlike(r"[\[{]") & (F.length(value) > LONGEST_BRACKETED))
    return each.select("doc_id", "field", F.when((F.col("field") == "receipt_number") & F.coalesce(dirty, F.lit(False)), F.lit(None)).otherwise(value).alias("value"))


# ---- flat text


def triplets(numbers: Column) -> Column:
    """Numbers in reading order as (quantity, unit_price, total_price), by one fold.

    Three numbers whose first is a whole number from 1 to 20 are an item; otherwise the first two are unit and total price of one
    piece, and the third begins the next item. At the end two numbers are a pair, and one is a total.
    """
    item = lambda q, u, t: F.struct(q.cast("int").alias("quantity"), u.cast(_AMOUNT).alias("unit_price"), t.cast(_AMOUNT).alias("total_price"))
    none, one = F.array().cast(f"array<{_AMOUNT}>"), F.lit(1)
    start = F.struct(none.alias("queue"), F.array().cast(f"array<struct<quantity:int,unit_price:{_AMOUNT},total_price:{_AMOUNT}>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        queue = F.concat(s["queue"], F.array(x))
        a, b = F.get(queue, F.lit(0)), F.get(queue, F.lit(1))
        whole = (a == F.floor(a)) & a.between(1, 20) & (b > 0) & (x > 0)
        full = F.size(queue) == 3
        rest = F.when(full & whole, none).when(full, F.array(x)).otherwise(queue)
        return F.struct(rest.alias("queue"), F.when(full, F.concat(s["out"], F.array(F.when(whole, item(a, b, x)).otherwise(item(one, a, b))))).otherwise(s["out"]).alias("out"))

    def end(s: Column) -> Column:
        a, b = F.get(s["queue"], F.lit(0)), F.get(s["queue"], F.lit(1))
        return F.when(F.size(s["queue"]) == 2, F.concat(s["out"], F.array(item(one, a, b)))).when(F.size(s["queue"]) == 1, F.concat(s["out"], F.array(item(one, F.lit(None), a)))).otherwise(s["out"])

    return F.aggregate(numbers, start, step, end)


def shared_out(words: Column, n: Column) -> Column:
    """Words as n names of as many words each, the last with the rest; too few words are cut at capitals first, and if they are still too few each name is all of them."""
    cut = F.filter(F.split(F.regexp_replace(F.array_join(words, " "), r"(?<=\p{Ll})(?=\p{Lu})", " "), " "), lambda w: w != "")
    own = F.when(F.size(words) >= n, words).otherwise(cut)
    each = F.floor(F.size(own) / n).cast("int")
    name = lambda i: F.when(F.size(own) < n, F.array_join(words, " ")).otherwise(F.array_join(F.slice(own, i * each + 1, F.when(i == n - 1, F.size(own) - i * each).otherwise(each)), " "))
    return F.transform(F.sequence(F.lit(0), n - 1), name)


def recover_items_flat(texts: DataFrame) -> DataFrame:
    """(doc_id, item_no, name, quantity, unit_price, total_price) from one text per document, whatever its line breaks.

    The block lies between the words of the table's head and its foot. If words follow each run of numbers up to the last number,
    a run of words names the items of the run of numbers behind it; if all words come after (or before) all numbers, they are shared out among all items.
    A text without numbers in its block gives no rows.
    """
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    behind = F.regexp_replace(flat, rf"^.*?\b(?:{HEAD})\b(?:\s*\b(?:(?i)(?:{HEAD}))\b)*", "")
    block = F.trim(F.get(F.split(behind, rf"(?i)\b(?:{FOOT})\b", 2), F.lit(0)))
    number = r"^\d+(?:[.,]\d+)?$"
    rows = texts.select("doc_id", F.filter(F.split(block, " "), lambda t: (t != "") & (t != "x") & (t != "£")).alias("t"))
    rows = rows.withColumn("t", F.transform("t", lambda t: F.regexp_replace(t, r"^[£€$](?=\d)", "")))
    # runs: each word or number token goes to the run that it continues, words first
    word = lambda t: ~t.rlike(number)
    run = "struct<words:array<string>,numbers:array<decimal(16,2)>>"
    fresh = lambda w, n: F.struct(w.cast("array<string>").alias("words"), n.cast("array<decimal(16,2)>").alias("numbers"))
    value = lambda t: F.array(F.replace(t, F.lit(","), F.lit(".")).try_cast(_AMOUNT))

    def step(runs: Column, t: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        before = F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))
        new = (F.size(runs) == 0) | (word(t) & (F.size(last["numbers"]) > 0))
        return (
            F.when(new & word(t), F.concat(runs, F.array(fresh(F.array(t), F.array()))))
            .when(new, F.concat(runs, F.array(fresh(F.array(), value(t)))))
            .when(word(t), F.concat(before, F.array(fresh(F.concat(last["words"], F.array(t)), last["numbers"]))))
            .otherwise(F.concat(before, F.array(fresh(last["words"], F.concat(last["numbers"], value(t))))))
        )

    runs = F.aggregate("t", F.array().cast(f"array<{run}>"), step)
    rows = rows.select("doc_id", runs.alias("r"))
    named = F.size(F.filter("r", lambda x: (F.size(x["words"]) > 0) & (F.size(x["numbers"]) > 0)))
    # numbers first and all names behind, or all names and then all numbers: one run of both
    apart = (F.size("r") == 2) & (named == 0)
    whole = F.array(fresh(F.flatten(F.transform("r", lambda x: x["words"])), F.flatten(F.transform("r", lambda x: x["numbers"]))))
    used = F.when(apart, whole).otherwise(F.filter("r", lambda x: F.size(x["numbers"]) > 0))
    priced = F.transform(used, lambda x: F.struct(x["words"].alias("words"), triplets(x["numbers"]).alias("i")))
    priced = F.filter(priced, lambda x: F.size(x["i"]) > 0)
    each = F.flatten(F.transform(priced, lambda x: F.arrays_zip(shared_out(x["words"], F.size(x["i"])).alias("name"), x["i"].alias("item"))))
    found = rows.select("doc_id", F.posexplode(each).alias("k", "y"))  # items leave their document once
    return found.select("doc_id", (F.col("k") + 1).alias("item_no"), "y.name", "y.item").select("doc_id", "item_no", "name", "item.*")
