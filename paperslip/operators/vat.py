"""VAT lines: tokens are typed, the string of types names the layout, and size and ratio give the amounts their roles.

A line is split at blanks; each token becomes one letter: K or I (tax word, also in other languages), P (percentage), C (code),
B (code and percentage in one, A(20%)), A (amount), N (net word), T (total word), O ("on"), X ("inc"), W (any other word).
Layouts are patterns over these letters, so that a new one is a row of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (letter, pattern of a whole token), the first that fits.
TOKENS = [
    ("K", r"(?i)(?:vat|tax|gst)[.:]?"),
    ("I", r"(?i)(?:tva|mwst|ust|iva|btw)[.:]?"),
    ("B", r"[A-Za-z0-9]{1,2}:?\(\d+(?:\.\d+)?%\)"),
    ("P", r"\d+(?:\.\d+)?%|\d{1,2}"),
    ("A", r"-?[£€$]?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{1,2}|-?[£€$]\d+(?:,\d{3})*"),
    ("N", r"(?i)(?:net|amount|goods|excl)[.:]?"),
    ("T", r"(?i)(?:totals?|gross|sum)[.:]?"),
    ("O", r"(?i)(?:on|from|of)"),
    ("X", r"(?i)(?:inc|incl|including)\.?"),
    ("C", r"[A-Za-z][A-Za-z0-9]?:?|\d[A-Za-z]:?"),
]
#: (layout, pattern over the letters, whether it needs a table header above if the line has no tax word), the first that fits.
LAYOUTS = [
    ("rate_on_net", r"[KI]PAOA", False),
    ("named_parts", r"NA[KI]ATA", False),
    ("rate_word_code", r"P[KI]CA", False),
    ("rate_word", r"P[KI]A", False),
    ("foreign_table", r"IPA{1,3}", False),
    ("word_at_rate", r"KPA{0,3}", False),
    ("joined_code_table", r"W*BA{1,4}", False),
    ("code_table", r"CPA{2,4}", False),
    ("rated_code_table", r"CPW+A{2,4}", False),
    ("rate_table", r"PA{2,4}", False),
    ("net_rate_total", r"APA", True),
    ("included", r"X?[KI]A", False),
    ("totals", r"TA{3}", True),
    ("amounts", r"A{3}", True),
    ("code_amount", r"CA{1,3}", True),
]
#: A header names two of these words; it holds for the lines up to HEADER_REACH below it.
HEADER_WORDS = ["VAT", "NET", "GROSS", "RATE", "TAX", "CODE", "GOODS"]
HEADER_REACH = 8
_ZERO = "CAST(0 AS DECIMAL(16,2))"


def tidied(text: Column) -> Column:
    """One blank between tokens; decimal commas, letters read for digits, and blanks inside amounts and percentages repaired; signs that only separate go."""
    for pattern, by in (
        (r"(?<=\d)[oO](?=[\d.,%])|(?<=[.,]\d{0,1})[oO](?![A-Za-z])", "0"),
        (r"(\d),(\d{1,2})(?![\d,])", "$1.$2"),
        (r"([£€$])\s+(?=\d)", "$1"),
        (r"(\d)\s+%", "$1%"),
        (r"(?<=^|\s)([A-Za-z]\d?:?)\s*\(\s*(\d+(?:\.\d+)?%)\s*\)", "$1($2)"),
        (r"%:", "%"),
        (r"[@=|]", " "),
        (r"(?<=\d[%.]?\d{0,2})\s*:\s*(?=[£€$])", " "),
        (r"\s+", " "),
    ):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def _letter(token: Column) -> Column:
    out = F.lit("W")
    for letter, pattern in reversed(TOKENS):
        out = F.when(token.rlike(f"^(?:{pattern})$"), F.lit(letter)).otherwise(out)
    return out


def parse_vat_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, layout, code, rate, net, vat, total, consistent) of the lines that a layout reads, or (layout `tokens`) that have a tax word and an amount, or only codes, numbers and amounts below a header.

    Three amounts are VAT, net and total by size if the smallest is 5 to 40 % of the middle one, else only net and total; of
    more the three largest count, with the first that is such a share of the net as VAT. Two are VAT and net by the same share, with
    their sum as total, else net and total with their difference as VAT. One is the VAT. At a rate of zero the largest is net
    and total. Consistent: net + VAT is the total within 0.02, VAT is the rate's share of the net within one point, and the rate
    is 40 % at most, as far as these are known.
    """
    w = Window.partitionBy("doc_id").orderBy("line_number", "text")
    named = sum((F.upper("text").rlike(rf"\b{word}\b").cast("int") for word in HEADER_WORDS), F.lit(0))
    header = (named >= 2) & ~F.col("text").rlike(r"\d")
    near = F.max(F.when(header, F.col("_n"))).over(w.rowsBetween(-HEADER_REACH, -1)).isNotNull()
    rows = lines.select("doc_id", "line_number", "text").withColumn("_n", F.lit(1)).withColumn("_header", near)
    # most lines have neither a percentage nor a tax word nor a header above
    rows = rows.where(F.col("text").rlike(r"(?i)\d") & (F.col("_header") | F.col("text").rlike(r"(?i)[%a]|tax|iva|mwst|ust|btw|gst")))
    # within arrays: the filter on the layout would be moved below and type all tokens again for each layout
    rows = rows.select("*", F.inline(F.array(F.struct(F.split(tidied(F.col("text")), " ").alias("_t")))))
    rows = rows.select("*", F.inline(F.array(F.struct(F.array_join(F.transform("_t", _letter), "").alias("_k")))))
    layout = F.lit(None).cast("string")
    for name, pattern, needs in reversed(LAYOUTS):
        fits = F.col("_k").rlike(f"^(?:{pattern})$")
        layout = F.when(fits & F.col("_header") if needs else fits, F.lit(name)).otherwise(layout)
    marked = F.col("_t")
    free = ((F.col("_header") & F.col("_k").rlike("^[ABCNPT]+$")) | F.col("_k").rlike("[KI]")) & F.col("_k").rlike("A") & ~F.col("text").rlike(r"(?i)\b(?:no|number|reg)\b|^(?:sub)?total")
    rows = rows.withColumn("layout", F.coalesce(layout, F.when(free, F.lit("tokens")))).where("layout IS NOT NULL")

    of = lambda letters: F.filter(marked, lambda t, i: F.contains(F.lit(letters), F.substring(F.col("_k"), i + 1, F.lit(1))))
    number = lambda t, kind: F.regexp_replace(t, "[^0-9.-]", "").try_cast(kind)
    joined = F.try_element_at(of("B"), F.lit(1))
    rate = F.coalesce(F.regexp_extract(joined, r"\((\d+(?:\.\d+)?)%", 1).try_cast("decimal(5,2)"), number(F.try_element_at(of("P"), F.lit(1)), "decimal(5,2)"))
    code = F.upper(F.coalesce(F.regexp_extract(joined, r"^([A-Za-z0-9]{1,2})", 1), F.regexp_replace(F.try_element_at(of("C"), F.lit(1)), ":", "")))
    amounts = F.filter(F.transform(of("A"), lambda t: number(t, "decimal(16,2)")), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "line_number", "layout", code.alias("code"), rate.alias("rate"), amounts.alias("a")).withColumn("s", F.array_sort("a")).withColumn("n", F.size("a"))
    rows = rows.where("n > 0 OR layout = 'word_at_rate'")

    at = lambda c, i: F.get(c, i if isinstance(i, Column) else F.lit(i))
    share = lambda small, net: F.coalesce((small >= net * F.expr("0.05BD")) & (small <= net * F.expr("0.4BD")), F.lit(False))
    n, a, s = F.col("n"), F.col("a"), F.col("s")
    mid, top = at(s, n - 2), at(s, n - 1)
    low = F.when(n == 3, at(s, 0)).otherwise(F.get(F.filter(a, lambda x: share(x, mid)), F.lit(0)))
    part = lambda net, vat, total: F.struct(net.cast("decimal(16,2)").alias("net"), vat.cast("decimal(16,2)").alias("vat"), total.cast("decimal(16,2)").alias("total"))
    null = F.lit(None)
    roles = (
        F.when(n == 0, part(null, null, null))
        .when(F.col("rate") == 0, part(top, F.expr(_ZERO), top))
        .when(F.col("layout") == "rate_on_net", part(at(a, 1), at(a, 0), at(a, 0) + at(a, 1)))
        .when(F.col("layout") == "named_parts", part(at(a, 0), at(a, 1), at(a, 2)))
        .when(F.col("layout") == "net_rate_total", part(at(a, 0), at(a, 1) - at(a, 0), at(a, 1)))
        .when(n == 1, part(null, at(a, 0), null))
        .when(n == 2, F.when(share(at(s, 0), at(s, 1)), part(at(s, 1), at(s, 0), at(s, 0) + at(s, 1))).otherwise(part(at(s, 0), at(s, 1) - at(s, 0), at(s, 1))))
        .otherwise(part(mid, F.when(share(low, mid), low), top))
    )
    out = rows.select("doc_id", "line_number", "layout", "code", "rate", F.inline(F.array(roles)))
    sums = F.abs(F.col("net") + F.col("vat") - F.col("total")) <= F.expr("0.02BD")
    close = F.abs(F.col("vat") * 100 - F.col("rate") * F.col("net")) <= F.greatest(F.col("net"), F.expr("2.00BD"))
    return out.withColumn("consistent", F.coalesce(sums, F.lit(True)) & F.coalesce(close, F.lit(True)) & F.coalesce(F.col("rate") <= 40, F.lit(True)))
