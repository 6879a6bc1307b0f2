"""Dates in any of many layouts: mined from lines by ranked patterns and formats, and found again in any of their renderings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: patterns by priority (3 is high), formats in the order in which they are tried, renderings that a date is looked for in
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|January|February|March|April|May|June|July|August|September|October|November|December)"
LABEL = "date|invoice date|bill date|transaction date|receipt date|purchase date|sale date|dt|dated"
RULES = [
    (3, "day_month_name", rf"\b\d{{1,2}}\s+{MONTH}\s?'?\s*\d{{2,4}}\b"),
    (3, "month_name_day", rf"\b{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s*\d{{2,4}})?\b"),
    (3, "labelled", rf"\b(?:{LABEL})[:\s]*\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}\b"),
    (3, "iso_time", r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\b"),
    (3, "iso", r"\b\d{4}-\d{2}-\d{2}\b"),
    (3, "eight_digits", r"\b(?:19|20)\d{6}\b"),
    (3, "day_month_year", r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b"),
    (2, "short_year", r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2}\b"),
    (2, "joined_day_first", rf"\b\d{{1,2}}[-/.]?{MONTH}[-/.]?\d{{2,4}}\b"),
    (2, "joined_month_first", rf"\b{MONTH}\d{{1,2}}\d{{2,4}}\b"),
    (1, "six_digits", r"\b\d{6}\b"),
]
FORMATS = [
    "d-M-yyyy", "d-M-yy", "d/M/yyyy", "d.M.yyyy", "d/M/yy", "d.M.yy", "yyyy-M-d", "yyyyMMdd", "yyMMdd", "d MMM yyyy", "d MMM yy", "d MMMM yyyy", "d MMMM yy", "MMM d yyyy", "MMMM d yyyy", "MMM ddyyyy", "MMMM ddyyyy",
    "MMM ddyy", "MMMM ddyy", "ddMMyyyy", "ddMMyy", "d-MMM-yy", "d-MMM-yyyy", "d/MMM/yyyy", "d.MMM.yyyy", "d/MMM/yy", "d.MMM.yy", "yyyy-MM-dd'T'HH:mm:ss",
]
RENDERINGS = ["dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yy", "dd-MM-yy", "dd.MM.yy", "dd MMM yyyy", "dd MMMM yyyy", "MMM dd yyyy", "MMMM dd, yyyy", "yyyy-MM-dd"]
#: Years from this one on are preferred.
RECENT = 2020


def tidied(raw: Column) -> Column:
    """A found date without its label, ordinal letters, commas and apostrophes, with blanks between day, month name and year."""
    for pattern, by in (
        (rf"(?i)^(?:{LABEL})[:\s-]*", ""),
        (r"[’'`,]", " "),
        (r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"),
        (r"(?i)\bsept\b|(?<=\d)sept(?=\d|\b)|\bsept(?=\d)", "Sep"),
        (r"(?<=[A-Za-z]{3})(?=\d)", " "),
        (r"(?<=\d)(?=[A-Za-z]{3})", " "),
        (r"\s+", " "),
    ):
        raw = F.regexp_replace(raw, pattern, by)
    return F.trim(raw)


def _shape(form: str) -> str:
    """A pattern that every text has which the format reads, its year within 1900 to 2100 if it has four digits."""
    sizes = {"yyyy": r"(?:(?:19|20)\d\d|2100)", "yy": r"\d\d", "dd": r"\d\d", "MM": r"\d\d", "HH": r"\d\d", "mm": r"\d\d", "ss": r"\d\d", "d": r"\d+", "M": r"\d+", "MMM": "[A-Za-z]+", "MMMM": "[A-Za-z]+", "'T'": "[Tt]", ".": "[.]"}
    return "^" + "".join(sizes.get(part, part) for part in re.findall(r"y+|M+|d+|H+|m+|s+|'T'|.", form)) + "$"


def parsed(text: Column) -> Column:
    """The day of the first format that reads the text; two digits of a year from 69 on are of the last century. Only 1900 to 2100."""
    read = []
    for form in FORMATS:  # a format is tried only where the text has its shape, as a failing one costs an exception
        found = F.to_date(F.try_to_timestamp(text, F.lit(form)))
        if "yyyy" not in form:
            found = F.add_months(found, F.when(F.year(found) >= 2069, -1200).otherwise(0))
        read.append(F.when(text.rlike(_shape(form)), found))
    return F.coalesce(*read)


def dates_in(lines: DataFrame) -> DataFrame:
    """(doc_id, line_number, raw, rule, priority, day, labelled): every date that a pattern finds and a format reads."""
    text = F.col("text")

    def of(priority: int, name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0)), lambda raw: F.struct(raw.alias("raw"), F.lit(name).alias("rule"), F.lit(priority).alias("priority"), tidied(raw).alias("tidied")))

    found = F.concat(*(of(*rule) for rule in RULES))
    read = F.transform(found, lambda x: F.struct(x["raw"].alias("raw"), x["rule"].alias("rule"), x["priority"].alias("priority"), parsed(x["tidied"]).alias("day")))
    labelled = F.lower(text).rlike(r"\b(?:date|invoice|bill|transaction|receipt|purchase|sale|dt|dated)\b")
    month = "(?:jan|feb|ma[ry]|apr|ju[nl]|aug|sep|oct|nov|dec)"
    shaped = rf"(?i)\d(?:[-/.]\d{{1,2}}[-/.]\d|[-/.\s]*{month})|\b\d{{6}}(?:\d\d)?\b|{month}[a-z]*\s*\d"  # what every rule asks for
    # dates without a day go within the array: a filter behind it would be moved down and read every date twice
    return lines.where(text.rlike(shaped)).select("doc_id", "line_number", labelled.alias("labelled"), F.inline(F.filter(read, lambda x: x["day"].isNotNull()))).select("doc_id", "line_number", "raw", "rule", "priority", "day", "labelled")


def mine_dates(lines: DataFrame) -> DataFrame:
    """(doc_id, day, line_number, labelled): the best date per document: by priority, recent years, the longer text, labelled lines, then the first line."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("priority"), F.desc(F.year("day") >= RECENT), F.desc(F.length("raw")), F.desc("labelled"), "line_number", "raw")
    return dates_in(lines).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "day", "line_number", "labelled")


def renderings(day: Column) -> Column:
    return F.array(*(F.lower(F.date_format(day, f)) for f in RENDERINGS))


def locate_source_line(values: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, value, line_number): the first line that holds a value, in any case; a date (yyyy-MM-dd) in any of its renderings; null if none."""
    day = F.when(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("value").try_cast("date"))
    wanted = values.select("doc_id", "value", F.when(day.isNotNull(), renderings(day)).otherwise(F.array(F.lower("value"))).alias("_forms"))
    row = F.struct("line_number", F.lower("text").alias("text"))
    docs = lines.where("line_number IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("_lines"))  # one document's lines; values meet them as one row
    first = F.try_element_at(F.filter("_lines", lambda l: F.exists("_forms", lambda f: F.contains(l["text"], f))), F.lit(1))["line_number"]
    return wanted.join(docs, "doc_id", "left").select("doc_id", "value", first.alias("line_number"))
