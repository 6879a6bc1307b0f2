"""Layout operators on words with boxes: reading order, line grouping, neighbours by place."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDRESS_WORDS = r"(?i)street|road|avenue|lane|suite|receipt|date"


def _gathered(words: DataFrame, columns: list[str]) -> DataFrame:
    return words.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("ws"))  # one document's words


def _flat(ws: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The words of a batch's documents, and for each the place of its document."""
    ends = ws.offsets.to_numpy()
    return np.repeat(np.arange(len(ws)), np.diff(ends)), ws.flatten()


def _numbers(flat: pa.StructArray, name: str) -> np.ndarray:
    """A column of whole numbers; nulls stand first, as in Spark's order."""
    return flat.field(name).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _ordered(flat: pa.StructArray, *keys: np.ndarray) -> np.ndarray:
    """Places by the keys, the first of them first; what is equal in all stands by its text."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for key in keys:
        same &= key[order[1:]] == key[order[:-1]]
    if same.any():
        text = np.unique(np.array(flat.field("text").fill_null("").to_pylist(), object), return_inverse=True)[1]
        order = np.lexsort((text, *keys[::-1]))
    return order


def _joined(text: pa.Array, starts: np.ndarray) -> pa.Array:
    """The texts from each start to the next, with blanks between; nulls are left out."""
    there = text.is_valid().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(there)])[np.append(starts, len(text))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), text.drop_null()), " ")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def reconstruct_lines(words: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(doc_id, line_number, text): words in reading order, per page of a document.

    Words by the height of their middle join the open line whose mean middle is nearest, within
    `tolerance` x its mean height; a fold that depends on its own order, so it runs per document. Middles only grow
    down a page, so a line that a word lies too far below is closed: no later word reaches it.
    """
    placed = ["page", (F.col("y0") + F.col("y1")).alias("cy"), (F.col("x0") + F.col("x1")).alias("cx"), "word_id", (F.col("y1") - F.col("y0")).alias("h"), "text"]

    def fold(doc: list[int], page: list[int], cy: list[int], h: list[int]) -> tuple[list[int], list[float]]:
        number, middles, at, heights, counts = [], [], None, [], []
        open_lines: list[int] = []
        for d, p, y, high in zip(doc, page, cy, h, strict=True):
            if at != (d, p):
                at, open_lines = (d, p), []
            best = away = -1
            closed = False
            for i in open_lines:
                apart = abs(y - middles[i])
                if apart > 2 * tolerance * heights[i]:
                    closed = True
                elif best < 0 or apart < away:
                    best, away = i, apart
            if closed:
                open_lines = [i for i in open_lines if abs(y - middles[i]) <= 2 * tolerance * heights[i]]
            if best < 0:
                best = len(middles)
                middles.append(y)
                heights.append(high)
                counts.append(1)
                open_lines.append(best)
            else:
                n = counts[best]
                middles[best], heights[best], counts[best] = (middles[best] * n + y) / (n + 1), (heights[best] * n + high) / (n + 1), n + 1
            number.append(best)
        return number, middles

    def run(batches):
        for batch in batches:
            doc, flat = _flat(batch.column(1))
            if not len(flat):
                continue
            page, cy, cx, word_id, h = (_numbers(flat, c) for c in ("page", "cy", "cx", "word_id", "h"))
            order = _ordered(flat, doc, page, cy, cx, word_id, h)
            doc, page, cy, cx, h = (x[order] for x in (doc, page, cy, cx, h))
            number, middles = (np.array(x) for x in fold(*(x.tolist() for x in (doc, page, cy, h))))
            middle = middles[number]
            place = np.lexsort((cx, number, middle, page, doc))
            starts = _starts(doc[place], number[place])
            owner = doc[place][starts]
            first = _starts(owner)
            k = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts)))) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(k, pa.int64()), _joined(flat.field("text").take(pa.array(order[place])), starts)], names=["doc_id", "line_number", "text"])

    return _gathered(words, placed).mapInArrow(run, "doc_id long, line_number long, text string")


def group_words(words: DataFrame, tolerance: int = 4) -> DataFrame:
    """(doc_id, line_number, text, x0, y0, x1, y1): a word joins the line if its top is within `tolerance` of that of the line's first word.

    The anchor is the first word, not the neighbour, so this is a fold over the sorted words of a page; it
    jumps from anchor to anchor by binary search. Lines leave whole: their words are not dealt out again.
    """
    kinds = {f.name: f.dataType for f in words.schema.fields}
    sides = ["x0", "y0", "x1", "y1"]
    schema = T.StructType([T.StructField("doc_id", kinds["doc_id"]), T.StructField("line_number", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, kinds[c]) for c in sides)])

    def run(batches):
        for batch in batches:
            doc, flat = _flat(batch.column(1))
            if not len(flat):
                continue
            x, word_id = _numbers(flat, "x0"), _numbers(flat, "word_id")
            page, top = (flat.field(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in ("page", "y0"))
            order = np.lexsort((top, page, doc))
            pages = _starts(doc[order], page[order])
            tops = top[order].tolist()
            number = np.empty(len(flat), np.int64)
            n, before = 0, -1
            for a, b, d in zip(pages.tolist(), [*pages[1:].tolist(), len(tops)], doc[order][pages].tolist(), strict=True):
                if d != before:
                    n, before = 0, d
                while a < b:
                    n += 1
                    to = bisect_right(tops, tops[a] + tolerance, a, b)
                    number[a:to] = n
                    a = to
            line = np.empty(len(flat), np.int64)
            line[order] = number
            place = _ordered(flat, doc, line, x, word_id)
            starts = _starts(doc[place], line[place])
            ends = np.append(starts[1:], len(place))
            out = [batch.column(0).take(pa.array(doc[place][starts])), pa.array(line[place][starts]), _joined(flat.field("text").take(pa.array(place)), starts)]
            for side in sides:
                column = flat.field(side).take(pa.array(place))
                low = side in ("x0", "y0")
                least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
                values = column.cast(pa.int64()).fill_null(most if low else least).to_numpy(zero_copy_only=False)
                some = np.diff(np.concatenate([[0], np.cumsum(column.is_valid().to_numpy(zero_copy_only=False))])[np.append(starts, ends[-1])]) > 0
                side_of = (np.minimum if low else np.maximum).reduceat(values, starts)
                out.append(pa.array(np.where(some, side_of, 0), pa.int64(), mask=~some).cast(column.type))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return _gathered(words, ["page", "y0", "x0", "word_id", "text", "x1", "y1"]).mapInArrow(run, schema)


def tallest_text(words: DataFrame, excluded: str = r"(?i)^(?:receipt|total|date:?)$") -> DataFrame:
    """(doc_id, text, height): the tallest word that is not excluded, the first of equals."""
    kept = words.where(~F.col("text").rlike(excluded)).withColumn("height", F.col("y1") - F.col("y0"))
    return kept.groupBy("doc_id").agg(F.max_by("text", F.struct("height", -F.col("word_id"))).alias("text"), F.max("height").alias("height"))


def label_below(words: DataFrame, label: str = r"(?i)^(?:date|no|receipt):?$", reach: int = 150) -> DataFrame:
    """(doc_id, label_id, text, confidence): the first word below each label within `reach`, nearest first.

    A range join: labels and words meet on the document and a band of `reach` and its neighbour.
    """
    band = lambda c: F.floor(F.col(c) / reach)
    labels = words.where(F.col("text").rlike(label)).select("doc_id", "page", F.col("word_id").alias("label_id"), F.col("y1").alias("ly"), F.col("x0").alias("lx")).withColumn("band", F.explode(F.array(band("ly"), band("ly") + 1)))
    below = labels.join(words.withColumn("band", band("y0")), ["doc_id", "page", "band"]).where((F.col("y0") > F.col("ly")) & (F.col("y0") - F.col("ly") < reach) & (F.length("text") >= 3))
    w = Window.partitionBy("doc_id", "label_id").orderBy("y0", "x0", "word_id")
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("label_id"))
    first = below.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.withColumn("_i", i).select("doc_id", "label_id", "text", F.expr("CAST(0.80BD + greatest(0.05BD - 0.01BD * (_i - 1), 0.00BD) AS DECIMAL(4,2))").alias("confidence"))


def context_below(words: DataFrame, candidate: str = r"(?i)^(?:ltd|limited)$", reach: int = 100) -> DataFrame:
    """(doc_id, word_id, n, bonus): address-like words within `reach` below a candidate; bonus min(0.15 n, 0.3)."""
    band = lambda c: F.floor(F.col(c) / reach)
    found = words.where(F.col("text").rlike(candidate)).select("doc_id", "page", "word_id", F.col("y1").alias("cy"))
    near = found.withColumn("band", F.explode(F.array(band("cy"), band("cy") + 1))).join(words.where(F.col("text").rlike(ADDRESS_WORDS)).select("doc_id", "page", F.col("y0").alias("wy")).withColumn("band", band("wy")), ["doc_id", "page", "band"])
    counts = near.where((F.col("wy") > F.col("cy")) & (F.col("wy") - F.col("cy") < reach)).groupBy("doc_id", "word_id").agg(F.count(F.lit(1)).alias("n"))
    out = found.select("doc_id", "word_id").join(counts, ["doc_id", "word_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("bonus", F.expr("CAST(least(0.15BD * n, 0.30BD) AS DECIMAL(4,2))"))


def nearest_overlap_above(words: DataFrame, anchor: str = r"^(?:TOTAL|LIMITED)$") -> DataFrame:
    """(doc_id, anchor_id, text): for the topmost anchor word, the nearest word above that overlaps it in x, unless one over 50 taller stands above."""
    top = words.where(F.col("text").rlike(anchor)).groupBy("doc_id", "page").agg(F.min_by(F.struct("word_id", "x0", "x1", "y0", "y1"), F.struct("y0", "word_id")).alias("a"))
    above = words.join(top, ["doc_id", "page"]).where((F.col("y1") <= F.col("a.y0")) & (F.col("x0") < F.col("a.x1")) & (F.col("x1") > F.col("a.x0")))
    per = above.groupBy("doc_id", F.col("a.word_id").alias("anchor_id")).agg(F.max_by("text", F.struct("y1", -F.col("word_id"))).alias("text"), F.max(F.col("y1") - F.col("y0") - (F.col("a.y1") - F.col("a.y0"))).alias("taller"))
    return per.where("taller <= 50").select("doc_id", "anchor_id", "text")


def validate_domains(pages: DataFrame) -> DataFrame:
    """(page_id, domain, name, confidence): a domain's own label, confirmed by a word of the page that contains it (0.9), else kept (0.4)."""
    domain = F.regexp_extract("url", r"https?://(?:www\.)?([^/:]+)", 1)
    label = F.substring_index(domain, ".", 1)
    visible = F.regexp_replace("html", r"<[^>]*>", " ")
    words = F.filter(F.split(visible, r"[^A-Za-z0-9]+"), lambda w: F.contains(F.lower(w), F.lower(label)))
    name = F.when((F.length(label) > 0) & (F.size(words) > 0), F.try_element_at(words, F.lit(1)))
    return pages.select("page_id", domain.alias("domain"), F.coalesce(name, label).alias("name"), F.when(name.isNotNull(), F.expr("0.9BD")).otherwise(F.expr("0.4BD")).alias("confidence"))


def ocr_confidence(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, confidence): the mean of a document's words, 0.8 without any."""
    mean = words.groupBy("doc_id").agg((F.sum("confidence") / F.count("confidence")).cast("decimal(6,4)").alias("confidence"))
    return docs.select("doc_id").distinct().join(mean, "doc_id", "left").select("doc_id", F.coalesce("confidence", F.expr("CAST(0.8 AS DECIMAL(6,4))")).alias("confidence"))
